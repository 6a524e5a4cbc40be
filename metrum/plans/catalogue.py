"""The queries over the reference tables: name to function, and name to DuckDB SQL."""

from __future__ import annotations

from metrum.plans import curation_queries, draft_queries, event_queries, presentation_queries, score_queries, sequence_queries, star_queries, text_queries, validation_queries

_PARTS = (event_queries, text_queries, star_queries, sequence_queries, curation_queries, draft_queries, score_queries, presentation_queries, validation_queries)
QUERIES = {k: f for m in _PARTS for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _PARTS for k, s in m.ORACLES.items()}
