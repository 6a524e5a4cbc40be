"""The audit of sources against exact fractions, and its edge cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrum.llm import divergence, queries
from tests.oracle import differences

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least, top=50):
    """rows of (text, lang, source)."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        df = Counter(t for ts, *_ in mine for t in set(ts))
        kept = sorted((t for t in df if df[t] >= least), key=str.encode)
        n = defaultdict(Counter)
        for ts, _, source in mine:
            n[source].update(t for t in ts if df[t] >= least)
        every = sum(n.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        shares, q = {s: p(n[s]) for s in n}, p(every)
        for s in shares:
            pairs = [(o, sum(abs(shares[s][t] - shares[o][t]) for t in kept)) for o in shares if o != s]
            more = [(t, shares[s][t] - q[t]) for t in kept if n[s][t] and shares[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", more, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def found(df):
    return sorted((r.lang, r.source, r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


EDGE = [
    ("A b ſs é", "en", "x"), ("a B c", "en", "y"), ("a b", "en", None), (None, "en", "empty"), ("", "en", "empty"), ("a", None, "x"), ("a a a", None, "y"), ("zz", None, None), ("only here", "de", "x"), ("日本 \U0001f600 a_b", "en", "x"), ("a", "en", "z1"), ("b", "en", "z0"), ("a b", "en", "x"), ("a b", "en", "x"),
]


@pytest.mark.parametrize(("chunk", "groups", "held"), [(4096, 64, 400_000), (2, 2, 1)])
def test_edges(spark, monkeypatch, chunk, groups, held):
    for name, value in (("CHUNK", chunk), ("GROUPS", groups), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(EDGE)], SCHEMA).selectExpr("*", "1 AS term", "2 AS n", "'x' AS chunk", "'y' AS docs", "3 AS first")
    for least in (1, 2, 3):
        assert found(divergence.audit(docs, least)) == brute(EDGE, least)
    assert found(divergence.audit(docs, 1, top=1)) == brute(EDGE, 1, 1)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_chunks_and_blocks_make_no_difference(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.text, r.lang, r.source) for r in docs.collect()], 10)
    monkeypatch.setattr(divergence, "CHUNK", 7)
    monkeypatch.setattr(divergence, "GROUPS", 3)
    assert found(divergence.audit(docs, 10)) == want


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(queries.QUERIES["op12_source_divergence"](spark, sf), queries.ORACLES["op12_source_divergence"], sf) == ""


def test_long_text_and_large_counts(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word "), 30_000), F.lit("é" * 5000)).alias("text"), F.lit("en").alias("lang"), (F.col("id") % 2).cast("string").alias("source"), F.lit(0).alias("n_chars"))
    assert found(divergence.audit(docs)) == brute([(r.text, r.lang, r.source) for r in docs.collect()], 30)
    c, d = np.array([0, 5, 10**15, 3 * 10**15]), np.int64(3 * 10**15 + 7)
    assert divergence.shares(c, d).tolist() == [1 + 10**9 * x // int(d) for x in c.tolist()]
    n = np.array([2**53 + 1, 2**61 - 1, 3])
    assert divergence._summed(np.array([2, 0, 1]), n, 4).tolist() == [2**61 - 1, 3, 2**53 + 1, 0]
