"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for credential-like spans. The value of each span is hashed, and the hashes are counted over the
whole corpus by distinct repositories and distinct owners. A value that many owners have is a copied example (sample
keys of manuals, licence fingerprints); a value that few owners have is live-looking. Tokens that no base pattern
covers become spans of kind ``live`` only if they look drawn at random (small and capital letters and digits, no long run of
small letters as in words and paths, entropy) and the corpus shows them to be live-looking.

Values that occur more than once, by owners or repositories, are counted apart: they are sent to the spans as long as they
are few, and beyond that joined from a written table, where a value of very many spans can be split. All others have one owner.

Defined results: a null text is empty; a null owner counts as the owner ''; repeated rows each give a row, but count
once as a repository; a text without spans has empty lists. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.llm.shared import BROADCAST_ROWS, bound_arrow, materialize

# Patterns, least lengths and the order of kinds.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: What a token must have, and what it must not, to look drawn at random.
DRAWN, WORDLIKE = [re.compile(x) for x in ("[0-9]", "[A-Z]", "[a-z]")], re.compile("[a-z]{9}")
MIN_ENTROPY = 3.5
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

_SCANNED = "array<struct<kind:int,start:int,end:int,value:string>>"


def entropy(value: str) -> float:
    """Bits a character, from the value's own characters."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def scan(text: str | None, min_entropy: float = MIN_ENTROPY) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of all candidates: base spans by the fixed patterns, and other tokens of 20+ characters
    that look drawn at random and touch no base span. Offsets in code points, end exclusive."""
    if not text:
        return []
    found = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    # Tokens come in order, so one pass over the base spans in order finds those that touch one.
    base, at, reach = sorted((s, e) for _, s, e, _ in found), 0, 0
    for m in TOKEN.finditer(text):
        s, e, v = m.start(), m.end(), m[0]
        while at < len(base) and base[at][0] < e:
            reach = max(reach, base[at][1])
            at += 1
        if reach <= s and all(x.search(v) for x in DRAWN) and not WORDLIKE.search(v) and entropy(v) >= min_entropy:
            found.append((3, s, e, v))
    return sorted(found, key=lambda x: (x[1], x[0]))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None, min_entropy: float = MIN_ENTROPY) -> DataFrame:
    """One row for each row of docs: row (unique number), key, owner, repository, found (list of candidates with hashed
    values), written to the shared folder. Without a repository column each distinct text is a repository of its own."""
    bound_arrow(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    repo = F.col(repository).cast("string") if repository else F.lit(None).cast("string")
    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("o"), repo.alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        spans = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        for b in batches:
            texts, repos = b.column("t").to_pylist(), b.column("r").to_pylist()
            found = [[{"kind": k, "start": s, "end": e, "value": xxhash.xxh128_hexdigest(v)} for k, s, e, v in scan(t, min_entropy)] for t in texts]
            own = [r if r is not None else (xxhash.xxh128_hexdigest(t or "") if f else "") for r, t, f in zip(repos, texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(texts)), pa.int64()), b.column("k"), b.column("o"), pa.array(own, pa.string()), pa.array(found, spans)], names=["row", "key", "owner", "repository", "found"])
            row += len(texts)

    return materialize(slim.mapInArrow(run, f"row long, key {kind}, owner string, repository string, found {_SCANNED}"), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """value, repositories, owners: exact distinct counts; partial counts run before every shuffle."""
    each = found.select(F.explode("found.value").alias("value"), "owner", "repository").distinct()
    return each.groupBy("value").agg(F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"))


def is_example(owners: Column, repositories: Column, min_owners: int, min_repositories: int) -> Column:
    """Copied widely: by many owners, or by two owners in many repositories."""
    return (owners >= min_owners) | ((owners >= 2) & (repositories >= min_repositories))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None, min_owners: int = 3, min_repositories: int = 25, min_entropy: float = MIN_ENTROPY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of docs: key and spans, a list of (start, kind, end, live, owners, repositories), by start and
    then kind. Spans of kind live are those that the ownership counts prove live-looking; base spans always stay, and
    their flag tells examples from live-looking credentials."""
    found = candidates(docs, key, text, owner, repository, min_entropy)
    counts = materialize(ownership(found).where("owners > 1 OR repositories > 1"), "owned")
    if counts.count() <= broadcast_rows:
        counts = F.broadcast(counts)
    each = found.select("row", F.explode("found").alias("s")).select("row", "s.*")
    live = ~is_example(F.col("owners"), F.col("repositories"), min_owners, min_repositories)
    once = [F.coalesce(c, F.lit(1).cast("long")).alias(c) for c in ("owners", "repositories")]
    told = each.join(counts, "value", "left").select("row", "start", "kind", "end", *once).withColumn("live", live).where((F.col("kind") < 3) | F.col("live"))
    spans = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", "owners", "repositories"))).alias("spans"))
    return found.select("row", F.col("key").alias(key)).join(spans, "row", "left").select(key, F.coalesce("spans", F.expr("array()").cast(spans.schema["spans"].dataType)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digests and verdicts of scan_secrets()."""
    of_kind = lambda k: lambda s: s["kind"] == k  # noqa: E731 - a second parameter would be the place in the list
    spans, many = F.col("spans"), lambda test: F.size(F.filter("spans", test)).cast("long")
    return scanned.select(
        key,
        *(many(of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
        many(lambda s: s["live"]).alias("n_live_looking"),
        many(lambda s: ~s["live"]).alias("n_example"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["owners"])), F.lit(0).cast("long")).alias("most_owners"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", key: str = "doc_id", text: str = "text", owner: str = "source", length: str | None = "n_chars", broadcast_rows: int = BROADCAST_ROWS, **rules) -> DataFrame:
    """docs with each live-looking span replaced by mask; copied examples stay. Columns and rows stay as they are;
    length, where it is a column, is counted anew for changed texts. Rows that share a key get the spans of the texts
    they themselves hold: the join also compares a hash of the text. The spans of the texts to change are counted, and
    sent to the texts as long as they are broadcast_rows rows or fewer; beyond that both sides are exchanged."""
    bound_arrow(docs.sparkSession)
    stamped = docs.select("*", F.xxhash64(text).alias("__m_hash"))
    slim = stamped.select(F.struct(F.col(key).alias("k"), F.col("__m_hash").alias("h")).alias("__m_key"), F.col(text).alias("__m_text"), F.col(owner).alias("__m_owner"))
    found = scan_secrets(slim, "__m_key", "__m_text", "__m_owner", broadcast_rows=broadcast_rows, **rules)
    live = found.select("__m_key", F.filter("spans", lambda s: s["live"]).alias("__m_spans")).where(F.size("__m_spans") > 0).dropDuplicates(["__m_key"])
    live = materialize(live.select(F.col("__m_key.k").alias("__m_k"), F.col("__m_key.h").alias("__m_h"), F.transform("__m_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("__m_spans")), "live")
    if live.count() <= broadcast_rows:
        live = F.broadcast(live)
    body = F.col(text)

    def cut(acc: Column, s: Column) -> Column:
        at = acc["at"]
        kept = F.concat(acc["out"], F.substring(body, at + 1, F.greatest(s["start"] - at, F.lit(0))), F.when(s["start"] >= at, F.lit(mask)).otherwise(F.lit("")))
        return F.when(s["end"] <= at, acc).otherwise(F.struct(kept.alias("out"), s["end"].alias("at")))

    clean = F.aggregate("__m_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), cut, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.lit(2**31 - 1))))
    joined = stamped.join(live, F.col(key).eqNullSafe(F.col("__m_k")) & F.col("__m_hash").eqNullSafe(F.col("__m_h")), "left")
    # The new text has a name of its own: names in a select may mean the aliases beside them.
    made = joined.withColumn("__m_new", F.when(F.col("__m_spans").isNull(), body).otherwise(clean))
    own = {text: F.col("__m_new")}
    if length in docs.columns:
        own[length] = F.when(F.col("__m_spans").isNull(), F.col(length)).otherwise(F.length("__m_new")).cast(docs.schema[length].dataType)
    return made.select(*(own.get(c, F.col(c)).alias(c) for c in docs.columns))
