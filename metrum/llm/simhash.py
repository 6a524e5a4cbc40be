"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint gets a vector phi(i) of radius + 1 bits. For every non-zero vector v, table v keeps the bits with
<phi(i), v> = 1 (mod 2) and masks the others. Up to `radius` differing bits give at most `radius` linear equations
<phi(i), v> = 0 in radius + 1 unknowns, so some non-zero v solves them all: in that table every differing bit is masked,
and the pair has the same kept value. No pair is missed, and 2**(radius+1) - 1 tables do.

Fingerprints are made distinct before the tables; a bucket is compared in blocks of bounded size, whose tasks emit a
spanning forest and not the pairs.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows each give a row; a
null id takes no part in the smallest id of its component (null only if all its ids are null); extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.llm.shared import BROADCAST_ROWS, bound_arrow, connected_components, materialize

SEED = 42
BLOCK = 2048


def shingles(text: str | None, words: int = 3) -> list[bytes]:
    """Runs of words of the text with A-Z lower-cased; the whole sequence if it is shorter; none if there is no word."""
    w = (text or "").encode().lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    joined = b" ".join(w)
    ends = list(accumulate(len(x) + 1 for x in w))
    return [joined[i : j - 1] for i, j in zip([0, *ends], ends[words - 1 :], strict=False)]


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits; bit i is set if over half of the shingles' hashes have it set."""
    parts = shingles(text, words)
    if not parts:
        return 0
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), "<u8", len(parts))
    many = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        many += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(many * 2 > len(parts), bitorder="little").view("<u8")[0])


def masks(radius: int = 3, bits: int = 64) -> list[int]:
    """The bits that each table keeps. phi runs through all non-zero vectors in turn, so each table keeps about half."""
    n = 2 ** (radius + 1) - 1
    phi = [i % n + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fingerprint as a signed long)."""
    bound_arrow(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: dict[str, int] = {}
            for t in (texts := b.column("t").to_pylist()):
                if t not in made:
                    made[t] = _signed(fingerprint(t, words))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([made[t] for t in texts], pa.int64())], names=["key", "fingerprint"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, fingerprint long")


def forest(prints: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Index pairs that span each component of the graph of pairs within the radius, each pair a link itself."""
    left = np.arange(len(prints))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            here, front = front, np.empty(0, np.int64)
            for i in here:
                near = np.bitwise_count(prints[left] ^ prints[i]) <= radius
                if near.any():
                    yield from zip(repeat(int(i)), left[near].tolist())
                    front, left = np.append(front, left[near]), left[~near]
                if not len(left):
                    break


def links(nodes: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between the nodes' ids (node, fingerprint: distinct) that connect all that links connect."""
    spark = nodes.sparkSession
    bound_arrow(spark)
    tables = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(_signed(m)).alias("m")) for v, m in enumerate(masks(radius))))
    keyed = nodes.select("node", "fingerprint", F.explode(tables).alias("t")).select("node", "fingerprint", F.col("t.v").alias("v"), F.col("fingerprint").bitwiseAND(F.col("t.m")).alias("kept"))
    full = materialize(keyed.groupBy("v", "kept").count().where("count > 1"), "buckets")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # A block meets itself and each other block of its bucket once: (own, j) and (i, own).
    with_blocks = keyed.join(full, ["v", "kept"]).withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).withColumn("own", own)
    met = with_blocks.select("v", "kept", "node", "fingerprint", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))).alias("b")).select("v", "kept", "b.i", "b.j", "node", "fingerprint")
    group = ["v", "kept", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[list[np.ndarray], np.ndarray, np.ndarray] | None = None

        def edges(node: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            pairs = np.array(list(forest(prints.view(np.uint64), radius)), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["u", "v"])

        for b in batches:
            cols = [b.column(c).to_numpy() for c in group]
            node, prints = b.column("node").to_numpy(), b.column("fingerprint").to_numpy()
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest[0], cols, strict=True)]
                node, prints = np.concatenate([rest[1], node]), np.concatenate([rest[2], prints])
            if not len(node):
                continue
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            starts = [0, *new.tolist()]
            for lo, hi in zip(starts, starts[1:], strict=False):
                yield edges(node[lo:hi], prints[lo:hi])
            lo = starts[-1]
            rest = [c[lo:] for c in cols], node[lo:], prints[lo:]
        if rest is not None:
            yield edges(rest[1], rest[2])

    return met.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "u long, v long")


def components(docs: DataFrame, radius: int = 3, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, fingerprint (signed long), component_id: the smallest key reachable over links
    of at most `radius` differing bits. Keys are longs."""
    prints = materialize(fingerprints(docs, words, key, text), "fingerprints")
    named = materialize(components_of(prints, radius).select("fingerprint", "component_id"), "named")
    return prints.join(named, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")


def components_of(prints: DataFrame, radius: int) -> DataFrame:
    """fingerprint, component (its smallest fingerprint, as a number), component_id (its smallest key, null if all keys
    are) for each fingerprint of prints (key, fingerprint)."""
    nodes = materialize(prints.groupBy("fingerprint").agg(F.min("key").cast("long").alias("least")), "nodes")
    found = connected_components(links(nodes.select(F.col("fingerprint").alias("node"), "fingerprint"), radius))
    of = nodes.join(found, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    smallest = materialize(of.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    return of.join(smallest, "component").select("fingerprint", "component", "component_id")


def fingerprint_hex(c: Column) -> Column:
    """16 lowercase digits of a signed long."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def keep_one(docs: DataFrame, radius: int = 3, words: int = 3, key: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with one row of each component: of its rows the one with the smallest key (null after all others), then the
    smallest fingerprint, then the smallest hashes of the text. Texts are no part of the comparison and stay in their
    tasks: what goes is named by key and hashes of the text, and sent to the rows as long as it is broadcast_rows rows or
    fewer; beyond that both sides are exchanged. Repeated rows (equal key and text) are one: of these, and only these,
    whole rows are exchanged."""
    hashes = [F.xxhash64(text).alias("__m_h"), F.xxhash64(F.lit(1), text).alias("__m_g")]
    named = docs.select(F.struct(F.col(key).cast("long").alias("k"), *(h.alias(n) for h, n in zip(hashes, "hg", strict=True))).alias("who"), F.col(text).alias("t"))
    prints = materialize(fingerprints(named, words, "who", "t"), "rows")
    parts = components_of(prints.select(F.col("key.k").alias("key"), "fingerprint"), radius)
    rows = prints.groupBy("fingerprint", "key").agg(F.count("*").alias("n")).join(parts.select("fingerprint", "component"), "fingerprint")
    rank = F.struct(F.col("key.k").isNull(), "key.k", "fingerprint", "key.h", "key.g")
    best = rows.groupBy("component").agg(F.min(rank).alias("best"))
    told = materialize(rows.join(best, "component").select(F.col("key.k").alias("__m_k"), F.col("key.h").alias("__m_h"), F.col("key.g").alias("__m_g"), (rank != F.col("best")).alias("goes"), "n"), "told")
    gone, again = told.where("goes").drop("goes", "n"), told.where("n > 1 AND NOT goes").drop("goes", "n")
    is_row = lambda d: F.col(key).cast("long").eqNullSafe(d["__m_k"]) & F.col("__m_th").eqNullSafe(d["__m_h"]) & F.col("__m_tg").eqNullSafe(d["__m_g"])
    few = lambda d: F.broadcast(d) if d.count() <= broadcast_rows else d
    stamped = docs.select("*", hashes[0].alias("__m_th"), hashes[1].alias("__m_tg"))
    kept = stamped.join(few(gone), is_row(gone), "left_anti")
    if not again.isEmpty():
        again = few(again)
        kept = kept.join(again, is_row(again), "left_anti").unionByName(kept.join(again, is_row(again), "left_semi").dropDuplicates([key, "__m_th", "__m_tg"]))
    return kept.select(*docs.columns)
