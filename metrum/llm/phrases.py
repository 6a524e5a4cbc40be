"""Lempel-Ziv phrase fingerprints.

A document's UTF-8 bytes are parsed by LZ78 into dictionary phrases: each phrase is the longest one known so far and one
byte more. Two documents that share long passages share phrases, as they would compress well together. The set of
phrases is hashed, and the smallest SIZE hashes are the fingerprint; the likeness of two fingerprints is the share of
the smallest SIZE hashes of their union that both have, an estimate of the sets' Jaccard index.

The dictionary is closed under prefixes, so the longest known phrase is found by widening or narrowing a guess instead
of byte by byte; a parse can be continued from a copy, so an edited text that shares a first half with its original
shares that half's parse.

Defined results: a null text is empty; an empty text has the empty fingerprint, which is like itself (1) and unlike all
others (0); equal texts have equal fingerprints; repeated rows follow one another in the order and are fingerprinted
each; null ids come last, rows of one id in the order of a hash of their texts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrum.llm.shared import bound_arrow, literals, places

SIZE = 64
#: Ranges at most: the driver and the plan hold two numbers for each, and longer ranges only take longer, as rows stream.
MOST_RANGES = 4096
_MASK = (1 << 32) - 1


class Parse:
    """An LZ78 parse that can go on: add() takes more bytes, and the phrase in progress carries over."""

    def __init__(self, known: set[bytes] | None = None, tail: bytes = b""):
        self.known = known if known is not None else set()
        self.tail = tail

    def copy(self) -> Parse:
        return Parse(set(self.known), self.tail)

    def add(self, more: bytes) -> Parse:
        data, known, put = self.tail + more, self.known, self.known.add
        at, n, guess = 0, len(data), 4
        while at < n:
            p = data[at : at + guess]
            if p in known:
                while True:
                    guess += 1
                    p = data[at : at + guess]
                    if p not in known or at + guess > n:
                        break
            else:
                while guess > 1:
                    shorter = data[at : at + guess - 1]
                    if shorter in known:
                        break
                    guess -= 1
                    p = shorter
            if at + guess > n:
                break  # what is left is known whole: a phrase in progress
            put(p)
            at += guess
        self.tail = data[at:]
        return self

    def phrases(self) -> list[bytes]:
        """The dictionary, and the phrase in progress, which counts as a phrase of the document too."""
        return [*self.known, self.tail] if self.tail and self.tail not in self.known else list(self.known)


def sketch(phrases: list[bytes]) -> np.ndarray:
    """The smallest distinct hashes, of 32 bits, in order."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), np.uint64, len(phrases)) & np.uint64(_MASK)
    if len(h) > 4 * SIZE:
        h = np.partition(h, 2 * SIZE)[: 2 * SIZE + 1] if len(np.unique(np.partition(h, 2 * SIZE)[: 2 * SIZE + 1])) >= SIZE else h
    return np.unique(h)[:SIZE].astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of the smallest hashes of the union, the share in both; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SIZE]
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def text_of(a: np.ndarray) -> str:
    """Eight lowercase digits a hash, joined."""
    return a.astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> str:
    return text_of(sketch(Parse().add((text or "").encode()).phrases()))


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class _Row:
    """A document whose follower is still to come: its own parse, and that of the half it keeps."""

    def __init__(self, key: object, text: str):
        self.key, self.text = key, text
        self.half = len(text) // 2
        kept = text[: len(text) - self.half]
        first = Parse().add(kept.encode())
        self.shared = first.copy()
        self.sketch = sketch(first.add(text[len(kept) :].encode()).phrases())

    def against(self, other: _Row) -> tuple:
        new = self.text[: len(self.text) - self.half] + other.text[: self.half]
        after = sketch(self.shared.add(other.text[: self.half].encode()).phrases()) if new != self.text else self.sketch
        return self.key, len(self.text), hashlib.sha256(new.encode()).hexdigest(), text_of(self.sketch), text_of(after), likeness(self.sketch, after), likeness(self.sketch, other.sketch)


def compare_with_next(docs: DataFrame, rows_a_range: int = 2000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The next document is the one that follows by descending key, then by a hash of the text, then by text; after
    the last comes the first.

    Rows are dealt to ranges of that order, MOST_RANGES at most. Spark's range partitioner cuts the ranges over ids and
    hashes of the whole texts alone, and the driver gets one such pair a range: its first. Rows find their range by binary
    search, and a range's first row also goes to the range before, where it ends the chain. So texts are exchanged once.
    Only rows that share id and text share a range.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    kind = docs.schema[key].dataType.simpleString()
    # Descending ids as ascending numbers; null ids come last.
    down = F.coalesce(F.bitwise_not(F.col(key).cast("long")), F.lit((1 << 63) - 1))
    body = F.coalesce(F.col(text), F.lit(""))
    heads = first_keys(docs.select(down.alias("i"), F.xxhash64(body).alias("h")), rows_a_range)
    n = max(len(heads), 1)
    routed = docs.select(F.col(key).alias("k"), body.alias("t"), down.alias("i"), F.xxhash64(body).alias("h"))
    own = F.greatest(places(heads, [F.col("i"), F.col("h")], ["long", "long"]), F.lit(1)) - 1
    ranged = routed.withColumn("r", own)
    is_head = (F.col("i") == F.get(literals([h[0] for h in heads], "long"), F.col("r"))) & (F.col("h") == F.get(literals([h[1] for h in heads], "long"), F.col("r")))
    to = F.array_compact(F.array(F.struct(F.col("r"), F.lit(0).alias("ahead")), F.when(is_head, F.struct(F.pmod(F.col("r") - 1, F.lit(n)).alias("r"), F.lit(1).alias("ahead")))))
    sent = ranged.select("k", "t", "i", "h", F.explode(to).alias("to")).select("k", "t", "i", "h", "to.r", "to.ahead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ended = None, None, True
        for b in batches:
            out = []
            for k, t, r, ahead in zip(*(b.column(c).to_pylist() for c in ("k", "t", "r", "ahead")), strict=True):
                if r != at:
                    at, held, ended = r, None, False
                if ended:
                    continue
                row = _Row(k, t)
                if held is not None:
                    out.append(held.against(row))
                held, ended = row, bool(ahead)
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [b.schema.field("k").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(cols, types, strict=True)], names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    dealt = sent.repartition(n, "r").sortWithinPartitions("r", "ahead", "i", "h", "t")
    return dealt.mapInArrow(run, f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def first_keys(keys: DataFrame, rows_a_range: int) -> list[tuple[int, int]]:
    """The first (i, h) of each range, in order; ranges have about rows_a_range rows, or more beyond MOST_RANGES ranges."""
    wanted = min(MOST_RANGES, max(8, -(-keys.count() // rows_a_range)))
    cut = keys.repartitionByRange(wanted, "i", "h").select("i", "h", F.spark_partition_id().alias("r"))
    return sorted((x["i"], x["h"]) for (x,) in cut.groupBy("r").agg(F.min(F.struct("i", "h")).alias("x")).select("x").collect())
