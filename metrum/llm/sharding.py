"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a composite key (hash of the text, id, number of the row), so equal texts lie together and no two
rows share a key. Splitters are found before any row moves: each round counts the exact bytes below candidate boundaries
over all partitions, in one aggregation, and narrows each splitter's interval to the probe gap that holds its target,
until the bytes left in the interval meet the tolerance or one row is left there. Only the counts of the probes reach
the driver. The rows are then exchanged once, to ranges of (shard, composite key), so that no key, however often it occurs,
makes a task larger; a row's slot is its place in the range plus the counts of the shard's ranges before.

Defined results: a null text has no bytes, so size 1; a null id sorts before all others; repeated rows lie together,
in the order of their numbers, and are parted where a boundary falls among them; with fewer rows than shards some shards are empty; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.llm.shared import BROADCAST_ROWS, materialize, places

SHARDS = 8
PROBES = 64
RANGE_ROWS, LEAST_RANGES = 500_000, 32
_LOW = -(1 << 63)


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, major, minor, tie): bytes and one more, and the composite key: 60 bits of the text's
    MD5, the id, and a number of the row that parts repeated rows; it is fixed once this table is written."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).cast("long").alias("id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.conv(F.substring(F.md5(F.encode(body, "UTF-8")), 1, 15), 16, 10).cast("long").alias("major"),
        F.coalesce(F.col(key).cast("long"), F.lit(_LOW)).alias("minor"),
        F.monotonically_increasing_id().alias("tie"),
    )


KEY, KINDS = ["major", "minor", "tie"], ["long"] * 3


@dataclass(frozen=True)
class _Line:
    """Composite keys as points of one line of whole numbers, in their order: no gaps but those between hashes."""

    least: int
    ids: int
    ties: int

    def key(self, at: int) -> tuple[int, int, int]:
        rest, tie = divmod(at, self.ties)
        major, minor = divmod(rest, self.ids)
        return major, minor + self.least, tie

    @property
    def end(self) -> int:
        return (1 << 60) * self.ids * self.ties


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: int = 0, probes: int = PROBES) -> list[tuple[int, int, int]]:
    """shards - 1 keys; a row goes to the shard numbered by the splitters at or below its key. Splitter i parts the rows
    where the bytes before first reach i / shards of all: exactly for tolerance 0, else within so many bytes."""
    total, least, most, ties = rows.agg(F.sum("size"), F.min("minor"), F.max("minor"), F.max("tie")).first()
    if not total:
        return [(1 << 60, 0, 0)] * (shards - 1)
    line = _Line(least, most - least + 1, ties + 1)
    goal = [-(-i * total // shards) for i in range(1, shards)]  # bytes at or above which a key is past splitter i
    # Fewer than `goal` bytes lie below lo, `goal` or more below hi. With one row between them, hi parts the rows.
    lo, hi = [0] * (shards - 1), [line.end] * (shards - 1)
    under, over = [(0, 0)] * (shards - 1), [(total, 2)] * (shards - 1)
    while True:
        open_ = [i for i in range(shards - 1) if over[i][0] - under[i][0] > tolerance and over[i][1] - under[i][1] > 1 and hi[i] - lo[i] > 1]
        if not open_:
            return [line.key(h) for h in hi]
        bounds = sorted({lo[i] + (hi[i] - lo[i]) * k // (probes + 1) for i in open_ for k in range(1, probes + 1)} - {0})
        at = places([line.key(p) for p in bounds], [F.col(c) for c in KEY], KINDS)
        sums = {r["at"]: (r["bytes"], r["rows"]) for r in rows.groupBy(at.alias("at")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
        before = list(accumulate((sums.get(k, (0, 0)) for k in range(len(bounds) + 1)), lambda x, y: (x[0] + y[0], x[1] + y[1])))
        for i, g in enumerate(goal):
            if i in open_ and over[i][0] == total:
                over[i] = before[-1]
            for p, seen in zip(bounds, before, strict=False):
                if seen[0] < g and p > lo[i]:
                    lo[i], under[i] = p, seen
                elif seen[0] >= g and p < hi[i]:
                    hi[i], over[i] = p, seen


def assign(docs: DataFrame, shards: int = SHARDS, tolerance: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, shard, slot. Slots number a shard's rows from 0 without gaps, in the
    order of the composite key."""
    rows = materialize(sized(docs, key, text), "sized")
    ranges = max(LEAST_RANGES, -(-rows.count() // RANGE_ROWS))
    placed = rows.withColumn("shard", places(splitters(rows, shards, tolerance), [F.col(c) for c in KEY], KINDS))
    by = ["shard", *KEY]
    # The identifier has the range in its upper bits and the row's place there in the lower 33.
    number = F.monotonically_increasing_id()
    sorted_ = placed.repartitionByRange(ranges, *by).sortWithinPartitions(*by).select("id", "size", "text_crc32", "shard", F.shiftright(number, 33).alias("range"), number.alias("number"))
    sorted_ = materialize(sorted_, "sorted")
    counts = sorted_.groupBy("shard", "range").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each range, and one more for each shard that begins within one.
    offsets = materialize(counts.select("shard", "range", "first", before.alias("before")), "offsets")
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets
    return sorted_.join(offsets, ["shard", "range"]).select(F.col("id").alias(key), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("number") - F.col("first")).cast("long").alias("slot"))
