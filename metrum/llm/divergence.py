"""Source divergence audit: how the term shares of a language's sources differ, by integer-dictionary encoding.

Tasks count the terms of their texts by language and source and emit each count once. Terms in enough documents of their
language are kept and numbered in UTF-8 order, CHUNK numbers a chunk. A chunk's kept terms are one sorted array; searchsorted
gives its rows their ids, and bincount the dense vector of counts of each group (language and source). Ids have the terms'
order, so ties in a ranking go by the id. Groups are met in blocks, so a task holds two blocks of
vectors of one chunk; sums over chunks are Spark's. Nothing of the dictionary or the groups passes the driver.

Defined results: null text, language and source are empty strings, and such a language or source is one like any other;
repeated rows count each; a group without terms has its smoothed shares; a language without kept terms has pairs of value 0
and no term; extra columns are ignored. Counts may reach 9e15 in a language: shares are long divisions in 64 bits, without
rounding.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.llm.shared import BROADCAST_ROWS, bound_arrow, materialize

LEAST_DOCUMENTS, SMOOTHING, SCALE, TOP = 30, 5, 10**9, 50
#: Terms of a chunk, groups of a block, and counts that a task holds before it emits them.
CHUNK, GROUPS, HELD = 4096, 64, 400_000

#: Letters A-Z in lower case; everything that is no ASCII letter and below \x80 becomes a space.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters A-Z, lower-cased, and of characters beyond ASCII, in UTF-8."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def _counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, summed up within tasks only."""
    bound_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_) in held.items():
                if n:
                    names = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(n), np.int32))) for x in (lang, source)]
                    arrays = [*names, pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs_[t] for t in n], pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "t")), strict=True):
                n, docs_ = held.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                n.update(found)
                docs_.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from emit()
        yield from emit()

    return docs.select("lang", "source", F.col("text").alias("t")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (lang, term, ...) with id: how many of the language's terms come before. Rows are sorted in ranges and numbered
    within them; then the numbers of terms in the ranges before are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, last = TaskContext.get().partitionId(), -1, (None, None)
        for b in batches:
            if not b.num_rows:
                continue
            lang, term = b.column("lang"), b.column("term")
            other, new = np.ones(b.num_rows, bool), np.ones(b.num_rows, bool)
            other[1:] = np.asarray(pc.not_equal(lang[1:], lang[:-1]))
            new[1:] = other[1:] | np.asarray(pc.not_equal(term[1:], term[:-1]))
            other[0] = lang[0].as_py() != last[0]
            new[0] = other[0] or term[0].as_py() != last[1]
            at = np.cumsum(new) + place
            # A language's first term has place 0.
            starts = np.flatnonzero(other)
            at -= np.concatenate([[0], at[starts]])[np.cumsum(other)]
            place, last = int(at[-1]), (lang[-1].as_py(), term[-1].as_py())
            yield b.append_column("part", pa.array([part] * b.num_rows, pa.int32())).append_column("place", pa.array(at, pa.int64()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = materialize(rows.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, f"{kinds}, part int, place long"), "placed")
    sizes = placed.groupBy("lang", "part").agg((F.max("place") + 1).alias("size"))
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = materialize(sizes.select("lang", "part", F.coalesce(before, F.lit(0)).alias("before")), "before")
    before = F.broadcast(before) if before.count() <= BROADCAST_ROWS else before
    return placed.join(before, ["lang", "part"]).withColumn("id", F.col("place") + F.col("before")).drop("part", "place", "before")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / total), exactly: three decimal places of the quotient at a time."""
    whole, rest = np.divmod(counts, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return 1 + whole


def _summed(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """bincount of whole numbers below 2**62: its weights are doubles, so the halves of the numbers are summed apart."""
    low, high = (np.bincount(at, x, size).astype(np.int64) for x in (n & 0x7FFFFFFF, n >> 31))
    return (high << 31) + low


def _compared(met: DataFrame, top: int) -> DataFrame:
    """lang, source, part, item, value of each chunk and pair of blocks: distances of two groups summed over the chunk's
    terms, and each group's first terms. met has rows of kind 0 (term, n: its occurrences in the language), 1 (no, source, n:
    occurrences, all_: those of the language, v: kept terms) and 2 (no, term, n)."""
    key = ["lang", "chunk", "i", "j"]

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, i, j, lang = t.column("kind").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("lang")[0].as_py()
        words, groups, rows = (t.filter(pa.array(kind == k)) for k in range(3))
        kept = np.array([x.encode() for x in words.column("term").to_pylist()] or [], object)
        no, sources = groups.column("no").to_numpy(), np.array(groups.column("source").to_pylist(), object)
        order = np.argsort(no)
        no, sources, total = no[order], sources[order], groups.column("n").to_numpy()[order]
        v, all_ = groups.column("v")[0].as_py(), groups.column("all_")[0].as_py()
        counts = np.zeros((len(no), len(kept)), np.int64)
        if len(rows):
            ids = np.searchsorted(kept, np.array([x.encode() for x in rows.column("term").to_pylist()], object))
            at = np.searchsorted(no, rows.column("no").to_numpy()) * len(kept) + ids
            counts = _summed(at, rows.column("n").to_numpy(), counts.size).reshape(counts.shape)
        p = shares(counts + SMOOTHING, total[:, None] + SMOOTHING * v) if len(kept) else counts
        block = no // GROUPS
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        source, item, value = [], [], []
        for k in a.tolist():
            others = b[b > k]
            far = np.abs(p[others] - p[k]).sum(axis=1)
            source += [sources[k]] * len(others) + sources[others].tolist()
            item += sources[others].tolist() + [sources[k]] * len(others)
            value += far.tolist() * 2
        part = ["pair"] * len(value)
        if i == j and len(kept):
            q = shares(words.column("n").to_numpy() + SMOOTHING, np.int64(all_ + SMOOTHING * v))
            for k in range(len(no)):
                more = np.flatnonzero((counts[k] > 0) & (p[k] > q))
                f = p[k][more] - q[more]
                first = np.lexsort((more, -f))[:top]
                source += [sources[k]] * len(first)
                item += [x.decode() for x in kept[more[first]]]
                value += f[first].tolist()
                part += ["term"] * len(first)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(value), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if not len(rest):
                continue
            changed = [pc.not_equal(rest.column(c).combine_chunks()[1:], rest.column(c).combine_chunks()[:-1]) for c in key]
            starts = [0, *(np.flatnonzero(np.any([np.asarray(c) for c in changed], axis=0)) + 1).tolist()]
            for lo, hi in zip(starts, starts[1:], strict=False):
                yield from work(rest.slice(lo, hi - lo))
            rest = rest.slice(starts[-1])
        if rest is not None and len(rest):
            yield from work(rest)

    return met.repartition(*key).sortWithinPartitions(*key, "kind", "term").mapInArrow(run, "lang string, source string, part string, item string, value long")


def _others(blocks: Column, own: Column) -> Column:
    """The pairs (i, j) in which a block meets all blocks, itself included."""
    return F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j"))))


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its distance to every other source of the language (part
    pair), and the terms it has more of than the language, of which the first `top` are kept (part term)."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    of_term = Window.partitionBy("lang", "term")
    # One exchange by language and term serves the counts of groups and the sums over them.
    counted = _counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counted.withColumn("docs", F.sum("docs").over(of_term)).withColumn("all_", F.sum("n").over(of_term)).withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
    # Written before the sort, as Spark reads what it cuts into ranges twice.
    kept = materialize(kept.where(F.col("docs") >= least_documents).select("lang", "term", "source", "n", "all_", "first"), "counted")
    kept = materialize(_numbered(kept).withColumn("chunk", F.floor(F.col("id") / CHUNK)).drop("id"), "kept")
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("all_"), F.count_if("first").alias("v"))
    groups = docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "all_", "v"])
    numbered = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = materialize(numbered.withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("lang")) / GROUPS).cast("long")), "groups")
    placed = groups.select("lang", "source", "no", "blocks", F.floor(F.col("no") / GROUPS).alias("own"))
    pairs = placed.select("lang", "own", _others(F.col("blocks"), F.col("own")).alias("b")).select("lang", "own", "b.i", "b.j").distinct()
    chunks = kept.select("lang", "chunk").distinct().unionByName(groups.select("lang", F.lit(-1).cast("long").alias("chunk")).distinct())
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    words = kept.where("first").select("lang", "chunk", "term", F.col("all_").alias("n")).join(pairs.select("lang", "i", "j").distinct(), "lang")
    there = groups.withColumn("own", F.floor(F.col("no") / GROUPS)).join(pairs, ["lang", "own"]).join(chunks, "lang")
    counts = kept.select("lang", "chunk", "source", "term", "n").join(placed, ["lang", "source"]).join(pairs, ["lang", "own"])
    keyed = ["lang", "chunk", "i", "j"]
    met = (
        words.select(*keyed, F.lit(0).alias("kind"), none("long", "no"), none("string", "source"), "term", "n", none("long", "all_"), none("long", "v"))
        .unionByName(there.select(*keyed, F.lit(1).alias("kind"), "no", "source", none("string", "term"), "n", "all_", "v"))
        .unionByName(counts.select(*keyed, F.lit(2).alias("kind"), "no", none("string", "source"), "term", "n", none("long", "all_"), none("long", "v")))
    )
    found = materialize(_compared(met, top), "compared")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    firsts = found.where("part = 'term'").select("*", rank).where(F.col("rank") <= top)
    return sums.select("*", rank).unionByName(firsts).select("lang", "source", "part", "item", "value", "rank")
