"""Nearest neighbours by inner product over vantage-point trees, one a shard.

A vector x becomes (x, sqrt(M^2 - |x|^2)) with M the largest norm, a query q becomes (q, 0): Euclidean order is then
inner-product order, and the triangle inequality holds. A tree takes a vantage point, halves the rest at the median
distance, and ends in leaves. A search descends on the query's side first and visits the other side unless the triangle
inequality, relaxed by `factor`, rules it out: the other side is left if |d - median| * factor > tau, the distance of the
k-th best so far. Factor one is the exact search; larger factors leave more.

The upper levels of the tree, fitted on a bounded sample, cut all rows into cells; a cell is indexed in shards of a
bounded number of rows, with a tree each. A query first searches the cell it falls into, which gives its tau, and then
goes to those other cells that tau does not rule out. A shard's tree travels once for each SLICE_ROWS of its queries,
which stream past it, so what is exchanged grows with the queries' visits to cells and not with pairs of blocks. Shards
answer with rows better than tau alone.

Equal vectors are indexed by the k + 1 smallest ids among them: no other can be among the k nearest of any query, since
ties go to smaller ids. So a vector that a third of all rows share is no hot spot, and no result is lost.

Defined results: vectors that are null, empty, zero, of another length than the most common one, or hold null or
non-finite components take no part; so do null ids; repeated rows (equal id and vector) count once; with fewer than k
candidates all are returned; extra columns are ignored. Distances are of vectors scaled by a power of two, so that large
components don't overflow; scores are of the vectors as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from metrum.llm.shared import bound_arrow, materialize, union_all

SHARD_ROWS = 65_536
LEAST_CELLS, MOST_CELLS = 16, 1024  # powers of two; beyond MOST_CELLS * SHARD_ROWS rows a cell has more than one shard
SAMPLE_ROWS = 16_384
SLICE_ROWS = 100_000
LEAF = 256
_SLACK = 1e-9


@dataclass
class Tree:
    """rows in tree order; nodes as (from, to, median, inner child, outer child), -1 for leaves. A node's vantage point
    is the row at `from`."""

    order: np.ndarray
    nodes: list[tuple[int, int, float, int, int]]


def build(x: np.ndarray, leaf: int = LEAF, seed: int = 3) -> Tree:
    """A vantage-point tree over the rows of x (augmented vectors). Vantage points are drawn by a fixed seed."""
    rng, order, nodes = np.random.default_rng(seed), np.arange(len(x)), []

    def grow(lo: int, hi: int) -> int:
        me = len(nodes)
        nodes.append((lo, hi, 0.0, -1, -1))
        if hi - lo > leaf:
            pick = lo + int(rng.integers(hi - lo))
            order[lo], order[pick] = order[pick], order[lo]
            d = np.linalg.norm(x[order[lo + 1 : hi]] - x[order[lo]], axis=1)
            by = np.argsort(d, kind="stable")
            order[lo + 1 : hi] = order[lo + 1 : hi][by]
            mid = lo + 1 + len(by) // 2
            nodes[me] = (lo, hi, float(d[by[len(by) // 2]]), grow(lo + 1, mid), grow(mid, hi))
        return me

    if len(x):
        grow(0, len(x))
    return Tree(order, nodes)


class _Best:
    """The k nearest rows of each query so far, by squared distance, among those nearer than a limit."""

    def __init__(self, queries: int, k: int, limit: np.ndarray):
        self.k = k
        self.far = np.repeat(limit[:, None], k, axis=1)
        self.row = np.full((queries, k), -1, np.int64)

    def offer(self, q: np.ndarray, rows: np.ndarray, far: np.ndarray) -> None:
        both, ids = np.concatenate([self.far[q], far], axis=1), np.concatenate([self.row[q], np.broadcast_to(rows, far.shape)], axis=1)
        pick = np.argpartition(both, self.k - 1, axis=1)[:, : self.k]
        self.far[q], self.row[q] = np.take_along_axis(both, pick, 1), np.take_along_axis(ids, pick, 1)

    def tau(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(self.far[q].max(axis=1))


def search(tree: Tree, x: np.ndarray, queries: np.ndarray, k: int, factor: float, limit: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Rows of x nearest to each query (-1 where there are fewer), unordered, and how many distances were computed. limit:
    squared distances beyond which rows are not wanted."""
    best, work = _Best(len(queries), k, np.full(len(queries), np.inf) if limit is None else limit), 0
    y = x[tree.order]
    norms, q_norms = (y * y).sum(axis=1), (queries * queries).sum(axis=1)

    def scan(q: np.ndarray, lo: int, hi: int) -> None:
        nonlocal work
        work += len(q) * (hi - lo)
        far = np.maximum(q_norms[q, None] + norms[None, lo:hi] - 2 * queries[q] @ y[lo:hi].T, 0)
        best.offer(q, tree.order[lo:hi], far)

    def visit(node: int, q: np.ndarray) -> None:
        lo, hi, median, inner, outer = tree.nodes[node]
        if not len(q):
            return
        if inner < 0:
            scan(q, lo, hi)
            return
        scan(q, lo, lo + 1)
        d = np.linalg.norm(queries[q] - y[lo], axis=1)
        near = d < median
        visit(inner, q[near])
        visit(outer, q[~near])
        cross = np.abs(d - median) * factor <= best.tau(q) * (1 + 1e-12)
        visit(outer, q[near & cross])
        visit(inner, q[~near & cross])

    if tree.nodes:
        visit(0, np.arange(len(queries)))
    return best.row, work


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (array of doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    good = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    return good.withColumn("n", F.size("v"))


@dataclass
class Top:
    """The upper levels of a tree: a vantage point and a median distance for each node; the children of node i are 2i + 1
    (nearer than the median) and 2i + 2, and the last level's are the cells."""

    points: np.ndarray
    medians: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.medians) + 1

    def cell(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.cells.bit_length() - 1):
            at = 2 * at + 1 + (np.linalg.norm(x - self.points[at], axis=1) >= self.medians[at])
        return at - len(self.medians)

    def reach(self, x: np.ndarray, tau: np.ndarray, factor: float) -> np.ndarray:
        """By query and cell, whether the relaxed triangle inequality leaves the cell to be visited."""
        n = len(self.medians)
        on = np.zeros((len(x), 2 * n + 1), bool)
        on[:, 0] = True
        for i in range(n):
            off = np.linalg.norm(x - self.points[i], axis=1) - self.medians[i]
            on[:, 2 * i + 1] = on[:, i] & (off * factor <= tau)
            on[:, 2 * i + 2] = on[:, i] & (-off * factor <= tau)
        return on[:, n:]


def plan_cells(x: np.ndarray, cells: int, seed: int = 5) -> Top:
    """The upper levels over a sample, for `cells` cells (a power of two)."""
    rng, n = np.random.default_rng(seed), cells - 1
    top = Top(np.zeros((n, x.shape[1])), np.full(n, np.inf))
    rows = {0: np.arange(len(x))}
    for i in range(n):
        own = rows.pop(i, np.empty(0, np.int64))
        if len(own):
            top.points[i] = x[own[int(rng.integers(len(own)))]]
            d = np.linalg.norm(x[own] - top.points[i], axis=1)
            top.medians[i] = np.median(d)
            rows[2 * i + 1], rows[2 * i + 2] = own[d < top.medians[i]], own[d >= top.medians[i]]
    return top


def dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component to the last."""
    total = x[..., 0] * q[..., 0]
    for j in range(1, x.shape[-1]):
        total = total + x[..., j] * q[..., j]
    return total


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of queries its k nearest rows of vectors but itself (by id),
    by inner product in double precision, ties to smaller ids."""
    spark = vectors.sparkSession
    bound_arrow(spark)
    rows = usable(vectors, key, vector)
    length = rows.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.col("n") == length["n"]).select("id", "v").dropDuplicates(["id", "v"])
    # Of equal vectors the k + 1 smallest ids; tasks keep as many before the exchange.
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1).select("id", "v")
    few = materialize(few, "vectors")
    asked = usable(queries, key, vector).where(F.col("n") == length["n"]).select("id", "v").dropDuplicates(["id", "v"])
    most, many = few.agg(F.max(F.array_max(F.transform("v", F.abs))), F.count("*")).first()
    scale = 2.0 ** -math.frexp(most)[1]
    norm2 = few.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * scale * x * scale))).first()[0]
    kind = "<f4" if isinstance(vectors.schema[vector].dataType.elementType, FloatType) else "<f8"
    width, cells = length["n"], LEAST_CELLS
    while cells < MOST_CELLS and cells * SHARD_ROWS < many:
        cells *= 2

    def lifted(x: np.ndarray) -> np.ndarray:
        y = x * scale
        return np.column_stack([y, np.sqrt(np.maximum(norm2 - (y * y).sum(axis=1), 0))])

    def asking(q: np.ndarray) -> np.ndarray:
        return np.column_stack([q * scale, np.zeros(len(q))])

    def squared(q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The squared distance at which a query's k-th score lies, with some slack; infinite for none."""
        size = ((q * scale) ** 2).sum(axis=1) + norm2
        return np.where(np.isfinite(score), np.maximum(size - 2 * score * scale * scale, 0) + _SLACK * size, np.inf)

    sample = few.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").collect()
    top = plan_cells(lifted(np.array([r["v"] for r in sample], np.float64)), cells)

    def read(column: pa.Array) -> np.ndarray:
        """The matrix that a column of lists or of packed vectors holds."""
        if pa.types.is_list(column.type):
            return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).astype(np.float64)

    def packed(x: np.ndarray) -> pa.Array:
        return pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())

    def place(lift) -> object:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = read(b.column("v"))
                    yield pa.RecordBatch.from_arrays([pa.array(top.cell(lift(x)), pa.int32()), b.column("id"), packed(x)], names=["cell", "id", "v"])

        return run

    placed = materialize(few.mapInArrow(place(lifted), "cell int, id long, v binary"), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("parts"))
    parts = {r["cell"]: r["parts"] for r in sizes.collect()}  # MOST_CELLS rows at most
    parts_of = F.element_at(F.create_map(*(F.lit(x) for kv in parts.items() for x in kv)), F.col("cell"))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.frombuffer(b"".join(pdf["v"]), kind).reshape(-1, width), pdf["id"].to_numpy(np.int64)
        tree = build(lifted(x.astype(np.float64)))
        nodes = np.array(tree.nodes, np.float64)
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "part": pdf["part"].iloc[:1], "ids": [ids[tree.order].tobytes()], "x": [x[tree.order].tobytes()], "nodes": [nodes.tobytes()]})

    cut = placed.withColumn("part", F.pmod(F.xxhash64("id"), parts_of).cast("int"))
    trees = materialize(cut.groupBy("cell", "part").applyInPandas(plant, "cell int, part int, ids binary, x binary, nodes binary"), "trees")
    searching = materialize(asked.mapInArrow(place(asking), "cell int, id long, v binary"), "queries")

    def search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's row comes before those of its queries."""
        shard, tree, ids, x, ax = None, None, None, None, None
        for b in batches:
            own = np.array([b.column(c).to_numpy() for c in ("cell", "part", "slice")]).T
            starts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in zip(starts, starts[1:], strict=False):
                if tuple(own[lo]) != shard:
                    shard = tuple(own[lo])
                    ids, flat, nodes = (b.column(c)[lo].as_py() for c in ("ids", "x", "nodes"))
                    ids, x = np.frombuffer(ids, np.int64), np.frombuffer(flat, kind).reshape(-1, width).astype(np.float64)
                    tree = Tree(np.arange(len(ids)), [(int(f), int(t), m, int(i), int(o)) for f, t, m, i, o in np.frombuffer(nodes).reshape(-1, 5)])
                    ax, lo = lifted(x), lo + 1
                if lo < hi:
                    part = b.slice(lo, hi - lo)
                    q, q_ids, kth = read(part.column("v")), part.column("id").to_numpy(), part.column("kth").to_numpy()
                    found = _with_ties(tree, x, ax, q, asking(q), ids, q_ids, k, factor, squared(q, kth))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    def hits(visits: DataFrame, tag: str) -> DataFrame:
        """visits: (cell, id, v, kth). Each shard's queries in slices, each after a copy of the shard."""
        visits = materialize(visits, tag)
        loads = visits.groupBy("cell").agg(F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("slices"))
        slices = {r["cell"]: r["slices"] for r in loads.collect()}
        slices_of = F.element_at(F.create_map(*(F.lit(x) for kv in slices.items() for x in kv)), F.col("cell")) if slices else F.lit(None).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        nothing = F.lit(None).cast("binary")
        index = trees.where(slices_of.isNotNull()).select("cell", "part", every(slices_of).alias("slice"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("kth"), nothing.alias("v"), "ids", "x", "nodes")
        asks = visits.where(parts_of.isNotNull()).select("cell", every(parts_of).alias("part"), F.pmod(F.xxhash64("id"), slices_of).cast("int").alias("slice"), F.lit(1).alias("kind"), "id", "kth", "v", nothing.alias("ids"), nothing.alias("x"), nothing.alias("nodes"))
        work = sum(slices.get(c, 0) * n for c, n in parts.items())
        dealt = index.unionByName(asks).repartition(max(1, min(work, 10_000)), "cell", "part", "slice").sortWithinPartitions("cell", "part", "slice", "kind")
        return dealt.mapInArrow(search_shards, "query_id long, vec_id long, score double")

    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    none = float("-inf")
    first = materialize(hits(searching.withColumn("kth", F.lit(none)), "first"), "near")
    kth = first.withColumn("nth", nth).where(F.col("nth") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    told = searching.join(kth, "id", "left").select("cell", "id", "v", F.coalesce("kth", F.lit(none)).alias("kth"))

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = read(b.column("v"))
                on = top.reach(asking(q), np.sqrt(squared(q, b.column("kth").to_numpy())) * (1 + _SLACK), factor)
                on[np.arange(len(q)), b.column("cell").to_numpy()] = False
                row, cell = np.nonzero(on)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *(b.column(c).take(at) for c in ("id", "v", "kth"))], names=["cell", "id", "v", "kth"])

    rest = hits(told.mapInArrow(elsewhere, "cell int, id long, v binary, kth double"), "visits")
    ranked = union_all([first, rest]).withColumn("rank", nth)
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _with_ties(tree: Tree, x: np.ndarray, ax: np.ndarray, q: np.ndarray, aq: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, k: int, factor: float, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best in the shard, within the limit. Distances of the search are rounded, so
    it is asked for more than k, and scores are summed anew in one fixed order; if the last of them ties with the k-th,
    the query is answered by its scores against the whole shard."""
    more = min(len(ids), 2 * k + 2)
    rows, _ = search(tree, ax, aq, more, factor, limit)
    full = (rows >= 0).all(axis=1)
    n, at = np.nonzero(rows >= 0)
    row = rows[n, at]
    score = dot(x[row], q[n])
    own = ids[row] == q_ids[n]
    n, row, score = n[~own], row[~own], score[~own]
    order = np.lexsort((ids[row], -score, n))
    n, row, score = n[order], row[order], score[order]
    place = np.arange(len(n)) - np.searchsorted(n, n, "left")
    out_n, out_row, out_score = [n[place < k]], [row[place < k]], [score[place < k]]
    if more < len(ids):
        count = np.bincount(n, minlength=len(q))
        kth, last = np.full(len(q), -np.inf), np.full(len(q), -np.inf)
        kth[n[place == k - 1]] = score[place == k - 1]
        last[n[place == count[n] - 1]] = score[place == count[n] - 1]
        tied = np.flatnonzero(full & (count >= k) & (last >= kth - 1e-9 * np.maximum(1, np.abs(kth))))
        if len(tied):
            keep = ~np.isin(out_n[0], tied)
            out_n, out_row, out_score = [out_n[0][keep]], [out_row[0][keep]], [out_score[0][keep]]
            for t in tied:
                s = dot(x, q[t])
                s[ids == q_ids[t]] = -np.inf
                pick = np.lexsort((ids, -s))[:k]
                pick = pick[s[pick] > -np.inf]
                out_n.append(np.full(len(pick), t))
                out_row.append(pick)
                out_score.append(s[pick])
    n, row, score = map(np.concatenate, (out_n, out_row, out_score))
    return q_ids[n], ids[row], score
