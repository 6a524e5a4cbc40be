"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, and connected
components by alternating large-star and small-star.

A text's set is that of its distinct shingles of five words, A-Z lower-cased. 160 functions a * x + b (mod 2**32, a odd) of
the shingles' hashes have a minimum each, of which one byte is kept; two sets of similarity s agree in a byte with
chance s + (1 - s) / 256. 32 bands of five bytes are buckets: a pair of similarity 0.85 has no bucket in common with
chance (1 - 0.85**5)**32 < 1e-8. Pairs of a bucket are candidates if as many bytes agree as a link has but for one case in
a billion, and every link is confirmed on the full sets of shingles, as bytes, so no hash decides it.

Equal word sequences are one node. Buckets are compared in blocks of bounded size. First each block ties its nodes to the
node that agrees most with all others, a star and not all pairs, and these links are confirmed. Then, where a bucket still
has candidates in different components, the nodes that have such a candidate are compared in full inside their blocks, until
none are left. So the components are those of all links, though only a few links of a large group are ever made.

Defined results: null and empty texts, and texts without words, have no shingles and are linked with nothing; repeated rows
each give a row; a null id takes no part in the smallest id of its component (null only if all its ids are null, and then
kept); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from itertools import accumulate, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrum.llm.shared import BROADCAST_ROWS, bound_arrow, materialize, union_all

WORDS = 5
PERCENT = 85
BANDS, ROWS = 32, 5
MISSED = 1e-9
#: Nodes of a block of signatures; shingles of a block of sets; links that are confirmed with one copy of their centre;
#: neighbours beyond which a node's smallest one is broadcast.
BLOCK, BLOCK_SHINGLES, LEAVES, HEAVY = 2048, 500_000, 256, 100_000


def shingles(text: str | None, words: int = WORDS) -> tuple[bytes, list[bytes]]:
    """The words, joined by spaces, and their runs; all words if they are fewer; no run if there is no word."""
    w = (text or "").encode().lower().split()
    joined = b" ".join(w)
    if len(w) <= words:
        return joined, [joined] if w else []
    ends = list(accumulate(len(x) + 1 for x in w))
    return joined, [joined[i : j - 1] for i, j in zip([0, *ends], ends[words - 1 :], strict=False)]


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
    return drawn[0] | np.uint32(1), drawn[1]


def signature(parts: set[bytes]) -> np.ndarray:
    """The lowest byte of each function's minimum; as a is odd, two shingles share it with chance 1 / 256."""
    a, b = _functions()
    x = np.fromiter(map(xxhash.xxh32_intdigest, parts, repeat(1)), np.uint32, len(parts))
    least, room = np.full(len(a), np.iinfo(np.uint32).max), np.empty((len(a), 512), np.uint32)
    for i in range(0, len(x), 512):
        some = x[i : i + 512]
        h = np.multiply(a, some, out=room[:, : len(some)])
        h += b
        np.minimum(least, h.min(axis=1), out=least)
    return least.astype(np.uint8)


def buckets(sig: np.ndarray) -> np.ndarray:
    """The band's number and its bytes, as one number for each band."""
    rows = sig.reshape(BANDS, ROWS).astype(np.int64)
    key = np.arange(BANDS, dtype=np.int64)
    for r in range(ROWS):
        key = key << 8 | rows[:, r]
    return key


def least_agreeing(percent: int = PERCENT, missed: float = MISSED) -> int:
    """The number of bytes that a pair of this similarity agrees in, but for a chance below `missed`."""
    n, s, below = BANDS * ROWS, percent / 100, 0.0
    for k in range(n + 1):
        below += comb(n, k) * s**k * (1 - s) ** (n - k)
        if below >= missed:
            return k
    return n


def sets(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n, digest of the words, h and g: hashes that tell the text, sig, buckets); without words n is 0 and the
    rest but the text's hashes null."""
    bound_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: dict[str, tuple] = {}
            for t in (texts := b.column("t").to_pylist()):
                if t not in made:
                    joined, parts = shingles(t, words)
                    if parts:
                        distinct = set(parts)
                        sig = signature(distinct)
                        made[t] = len(distinct), blake2b(joined, digest_size=16).digest(), sig.tobytes(), buckets(sig)
                    else:
                        made[t] = 0, None, None, None
            n, digest, sig, at = zip(*(made[t] for t in texts), strict=True) if texts else ((),) * 4
            arrays = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(at, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("h"), b.column("g"), *arrays], names=["key", "h", "g", "n", "digest", "sig", "buckets"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "key long, h long, g long, n long, digest binary, sig binary, buckets array<long>")


def nodes_of(found: DataFrame) -> DataFrame:
    """One row for each digest of sets(): node (a number), digest, least key, n, sig, buckets, and h and g of one text."""
    first = [F.first(c).alias(c) for c in ("n", "sig", "buckets")]
    one = found.where("n > 0").groupBy("digest").agg(F.min("key").alias("least"), F.min(F.struct("h", "g")).alias("text"), *first)
    return materialize(one.select(F.monotonically_increasing_id().alias("node"), "digest", "least", "n", "sig", "buckets", "text.h", "text.g"), "nodes")


def _blocks(keyed: DataFrame, full: DataFrame) -> DataFrame:
    """Rows of keyed (bucket, node, ...) in the buckets of full (bucket, blocks), once for each pair (i, j) of blocks that
    meet, a block with itself included."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    placed = keyed.join(full, "bucket").withColumn("own", own).withColumn("b", met)
    return placed.select("bucket", "b.i", "b.j", *(c for c in keyed.columns if c != "bucket"))


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[dict[str, np.ndarray | list]]:
    """The columns of consecutive rows that have the same values of the integer columns `by`: signatures as rows of bytes,
    texts as a list."""

    def opened(b: pa.RecordBatch) -> dict:
        out = {}
        for name, column in zip(b.schema.names, b.columns, strict=True):
            out[name] = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) if name == "sig" else column.to_pylist() if name == "t" else column.to_numpy()
        return out

    rest: dict | None = None
    for b in batches:
        if not b.num_rows:
            continue
        now = opened(b)
        if rest is not None:
            now = {k: rest[k] + v if k == "t" else np.concatenate([rest[k], v]) for k, v in now.items()}
        starts = [0, *(np.flatnonzero(np.any([now[c][1:] != now[c][:-1] for c in by], axis=0)) + 1).tolist()]
        for lo, hi in zip(starts, starts[1:], strict=False):
            yield {k: v[lo:hi] for k, v in now.items()}
        rest = {k: v[starts[-1] :] for k, v in now.items()}
    if rest is not None:
        yield rest


def _near(sig: np.ndarray, n: np.ndarray, i: int, among: np.ndarray, agreeing: int, percent: int) -> np.ndarray:
    """Which of the nodes `among` may be linked with node i, by sizes and signatures."""
    fits = 100 * np.minimum(n[among], n[i]) >= percent * np.maximum(n[among], n[i])
    return fits & (np.count_nonzero(sig[among] == sig[i], axis=1) >= agreeing)


def _meet_first(sig: np.ndarray, i: int, among: np.ndarray, band: int) -> np.ndarray:
    """Which of the nodes `among` have no bucket in common with node i before this band's, so that a pair is met once."""
    if not band:
        return np.ones(len(among), bool)
    width = band * ROWS
    return ~(sig[among, :width] == sig[i, :width]).reshape(len(among), band, ROWS).all(axis=2).any(axis=1)


def _central(sig: np.ndarray, left: np.ndarray) -> int:
    """The node of `left` whose bytes most others have, too; the first on a tie."""
    if len(left) <= 2:
        return int(left[0])
    coded = sig[left].astype(np.int64) + 256 * np.arange(sig.shape[1])
    return int(left[np.argmax(np.bincount(coded.ravel(), minlength=256 * sig.shape[1])[coded].sum(axis=1))])


def stars(sig: np.ndarray, n: np.ndarray, agreeing: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Candidates (centre, other): centres in turn take the nodes near them that are left."""
    left, out = np.arange(len(sig)), []
    while len(left) > 1:
        centre = _central(sig, left)
        left = left[left != centre]
        near = _near(sig, n, centre, left, agreeing, percent)
        out += zip(repeat(centre), left[near].tolist())
        left = left[~near]
    return out


_GROUP = ["bucket", "i", "j"]


def _batches(found: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns of longs, as batches of a fair size."""
    held, rows = [], 0
    for columns in found:
        held.append(columns)
        rows += len(columns[0])
        if rows > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held, strict=True)], names=names)
            held, rows = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held, strict=True)], names=names)


def _first_candidates(nodes: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Candidates (u: centre, v), for each v the centre that most blocks give it."""
    agreeing = least_agreeing(percent)
    keyed = nodes.select("node", F.explode("buckets").alias("bucket"))
    met = _blocks(keyed, full).join(nodes.select("node", "n", "sig"), "node")

    def found_in(g: dict) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(g["node"])
        node = g["node"][order]
        pairs = np.array(stars(g["sig"][order], g["n"][order], agreeing, percent), np.int64).reshape(-1, 2)
        return node[pairs[:, 0]], node[pairs[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(map(found_in, _groups(batches, _GROUP)), ["u", "v"])

    found = met.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, "u long, v long")
    votes = found.groupBy("u", "v").agg(F.count("*").alias("votes"))
    best = votes.groupBy("v").agg(F.max(F.struct("votes", -F.col("u"))).alias("best"))
    return best.select((-F.col("best.col2")).alias("u"), "v")


def _texts(docs: DataFrame, wanted: DataFrame, text: str, broadcast_rows: int) -> DataFrame:
    """node, t for wanted (node, h, g), one row a node however often its text occurs."""
    rows = docs.select(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"), F.col(text).alias("t"))
    if wanted.count() <= broadcast_rows:
        return rows.join(F.broadcast(wanted), ["h", "g"]).groupBy("node").agg(F.first("t").alias("t"))
    return rows.groupBy("h", "g").agg(F.first("t").alias("t")).join(wanted, ["h", "g"]).select("node", "t")


def is_link(a: set[bytes], b: set[bytes], percent: int = PERCENT) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, percent: int, text: str, broadcast_rows: int) -> DataFrame:
    """Those of the pairs (u, v) that are links. A centre travels once for LEAVES of its pairs."""
    chunks = pairs.groupBy("u").agg(F.ceil(F.count("*") / LEAVES).cast("int").alias("chunks"))
    leaves = materialize(pairs.join(chunks, "u").select("u", F.pmod(F.xxhash64("v"), "chunks").cast("int").alias("chunk"), F.lit(1).alias("role"), F.col("v").alias("node")), "leaves")
    jobs = leaves.unionByName(leaves.select("u", "chunk").distinct().select("u", "chunk", F.lit(0).alias("role"), F.col("u").alias("node")))
    wanted = materialize(nodes.select("node", "h", "g").join(jobs.select("node").distinct(), "node", "left_semi"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre: set[bytes] = set()
        for b in batches:
            u, v = [], []
            for at, role, node, t in zip(*(b.column(c).to_pylist() for c in ("u", "role", "node", "t")), strict=True):
                has = set(shingles(t, words)[1])
                if role == 0:
                    centre = has
                elif is_link(centre, has, percent):
                    u.append(at)
                    v.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    by = ["u", "chunk"]
    return jobs.join(_texts(docs, wanted, text, broadcast_rows), "node").repartition(*by).sortWithinPartitions(*by, "role").mapInArrow(run, "u long, v long")


def _unsettled(nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """bucket, node, n, label of the nodes that have a candidate of another component in a bucket."""
    agreeing = least_agreeing(percent)
    told = materialize(nodes.join(labels, "node", "left").select("node", "n", F.coalesce("component", "node").alias("label")), "told")
    keyed = nodes.select("node", F.explode("buckets").alias("bucket")).join(told, "node")
    mixed = keyed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("lo < hi")
    met = _blocks(keyed, materialize(mixed.select("bucket", "blocks"), "mixed")).join(nodes.select("node", "sig"), "node")

    def open_in(g: dict) -> tuple[np.ndarray, ...]:
        sig, n, label, band = g["sig"], g["n"], g["label"], int(g["bucket"][0]) >> 8 * ROWS
        takes_part = np.zeros(len(n), bool)
        for i in range(len(n) - 1):
            among = np.arange(i + 1, len(n))[label[i + 1 :] != label[i]]
            if len(among):
                among = among[_near(sig, n, i, among, agreeing, percent)]
                among = among[_meet_first(sig, i, among, band)]
                takes_part[among] = True
                takes_part[i] |= len(among) > 0
        return tuple(g[c][takes_part] for c in ("bucket", "node", "n", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(map(open_in, _groups(batches, _GROUP)), ["bucket", "node", "n", "label"])

    return met.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, "bucket long, node long, n long, label long").distinct()


def _links_inside(docs: DataFrame, nodes: DataFrame, open_: DataFrame, words: int, percent: int, text: str, broadcast_rows: int) -> DataFrame:
    """Links (u, v) that connect what all links between the nodes of a bucket of open_ connect, found on full sets."""
    agreeing = least_agreeing(percent)
    wanted = materialize(nodes.select("node", "h", "g").join(open_.select("node").distinct(), "node", "left_semi"), "wanted")
    full = open_.groupBy("bucket").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    met = _blocks(open_, materialize(full, "full")).join(nodes.select("node", "sig"), "node").join(_texts(docs, wanted, text, broadcast_rows), "node")

    def linked_in(g: dict) -> tuple[np.ndarray, np.ndarray]:
        node, sig, n, label, band = g["node"], g["sig"], g["n"], g["label"].copy(), int(g["bucket"][0]) >> 8 * ROWS
        has = [set(shingles(t, words)[1]) for t in g["t"]]
        pairs = []
        left = np.arange(len(node))
        while len(left) > 1:
            i = _central(sig, left)
            left = left[left != i]
            near = left[_near(sig, n, i, left, agreeing, percent)]
            for k in near[_meet_first(sig, i, near, band)].tolist():
                if label[k] != label[i] and is_link(has[i], has[k], percent):
                    pairs.append((node[i], node[k]))
                    label[label == label[k]] = label[i]
        found = np.array(pairs, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(map(linked_in, _groups(batches, _GROUP)), ["u", "v"])

    return met.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, "u long, v long")


def _with_least(rows: DataFrame, least: DataFrame, heavy: int) -> DataFrame:
    """rows (u, v) with m of least (u, m, degree). Nodes of more than `heavy` neighbours, of which there are at most twice
    the edges over `heavy`, are broadcast if they are few, so that no task gets all their rows."""
    big = least.where(F.col("degree") > heavy).select("u", "m")
    if big.isEmpty() or big.count() > BROADCAST_ROWS:
        return rows.join(least.select("u", "m"), "u")
    big = F.broadcast(big)
    return rows.join(big, "u").unionByName(rows.join(big, "u", "left_anti").join(least.select("u", "m"), "u"))


def star_components(edges: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Rows (node, component) for every node of edges (u, v: long); component is the smallest node that is reachable.

    A large-star ties each node's larger neighbours to its smallest one, a small-star its smaller neighbours and itself; both
    keep what is connected, and they alternate until every component is a star about its smallest node. Each round's edges
    are written; counts and two sums of hashes tell whether a round changed anything."""
    seen, step = None, 0
    now = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first()
        if state == seen or state[0] == 0:
            return now.select("u", "v").union(now.select("u", "u").distinct()).select(F.col("v").alias("node"), F.col("u").alias("component"))
        seen, step = state, step + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("degree")), f"large{step}")
        # Each edge once, seen from its smaller end: its larger end goes to the smallest neighbour.
        large = materialize(_with_least(now, least, heavy).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"ties{step}")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), f"small{step}")
        ties = _with_least(large, least, heavy)
        now = materialize(ties.select(F.col("m").alias("u"), "v").where("u <> v").unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct(), f"edges{step}")


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id (the smallest key reachable over links of a similarity of
    percent / 100 or more), kept (whether it is that key). Keys are longs."""
    found = materialize(sets(docs, words, key, text), "sets")
    nodes = nodes_of(found)
    full = nodes.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().where("count > 1")
    full = materialize(full.select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "full")
    pairs = materialize(_first_candidates(nodes, full, percent), "pairs")
    links = materialize(_confirm(docs, nodes, pairs, words, percent, text, broadcast_rows), "links")
    labels = star_components(links)
    open_ = materialize(_unsettled(nodes, labels, percent), "open")
    if not open_.isEmpty():
        labels = star_components(union_all([links, _links_inside(docs, nodes, open_, words, percent, text, broadcast_rows)]))
    of = nodes.join(labels, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("component"))
    smallest = materialize(of.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    named = materialize(of.join(smallest, "component").select("digest", "component_id"), "named")
    told = found.select("key", "n", "digest").where("n > 0").join(named, "digest").select("key", "n", "component_id")
    alone = found.where("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return told.unionByName(alone).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
