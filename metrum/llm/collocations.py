"""Phrase collocations from depth-limited count tries.

A task is a shard: it numbers its words in their order and builds a trie level by level, as sorted arrays of (parent, word,
count). Tries are written serialised and sorted: for each range of heads (prefixes of the phrases) one row with the subtrees
below them, in preorder, as packed numbers. The ranges are cut so that frequent heads are dealt out evenly, and a task merges
the rows of a range from all shards: it holds the range's distinct nodes and some rows more. Walking down a merged trie gives the counts of a phrase's left parts; its right
parts come by suffix links, the node of the phrase without its first word, level by level.

Three passes: words, tries of depth 2 below heads of one word, and of depth 5 below heads of two. A phrase cannot be frequent
unless all its words and word pairs are, so a pass grows only where bitmaps of fixed size have all words, and then all pairs;
what shares a bit with a frequent one is counted in vain, never left out.

Defined results: null text is empty, null language is `und`; repeated rows count each; texts without words give nothing; extra
columns are ignored. Counts are exact; scores are quotients of whole numbers of up to 38 digits.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.llm.shared import BROADCAST_ROWS, bound_arrow, materialize, union_all

LEAST, WORDS, FIRST = 100, 5, 2000
#: Words of a shard's trie, distinct words that a task counts before it emits them, nodes that a merge holds besides those of
#: one range, bits of a bitmap and of one of its parts; words of a range, and how many ranges there are at least and at most.
SHARD, DISTINCT, NODES, BITS, PART = 1_300_000, 400_000, 1_000_000, 26, 19
RANGE_WORDS, LEAST_RANGES, MOST_RANGES = 2_000_000, 32, 65_536

_BREAK = set(b".,;:!?\n\x0b\x0c\r")
_BYTES = bytes(10 if c in _BREAK else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: heads and words: strings, a line each; own: the heads' counts; sizes: their numbers of nodes; depth, word (a place in words) and
#: count of the nodes: numbers. All are compressed.
TRIE = "lang string, range int, heads binary, words binary, own binary, sizes binary, depth binary, word binary, count binary"


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, a line feed between pieces, and empty ones where blanks adjoin."""
    return (text or "").encode().translate(_BYTES).replace(b"\n", b" \n ").split(b" ")


def numbered(parts: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes below `parts` (numbers of nodes) by `words`, in order: the number of each row's node, and the nodes' parents,
    words and first numbers of rows."""
    codes, inverse, n = np.unique(parts * size + words, return_inverse=True, return_counts=True)
    return inverse, codes // size, codes % size, n


def _slot(a: np.ndarray, b: np.ndarray, lang: str, bits: int) -> np.ndarray:
    """The bit of a pair of words, from their hashes (of one word if b is 0), in a bitmap of 2**bits."""
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - bits)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _has(bitmap: bytes, a: np.ndarray, b: np.ndarray, lang: str) -> np.ndarray:
    slot = _slot(a, b, lang, (8 * len(bitmap)).bit_length() - 1)
    return np.frombuffer(bitmap, np.uint8)[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1


class _Nodes:
    """Subtrees in preorder: for each node the place of its head in heads, depth, word and count; own: the heads' counts. Heads
    and words are arrays of strings."""

    def __init__(self, heads: pa.Array, own: np.ndarray, of: np.ndarray, depth: np.ndarray, word: pa.Array, count: np.ndarray):
        self.heads, self.own, self.of, self.depth, self.word, self.count = heads, own, of, depth, word, count


def _packed(lang: str, t: _Nodes, bounds: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of TRIE: the heads, which are sorted, by ranges; bounds: the first keys (language, head) of ranges but the first."""
    before = sum(b[0] < lang for b in bounds)
    own = np.array([b[1] for b in bounds if b[0] == lang], object)
    heads = np.array(t.heads.cast(pa.binary()).to_pylist(), object)
    place = before + (np.searchsorted(own, heads, "right") if len(own) else np.zeros(len(heads), np.int64))
    starts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(heads)]
    edges = np.searchsorted(t.of, starts)
    rows = []
    for lo, hi, a, b in zip(starts, starts[1:], edges, edges[1:], strict=False):
        if lo < hi:
            coded = t.word[int(a) : int(b)].dictionary_encode()
            sizes = np.bincount(t.of[a:b] - lo, minlength=hi - lo)
            numbers = (t.own[lo:hi].astype("<i8"), sizes.astype("<i4"), t.depth[a:b].astype("u1"), coded.indices.to_numpy().astype("<i4"), t.count[a:b].astype("<u4"))
            names = ("\n".join(x.to_pylist()).encode() for x in (t.heads[lo:hi], coded.dictionary))
            rows.append((lang, int(place[lo]), *map(_small, names), *(_small(x.tobytes()) for x in numbers)))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


_NAMES = ["lang", "range", "heads", "words", "own", "sizes", "depth", "word", "count"]
_KINDS = [pa.string(), pa.int32(), *[pa.binary()] * 7]


def _small(x: bytes) -> bytes:
    """Compressed, after its length."""
    return len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True)


def _whole(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)


def shard_trie(lang: str, x: np.ndarray, words: list[bytes], pairs: bytes | None, deepest: int) -> _Nodes | None:
    """The trie of the words' numbers x in their order (-1 between pieces and for rare words). Without pairs: heads of one word and the
    words after them; else heads of two words and up to deepest - 2 words after them, as far as the bitmap has all pairs."""
    names, size = pa.array(words, pa.binary()).cast(pa.string()), max(len(words), 1)
    at = np.flatnonzero(x >= 0)
    node, _, first, n1 = numbered(np.zeros(len(at), np.int64), x[at], size)
    # Positions at which a pair begins, as places in `at`.
    begins = np.flatnonzero((at + 1 < len(x)) & (x[np.minimum(at + 1, len(x) - 1)] >= 0))
    pair, parent, word, n2 = numbered(node[begins], x[at[begins] + 1], size)
    if pairs is None:
        return _Nodes(names.take(pa.array(first)), n1, parent, np.ones(len(word), np.int8), names.take(pa.array(word)), n2)
    h = _hashes(words)
    frequent = _has(pairs, h[first[parent]], h[word], lang)
    heads = pc.binary_join_element_wise(names.take(pa.array(first[parent])), names.take(pa.array(word)), " ")
    runs = np.zeros(len(x) + deepest, bool)
    runs[at[begins]] = frequent[pair]
    here, number = at[begins], pair
    levels, owners = [], np.arange(len(parent))
    for k in range(2, deepest):
        # The next word's pair must be frequent, too; the positions' nodes go on as those of the level below.
        on = runs[here] & runs[here + k - 1]
        here = here[on]
        number, up, word, n = numbered(number[on], x[here + k], size)
        levels.append((up, word, n))
    if not len(levels[0][0]):
        return None
    # Preorder: a node's key is the chain of numbers above it, in which the missing ones come first.
    keys, owner, depth, ids, count = [], [], [], [], []
    chain: list[np.ndarray] = []
    for d, (up, word, n) in enumerate(levels):
        chain = [c[up] for c in chain] if d else []
        owners = up if d == 0 else owners[up]
        chain.append(np.arange(len(up)))
        keys.append(np.stack(chain + [np.full(len(up), -1)] * (len(levels) - d - 1)))
        owner.append(owners)
        depth.append(np.full(len(up), d + 1, np.int8))
        ids.append(word)
        count.append(n)
    order = np.lexsort(np.concatenate(keys, axis=1)[::-1])
    owner_, depth_, ids_, count_ = (np.concatenate(c)[order] for c in (owner, depth, ids, count))
    used, place = np.unique(owner_, return_inverse=True)
    return _Nodes(heads.take(pa.array(used)), n2[used], place, depth_, names.take(pa.array(ids_)), count_)


def counted(docs: DataFrame) -> DataFrame:
    """lang, word, n of docs (lang, t)."""
    bound_arrow(docs.sparkSession)
    most = DISTINCT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                del n[b""], n[b"\n"]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), b.column("t").to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(tokens(t))
            if sum(map(len, held.values())) > most:
                yield from emit()
        yield from emit()

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def tries(docs: DataFrame, bounds: list[tuple[str, bytes]], singles: bytes, pairs: bytes | None = None, deepest: int = WORDS) -> DataFrame:
    """The shards' tries of docs (lang, t), see shard_trie, by ranges; words that the bitmap singles has not are rare."""
    bound_arrow(docs.sparkSession)
    shard = SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[bytes, int] = defaultdict()
        texts: dict[str, list[np.ndarray]] = {}
        held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            words = list(vocabulary)
            h, zero = _hashes(words), np.zeros(len(words), np.uint64)
            for lang, parts in texts.items():
                kept = np.flatnonzero(_has(singles, h, zero, lang))
                kept = sorted(kept[kept > 1].tolist(), key=words.__getitem__)
                rank = np.full(len(words), -1, np.int64)
                rank[kept] = np.arange(len(kept))
                x = np.concatenate(parts)
                trie = shard_trie(lang, rank[x[x != 0]], [words[k] for k in kept], pairs, deepest)
                if trie is not None:
                    yield from _packed(lang, trie, bounds)
            texts.clear()

        def begin() -> None:
            vocabulary.clear()
            vocabulary.default_factory = vocabulary.__len__
            vocabulary[b""], vocabulary[b"\n"] = 0, 1

        begin()
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), b.column("t").to_pylist(), strict=True):
                found = tokens(t)
                found.append(b"\n")
                texts.setdefault(lang, []).append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
                held += len(found)
                if held > shard:
                    yield from emit()
                    begin()
                    held = 0
        if held:
            yield from emit()

    return docs.mapInArrow(run, TRIE)


def _joined(parts: list[_Nodes]) -> _Nodes:
    """The parts as one, with one place for equal heads, in order; nodes are sorted by heads, those of a part together."""
    coded = pa.concat_arrays([p.heads for p in parts]).dictionary_encode()
    sorting = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(sorting), np.int64)
    rank[sorting.to_numpy()] = np.arange(len(sorting))
    place = rank[coded.indices.to_numpy()]
    own = np.zeros(len(sorting), np.int64)
    np.add.at(own, place, np.concatenate([p.own for p in parts]))
    ends = np.cumsum([len(p.heads) for p in parts])
    of = np.concatenate([place[end - len(p.heads) : end][p.of] for p, end in zip(parts, ends, strict=True)])
    order = np.argsort(of, kind="stable")
    depth, count = (np.concatenate([getattr(p, c) for p in parts])[order] for c in ("depth", "count"))
    return _Nodes(coded.dictionary.take(sorting), own, of[order], depth, pa.concat_arrays([p.word for p in parts]).take(pa.array(order)), count)


def _read(b: pa.RecordBatch, row: int) -> _Nodes:
    """A row of TRIE."""
    heads, words = (pa.array(x.split("\n") if (x := _whole(b.column(c)[row].as_py()).decode()) else [], pa.string()) for c in ("heads", "words"))
    own, sizes, depth, word, count = (np.frombuffer(_whole(b.column(c)[row].as_py()), kind) for c, kind in (("own", "<i8"), ("sizes", "<i4"), ("depth", "u1"), ("word", "<i4"), ("count", "<u4")))
    return _Nodes(heads, own, np.repeat(np.arange(len(sizes)), sizes), depth.astype(np.int8), words.take(pa.array(word)), count.astype(np.int64))


def merged(t: _Nodes) -> _Nodes:
    """Equal paths below equal heads as one node with the sum of their counts, in preorder."""
    if not len(t.of):
        return t
    coded = t.word.dictionary_encode()
    sorting = pc.sort_indices(coded.dictionary)
    vocabulary, rank = coded.dictionary.take(sorting), np.empty(len(sorting), np.int64)
    rank[sorting.to_numpy()] = np.arange(len(sorting))
    ids = rank[coded.indices.to_numpy()]
    deepest, rows = int(t.depth.max()), np.arange(len(t.of))
    number, levels, chain, above = np.zeros(len(rows), np.int64), [], [], t.of
    for d in range(1, deepest + 1):
        mine = np.flatnonzero(t.depth == d)
        # In preorder a node's parent is the last one before it that is a level higher.
        last = np.maximum.accumulate(np.where(t.depth == d - 1, rows, -1))[mine] if d > 1 else mine
        inverse, up, word, _ = numbered(number[last] if d > 1 else above[mine], ids[mine], len(vocabulary))
        count = np.zeros(len(up), np.int64)
        np.add.at(count, inverse, t.count[mine])
        number[mine] = inverse
        chain = [c[up] for c in chain] if d > 1 else []
        heads = levels[-1][0][up] if d > 1 else up
        chain.append(np.arange(len(up)))
        levels.append((heads, np.full(len(up), d, np.int8), word, count, np.stack(chain + [np.full(len(up), -1)] * (deepest - d))))
    of, depth, word, count = (np.concatenate([level[c] for level in levels]) for c in range(4))
    order = np.lexsort([*np.concatenate([level[4] for level in levels], axis=1)[::-1], of])
    return _Nodes(t.heads, t.own, of[order], depth[order], vocabulary.take(pa.array(word[order])), count[order])


def _frequent(lang: str, t: _Nodes, least: int) -> pa.RecordBatch:
    """lang, head, phrase, words (after the head), a, left (counts of the nodes above, the head's first) of the nodes that
    occur often enough."""
    out: list[tuple] = []
    path: list[tuple[str, int]] = []
    of = -1
    often = np.flatnonzero(t.count >= least)
    heads = t.heads.take(pa.array(t.of[often])).to_pylist()
    for i, head, d, word, count in zip(t.of[often].tolist(), heads, t.depth[often].tolist(), t.word.take(pa.array(often)).to_pylist(), t.count[often].tolist(), strict=True):
        if i != of:
            of, path = i, []
        del path[d - 1 :]
        path.append((word, count))
        out.append((lang, head, " ".join([head, *(w for w, _ in path)]), d, count, [int(t.own[i]), *(c for _, c in path[:-1])]))
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["lang", "head", "phrase", "words", "a", "left"])


def _kept(written: DataFrame, least: int) -> DataFrame:
    """Rows of _frequent over all shards' tries: rows of one language and range follow one another and are merged."""
    most = NODES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[_Nodes] = []
        nodes, now = 0, None
        for b in batches:
            for row, key in enumerate(zip(b.column("lang").to_pylist(), b.column("range").to_pylist(), strict=True)):
                if key != now and parts:
                    yield _frequent(now[0], merged(_joined(parts)), least)
                    parts, nodes = [], 0
                now = key
                parts.append(_read(b, row))
                nodes += len(parts[-1].of)
                if nodes > most:
                    parts, nodes = [merged(_joined(parts))], 0
        if parts:
            yield _frequent(now[0], merged(_joined(parts)), least)

    return written.repartition("range", "lang").sortWithinPartitions("range", "lang").mapInArrow(run, "lang string, head string, phrase string, words int, a long, left array<long>")


def bounds_of(phrases: DataFrame, weight: int) -> list[tuple[str, bytes]]:
    """First keys of ranges of the heads (lang, phrase, a), about `weight` occurrences each: MOST_RANGES at most. They only
    decide which rows meet in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = 0, []
        for b in batches:
            for lang, phrase, a in zip(*(b.column(c).to_pylist() for c in ("lang", "phrase", "a")), strict=True):
                if held >= weight:
                    out.append((lang, phrase))
                    held = 0
                held += a
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(2)], names=["lang", "phrase"])

    found = phrases.select("lang", "phrase", "a").repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase").mapInArrow(run, "lang string, phrase string")
    return sorted((r.lang, r.phrase.encode()) for r in found.collect())


def bitmap(phrases: DataFrame) -> bytes:
    """2**BITS bits, set for the phrases (lang, phrase) of one word or two. Its parts are made in tasks."""
    bits, part_bits = BITS, PART

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True):
                w = _hashes(phrase.encode().split(b" "))
                out.append(int(_slot(w[:1], w[1:] if len(w) > 1 else np.zeros(1, np.uint64), lang, bits)[0]))
            yield pa.RecordBatch.from_arrays([pa.array([x >> part_bits for x in out], pa.int64()), pa.array([x & (1 << part_bits) - 1 for x in out], pa.int64())], names=["part", "bit"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            part, bit = b.column("part").to_numpy(), b.column("bit").to_numpy()
            for k in np.unique(part).tolist():
                at = made.setdefault(k, np.zeros(1 << part_bits - 3, np.uint8))
                x = bit[part == k]
                np.bitwise_or.at(at, x >> 3, (1 << (x & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([x.tobytes() for x in made.values()], pa.binary())], names=["part", "bits"])

    parts = phrases.select("lang", "phrase").mapInArrow(slots, "part long, bit long").distinct().repartition("part").mapInArrow(fill, "part long, bits binary").collect()
    whole = np.zeros((1 << bits - part_bits, 1 << part_bits - 3), np.uint8)
    for r in parts:
        whole[r.part] |= np.frombuffer(r.bits, np.uint8)
    return whole.tobytes()


def mine(docs: DataFrame, least: int = LEAST, words: int = WORDS, first: int = FIRST, text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first collocations of 2 to `words` words."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col(text).alias("t"))
    every = materialize(counted(docs), "words")
    total = materialize(every.groupBy("lang").agg(F.sum("n").alias("n")), "total")
    single = every.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("a"))
    frequent = bitmap(single)
    # Ranges are as many as all words ask for, so their weight, of frequent heads, keeps within the bound.
    all_ = total.agg(F.sum("n")).first()[0] or 0
    weight = max(1, all_ // min(MOST_RANGES, max(LEAST_RANGES, all_ // RANGE_WORDS)))
    columns = ["lang", "phrase", "a", "left"]
    pairs = materialize(_kept(materialize(tries(docs, bounds_of(single, weight), frequent), "tries"), least).select(*columns), "pairs")
    of_size = {2: pairs}
    if words > 2:
        lower = materialize(_kept(materialize(tries(docs, bounds_of(pairs, weight), frequent, bitmap(pairs), words), "deep"), least), "lower")
        # A deep trie's walk begins at its pair; what is above it are the pair's own count and its first word's.
        above = pairs.select("lang", F.col("phrase").alias("head"), F.concat("left", F.array("a")).alias("above"))
        whole = lower.join(above, ["lang", "head"]).select("lang", "phrase", "a", F.concat("above", F.expr("slice(left, 2, size(left))")).alias("left"), "words")
        of_size |= {k + 2: whole.where(F.col("words") == k).select(*columns) for k in range(1, words - 1)}
    links, found = single.select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("b"), F.array().cast("array<long>").alias("right")), []
    for k in range(2, words + 1):
        linked = of_size[k].withColumn("suffix", F.expr("substr(phrase, instr(phrase, ' ') + 1)")).join(links, ["lang", "suffix"])
        linked = materialize(linked.select(*columns, F.concat(F.array("b"), "right").alias("right")), f"linked{k}")
        found.append(linked)
        links = linked.select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("b"), "right")
    # What is in a longer phrase of the same count is in one that is a word longer, as counts only fall with length.
    inside = [x.where(same).select("lang", F.expr(part).alias("phrase")) for x in found[1:] for same, part in (("element_at(left, -1) = a", "regexp_replace(phrase, ' [^ ]*$', '')"), ("right[0] = a", "substr(phrase, instr(phrase, ' ') + 1)"))]
    candidates = union_all(found)
    if inside:
        candidates = candidates.join(union_all(inside).distinct(), ["lang", "phrase"], "left_anti")
    candidates = candidates.join(F.broadcast(total) if total.count() <= BROADCAST_ROWS else total, "lang")
    cuts = F.expr("transform(left, (l, k) -> named_struct('score', (cast(a AS decimal(38, 0)) * cast(n AS decimal(38, 0)) * 1000) div (cast(l AS decimal(38, 0)) * cast(right[k] AS decimal(38, 0))), 'k', k, 'l', l, 'r', right[k]))")
    scored = candidates.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
