"""Sampled subword segmentations over a SentencePiece vocabulary, and lossless decoding.

The lattice of a text has an edge for every vocabulary piece that matches at a position. Forward filtering sums the
weights of all paths to each position; backward sampling then draws, from the end, each piece with its share of that
sum, so a segmentation is drawn with the probability its pieces' weights give it (shares are kept to 32 bits). A piece
of rank r in the model file weighs (r + 1) ** -alpha: the file is a merge list, and its ranks stand in for frequencies.

Where no piece of the vocabulary spans two neighbouring characters, as before spaces or between most ideographs, every
path has a node: the lattice falls apart there, and equal chunks have equal lattices. The forward pass runs in
logarithms, position by position over all new chunks of a batch at once; the backward pass runs for all chunks of a
batch at once. A worker keeps the lattices of chunks it has seen, up to a fixed number.
A draw hashes (seed, row key, place, step) and is compared with the thresholds of its own node, so a row's segmentation
depends on nothing but its key and text: not on partitions, nor on what a worker has kept.

Characters without a piece, and the space mark itself where a text has it, are written as byte pieces, so decoding gives
every text back.

Defined results: a null text is empty and has no ids; a null key counts as the empty key; repeated rows get equal ids;
extra columns are ignored; the time for a text is linear in its length, whatever its script.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrum.llm.shared import bound_arrow, ship

SPACE = "▁"
_CACHE_CHUNKS = 250_000
_PORTION_CHARS = 2_000_000
_BASE_A, _BASE_B, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(1)
_LAST = np.uint32(0xFFFFFFFF)


class Pieces:
    """A SentencePiece model file as text pieces, byte pieces and weights."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.alpha = alpha
        self.bytes = [-1] * 256
        self.text: dict[str, int] = {}
        self.surface: list[bytes] = []
        for i in range(m.vocab_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.surface.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.surface.append(b"")
            else:
                # Spaces are written plainly here; a literal mark in a text never equals a piece's.
                self.text[p.replace(SPACE, " ")] = i
                self.surface.append(p.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.text))
        ranks = {i: r for r, i in enumerate(sorted(self.text.values()))}
        self.weight = {t: (ranks[i] + 1.0) ** -alpha for t, i in self.text.items()}
        self.byte_weight = (len(ranks) + 1.0) ** -alpha
        self.index = self._index()
        self.classes, self.n_classes, self.spanned = self._pairs()
        self.surface_size = np.fromiter(map(len, self.surface), np.int64, len(self.surface))
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)

    def _pairs(self) -> tuple[np.ndarray, int, np.ndarray]:
        """A class for each code point (0: in no piece), and which pairs of classes some piece spans, in one row."""
        chars = sorted(set("".join(self.text)))
        classes = np.zeros(0x110000, np.uint16)
        classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        n = len(chars) + 1
        spanned = np.zeros(n * n, bool)
        for t in self.text:
            at = classes[[ord(c) for c in t]].astype(np.int64)
            spanned[at[:-1] * n + at[1:]] = True
        return classes, n, spanned

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The chunks of all texts in a row, and how many each text has."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        if not joined:
            return [], np.zeros(len(texts), np.int64)
        kind = self.classes[np.frombuffer(joined.encode("utf-32-le"), "<u4")]
        apart = np.ones(len(kind) + 1, bool)
        apart[1:-1] = ~self.spanned[kind[:-1].astype(np.int32) * self.n_classes + kind[1:]]
        ends = np.cumsum(sizes)
        apart[ends] = True
        at = np.flatnonzero(apart)
        listed = at.tolist()
        return [joined[i:j] for i, j in zip(listed, listed[1:], strict=False)], np.diff(np.searchsorted(at, np.concatenate([[0], ends])))

    def bytes_of(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()]

    def _index(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By length the pieces' two hashes (sorted by the first), ids and log weights."""
        out = [(np.empty(0, np.uint64),) * 4]
        for n in range(1, self.longest + 1):
            own = [t for t in self.text if len(t) == n]
            at = np.frombuffer("".join(own).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.uint64) + _ONE
            a, b = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint64)
            for k in range(n):
                a, b = a * _BASE_A + at[:, k], b * _BASE_B + at[:, k]
            order = np.argsort(a)
            out.append((a[order], b[order], np.array([self.text[t] for t in own], np.int32)[order], np.log(np.array([self.weight[t] for t in own]))[order] if own else np.empty(0)))
        return out

    def _edges(self, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All edges of chunks whose characters lie in a row: end, length, id, log weight. Substrings are looked up by two
        64-bit hashes that grow by a character a round. Where a character is no piece, its bytes are an edge; its id is
        minus the code point."""
        code = at.astype(np.uint64) + _ONE
        a, b, found = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64), []
        for n in range(1, min(self.longest, int(place.max()) + 1) + 1):
            m = len(at) - n + 1
            a, b = a[:m] * _BASE_A + code[n - 1 :], b[:m] * _BASE_B + code[n - 1 :]
            keys, check, ids, weights = self.index[n]
            begin = np.flatnonzero(place[n - 1 :] >= n - 1)  # substrings within one chunk
            hit = np.minimum(np.searchsorted(keys, a[begin]), len(keys) - 1) if len(keys) else np.zeros(len(begin), np.int64)
            ok = (keys[hit] == a[begin]) & (check[hit] == b[begin]) if len(keys) else np.zeros(len(begin), bool)
            end = begin[ok] + n - 1
            found.append((end, np.full(len(end), n), ids[hit[ok]], weights[hit[ok]]))
            if n == 1 and not ok.all():
                lone = begin[~ok]
                many = 1 + (at[lone] > 0x7F) + (at[lone] > 0x7FF).astype(np.int64) + (at[lone] > 0xFFFF)
                found.append((lone, np.ones(len(lone), np.int64), -at[lone].astype(np.int32), many * np.log(self.byte_weight)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def filtered(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lattices of non-empty chunks. Nodes are the characters of all chunks in a row, each the end of what leads to
        it. By node: its first edge. By edge, likelier ones of a node first: the threshold up to which a draw takes it,
        the node it comes from (-1: the chunk's start), its id."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        end, n, ids, weight = self._edges(at, place)
        order = np.lexsort((n, end, place[end]))
        end, n, ids, weight = end[order], n[order], ids[order], weight[order]
        to = np.where(place[end] >= n, end - n, -1)
        forward, share = np.zeros(len(at) + 1), np.empty(len(end))  # the last entry is that of -1, a chunk's start
        opens = np.flatnonzero(np.diff(end, prepend=-1))
        many = np.diff(opens, append=len(end))
        steps = np.searchsorted(place[end[opens]], np.arange(int(sizes.max()) + 1))
        for lo, hi in zip(steps, steps[1:], strict=False):
            at_edge = slice(opens[lo], opens[hi] if hi < len(opens) else len(end))
            x = weight[at_edge] + forward[to[at_edge]]
            seg, k = opens[lo:hi] - opens[lo], many[lo:hi]
            top = np.maximum.reduceat(x, seg)
            y = np.exp(x - np.repeat(top, k))
            total = np.add.reduceat(y, seg)
            forward[end[opens[lo:hi]]] = top + np.log(total)
            share[at_edge] = y / np.repeat(total, k)
        order = np.lexsort((n, -share, end))
        to, ids, share = to[order], ids[order], share[order]
        first = np.searchsorted(end[order], np.arange(len(at)))
        count = np.diff(first, append=len(share))
        # Sums run within a node alone, so that they don't depend on the nodes beside it.
        for k in range(1, int(count.max())):
            e = first[count > k] + k
            share[e] += share[e - 1]
        threshold = np.clip(np.rint(share * 2.0**32) - 1, 0, 2.0**32 - 1).astype(np.uint32)
        threshold[first + count - 1] = _LAST
        return first, threshold, to, ids


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each number."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Table:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.size = np.empty(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.empty(self.size + len(more), self.data.dtype)])
        self.data[self.size : self.size + len(more)] = more
        self.size += len(more)


class Sampler:
    """Segments texts. The lattices of chunks are kept in flat tables, up to a fixed number of chunks."""

    def __init__(self, path: str, alpha: float, seed: int):
        self.pieces, self.seed = Pieces(path, alpha), seed
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}  # a chunk's last node
        self.first, self.threshold, self.to, self.ids = map(_Table, (np.int32, np.uint32, np.int32, np.int32))

    def _learn(self, chunks: list[str]) -> None:
        first, threshold, to, ids = self.pieces.filtered(chunks)
        nodes, edges = self.first.size, self.threshold.size
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))) - 1 + nodes
        self.known.update(zip(chunks, ends.tolist(), strict=True))
        self.first.add(first + edges)
        self.threshold.add(threshold)
        self.to.add(np.where(to < 0, -1, to + nodes))
        self.ids.add(ids)

    def _last_nodes(self, chunks: list[str]) -> np.ndarray:
        got = list(map(self.known.get, chunks))
        if None in got:
            new = {c for c, x in zip(chunks, got, strict=True) if x is None}
            if self.known and len(self.known) + len(new) > _CACHE_CHUNKS:
                self._reset()
                new = set(chunks)
            self._learn(sorted(new))
            got = list(map(self.known.__getitem__, chunks))
        return np.array(got, np.int32)

    def sample(self, texts: list[str], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row, and how many each text has."""
        chunks, many = self.pieces.cut(texts)
        if not chunks:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        node = self._last_nodes(chunks)
        first, threshold, to, ids = self.first.data, self.threshold.data, self.to.data, self.ids.data
        base = np.array([int.from_bytes(hashlib.blake2b(f"{self.seed}:{k}".encode(), digest_size=8).digest(), "little") for k in keys], np.uint64)
        row_at = np.cumsum(many) - many
        place = (np.arange(len(chunks)) - np.repeat(row_at, many)).astype(np.uint64)
        state = mix(np.repeat(base, many) + mix(place))
        length, who, drawn, step = np.zeros(len(chunks), np.int32), np.arange(len(chunks), dtype=np.int32), [], 0
        while len(who):
            u = (mix(state + np.uint64(step)) >> np.uint64(32)).astype(np.uint32)
            edge = first[node]
            more = np.flatnonzero(u > threshold[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] > threshold[edge[more]]]
            drawn.append((who, ids[edge]))
            step += 1
            length[who] = step
            node = to[edge]
            on = np.flatnonzero(node >= 0)
            node, who, state = node[on], who[on], state[on]
        # Steps run backwards: the last drawn piece of a chunk is its first.
        ends = np.cumsum(length, dtype=np.int64)
        out = np.empty(int(ends[-1]), np.int32)
        for k, (w, piece) in enumerate(drawn):
            out[ends[w] - 1 - k] = piece
        total = np.concatenate([[0], ends])
        counts = total[row_at + many] - total[row_at]
        return self._with_bytes(out, counts)

    def _with_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with the byte pieces of characters that have no piece in their places."""
        lone = np.flatnonzero(ids < 0)
        if not len(lone):
            return ids, counts
        code, which = np.unique(-ids[lone], return_inverse=True)
        spelt = [self.pieces.bytes_of(chr(c)) for c in code.tolist()]
        n = np.fromiter(map(len, spelt), np.int64, len(spelt))[which]
        size = np.ones(len(ids), np.int64)
        size[lone] = n
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]), np.int32)
        out[ends[ids >= 0] - 1] = ids[ids >= 0]
        at = ends[lone] - n
        table = np.array([x + [0] * (4 - len(x)) for x in spelt], np.int32)
        for k in range(4):
            out[at[n > k] + k] = table[which[n > k], k]
        total = np.concatenate([[0], ends])
        upto = np.cumsum(counts)
        return out, total[upto] - total[upto - counts]


_samplers: dict[tuple, Sampler] = {}


def sampler(name: str, alpha: float, seed: int) -> Sampler:
    """One sampler for each setting in a worker process; name: of a file that ship() sent."""
    if (name, alpha, seed) not in _samplers:
        _samplers[name, alpha, seed] = Sampler(name if os.path.isabs(name) else SparkFiles.get(name), alpha, seed)
    return _samplers[name, alpha, seed]


def portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of the list, each of about _PORTION_CHARS characters or one text."""
    lo, size = 0, 0
    for hi in range(1, len(texts) + 1):
        size += len(texts[hi - 1])
        if size >= _PORTION_CHARS or hi == len(texts):
            yield lo, hi
            lo, size = hi, 0


def decode_bytes(ids: np.ndarray, p: Pieces) -> np.ndarray:
    """The UTF-8 bytes that ids stand for."""
    size = p.surface_size[ids]
    ends = np.cumsum(size)
    return p.surface_bytes[np.repeat(p.surface_at[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def decode_ids(ids: list[int], p: Pieces) -> str:
    return b"".join(map(p.surface.__getitem__, ids)).decode("utf-8", "replace")


def _ids_list(ids: np.ndarray, many: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model: str, alpha: float = 0.5, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, ids (a sampled segmentation of the whole text)."""
    bound_arrow(docs.sparkSession)
    kind, name = docs.schema[key].dataType.simpleString(), ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(name, alpha, seed)
        for b in batches:
            texts, names = [t or "" for t in b.column("t").to_pylist()], b.column("n").to_pylist()
            for lo, hi in portions(texts):
                ids, many = s.sample(texts[lo:hi], names[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column("k").slice(lo, hi - lo), _ids_list(ids, many)], names=[key, "ids"])

    named = F.coalesce(F.col(key).cast("string"), F.lit("")).alias("n")
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t"), named).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row for each row of encoded: key, ids, text (the text that was encoded)."""
    bound_arrow(encoded.sparkSession)
    kind, name = encoded.schema[key].dataType.simpleString(), ship(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sampler(name, 1.0, 0).pieces
        for b in batches:
            texts = [decode_ids(x or [], p) for x in b.column("i").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("i"), pa.array(texts, pa.string())], names=[key, "ids", "text"])

    return encoded.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"`{key}` {kind}, ids array<int>, text string")


def encode_checked(docs: DataFrame, model: str, alpha: float = 0.5, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, ids, n_pieces, decoded_crc32 (of the UTF-8 bytes that decoding gives) and
    lossless (whether these are the text's). Ids are decoded in the task that made them."""
    bound_arrow(docs.sparkSession)
    kind, name = docs.schema[key].dataType.simpleString(), ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(name, alpha, seed)
        for b in batches:
            texts, names = [t or "" for t in b.column("t").to_pylist()], b.column("n").to_pylist()
            for lo, hi in portions(texts):
                ids, many = s.sample(texts[lo:hi], names[lo:hi])
                upto = np.concatenate([[0], np.cumsum(s.pieces.surface_size[ids])])[np.concatenate([[0], np.cumsum(many)])].tolist()
                decoded = decode_bytes(ids, s.pieces).tobytes()
                back = [decoded[i:j] for i, j in zip(upto, upto[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("k").slice(lo, hi - lo),
                        _ids_list(ids, many),
                        pa.array(many, pa.int64()),
                        pa.array(list(map(zlib.crc32, back)), pa.int64()),
                        pa.array([x == t.encode() for x, t in zip(back, texts[lo:hi], strict=True)], pa.bool_()),
                    ],
                    names=[key, "ids", "n_pieces", "decoded_crc32", "lossless"],
                )

    named = F.coalesce(F.col(key).cast("string"), F.lit("")).alias("n")
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t"), named).mapInArrow(run, f"`{key}` {kind}, ids array<int>, n_pieces long, decoded_crc32 long, lossless boolean")
