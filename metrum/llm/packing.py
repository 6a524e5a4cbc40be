"""Best-fit packing of token sequences, improved by swap-based local search.

A length is at most the capacity, so the whole corpus is described by a histogram of as many counts. Packing works on
that histogram: equal bins are one entry with a multiplicity, best fit places all items of a length at once, and the
local search exchanges items between whole groups of equal bins. The plan's size therefore depends on the capacity and
not on the corpus. Rows then find their place by a rank among the pieces of their length; ranks come from counters kept
while tokenizing and from prefix sums, so no length, however frequent, meets in one task.

Defined results: a null text is empty and gives the end id alone; repeated rows are packed each; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.llm.shared import bound_arrow, materialize, ship

CAPACITY = 2048
END_ID = 0
_CACHE_WORDS = 300_000
_PORTION_CHARS = 2_000_000
_CACHE_CHARS = 64
_OTHER = re.compile(r"[^\n\x20-\x7e\xa1-\u024f]")
_ADJOINING = ("  ", " \n", "\n ", "\n\n")


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library.

    Every single space before a visible character begins a pre-token, so the ids of a text are those of its chunks at
    such spaces, joined. Chunks repeat, and their ids are kept, up to a fixed number. Texts with adjoining white space,
    with letters beyond Latin or with the string of a special token, which becomes that token, go through the library
    whole, where its own rules for them decide. New chunks are encoded by tiktoken from the same file's vocabulary, which
    gives the same ids (tests compare both).
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec["added_tokens"]}
        self.special = tuple(special)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        # Fixed value: the splitting pattern of byte-level pre-tokenizers.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.chunk = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for w, i in ranks.items() if w[:1] == b" "]] = True
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of the words, each after a space. One call encodes all: a token that begins with a space begins a word."""
        if not words:
            return {}
        listed = list(words)
        ids = np.array(self.chunk(" " + " ".join(listed)), "<u4")
        at = [*(np.flatnonzero(self.spaced[ids]) * 4).tolist(), len(ids) * 4]
        raw = ids.tobytes()
        new = {w: raw[i:j] for w, i, j in zip(listed, at[:-1], at[1:], strict=True)}
        if len(self.known) + len(new) > _CACHE_WORDS:
            self.known.clear()
        self.known.update((w, r) for w, r in new.items() if len(w) <= _CACHE_CHARS)
        return new

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers. Long lists go in portions of bounded size."""
        out, portion, size = [], [], 0
        for t in texts:
            portion.append(t)
            size += len(t)
            if size >= _PORTION_CHARS:
                out += self._encode(portion)
                portion, size = [], 0
        return out + self._encode(portion)

    def _encode(self, texts: list[str]) -> list[bytes]:
        uneven = [t[-1:] == " " or bool(_OTHER.search(t)) or any(x in t for x in _ADJOINING) or any(x in t for x in self.special) for t in texts]
        split = [[] if u else t.split(" ") for t, u in zip(texts, uneven, strict=True)]
        got = [list(map(self.known.get, w)) for w in split]
        new = self._learn({w for words, r in zip(split, got, strict=True) if None in r for w, x in zip(words[1:], r[1:], strict=True) if x is None})
        out = []
        for t, words, r in zip(texts, split, got, strict=True):
            if not words:
                out.append(np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            r[0] = np.array(self.chunk(words[0]), "<u4").tobytes()
            if None in r:
                r = [new[w] if x is None else x for w, x in zip(words, r, strict=True)]
            out.append(b"".join(r))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder for each file in a worker process; name: of a file that ship() sent."""
    if name not in _encoders:
        _encoders[name] = Encoder(SparkFiles.get(name))
    return _encoders[name]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32, part, nth): documents end with id 0; only longer ones are cut, all
    pieces but the first to the full capacity. part and nth number the pieces of each length, written by one task."""
    bound_arrow(docs.sparkSession)
    kind, name = docs.schema[key].dataType.simpleString(), ship(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(name), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            at, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, ids in enumerate(enc.encode_many([t or "" for t in b.column("t").to_pylist()])):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n - (n - 1) // capacity * capacity, n, capacity), n]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[4 * lo : 4 * hi]))
                    nth.append(seen[hi - lo])
                    seen[hi - lo] += 1
            yield pa.RecordBatch.from_arrays(
                [b.column("k").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(at), pa.int32()), pa.array(nth, pa.int64())],
                names=["key", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


# A bin is a tuple of (length, how many) runs, longest first; a plan maps bins to how many there are.
Bin = tuple[tuple[int, int], ...]
Plan = dict[Bin, int]


def fill(b: Bin) -> int:
    return sum(s * m for s, m in b)


def changed(b: Bin, out: tuple[int, ...] = (), into: tuple[int, ...] = ()) -> Bin:
    """b without the lengths in out and with those in into."""
    many = dict(b)
    for s in out:
        many[s] -= 1
    for s in into:
        many[s] = many.get(s, 0) + 1
    return tuple(sorted(((s, m) for s, m in many.items() if m), reverse=True))


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram of lengths. All items of a length go, bin group by bin group, to the fullest
    bins that still take them, so each length adds at most two groups to those there are."""
    room: dict[int, dict[Bin, int]] = defaultdict(lambda: defaultdict(int))
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            r = min((r for r, g in room.items() if g and r >= size), default=capacity)
            if room[r]:
                b, bins = room[r].popitem()
            else:
                b, bins = (), -(-left // (capacity // size))
            each = r // size
            whole = min(bins, left // each)
            if whole:
                room[r - each * size][(*b, (size, each))] += whole
                left -= whole * each
            bins -= whole
            if bins and left:
                room[r - left * size][(*b, (size, left))] += 1
                bins, left = bins - 1, 0
            if bins and b:
                room[r][b] += bins
    plan: Plan = defaultdict(int)
    for groups in room.values():
        for b, bins in groups.items():
            plan[b] += bins
    return dict(plan)


def pairs(b: Bin) -> dict[int, tuple[int, int]]:
    """Sums of two items of b, each with one such pair."""
    return {s + t: (s, t) for i, (s, m) in enumerate(b) for t, _ in b[i:] if s != t or m > 1}


def offers(b: Bin) -> dict[int, tuple[int, ...]]:
    """What b can give: sums of one or two of its items, one item where both have the sum."""
    return pairs(b) | {s: (s,) for s, _ in b}


def exchange(a: Bin, b: Bin, capacity: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The lengths that leave a and those that come from b, in the exchange that fills a (the fuller bin) most: a move of
    one or two, one for one, one for two or two for one; None if there is none. Any such exchange increases the squared
    fill."""
    found = [(sum(into) - sum(out), out, into) for out in [(), *offers(a).values()] for into in offers(b).values() if len(out) + len(into) <= 3]
    gain, out, into = max((x for x in found if 0 < x[0] <= capacity - fill(a)), default=(0, (), ()))
    return (out, into) if gain else None


class _Wants:
    """For all underfull groups what a bin could part with: nothing, one item or two. A row's limit is the most that may
    come instead. Rows are only added; those of groups that are gone are dead."""

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 0
        self.out: list[tuple[int, ...]] = []
        self.groups: list[Bin] = []
        self.slot_of: dict[Bin, int] = {}
        self.alive = np.zeros(1024, bool)
        self.rows = np.zeros((4, 4096), np.int64)  # sum of what leaves, limit, fill, slot
        self.two = np.zeros(4096, bool)

    def add(self, b: Bin) -> None:
        slot, f = len(self.groups), fill(b)
        self.groups.append(b)
        if b in self.slot_of:
            self.alive[self.slot_of[b]] = False
        self.slot_of[b] = slot
        if slot == len(self.alive):
            self.alive = np.concatenate([self.alive, np.zeros_like(self.alive)])
        self.alive[slot] = True
        out = [(), *offers(b).values()]
        n = self.size + len(out)
        while n > self.rows.shape[1]:
            self.rows, self.two = np.concatenate([self.rows, np.zeros_like(self.rows)], axis=1), np.concatenate([self.two, np.zeros_like(self.two)])
        x = np.fromiter(map(sum, out), np.int64, len(out))
        self.rows[:, self.size : n] = x, x + self.capacity - f, np.full(len(out), f), np.full(len(out), slot)
        self.two[self.size : n] = [len(o) == 2 for o in out]
        self.out += out
        self.size = n

    def drop(self, b: Bin) -> None:
        self.alive[self.slot_of.pop(b)] = False

    def without_dead(self, seen: dict[Bin, int]) -> dict[Bin, int]:
        """Takes out the dead rows once they are most; the same marks by the rows' new numbers."""
        kept = np.flatnonzero(self.alive[self.rows[3, : self.size]])
        if self.size < 4096 or 2 * len(kept) > self.size:
            return seen
        self.rows, self.two, self.out, self.size = self.rows[:, kept], self.two[kept], [self.out[k] for k in kept.tolist()], len(kept)
        return {b: int(np.searchsorted(kept, m)) for b, m in seen.items()}

    def best(self, donor: Bin, since: int, alone: bool) -> tuple[Bin, tuple[int, ...], tuple[int, ...]] | None:
        """Of the rows from `since` on the exchange that increases the squared fill most: taker, what leaves it, what it
        gets. alone: the donor's group has one bin, which has none of its own group to give to."""
        give, f = offers(donor), fill(donor)
        both, ones = np.array(sorted(give)), np.array(sorted(s for s, _ in donor))
        x, limit, filled, slot = self.rows[:, since : self.size]
        at = np.where(self.two[since : self.size], np.searchsorted(ones, limit, "right") - 1, np.searchsorted(both, limit, "right") - 1)
        got = np.where(self.two[since : self.size], ones[np.minimum(at, len(ones) - 1)], both[at])
        gain = np.where(at < 0, 0, got - x)
        ok = self.alive[slot] & (filled >= f) & (gain > 0)
        if alone:
            ok &= slot != self.slot_of[donor]
        if not ok.any():
            return None
        k = int(np.argmax(np.where(ok, gain * (filled - f + gain), 0)))
        into = (int(got[k]),) if self.two[since + k] else give[int(got[k])]
        return self.groups[int(slot[k])], self.out[since + k], into


def local_search(plan: Plan, capacity: int) -> Plan:
    """Empties the least filled bins into fuller ones: the least filled group makes the exchange that increases the
    squared fill most, for as many bins at once as both groups have. It ends when no two underfull bins have an exchange
    left. An exchange depends on the two bins' contents alone, so a donor that found none looks only at groups that came
    later. Work grows with the histogram, not with the corpus."""
    plan = {b: n for b, n in plan.items() if b and n}
    wants, seen = _Wants(capacity), {}
    queue = sorted((fill(b), b) for b in plan if fill(b) < capacity)
    for _, b in queue:
        wants.add(b)
    while queue:
        while queue:
            _, donor = heappop(queue)
            if not plan.get(donor):
                continue
            found = wants.best(donor, seen.get(donor, 0), plan[donor] < 2)
            if found is None:
                seen[donor] = wants.size
                continue
            taker, out, into = found
            bins = plan[donor] // 2 if taker == donor else min(plan[donor], plan[taker])
            for old in {taker, donor}:
                plan[old] -= bins * (2 if taker == donor else 1)
                if not plan[old]:
                    del plan[old]
                    wants.drop(old)
                    seen.pop(old, None)
            for new in (changed(taker, out, into), changed(donor, into, out)):
                if new:
                    before = plan.get(new, 0)
                    plan[new] = before + bins
                    # A single bin has not been tried with its own group.
                    if fill(new) < capacity and before < 2:
                        wants.add(new)
                        heappush(queue, (fill(new), new))
            if donor in plan:
                heappush(queue, (fill(donor), donor))
            seen = wants.without_dead(seen)
        queue = sorted((fill(b), b) for b in plan if fill(b) < capacity and seen.get(b, 0) < wants.size)
    return plan


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    return local_search(best_fit(histogram, capacity), capacity)


def places(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, bins' first number, items a bin, offset in the bin) by length and first rank."""
    rows, ranks, base = [], defaultdict(int), 0
    for b, bins in plan.items():
        offset = 0
        for size, m in b:
            rows.append((size, ranks[size], base, m, offset))
            ranks[size] += bins * m
            offset += size * m
        base += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset. Sequences hold at most capacity tokens,
    without gaps. To the driver come `capacity` counts at most."""
    cut = materialize(pieces(docs, tokenizer, capacity, key, text), "pieces")
    counts = materialize(cut.groupBy("length", "part").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    where = places(pack_histogram(histogram, capacity))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(counts.select("length", "part", before.alias("before")), ["length", "part"])
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = where[:, 0].astype(np.float64) * 2.0**40 + where[:, 1] if where[:, 1].max(initial=0) < 2**40 else None
        for b in batches:
            if not b.num_rows:
                continue
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            if firsts is not None:
                at = np.searchsorted(firsts, size * 2.0**40 + rank, "right") - 1
            else:
                lo, hi = np.searchsorted(where[:, 0], size), np.searchsorted(where[:, 0], size, "right")
                at = np.array([x + np.searchsorted(where[x:y, 1], r, "right") - 1 for x, y, r in zip(lo, hi, rank, strict=True)])
            w = where[at]
            nth = rank - w[:, 1]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("piece"), b.column("start"), b.column("length"), b.column("ids_crc32"), pa.array(w[:, 2] + nth // w[:, 3]), pa.array(w[:, 4] + nth % w[:, 3] * size)],
                names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    slim = ranked.select("key", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return slim.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
