"""Toxicity by a bag of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is itself and its character n-grams with word-boundary marks; each that occurs in enough texts of the fitted
sample has a row in the embedding table. A text's vector is the mean over the subwords of its distinct words and `pad` neutral
ones, so a few words alone decide little; a linear softmax over two classes reads it. Embeddings and softmax are trained together by Adam. Words never seen share n-grams with seen
ones, so misspellings get near vectors. A part of the sample is kept back to place the threshold at 0.5.

Since text vector and logit are linear in the subwords, a word adds one number to its text's logit; scoring keeps these
numbers for the words of a task and reads whole texts.

Defined results: null and empty texts have the score of the bias alone; labels outside 0 and 1 and rows without a label
are not trained on; if only one class or no labelled row is left, every score is that class's share (0 without labels);
repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.llm.shared import bound_arrow

WORD = re.compile(r"\w+")
_CACHE_WORDS = 150_000


@dataclass(frozen=True)
class Options:
    """buckets and dim: size of the table; short, long: n-gram lengths; pad: neutral subwords; least_docs: texts that a subword must occur in to be
    learnt; train_docs: the bound on the labelled sample that is fitted, half of it from each class where both have
    enough; train_chars: the bound on its text; starts: fits from other initial values whose logits are averaged."""

    dim: int = 8
    short: int = 4
    long: int = 5
    least_docs: int = 8
    pad: float = 400.0
    train_docs: int = 6000
    train_chars: int = 10_000_000
    epochs: int = 50
    rate: float = 1.0
    decay: float = 1e-4
    scale: float = 4.0
    seed: int = 7
    starts: int = 4


@dataclass(frozen=True)
class Model:
    """weights: what each subword adds to the logit of class 1, the product of its embedding and the softmax's
    difference; embeddings (rows in the order of weights) and softmax stay for other uses."""

    options: Options
    weights: dict[str, float]
    bias: float
    embeddings: np.ndarray | None = None
    softmax: np.ndarray | None = None


def subwords(word: str, o: Options) -> list[str]:
    """The marked word and its n-grams."""
    w = f"<{word}>"
    return [w, *(w[i : i + n] for n in range(o.short, min(o.long, len(w) - 1) + 1) for i in range(len(w) - n + 1))]


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class _Bags:
    """Texts as word counts and words as subword lists, in flat arrays."""

    def __init__(self, texts: list[str], o: Options):
        word_no: dict[str, int] = {}
        rows = []
        for t in texts:
            found: dict[int, int] = {}
            # In the text's order: a set's would differ by process, and with it which subword gets which initial row.
            for w in (w for chunk in dict.fromkeys(t.split()) for w in words(chunk)):
                i = word_no.setdefault(w, len(word_no))
                found[i] = found.get(i, 0) + 1
            rows.append(found)
        gram_no: dict[str, int] = {}
        lists = [[gram_no.setdefault(g, len(gram_no)) for g in subwords(w, o)] for w in word_no]
        n = len(word_no)
        self.n_texts, self.n_words = len(texts), n
        self.at = np.fromiter((i for f in rows for i in f), np.int64)
        self.many = np.fromiter((k for f in rows for k in f.values()), np.float64)
        self.of_text = np.repeat(np.arange(len(texts)), [len(f) for f in rows])
        sizes = np.fromiter((len(x) for x in lists), np.int64, n)
        sub, of_word = np.fromiter((g for x in lists for g in x), np.int64), np.repeat(np.arange(n), sizes)
        self.total = np.bincount(self.of_text, self.many * sizes[self.at], len(texts)) + o.pad
        # A subword's texts, counted by its words; a text with two of its words counts twice.
        seen = np.bincount(sub, np.bincount(self.at, minlength=n)[of_word], len(gram_no)) if n else np.zeros(0)
        kept = seen >= min(o.least_docs, 1 + len(texts) // 100)
        new = np.cumsum(kept) - 1
        self.grams = [g for g, i in gram_no.items() if kept[i]]
        self.sub, self.of_word = new[sub[kept[sub]]], of_word[kept[sub]]
        self.share = self.many / self.total[self.of_text]


def fit(texts: list[str], labels: list[int], o: Options = Options()) -> Model:
    """The mean logit of `starts` fits, which differ by their initial values alone, so the model hangs little on one start. As
    each is linear in the subwords, their mean is one linear softmax over their embeddings side by side. Every fifth text
    is kept back from all fits."""
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(o, {}, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    x = _Bags(texts, o)
    back = np.arange(len(y)) % 5 == 4
    if len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        back[:] = False
    tables, softs, biases = zip(*(_fit_from(np.random.default_rng((o.seed, i)), x, y, back, o) for i in range(o.starts)), strict=True)
    e, soft = np.concatenate(tables, axis=1), np.concatenate(softs) / o.starts
    return Model(o, dict(zip(x.grams, (e @ soft).tolist(), strict=True)), float(np.mean(biases)), e, soft)


def _fit_from(rng: np.random.Generator, x: _Bags, y: np.ndarray, back: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray, float]:
    """Embeddings, softmax and bias by full-batch Adam, with one second moment for a whole table so that rare subwords stay
    small, on the classes' mean losses, clean texts with more weight; texts in `back` place the threshold alone."""
    e, soft, bias = rng.normal(0, 0.1, (len(x.grams), o.dim)), rng.normal(0, 0.1, o.dim), 0.0
    fitted = ~back
    weight = fitted * np.where(y == 1, 0.35 / max(y[fitted].sum(), 1), 0.65 / max((1 - y[fitted]).sum(), 1))
    state: list[list] = [[np.zeros_like(e), 0.0], [np.zeros_like(soft), 0.0], [0.0, 0.0]]

    def logits() -> np.ndarray:
        """Logits without the bias. Text vectors are linear in the table, so each subword's product with the softmax is summed
        in place of its embedding; gradients below use the same."""
        by_word = np.bincount(x.of_word, (e @ soft * o.scale)[x.sub], x.n_words)
        return np.bincount(x.of_text, by_word[x.at] * x.share, x.n_texts)

    for step in range(1, o.epochs + 1):
        off = weight * (1 / (1 + np.exp(-np.clip(logits() + bias, -50, 50))) - y)
        pull = np.bincount(x.sub, np.bincount(x.at, off[x.of_text] * x.share, x.n_words)[x.of_word], len(x.grams)) * o.scale
        g_e = pull[:, None] * soft[None, :] + o.decay * e
        moves = []
        for s, g in zip(state, (g_e, e.T @ pull, off.sum()), strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * np.max(np.square(g))
            moves.append(o.rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-12))
        e, soft, bias = e - moves[0], soft - moves[1], float(bias - moves[2])
    if back.any():
        bias -= _threshold((logits() + bias)[back], y[back])
    return e, soft * o.scale, bias


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The logit with the fewest errors, in the middle of the gap where it lies."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    i = best[len(best) // 2]
    return float((z[max(i - 1, 0)] + z[min(i, len(z) - 1)]) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, o: Options = Options(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[str], list[int]]:
    """A bounded sample of labelled texts, chosen by hash of the key: about train_docs / 2 of each class, and no more
    than train_chars in all. Labels come from rows whose crc32(key as text) mod 5 is not 0; these alone may be learnt."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("k").isNotNull() & ~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    u = F.crc32(F.encode(F.concat(F.lit("sample:"), F.col("k").cast("string")), "UTF-8")) / F.lit(float(2**32))
    take = F.lit(0.0)
    for y, n in counts.items():
        take = F.when(F.col("y") == y, min(1.0, o.train_docs / 2 / n)).otherwise(take)
    # The sample's keys, 2 * train_docs at most, are broadcast, so no text is exchanged but the sample's.
    sample = F.broadcast(known.where(u < take).orderBy(u, "k").limit(2 * o.train_docs))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(sample, "k").where(F.col("t").isNotNull())
    texts, ys, size = [], [], 0
    for r in rows.select("t", "y", "k").orderBy(F.xxhash64("k"), "t").limit(2 * o.train_docs).toLocalIterator():
        size += len(r["t"])
        if size > o.train_chars and len(set(ys)) > 1:
            break
        texts.append(r["t"])
        ys.append(r["y"])
    return texts, ys


def held_out(key: Column) -> Column:
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, o: Options = Options(), **names) -> Model:
    return fit(*training_rows(docs, labels, o, **names), o)


class Scorer:
    """Scores with what each chunk between white space adds kept for the worker's tasks, up to a fixed number."""

    def __init__(self, model: Model):
        self.weights, self.bias, self.options = model.weights, model.bias, model.options
        self.known: dict[str, tuple[float, int]] = {}

    def of_chunk(self, chunk: str) -> tuple[float, int]:
        get, total, many = self.weights.get, 0.0, 0
        for w in words(chunk):
            s = subwords(w, self.options)
            total += sum([get(g, 0.0) for g in s])
            many += len(s)
        if len(self.known) >= _CACHE_WORDS:
            self.known.clear()
        if len(chunk) <= 64:
            self.known[chunk] = total, many
        return total, many

    def score(self, text: str | None) -> float:
        chunks = sorted(set(text.split())) if text else []
        got = list(map(self.known.get, chunks))
        if None in got:
            got = [self.of_chunk(c) if x is None else x for c, x in zip(chunks, got, strict=True)]
        sums, many = zip(*got, strict=True) if got else ((), ())
        z = sum(sums) / (sum(many) + self.options.pad) + self.bias
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, z))))


_scorers: dict[str, Scorer] = {}


def _scorer(shared: Broadcast) -> Scorer:
    """One scorer for each model in a worker process."""
    token, model = shared.value
    if token not in _scorers:
        _scorers.clear()
        _scorers[token] = Scorer(model)
    return _scorers[token]


def _share(docs: DataFrame, model: Model) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, Model(model.options, model.weights, model.bias)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, score): one for each row of docs."""
    bound_arrow(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    shared = _share(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([scorer.score(t) for t in b.column("t").to_pylist()], pa.float64())], names=[key, "score"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """docs without the rows whose score is the threshold or more; no row moves between tasks."""
    bound_arrow(docs.sparkSession)
    shared = _share(docs, model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for b in batches:
            yield b.filter(pa.array([scorer.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
