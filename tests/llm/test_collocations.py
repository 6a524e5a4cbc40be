"""Collocations against plain counts of all phrases, and their edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from metrum.llm import collocations, queries
from tests.oracle import differences

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least, first=2000, longest=5):
    """rows of (text, lang)."""
    out = []
    for lang in {r[1] or "und" for r in rows}:
        f = Counter()
        for t, of in rows:
            if (of or "und") == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    f.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = {p[i : i + m] for p, a in often.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if a >= f[p[i : i + m]]}
        scored = []
        for p, a in often.items():
            if p not in inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, r, n, -score) for i, (score, a, p, left, r) in enumerate(sorted(scored)[:first])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n=60):
    r = random.Random(seed)
    words = ["a", "b", "A", "the", "é", "日本", "x\x1cy", "of ", "end\x85", "\U0001f600"]
    return [("".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(r.randrange(80))), r.choice(["en", "fr", None])) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("least", [2, 9])
def test_equal_to_plain_counts(spark, monkeypatch, least, small):
    if small:
        for name, value in (("SHARD", 50), ("DISTINCT", 5), ("NODES", 20), ("BITS", 5), ("PART", 3), ("RANGE_WORDS", 40)):
            monkeypatch.setattr(collocations, name, value)
    rows = texts(least)
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    assert found(collocations.mine(docs, least)) == brute(rows, least)
    assert found(collocations.mine(docs, least, words=2, first=3)) == brute(rows, least, 3, 2)


def test_edges(spark):
    long = "to be or not " * 30_000
    rows = [(None, "en"), ("", None), (" \t .,", "en"), ("one", "en"), (long, "en"), ("a a a a a a", None), ("a a a a a a", None), ("A b. a B", "und")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], SCHEMA).selectExpr("*", "1 AS head", "2 AS word", "'x' AS phrase", "3 AS n", "4 AS t")
    for least in (2, 100):
        assert found(collocations.mine(docs, least)) == brute(rows, least)
    assert collocations.mine(docs.limit(0)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(queries.QUERIES["op13_collocations"](spark, sf), queries.ORACLES["op13_collocations"], sf) == ""


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 9 * 10**13, 8 * 10**17, 10**14, 9 * 10**13
    got = spark.sql(f"SELECT (cast({a}L AS decimal(38, 0)) * cast({n}L AS decimal(38, 0)) * 1000) div (cast({left}L AS decimal(38, 0)) * cast({right}L AS decimal(38, 0))) AS s").first().s
    assert got == 1000 * a * n // (left * right)


def test_merge_of_tries():
    words = sorted({b"", b"\n", b"a", b"b", b"c"})
    x = np.array([words.index(w) for w in (b"a", b"b", b"a", b"b", b"c")])
    trie = collocations.shard_trie("en", x, words, None, 5)
    rows = next(collocations._packed("en", trie, [("en", b"b"), ("fr", b"a")]))
    assert rows.column("range").to_pylist() == [0, 1]
    t = collocations.merged(collocations._joined([collocations._read(rows, 1), collocations._read(rows, 0), collocations._read(rows, 1)]))
    assert t.heads.to_pylist() == ["a", "b", "c"] and t.own.tolist() == [2, 4, 2]
    assert list(zip(t.of.tolist(), t.word.to_pylist(), t.count.tolist(), strict=True)) == [(0, "b", 2), (1, "a", 2), (1, "c", 2)]
