"""MinHash near-duplicates against all pairs, and their edge cases."""

import random
import re

import numpy as np
import pytest

from metrum.llm import minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    """Row by row: doc_id, size of the set, smallest id over links."""
    sets = [shingle_set(t) for _, t in rows]
    at, root = {}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in at[x] if j < i}:
            if 100 * len(s & sets[j]) >= 85 * len(s | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted((repr(k), len(s), repr(least.get(find(i))), k == least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(df):
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in df.collect())


def copies(seed, bases, of_each, edits):
    """Texts of 120 words with up to `edits` words changed, so links are on both sides of the threshold."""
    r = random.Random(seed)
    rows = []
    for _ in range(bases):
        base = [f"w{r.randrange(5000)}" for _ in range(120)]
        for _ in range(of_each):
            w = list(base)
            for _ in range(r.randrange(edits)):
                w[r.randrange(120)] = f"x{r.randrange(5000)}"
            rows.append((r.randrange(10**9), " ".join(w)))
    return rows


@pytest.mark.parametrize("edits", [3, 7])
def test_components_equal_all_pairs(spark, edits):
    rows = copies(edits, 12, 25, edits)
    got = minhash.components(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA))
    assert found(got) == brute(rows)


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 3000)
    monkeypatch.setattr(minhash, "LEAVES", 5)
    monkeypatch.setattr(minhash, "HEAVY", 3)
    rows = copies(1, 2, 150, 8)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    assert found(minhash.components(docs)) == brute(rows)
    assert found(minhash.components(docs, broadcast_rows=0)) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\ntwo "), (5, "one two"), (6, "one two three"), (None, "ONE two"), (None, None), (7, long), (8, long + " end"), (9, "a b c d e"), (10, "a b c d e f"), (11, "Ä b"), (12, "ä b"), (13, "lone"), (None, "only null ids"), (None, "only null ids")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).selectExpr("*", "'x' AS node", "1 AS key", "2 AS n", "'y' AS component", "'z' AS t")
    got = minhash.components(docs)
    assert found(got) == brute(rows) and got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert minhash.components(docs.limit(0)).count() == 0


def test_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(minhash.components(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_stars_reach_the_smallest_node(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HEAVY", 20)
    r = random.Random(5)
    chain = [(i, i + 1) for i in range(1000, 1100)]
    hub = [(5, i) for i in range(2000, 2300)]
    rest = [(r.randrange(3000, 3400), r.randrange(3000, 3400)) for _ in range(300)]
    edges = chain + hub + rest + hub[:9]
    got = {x.node: x.component for x in minhash.star_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    for node in near:
        seen, front = {node}, [node]
        while front:
            front = [y for x in front for y in near[x] - seen if not seen.add(y)]
        assert got[node] == min(seen)
    assert len(got) == len(near)


def test_signatures_estimate_similarity():
    r = random.Random(3)
    words = [str(r.random()).encode() for _ in range(4000)]
    for share in (0.2, 0.5, 0.85):
        both = int(3000 * share)
        a, b = set(words[:both] + words[both:3000:2]), set(words[:both] + words[both + 1 : 3000 : 2])
        agree = np.mean(minhash.signature(a) == minhash.signature(b))
        assert abs(agree - (share + (1 - share) / 256)) < 4 * np.sqrt(share * (1 - share) / 160)
    assert 95 < minhash.least_agreeing() < 115
