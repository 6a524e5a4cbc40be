"""Alignments that are cut at gaps against tables over the whole sequences; digests and staleness of tables."""

import random

import numpy as np
import pytest

from metrum.operators import alignment, gates


def whole_match(a, b, limit):
    """One table over all items; skipping a's item wins over skipping b's, and both over a match that is no better."""
    n, m = len(a), len(b)
    best = {(i, j): (0, 0, 0.0) for i in range(n + 1) for j in range(m + 1) if i == n or j == m}
    how = {}
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            options = [(best[i + 1, j], "a"), (best[i, j + 1], "b")]
            d = abs(a[i][0] - b[j][0])
            if a[i][1] == b[j][1] and d <= limit:
                k, w, e = best[i + 1, j + 1]
                options.append(((k + 1, w + (a[i][2] == b[j][2]), e - d), "both"))
            best[i, j], how[i, j] = options[0]
            for value, name in options[1:]:
                if value > best[i, j]:
                    best[i, j], how[i, j] = value, name
    out, i, j = [], 0, 0
    while i < n and j < m:
        step = how[i, j]
        if step == "both":
            out.append((i, j))
        i, j = i + (step != "b"), j + (step != "a")
    return out


def test_matches_equal_those_of_one_table():
    r = random.Random(1)
    for _ in range(400):
        side = lambda: sorted(((float(r.randrange(60)), r.choice("xy"), r.choice("uvw")) for _ in range(r.randrange(14))), key=lambda e: e[0])
        a, b, limit = side(), side(), r.choice([0, 1, 3, 8])
        assert alignment.match_events(a, b, limit) == whole_match(a, b, limit)


def least_cost(a, b):
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1))
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            if i == n or j == m:
                cost[i, j] = n - i + m - j
                continue
            both = max(0, min(a[i][1], b[j][1]) - max(a[i][0], b[j][0]))
            union = a[i][1] - a[i][0] + b[j][1] - b[j][0] - both
            cost[i, j] = min(cost[i + 1, j] + 1, cost[i, j + 1] + 1, cost[i + 1, j + 1] + 1 - both / union if both > 0 else np.inf)
    return cost[0, 0]


@pytest.mark.parametrize("whole", [True, False])
def test_spans_have_the_least_cost(whole):
    r = random.Random(2)
    for _ in range(400):
        def side():
            out, t = [], 0.0
            for _ in range(r.randrange(9)):
                s = t + (r.randrange(4) if whole else r.random() * 4)
                t = s + (r.randrange(5) if whole else r.random() * 5)
                out.append((s, t))
            return out
        a, b = side(), side()
        got = alignment.align_spans(a, b)
        assert sorted(i for i, _, _ in got if i >= 0) == list(range(len(a))) and sorted(j for _, j, _ in got if j >= 0) == list(range(len(b)))
        pairs = sorted((i, j) for i, j, _ in got if i >= 0 and j >= 0)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert abs(sum(1 - s if i >= 0 and j >= 0 else 1 for i, j, s in got) - least_cost(a, b)) < 1e-9


def test_long_cases_take_no_square_table():
    a = [(float(3 * i), "x", "u") for i in range(30_000)]
    assert len(alignment.match_events(a, [(t + 1, k, w) for t, k, w in a], 1.0)) == 30_000
    spans = [(10.0 * i, 10.0 * i + 4) for i in range(30_000)]
    assert all(i == j for i, j, _ in alignment.align_spans(spans, [(s + 1, e + 1) for s, e in spans]))


def test_digests(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, None), ("b", 3, ""), (None, 4, "1:x"), ("c", 5, "y")]
    schema = "g string, k long, t string"
    one = gates.digests(spark.createDataFrame(rows, schema), ["g"], ["k", "t"])
    again = gates.digests(spark.createDataFrame(rows[::-1], schema).repartition(5), ["g"], ["k", "t"])
    assert sorted(map(repr, one.collect())) == sorted(map(repr, again.collect()))
    other = [("a", 1, "x"), ("a", 2, None), ("a", 2, None), ("b", 3, None), (None, 4, "1:x"), ("d", 6, "z")]
    got = {r.g: r.status for r in gates.stale(one, gates.digests(spark.createDataFrame(other, schema), ["g"], ["k", "t"]), ["g"]).collect()}
    assert got == {"a": "changed", "b": "changed", None: "same", "c": "missing", "d": "new"}
    assert gates.stale(one.limit(0), one.limit(0), ["g"]).count() == 0
