"""Runs of poses by hand."""

from metrum.operators import runs

EVENTS = "case_id string, word_index long, idx long, k long, pose string"


def test_shares_by_hand(spark):
    # Word 0: a a b; word 1: b alone; word 2: a, c; word 3 lies among word 2's events and has a, b with one label only.
    events = [("x", 0, 0, 0, "a"), ("x", 0, 1, 1, "a"), ("x", 0, 2, 2, "b"), ("x", 1, 3, 0, "b"), ("x", 2, 4, 0, "a"), ("x", 3, 5, 0, "a"), ("x", 2, 6, 1, "c"), ("x", 3, 7, 1, "b")]
    labels = [("x", 0, 0, "a", 20), ("x", 0, 1, "a", 40), ("x", 0, 2, "b", 40), ("x", 2, 0, "a", 10), ("x", 2, 1, "c", 30), ("x", 2, 1, "c", -5), ("x", 3, 0, "a", 10), ("x", 3, 1, "a", 10)]
    # Step 0 is a tie that the first event wins; step 3 is too weak; event 9 isn't planned; word 2 isn't shown.
    samples = [("x", 0, 0, 0.5), ("x", 2, 0, 0.5), ("x", 1, 1, 0.6), ("x", 2, 1, 0.7), ("x", 2, 2, 0.3), ("x", 2, 3, 0.01), ("x", 9, 2, 1.0), ("x", 3, 2, 1.0)]
    s = lambda rows, kind: spark.createDataFrame(rows, kind)
    found = runs.shares(s(events, EVENTS), s(labels, "case_id string, word_index long, k long, pose string, length long"), s(samples, "case_id string, idx long, step long, weight double"), ["case_id"])
    rows = {(r.word_index, r.run): r for r in found.collect()}
    assert sorted(rows) == [(0, 0), (0, 1), (2, 0), (2, 1), (3, 0), (3, 1)]
    assert [(rows[0, i].pose, rows[0, i].gold, rows[0, i].shown) for i in (0, 1)] == [("a", 60, 1), ("b", 40, 2)]
    near = lambda x, y: abs(x - y) < 1e-9
    assert near(rows[0, 0].error, 0.6 - 1 / 3) and near(rows[0, 0].boundary_error, 0.6 - 1 / 3) and rows[0, 1].boundary_error is None and near(rows[0, 0].total_variation, 0.6 - 1 / 3)
    assert [rows[2, i].shown_share for i in (0, 1)] == [0.0, 0.0] and near(rows[2, 1].total_variation, 0.5) and [rows[3, i].gradeable for i in (0, 1)] == [False, False] and rows[3, 0].error is None
    g = runs.grade(found, ["case_id"]).collect()[0]
    assert (g.words, g.gradeable_words, g.ungradeable_words, g.dark_words, g.runs, g.near_runs, g.severe_words) == (3, 2, 1, 1, 4, 0, 2) and near(g.word_coverage, 2 / 3) and near(g.variation_mean, (0.6 - 1 / 3 + 0.5) / 2)


def test_empty_and_null(spark):
    none = lambda kind: spark.createDataFrame([], kind)
    e, l, s = none(EVENTS), none("case_id string, word_index long, k long, pose string, length long"), none("case_id string, idx long, step long, weight double")
    assert runs.shares(e, l, s, ["case_id"]).count() == 0 == runs.grade(runs.shares(e, l, s, ["case_id"]), ["case_id"]).count()
    got = runs.runs_of(spark.createDataFrame([("x", 0, 0, 0, None), ("x", 0, 1, 1, None), ("x", 0, 2, 2, "a")], EVENTS), ["case_id"]).orderBy("idx").collect()
    assert [r.run for r in got] == [0, 0, 1]
