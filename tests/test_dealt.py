"""Texts are dealt before their words are listed; softmaxes are computed once a frame."""

from metrum import session
from metrum.operators import validation
from metrum.plans import catalogue

SF = "/root/testdata/sf0.001"


def lines(df, what):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if what in x]


def test_only_texts_are_exchanged(spark):
    for name in ("text_plan", "transcript_tensor"):
        df = catalogue.QUERIES[name](spark, SF)
        assert len(lines(df, "Exchange hashpartitioning")) == 1 and not lines(df, "SortMergeJoin")
    assert len(lines(catalogue.QUERIES["pause_classes"](spark, SF), "Exchange hashpartitioning(conv_id")) == 1
    assert "REPARTITION_BY_NUM" in lines(catalogue.QUERIES["context_preference"](spark, SF), "Exchange hashpartitioning(conv_id")[0]


def test_tasks_grow_with_the_input(spark, monkeypatch):
    d = session.table(spark, SF, "conversations")
    monkeypatch.setattr(session, "DEALT_BYTES", 1000)
    assert session.dealt(d, "conv_id", "turn").rdd.getNumPartitions() > 8


def test_softmax_is_computed_once_a_frame(spark):
    frames = spark.createDataFrame([("x", 0, 0, [(0, 1.0), (1, 0.0)]), ("x", 1, 1, None), ("x", 2, None, [])], "case_id string, frame long, target long, scores array<struct<token: long, score: double>>")
    tokens = spark.createDataFrame([("x", 0, True, False), ("x", 1, False, True)], "case_id string, token long, word_start boolean, word_end boolean")
    found = validation.word_losses(tokens, frames, ["case_id"])
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("exp(") == 1
    # Both tokens are the word's: the first frame is sure, the second has no scores.
    assert abs(found.collect()[0].loss - 0.5 * 6 * 2.302585092994046) < 1e-5
