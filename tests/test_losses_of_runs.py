"""Losses that are summed over runs are those of the frames one by one, and no frame is exchanged or written."""

import random

import pytest
from metrum.operators import validation as v
from metrum.plans import catalogue
from pyspark.sql import functions as F

from tests.test_validation import TOKENS, _token

SF = "/root/testdata/sf0.001"


def _scores():
    near = [F.col("decoded") + k for k in (-1, 0, 1)]
    return [(F.when((t >= 0) & (t <= F.col("top")), t), (F.col("frame") * 7 + t * 13) % 10 / -10.0 - F.abs(t - F.col("decoded"))) for t in near]


def _tokens(seed):
    """Words that begin before the last one ended, tokens of no word, tokens that no frame shows, a case of one token."""
    r, rows = random.Random(seed), []
    for case in ("a", "b", "c"):
        at = 0
        for i in range({"a": 60, "b": 1, "c": 25}[case]):
            at += r.choice([0, 0, 1, 3, 60])
            flags = [f for f in ("silent", "vowel", "word_start", "word_end", "region_start", "region_end", "sentence_end") if r.random() < 0.3]
            rows.append((*_token(case, i, at, *flags, duration=float(r.choice([1, 2, 8])), confidence=r.choice([0.0, 0.5, 1.0]), role=r.randrange(4)), float(at + r.randint(-9, 9))))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_lose_what_frames_lose(spark, seed):
    t, speech = spark.createDataFrame(_tokens(seed), TOKENS + ", late double"), (F.col("frame") * 5 % 13 - 6) / 2.0
    listed = F.filter(F.array(*(F.struct(k.alias("token"), x.alias("score")) for k, x in _scores())), lambda s: s["token"].isNotNull())
    frames = v.frames_of(v.runs(t, ["case_id"], 2), 2).withColumn("scores", listed).withColumn("speech", speech)
    rows = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())
    names = ["case_id", "first", "last", "weight", "loss"]
    found = v.interval_losses_of_runs(t, ["case_id"], 2, _scores())
    assert rows(found.where("item = 'word'").select(names)) == rows(v.word_losses(t, frames, ["case_id"]).select(names))
    assert rows(found.where("item = 'phone'").select(names)) == rows(v.phone_losses(t, frames, ["case_id"]).select(names))
    want = v.losses(t, frames, ["case_id"])
    assert rows(v.losses_of_runs(t, ["case_id"], 2, _scores(), speech).select(want.columns)) == rows(want)


def test_only_events_are_exchanged(spark):
    for name in ("validation_loss", "interval_losses"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan and "events.parquet" in plan


def test_no_tokens(spark):
    none = spark.createDataFrame([], TOKENS + ", late double")
    assert v.losses_of_runs(none, ["case_id"], 2, _scores(), F.lit(0.0)).count() == 0 == v.interval_losses_of_runs(none, ["case_id"], 2, _scores()).count()
