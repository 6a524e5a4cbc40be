"""Weights in steps against the whole curve, and plans that stay small."""

from pyspark.sql import functions as F

from metrum.operators import envelopes as env
from metrum.plans import presentation_queries as q

SF = "/root/testdata/sf0.001"


def test_weight_in_steps_is_the_whole_curve(spark):
    rows = [(a, min(a + 9, c), max(c, r - 7), r, c, n, s, a, r, d) for a in (0, 5) for c in (2, 10, 20) for r in (15, 30) for n in (True, False) for s in (-0.5, 0.3, 1.5) for d in (True, False)]
    found = spark.createDataFrame(rows, "attack long, attack_end long, release_start long, release long, centre long, nucleus boolean, strength double, start long, end long, turns boolean").withColumn("t", F.explode(F.sequence(F.lit(-2), F.lit(33))))
    both = env.weighed(found, F.col("t"), 1000).withColumn("whole", env.weight(F.col("t"), 1000))
    assert both.where("_w <> whole OR _w IS NULL").count() == 0 and both.where("_w > 0 AND _w < 0.3").count() > 100


def test_curves_are_computed_once_and_samples_are_not_exchanged(spark):
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    # The curve's last constant stands once for each place that computes it.
    _, shown = q._shown(spark, SF)
    assert plan(q._seen(shown)).count("15.0") == 1 and "lambda" not in plan(q._seen(shown))
    of = q._run_shares(spark, SF)
    assert plan(of).count("15.0") == 1
    assert not any("step#" in x for x in of._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x)
