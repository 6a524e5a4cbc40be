"""Threshold gates over metrics in long form, and inventory checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_form(scores: DataFrame, prefix: str) -> DataFrame:
    """(metric, value) from one row of numeric columns; paths are dotted."""
    cols = scores.columns
    pairs = F.array(*(F.struct(F.lit(f"{prefix}.{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in cols))
    return scores.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")


def check(metrics: DataFrame, gates: list[tuple[str, str, float, float]]) -> DataFrame:
    """One row a gate (metric, kind, baseline, tolerance): `min` and `max` are relative to the baseline by the tolerance,
    `abs_min` and `abs_max` are limits themselves. A missing metric fails."""
    spark = metrics.sparkSession
    table = spark.createDataFrame(gates, "metric string, kind string, baseline double, tolerance double")
    v = F.col("value")
    ok = (
        F.when(F.col("kind") == "min", v >= F.col("baseline") - F.col("tolerance"))
        .when(F.col("kind") == "max", v <= F.col("baseline") + F.col("tolerance"))
        .when(F.col("kind") == "abs_min", v >= F.col("baseline"))
        .otherwise(v <= F.col("baseline"))
    )
    return F.broadcast(table).join(metrics, "metric", "left").select("metric", "kind", "value", "baseline", "tolerance", F.coalesce(ok, F.lit(False)).alias("passed"))


def reconcile(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, status) of keys on one side only: `missing` (expected, not observed) or `unlisted`. One full join."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(True))
    o = observed.select(key).distinct().withColumn("_o", F.lit(True))
    both = e.join(o, key, "full").where("_e IS NULL OR _o IS NULL")
    return both.select(key, F.when(F.col("_o").isNull(), "missing").otherwise("unlisted").alias("status"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def digests(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, n, low, high: a digest of each group's rows that depends neither on their order nor on how they are dealt. Every
    row's columns, each with its length so that no two rows read alike (null as `-`), give an MD5 whose first two runs of
    15 digits are summed up apart; repeated rows count each time."""
    text = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    row = F.md5(F.encode(F.concat(*map(text, columns)), "UTF-8"))
    lane = lambda at: F.sum(F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(20, 0)")).cast("decimal(38, 0)").cast("string")
    return rows.select(*by, row.alias("_h")).groupBy(*by).agg(F.count("*").alias("n"), lane(1).alias("low"), lane(16).alias("high"))


def stale(manifest: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """by, status: `same`, `changed`, `missing` (only in the manifest) or `new`, from two tables of digests()."""
    a = manifest.select(*by, F.struct("n", "low", "high").alias("_a"))
    b = current.select(*(F.col(c).alias(f"_{c}") for c in by), F.struct("n", "low", "high").alias("_b"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "new").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, on, "full").select(*(F.when(F.col("_a").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in by), status.alias("status"))
