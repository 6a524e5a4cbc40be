"""Activity regions of event streams, and joins between points and intervals.

Times are whole microseconds. A region is an interval of one case; cases never mix, so every operator partitions by
case, and the interval joins meet in time buckets besides, so a long case is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.functions.intervals import overlap


def gaps(points: DataFrame, case: str = "case_id", at: str = "t", tie: str = "event_id") -> DataFrame:
    """points with before (the earlier point's time, null for the first) and gap."""
    w = Window.partitionBy(case).orderBy(at, tie)
    return points.withColumn("before", F.lag(at).over(w)).withColumn("gap", F.col(at) - F.col("before"))


def islands(points: DataFrame, least_gap: int, hold: int = 0, case: str = "case_id", at: str = "t", tie: str = "event_id") -> DataFrame:
    """Regions (case_id, region, start, end, n): a gap of least_gap or more begins a new one; the end is held."""
    w = Window.partitionBy(case).orderBy(at, tie)
    new = (F.col("gap").isNull() | (F.col("gap") >= least_gap)).cast("int")
    numbered = gaps(points, case, at, tie).withColumn("region", (F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    return numbered.groupBy(F.col(case).alias("case_id"), "region").agg(F.min(at).alias("start"), (F.max(at) + hold).alias("end"), F.count("*").alias("n"))


def runs(rows: DataFrame, partition: list[str], order: list[str], key: list[str]) -> DataFrame:
    """rows with run: a number that grows where any column of key differs from the row before."""
    w = Window.partitionBy(*partition).orderBy(*order)
    new = F.lit(False)
    for k in key:
        new = new | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    first = F.row_number().over(w) == 1
    return rows.withColumn("_new", (new | first).cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def range_join(left: DataFrame, right: DataFrame, width: int, closed: bool = False, how: str = "inner") -> DataFrame:
    """Pairs of a case whose intervals meet: left (case_id, start, end), right (case_id, r_start, r_end).

    Both sides go to the time buckets that they cover; a pair is kept in the bucket where the later one starts, so it
    comes once and no distinct is needed. closed: touching ends meet, too."""
    cover = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor(F.greatest(s, e) / width)))
    a = left.withColumn("_b", cover(F.col("start"), F.col("end")))
    b = right.withColumnRenamed("case_id", "_case").withColumn("_rb", cover(F.col("r_start"), F.col("r_end")))
    meet = (F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end")) if closed else (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    at = F.floor(F.greatest(F.col("start"), F.col("r_start")) / width)
    on = (F.col("case_id") == F.col("_case")) & (F.col("_b") == F.col("_rb")) & meet & (F.col("_b") == at)
    return a.join(b, on, how).drop("_b", "_rb", "_case")


def best_overlap(spans: DataFrame, regions: DataFrame, width: int, nearest: bool = False) -> DataFrame:
    """spans (case_id, idx, start, end) with match: the region (r_idx, r_start, r_end) of the largest overlap, the first
    of several. Without overlap -1, or with `nearest` the region whose midpoint is closest, the first of several."""
    pairs = range_join(spans, regions, width)
    score = F.struct(overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")), -F.col("r_idx"))
    found = pairs.groupBy("case_id", "idx").agg(F.max_by("r_idx", score).alias("match"), F.max(overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).alias("shared"))
    out = spans.join(found, ["case_id", "idx"], "left")
    if not nearest:
        return out.select("case_id", "idx", F.coalesce("match", F.lit(-1)).alias("match"), F.coalesce("shared", F.lit(0)).alias("shared"))
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    # Only spans without overlap look further: by their neighbours in the order of midpoints, not by all regions.
    lone = out.where(F.col("match").isNull()).select("case_id", "idx", mid.alias("at"))
    near = nearest_point(lone, regions.select("case_id", "r_idx", F.floor((F.col("r_start") + F.col("r_end")) / 2).alias("r_at")))
    return out.join(near, ["case_id", "idx"], "left").select("case_id", "idx", F.coalesce("match", "near", F.lit(-1)).alias("match"), F.coalesce("shared", F.lit(0)).alias("shared"))


def nearest_point(points: DataFrame, targets: DataFrame) -> DataFrame:
    """points (case_id, idx, at) with near: the r_idx of the closest target (r_at), the smallest of several. One sort of
    both kinds together; each point sees the last target at or before it and the first after it."""
    one = targets.groupBy("case_id", "r_at").agg(F.min("r_idx").alias("r_idx"))
    rows = points.select("case_id", "at", "idx", F.lit(None).cast("long").alias("r_at"), F.lit(None).cast("int").alias("r_idx"), F.lit(1).alias("kind"))
    rows = rows.unionByName(one.select("case_id", F.col("r_at").alias("at"), F.lit(None).cast(points.schema["idx"].dataType).alias("idx"), "r_at", F.col("r_idx").cast("int").alias("r_idx"), F.lit(0).alias("kind")))
    w = Window.partitionBy("case_id").orderBy("at", "kind", "idx")
    t = F.when(F.col("kind") == 0, F.struct("r_at", "r_idx"))
    back = F.last(t, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(t, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    seen = rows.withColumn("b", back).withColumn("a", ahead).where("kind = 1")
    db, da = F.col("at") - F.col("b.r_at"), F.col("a.r_at") - F.col("at")
    pick = F.when(db.isNull(), F.col("a.r_idx")).when(da.isNull() | (db < da), F.col("b.r_idx")).when(da < db, F.col("a.r_idx")).otherwise(F.least("a.r_idx", "b.r_idx"))
    return seen.select("case_id", "idx", pick.alias("near"))


def owner_of_point(points: DataFrame, regions: DataFrame, width: int, tolerance: int) -> DataFrame:
    """points (case_id, idx, at) with owner: the region with start <= at <= end + tolerance if it is the only one, else
    -1."""
    spans = points.withColumn("start", F.col("at")).withColumn("end", F.col("at"))
    wide = regions.withColumn("r_end", F.col("r_end") + tolerance)
    found = range_join(spans, wide, width, closed=True).groupBy("case_id", "idx").agg(F.count("*").alias("k"), F.min("r_idx").alias("r"))
    return points.join(found, ["case_id", "idx"], "left").select("case_id", "idx", F.when(F.col("k") == 1, F.col("r")).otherwise(F.lit(-1)).alias("owner"))


def split_rule(mark: Column, gap: Column, hard: float, comma: float, strong: float) -> Column:
    """Whether a gap parts regions: hard marks from `hard` on, commas from `comma` on, all from `strong`, and from 1.5
    times comma at least, on."""
    return (F.coalesce(mark, F.lit("")) == "hard") & (gap >= hard) | (F.coalesce(mark, F.lit("")) == "comma") & (gap >= comma) | (gap >= max(strong, 1.5 * comma))


def interpolate_centres(rows: DataFrame, step: float, partition: list[str], order: str, value: str = "centre") -> DataFrame:
    """rows with filled: known centres, straight lines between them, `step` a row after the last; before the first a
    line from max(0, first - step * its place) at row 0; step times the place where none is known."""
    w = Window.partitionBy(*partition).orderBy(order)
    n = F.row_number().over(w) - 1
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    numbered = rows.withColumn("_i", n).withColumn("_k", known)
    seen = numbered.withColumn("_l", F.last("_k", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.first("_k", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    i, l, r = F.col("_i"), F.col("_l"), F.col("_r")
    first = F.greatest(F.lit(0.0), r["v"] - step * r["i"])
    lead = F.when(r["i"] == 0, r["v"]).otherwise(first + (r["v"] - first) * i / r["i"])
    inner = F.when(r["i"] == l["i"], l["v"]).otherwise(l["v"] + (r["v"] - l["v"]) * (i - l["i"]) / (r["i"] - l["i"]))
    filled = F.when(l.isNull() & r.isNull(), step * i).when(l.isNull(), lead).when(r.isNull(), l["v"] + step * (i - l["i"])).otherwise(inner)
    return seen.withColumn("filled", filled).drop("_i", "_k", "_l", "_r")

