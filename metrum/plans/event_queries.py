"""Queries over the event stream: regions, joins of intervals, activity, scorecards and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from metrum.functions import intervals, stats
from metrum.operators import regions, sampling
from metrum.plans import adapters
from metrum.plans.adapters import DAY, EVENTS_SQL, GOLD_SQL, HOUR, PRED_SQL

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


BOTH = f"WITH {EVENTS_SQL}, {GOLD_SQL}, {PRED_SQL}"


def ordered() -> WindowSpec:
    return Window.partitionBy("case_id").orderBy("t", "event_id")


@query(f"WITH {EVENTS_SQL}, {GOLD_SQL} SELECT case_id, region, s AS start_us, e AS end_us, n AS n_events FROM gold")
def pause_regions(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.gold(spark, sf).select("case_id", "region", F.col("start").alias("start_us"), F.col("end").alias("end_us"), F.col("n").alias("n_events"))


@query(f"""WITH {EVENTS_SQL}, b AS (
    SELECT case_id, event_id, t - lag(t) OVER w AS gap, lag(event_type) OVER w AS mark FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY t, event_id))
    SELECT case_id, event_id, gap, coalesce(mark, '') AS mark,
      (mark = 'error' AND gap >= {9 * HOUR}) OR (mark = 'click' AND gap >= {12 * HOUR}) OR gap >= {18 * HOUR} AS split
    FROM b WHERE gap IS NOT NULL""")
def pause_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps between neighbours, and whether they part regions by the mark before them."""
    b = regions.gaps(adapters.events(spark, sf)).withColumn("mark", F.lag("event_type").over(ordered())).where("gap IS NOT NULL")
    kind = F.when(F.col("mark") == "error", "hard").when(F.col("mark") == "click", "comma").otherwise("")
    return b.select("case_id", "event_id", "gap", F.coalesce("mark", F.lit("")).alias("mark"), regions.split_rule(kind, F.col("gap"), 9 * HOUR, 12 * HOUR, 16 * HOUR).alias("split"))


OVERLAP = """p AS (SELECT g.case_id, g.region AS idx, p.region AS r, greatest(0, least(g.e, p.e) - greatest(g.s, p.s)) AS shared, g.s AS gs, g.e AS ge, p.s AS ps, p.e AS pe
    FROM gold g JOIN pred p ON g.case_id = p.case_id AND g.s < p.e AND p.s < g.e),
    best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY case_id, idx ORDER BY shared DESC, r) = 1)"""


@query(f"""{BOTH}, {OVERLAP} SELECT g.case_id, g.region AS idx, coalesce(b.r, -1) AS match, coalesce(b.shared, 0) AS shared,
    round(coalesce(CAST(b.shared AS DOUBLE) / ((b.ge - b.gs) + (b.pe - b.ps) - b.shared), 0), 6) AS iou
    FROM gold g LEFT JOIN best b ON g.case_id = b.case_id AND g.region = b.idx""")
def region_overlap_match(spark: SparkSession, sf: str) -> DataFrame:
    left, right = adapters.as_left(adapters.gold(spark, sf)), adapters.as_right(adapters.predicted(spark, sf))
    found = regions.best_overlap(left, right, DAY).join(left, ["case_id", "idx"]).join(right.withColumnRenamed("r_idx", "match"), ["case_id", "match"], "left")
    iou = F.coalesce(intervals.iou(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")), F.lit(0.0))
    return found.select("case_id", "idx", "match", "shared", F.round(F.when(F.col("match") < 0, 0.0).otherwise(iou), 6).alias("iou"))


@query(f"""{BOTH}, pts AS (SELECT case_id, event_id AS idx, t + {HOUR // 2} AS at FROM ev),
    m AS (SELECT pts.case_id, pts.idx, count(*) AS k, min(p.region) AS r FROM pts JOIN pred p ON pts.case_id = p.case_id AND p.s <= pts.at AND pts.at <= p.e + {HOUR // 10} GROUP BY ALL)
    SELECT pts.case_id, pts.idx, CASE WHEN k = 1 THEN r ELSE -1 END AS owner FROM pts LEFT JOIN m ON pts.case_id = m.case_id AND pts.idx = m.idx""")
def region_point_ownership(spark: SparkSession, sf: str) -> DataFrame:
    points = adapters.events(spark, sf).select("case_id", F.col("event_id").alias("idx"), (F.col("t") + HOUR // 2).alias("at"))
    return regions.owner_of_point(points, adapters.as_right(adapters.predicted(spark, sf)), DAY, HOUR // 10)


@query(f"""{BOTH}, {OVERLAP}, per_p AS (SELECT case_id, r, count(*) AS k FROM p GROUP BY ALL), per_g AS (SELECT case_id, idx, count(*) AS k FROM p GROUP BY ALL)
    SELECT c.case_id, coalesce(a.merges, 0) AS merges, coalesce(b.splits, 0) AS splits, coalesce(b.matched, 0) AS matched
    FROM (SELECT DISTINCT case_id FROM gold) c LEFT JOIN (SELECT case_id, count_if(k > 1) AS merges FROM per_p GROUP BY 1) a ON a.case_id = c.case_id
    LEFT JOIN (SELECT case_id, count_if(k > 1) AS splits, count(*) AS matched FROM per_g GROUP BY 1) b ON b.case_id = c.case_id""")
def region_merge_split(spark: SparkSession, sf: str) -> DataFrame:
    """A predicted region that meets several gold ones is a merge; a gold one that meets several is a split."""
    left, right = adapters.as_left(adapters.gold(spark, sf)), adapters.as_right(adapters.predicted(spark, sf))
    pairs = regions.range_join(left, right, DAY).select("case_id", "idx", "r_idx")
    a = pairs.groupBy("case_id", "r_idx").count().groupBy("case_id").agg(F.count_if(F.col("count") > 1).alias("merges"))
    b = pairs.groupBy("case_id", "idx").count().groupBy("case_id").agg(F.count_if(F.col("count") > 1).alias("splits"), F.count("*").alias("matched"))
    return left.select("case_id").distinct().join(a, "case_id", "left").join(b, "case_id", "left").na.fill(0)


@query(f"""{BOTH}, {OVERLAP}, lone AS (SELECT g.case_id, g.region AS idx, (g.s + g.e) // 2 AS at FROM gold g WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.case_id = g.case_id AND b.idx = g.region)),
    near AS (SELECT l.case_id, l.idx, p.region AS r FROM lone l JOIN pred p ON l.case_id = p.case_id QUALIFY row_number() OVER (PARTITION BY l.case_id, l.idx ORDER BY abs((p.s + p.e) // 2 - l.at), p.region) = 1)
    SELECT g.case_id, g.region AS idx, coalesce(b.r, n.r, -1) AS match, coalesce(b.shared, 0) AS shared FROM gold g
    LEFT JOIN best b ON g.case_id = b.case_id AND g.region = b.idx LEFT JOIN near n ON g.case_id = n.case_id AND g.region = n.idx""")
def region_nearest_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return regions.best_overlap(adapters.as_left(adapters.gold(spark, sf)), adapters.as_right(adapters.predicted(spark, sf)), DAY, nearest=True)


@query(f"""{BOTH}, {OVERLAP} SELECT case_id, count(*) AS pairs, count_if(ps < gs) AS early, count_if(pe > ge) AS late,
    floor(avg(greatest(gs - ps, 0)) / 1000 * 1e3 + 0.5) / 1e3 AS mean_early_ms, max(greatest(pe - ge, 0)) AS max_late_us FROM best GROUP BY 1""")
def region_containment_leak(spark: SparkSession, sf: str) -> DataFrame:
    """How far matched regions reach out of the gold ones."""
    left, right = adapters.as_left(adapters.gold(spark, sf)), adapters.as_right(adapters.predicted(spark, sf))
    m = regions.best_overlap(left, right, DAY).where("match >= 0").join(left, ["case_id", "idx"]).join(right.withColumnRenamed("r_idx", "match"), ["case_id", "match"])
    early, late = F.greatest(F.col("start") - F.col("r_start"), F.lit(0)), F.greatest(F.col("r_end") - F.col("end"), F.lit(0))
    return m.groupBy("case_id").agg(F.count("*").alias("pairs"), F.count_if(early > 0).alias("early"), F.count_if(late > 0).alias("late"), stats.half_up(F.avg(early) / 1000.0, 3).alias("mean_early_ms"), F.max(late).alias("max_late_us"))


@query(f"""WITH {EVENTS_SQL}, {adapters.islands_sql("six", 6, "true", 0)} SELECT case_id, count(*) AS sessions, max(n) AS longest, sum(e - s) AS active_us, count_if(n = 1) AS single
    FROM six GROUP BY 1""")
def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = regions.islands(adapters.events(spark, sf), 6 * HOUR)
    return s.groupBy("case_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.sum(F.col("end") - F.col("start")).alias("active_us"), F.count_if(F.col("n") == 1).alias("single"))


@query(f"""WITH {EVENTS_SQL}, b AS (SELECT case_id, t // {6 * HOUR} AS bin, sqrt(avg(value * value)) AS rms FROM ev GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rms, bin) - 1 AS place, count(*) OVER (PARTITION BY case_id) AS n, max(rms) OVER (PARTITION BY case_id) AS peak FROM b),
    f AS (SELECT case_id, max(CASE WHEN place = greatest(0, CAST(floor(0.2 * n) AS BIGINT) - 1) THEN rms END) AS floor_, max(peak) AS peak FROM o GROUP BY 1)
    SELECT b.case_id, round(any_value(f.floor_), 6) AS noise_floor, count_if(rms >= f.floor_ + 0.25 * (f.peak - f.floor_)) AS active_bins, count(*) AS bins
    FROM b JOIN f ON b.case_id = f.case_id GROUP BY b.case_id""")
def activity_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Energy by time bin; the floor is the order statistic at max(0, floor(0.2 n) - 1)."""
    bins = adapters.events(spark, sf).groupBy("case_id", F.floor(F.col("t") / (6 * HOUR)).alias("bin")).agg(stats.rms(F.col("value")).alias("rms"))
    by = bins.groupBy("case_id").agg(F.array_sort(F.collect_list("rms")).alias("rms"), F.max("rms").alias("peak"))
    n = F.size("rms")
    floor_ = F.get("rms", F.greatest(F.floor(F.lit(0.2) * n) - 1, F.lit(0)).cast("int"))
    told = by.withColumn("floor_", floor_)
    active = F.size(F.filter("rms", lambda x: x >= F.col("floor_") + 0.25 * (F.col("peak") - F.col("floor_"))))
    return told.select("case_id", F.round("floor_", 6).alias("noise_floor"), active.cast("long").alias("active_bins"), n.cast("long").alias("bins"))


@query(f"""WITH RECURSIVE {EVENTS_SQL}, r AS (SELECT case_id, event_id, value, row_number() OVER (PARTITION BY case_id ORDER BY t, event_id) AS i,
      lag(value) OVER (PARTITION BY case_id ORDER BY t, event_id) AS before FROM ev),
    d AS (SELECT case_id, event_id, i, value, before, greatest(0.995 * 0.0001, value) AS peak, CASE WHEN value >= 0.995 * 0.0001 THEN value END AS peak_value, CASE WHEN value >= 0.995 * 0.0001 THEN 0 END AS peak_age FROM r WHERE i = 1
      UNION ALL SELECT r.case_id, r.event_id, r.i, r.value, r.before, greatest(0.995 * d.peak, r.value), CASE WHEN r.value >= 0.995 * d.peak THEN r.value ELSE d.peak_value END, CASE WHEN r.value >= 0.995 * d.peak THEN 0 ELSE d.peak_age + 1 END
        FROM d JOIN r ON r.case_id = d.case_id AND r.i = d.i + 1)
    SELECT case_id, event_id, round(coalesce(value - before, 0), 6) AS delta, round(greatest(coalesce(value - before, 0), 0), 6) AS flux, peak_value, CAST(peak_age AS INTEGER) AS peak_age FROM d""")
def delta_flux_decay(spark: SparkSession, sf: str) -> DataFrame:
    """Change from the row before, its positive part, and of a running maximum that decays by 0.995 a row the value it
    comes from and how many rows ago that was, as both are exact where the product is rounded (null: the floor)."""
    d = F.coalesce(F.col("value") - F.lag("value").over(ordered()), F.lit(0.0))
    rows = adapters.events(spark, sf).withColumn("delta", d)
    return sampling.decaying_max(rows, "value", 0.995, 1e-4, ["case_id"], ["t", "event_id"]).select("case_id", "event_id", F.round("delta", 6).alias("delta"), F.round(F.greatest("delta", F.lit(0.0)), 6).alias("flux"), "peak_value", "peak_age")


@query(f"""WITH {EVENTS_SQL} SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90,
    round(avg(value), 6) AS mean, max(value) AS most, round(sqrt(avg(value * value)), 6) AS rms FROM ev GROUP BY 1""")
def percentile_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return adapters.events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.round(stats.percentile(v, 0.5), 6).alias("median"), F.round(stats.percentile(v, 0.9), 6).alias("p90"), F.round(stats.mean(v), 6).alias("mean"), F.max(v).alias("most"), F.round(stats.rms(v), 6).alias("rms"))


@query(f"""WITH {EVENTS_SQL}, k AS (SELECT case_id, t // {HOUR} % 24 AS hour, count(*) AS n FROM ev GROUP BY ALL)
    SELECT case_id, hour AS busiest_hour, n FROM k QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, hour) = 1""")
def mode_tie_smallest(spark: SparkSession, sf: str) -> DataFrame:
    k = adapters.events(spark, sf).groupBy("case_id", (F.floor(F.col("t") / HOUR) % 24).alias("hour")).agg(F.count("*").alias("n"))
    return k.groupBy("case_id").agg(stats.mode_smallest(F.col("hour"), F.col("n")).alias("busiest_hour"), F.max("n").alias("n"))


@query(f"""WITH {EVENTS_SQL}, {GOLD_SQL}, {PRED_SQL}, w AS (SELECT a.case_id, a.event_id, a.t, a.region AS g, b.region AS p FROM gold_n a JOIN pred_n b ON a.event_id = b.event_id),
    s AS (SELECT case_id, g <> lag(g) OVER v AS gold_split, p <> lag(p) OVER v AS pred_split FROM w WINDOW v AS (PARTITION BY case_id ORDER BY t, event_id)),
    c AS (SELECT case_id, count_if(gold_split AND pred_split) AS tp, count_if(NOT gold_split AND pred_split) AS fp, count_if(gold_split AND NOT pred_split) AS fn FROM s GROUP BY 1)
    SELECT case_id, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision_,
      round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
      round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1 FROM c""")
def split_precision_recall_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of region between neighbouring events, predicted against gold."""
    ev = adapters.events(spark, sf)

    def numbered(rows: DataFrame, gap: int, name: str) -> DataFrame:
        new = (F.col("gap").isNull() | (F.col("gap") >= gap)).cast("int")
        return regions.gaps(rows).withColumn(name, F.sum(new).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))

    g = numbered(ev, 8 * HOUR, "g").select("case_id", "event_id", "t", "g")
    p = numbered(ev.where(~F.col("event_type").isin("error", "view")), 12 * HOUR, "p").select("case_id", "event_id", "p")
    w = g.join(p, ["case_id", "event_id"]).withColumn("gs", F.col("g") != F.lag("g").over(ordered())).withColumn("ps", F.col("p") != F.lag("p").over(ordered()))
    c = w.groupBy("case_id").agg(F.count_if(F.col("gs") & F.col("ps")).alias("tp"), F.count_if(~F.col("gs") & F.col("ps")).alias("fp"), F.count_if(F.col("gs") & ~F.col("ps")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("case_id", "tp", "fp", "fn", F.round(intervals.ratio(tp, tp + fp), 6).alias("precision_"), F.round(intervals.ratio(tp, tp + fn), 6).alias("recall"), F.round(intervals.ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


GRID_SQL = f"""grid AS (SELECT case_id, region, s, e, unnest(generate_series(0, (e - s) // {HOUR // 2})) AS step FROM gold)"""


@query(f"""WITH {EVENTS_SQL}, {GOLD_SQL}, {GRID_SQL}, x AS (SELECT case_id, region, step, least(1.0, greatest(0.0, step * {HOUR // 2} / CAST({HOUR} AS DOUBLE))) AS up, least(1.0, greatest(0.0, (e - s - step * {HOUR // 2}) / CAST({HOUR} AS DOUBLE))) AS down FROM grid)
    SELECT case_id, region, step, round(least(up * up * up * (10 + up * (6 * up - 15)), down * down * down * (10 + down * (6 * down - 15))), 6) AS weight FROM x""")
def envelope_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every half hour of a region, an envelope that rises and falls over an hour by a minimum-jerk curve."""
    return sampling.envelope(sampling.grid(adapters.gold(spark, sf), HOUR // 2), HOUR // 2, HOUR).select("case_id", "region", F.col("step").cast("long").alias("step"), F.round("weight", 6).alias("weight"))


@query(f"""WITH {EVENTS_SQL}, {GOLD_SQL}, {GRID_SQL}, pulse AS (SELECT g.case_id, g.region, g.step, max(greatest(0.0, CASE WHEN v.t <= g.s + g.step * {HOUR // 2} THEN 1 - (g.s + g.step * {HOUR // 2} - v.t) / CAST({2 * HOUR} AS DOUBLE) ELSE 1 - (v.t - g.s - g.step * {HOUR // 2}) / CAST({HOUR} AS DOUBLE) END)) AS w
      FROM grid g JOIN ev v ON v.case_id = g.case_id AND v.event_type = 'purchase' AND v.t > g.s + g.step * {HOUR // 2} - {2 * HOUR} AND v.t < g.s + g.step * {HOUR // 2} + {HOUR} GROUP BY ALL)
    SELECT g.case_id, g.region, g.step, round(coalesce(p.w, 0), 6) AS pulse FROM grid g LEFT JOIN pulse p ON g.case_id = p.case_id AND g.region = p.region AND g.step = p.step""")
def stress_pulse(spark: SparkSession, sf: str) -> DataFrame:
    """A pulse around each purchase, an hour up and two down; the largest of overlapping ones."""
    g = sampling.grid(adapters.gold(spark, sf), HOUR // 2).withColumn("at", F.col("start") + F.col("step") * (HOUR // 2))
    marks = adapters.events(spark, sf).where("event_type = 'purchase'").select("case_id", (F.col("t") - HOUR).alias("r_start"), (F.col("t") + 2 * HOUR).alias("r_end"), F.col("t").alias("m"))
    spans = g.select("case_id", "region", "step", F.col("at").alias("start"), (F.col("at") + 1).alias("end"))
    hit = regions.range_join(spans, marks, DAY)
    late, early = F.col("start") - F.col("m"), F.col("m") - F.col("start")
    w = F.greatest(F.lit(0.0), F.when(late >= 0, 1 - late / float(2 * HOUR)).otherwise(1 - early / float(HOUR)))
    top = hit.groupBy("case_id", "region", "step").agg(F.max(w).alias("w"))
    return g.select("case_id", "region", "step").join(top, ["case_id", "region", "step"], "left").select("case_id", "region", F.col("step").cast("long").alias("step"), F.round(F.coalesce("w", F.lit(0.0)), 6).alias("pulse"))


@query(f"""WITH {EVENTS_SQL}, {GOLD_SQL}, ph AS (SELECT case_id, region, s, e, CAST(unnest([0, 1, 2]) AS BIGINT) AS phase FROM gold),
    g AS (SELECT *, unnest(generate_series(0, (e - s - phase * {HOUR // 3}) // {HOUR})) AS step FROM ph WHERE e - s >= phase * {HOUR // 3}),
    v AS (SELECT g.case_id, g.region, g.phase, count(*) AS samples FROM g JOIN ev ON ev.case_id = g.case_id AND ev.event_type = 'click' AND ev.t BETWEEN g.s + g.phase * {HOUR // 3} + g.step * {HOUR} - {HOUR // 2} AND g.s + g.phase * {HOUR // 3} + g.step * {HOUR} + {HOUR // 2} GROUP BY ALL),
    a AS (SELECT p.case_id, p.region, p.phase, coalesce(v.samples, 0) AS samples FROM ph p LEFT JOIN v ON v.case_id = p.case_id AND v.region = p.region AND v.phase = p.phase)
    SELECT case_id, region, min(samples) AS least, bool_and(samples > 0) AS robust, count_if(samples > 0) AS phases FROM a GROUP BY ALL""")
def visibility_phases(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of clicks on hourly grids in three phases; robust if every phase has one."""
    third = HOUR // 3
    ph = adapters.gold(spark, sf).withColumn("phase", F.explode(F.array(*(F.lit(k).cast("long") for k in range(3)))))
    g = sampling.grid(ph.where(F.col("end") - F.col("start") >= F.col("phase") * third).withColumn("start", F.col("start") + F.col("phase") * third), HOUR)
    at = F.col("start") + F.col("step") * HOUR
    spans = g.select("case_id", "region", "phase", (at - HOUR // 2).alias("s0"), (at + HOUR // 2).alias("e0")).withColumnsRenamed({"s0": "start", "e0": "end"})
    clicks = adapters.events(spark, sf).where("event_type = 'click'").select("case_id", F.col("t").alias("r_start"), F.col("t").alias("r_end"))
    v = regions.range_join(spans, clicks, DAY, closed=True).groupBy("case_id", "region", "phase").agg(F.count("*").alias("samples"))
    a = ph.select("case_id", "region", "phase").join(v, ["case_id", "region", "phase"], "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    return a.groupBy("case_id", "region").agg(F.min("samples").alias("least"), F.min(F.col("samples") > 0).alias("robust"), F.count_if(F.col("samples") > 0).alias("phases"))


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT case_id, event_id, t, value - lag(value) OVER w AS step FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY t, event_id)),
    a AS (SELECT *, step - lag(step) OVER (PARTITION BY case_id ORDER BY t, event_id) AS acc FROM s)
    SELECT case_id, round(coalesce(max(abs(step)), 0), 6) AS max_step, round(coalesce(sqrt(avg(step * step)), 0), 6) AS rms_step, round(coalesce(max(abs(acc)), 0), 6) AS max_acc, round(coalesce(sqrt(avg(acc * acc)), 0), 6) AS rms_acc FROM a GROUP BY 1""")
def motion_grade(spark: SparkSession, sf: str) -> DataFrame:
    s = adapters.events(spark, sf).withColumn("step", F.col("value") - F.lag("value").over(ordered()))
    a = s.withColumn("acc", F.col("step") - F.lag("step").over(ordered()))
    most = lambda c: F.round(F.coalesce(F.max(F.abs(c)), F.lit(0.0)), 6)
    return a.groupBy("case_id").agg(most(F.col("step")).alias("max_step"), F.round(stats.rms(F.col("step")), 6).alias("rms_step"), most(F.col("acc")).alias("max_acc"), F.round(stats.rms(F.col("acc")), 6).alias("rms_acc"))


@query(f"""WITH RECURSIVE {EVENTS_SQL}, r AS (SELECT case_id, event_id, t, value, row_number() OVER w AS i, (t - lag(t) OVER w) / CAST({HOUR} AS DOUBLE) AS dt FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY t, event_id)),
    d AS (SELECT case_id, event_id, i, value AS shown FROM r WHERE i = 1
      UNION ALL SELECT r.case_id, r.event_id, r.i, d.shown + (r.value - d.shown) * (1 - exp(-r.dt / CASE WHEN r.value > d.shown THEN 4.0 ELSE 12.0 END)) FROM d JOIN r ON r.case_id = d.case_id AND r.i = d.i + 1)
    SELECT case_id, event_id, round(shown, 5) AS shown FROM d""")
def displayed_pose_iir(spark: SparkSession, sf: str) -> DataFrame:
    """A first-order filter with other time constants for rise and fall; the state is sequential within a case."""
    return sampling.attack_release(adapters.events(spark, sf), 4.0, 12.0, HOUR).select("case_id", "event_id", F.round("shown", 5).alias("shown"))
