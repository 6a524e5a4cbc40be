"""Queries over runtime events against gold: lookups, onsets, assignment, boundaries, gates, selections of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.functions import stats
from metrum.operators import drafting, regions, scoring
from metrum.plans import adapters, cases
from metrum.plans.adapters import DAY, GOLD_SQL, PRED_SQL
from metrum.plans.cases import MINUTE, PHONES_SQL, RUNTIME_SQL, WORDS_SQL
from metrum.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


TRACK_SQL = f"WITH {WORDS_SQL}, {PHONES_SQL}, {RUNTIME_SQL}, shown AS (SELECT * FROM rt WHERE renderable AND NOT cancelled)"


@query(f"""{TRACK_SQL} SELECT case_id, idx, lag(idx) OVER w AS previous, lead(idx) OVER w AS next, strength > 0.012 AS delivered, row_number() OVER (PARTITION BY case_id ORDER BY c, word_index, pose, idx) AS place FROM shown WINDOW w AS (PARTITION BY case_id ORDER BY idx)""")
def rendered_events(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered events with their rendered neighbours, whether they count for delivery, and their place by start, word and
    pose."""
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("centre", "word_index", "pose", "idx"))
    return scoring.rendered_neighbours(cases.runtime(spark, sf)).select("case_id", "idx", "previous", "next", scoring.delivery_candidate().alias("delivered"), place.alias("place"))


@query(f"""{TRACK_SQL}, rep AS (SELECT case_id, word_index % 40 AS word_index, idx, pose FROM rt)
    SELECT g.case_id, g.word_index, max_by(o.pose, o.idx) AS pose FROM gw g LEFT JOIN rep o ON o.case_id = g.case_id AND o.word_index = g.word_index GROUP BY ALL""")
def last_row_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A lookup by word whose rows repeat keys: the last one wins."""
    repeated = cases.runtime(spark, sf).withColumn("word_index", F.col("word_index") % 40)
    return scoring.last_row_wins(cases.words(spark, sf).select("case_id", "word_index"), repeated, ["case_id", "word_index"], "idx", ["pose"])


@query(f"""{TRACK_SQL}, one AS (SELECT case_id, word_index, min_by(idx, idx) AS first_event, min_by(pose, idx) AS first_pose FROM shown GROUP BY ALL), two AS (SELECT case_id, word_index % 30 AS w, k, pose, min(idx) AS idx FROM shown GROUP BY ALL)
    SELECT g.case_id, g.word_index, o.first_event, o.first_pose, t.idx AS keyed_event FROM gw g LEFT JOIN one o ON o.case_id = g.case_id AND o.word_index = g.word_index LEFT JOIN two t ON t.case_id = g.case_id AND t.w = g.word_index AND t.k = 0 AND t.pose = 'p' || (g.event_id % 4)""")
def first_event_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each word's first rendered event, and the first one of its number, place and pose."""
    shown = cases.runtime(spark, sf).where(scoring.rendered())
    g = cases.words(spark, sf).select("case_id", "word_index", F.lit(0).cast("long").alias("k"), F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string")).alias("pose"))
    one = scoring.first_match(g, shown.select("case_id", "word_index", "idx", F.col("idx").alias("first_event"), F.col("pose").alias("first_pose")), ["case_id", "word_index"], "idx", ["first_event", "first_pose"])
    two = shown.select("case_id", (F.col("word_index") % 30).alias("word_index"), "k", "pose", "idx", F.col("idx").alias("keyed_event"))
    return scoring.first_match(one, two, ["case_id", "word_index", "k", "pose"], "idx", ["keyed_event"]).select("case_id", "word_index", "first_event", "first_pose", "keyed_event")


@query(f"""{TRACK_SQL}, {PRED_SQL}, x AS (SELECT r.case_id, r.idx, p.region, p.s <= r.c AND r.c <= p.e AS held, greatest(p.s - r.c, r.c - p.e, 0) AS d FROM rt r JOIN pred p ON p.case_id = r.case_id),
    b AS (SELECT case_id, idx, min(region) FILTER (held) AS containing, min_by(region, (d, region)) AS nearest FROM x GROUP BY ALL)
    SELECT r.case_id, r.idx, coalesce(containing, -1) AS containing, coalesce(nearest, -1) AS nearest FROM rt r LEFT JOIN b ON b.case_id = r.case_id AND b.idx = r.idx""")
def playback_region(spark: SparkSession, sf: str) -> DataFrame:
    """For each event's centre the detected region that holds it, and the nearest one."""
    points = cases.runtime(spark, sf).select("case_id", "idx", F.col("centre").alias("at"))
    return scoring.region_at(points, adapters.as_right(adapters.predicted(spark, sf)))


@query(f"""{TRACK_SQL}, refs AS (SELECT DISTINCT case_id, word_index FROM ph WHERE label NOT IN ('', 'sil') AND pe > ps), first_ AS (SELECT case_id, word_index, min_by(c, idx) AS c FROM shown GROUP BY ALL),
    e AS (SELECT r.case_id, f.c - {5 * MINUTE} - g.s AS error FROM refs r JOIN gw g ON g.case_id = r.case_id AND g.word_index = r.word_index LEFT JOIN first_ f ON f.case_id = r.case_id AND f.word_index = r.word_index)
    SELECT case_id, count(*) AS reference_count, count(error) AS matched_count, count(*) - count(error) AS missing_count, round(coalesce(avg(abs(error)), 0) / 1000, 4) AS mean_abs_ms, round(coalesce(quantile_cont(abs(error), 0.5), 0) / 1000, 4) AS median_abs_ms,
      round(coalesce(quantile_cont(abs(error), 0.9), 0) / 1000, 4) AS p90_abs_ms, round(coalesce(avg(greatest(-error, 0)) FILTER (error IS NOT NULL), 0) / 1000, 4) AS mean_early_ms, round(coalesce(avg(greatest(error, 0)) FILTER (error IS NOT NULL), 0) / 1000, 4) AS mean_late_ms FROM e GROUP BY 1""")
def word_onset_report(spark: SparkSession, sf: str) -> DataFrame:
    refs = drafting.clean_phones(cases.phones(spark, sf))
    r = scoring.onset_report(cases.words(spark, sf), refs, cases.runtime(spark, sf), 5 * MINUTE)
    return r.select(*(F.round(c, 4).alias(c) if c.endswith("_ms") else c for c in r.columns))


@query(f"""{TRACK_SQL}, t AS (SELECT case_id, c + 1 < lag(c) OVER (PARTITION BY case_id ORDER BY idx) AS back, renderable AND NOT cancelled AS shown FROM rt), tr AS (SELECT case_id, count(*) FILTER (back) AS order_violations, count(*) FILTER (shown) AS committed_count FROM t GROUP BY 1),
    m AS (SELECT l.case_id, l.ps, l.pe, s.c FROM ph l LEFT JOIN shown s ON s.case_id = l.case_id AND s.word_index = l.word_index AND s.k = l.k WHERE l.label NOT IN ('', 'sil') AND l.pe > l.ps),
    g AS (SELECT case_id, count(*) AS reference_count, count(c) AS matched_count, avg(abs(2 * c - ps - pe)) / 2000 AS centre_ms, avg(abs(c - {5 * MINUTE} - ps)) / 1000 AS start_ms, avg(abs(c + {5 * MINUTE} - pe)) / 1000 AS end_ms, avg(CASE WHEN c IS NOT NULL THEN abs({10 * MINUTE} - pe + ps) END) / 1000 AS duration_ms,
      count(*) FILTER (c - {5 * MINUTE} + {3 * MINUTE} < ps) AS early, count(*) FILTER (c + {5 * MINUTE} - {3 * MINUTE} > pe) AS late FROM m GROUP BY 1)
    SELECT coalesce(tr.case_id, g.case_id) AS case_id, coalesce(order_violations, 0) AS order_violations, coalesce(committed_count, 0) AS committed_count, coalesce(reference_count, 0) AS reference_count, coalesce(matched_count, 0) AS matched_count, round(coalesce(centre_ms, 0), 4) AS centre_ms, round(coalesce(start_ms, 0), 4) AS start_ms,
      round(coalesce(end_ms, 0), 4) AS end_ms, round(coalesce(duration_ms, 0), 4) AS duration_ms, round(CASE WHEN matched_count > 0 THEN early / CAST(matched_count AS DOUBLE) ELSE 0 END, 6) AS early_start_rate, round(CASE WHEN matched_count > 0 THEN late / CAST(matched_count AS DOUBLE) ELSE 0 END, 6) AS late_tail_rate,
      coalesce(reference_count, 0) - coalesce(matched_count, 0) AS missing_count, coalesce(committed_count, 0) - coalesce(matched_count, 0) AS extra_count FROM tr FULL JOIN g ON g.case_id = tr.case_id""")
def track_grade(spark: SparkSession, sf: str) -> DataFrame:
    g = scoring.track_grade(drafting.clean_phones(cases.phones(spark, sf)), cases.runtime(spark, sf), 5 * MINUTE, 3 * MINUTE)
    return g.select(*(F.round(c, 4).alias(c) if c.endswith("_ms") else F.round(c, 6).alias(c) if c.endswith("_rate") else c for c in g.columns))


ASSIGNED_SQL = f"""{TRACK_SQL}, {GOLD_SQL}, {PRED_SQL},
    ow AS (SELECT s.case_id, s.idx, CASE WHEN count(*) = 1 THEN min(p.region) END AS owner FROM shown s JOIN pred p ON p.case_id = s.case_id AND p.s <= s.c AND s.c <= p.e GROUP BY ALL),
    o2 AS (SELECT p.case_id, p.region AS owner, g.region AS to_ FROM pred p JOIN gold g ON g.case_id = p.case_id AND g.s < p.e AND p.s < g.e QUALIFY row_number() OVER (PARTITION BY p.case_id, p.region ORDER BY least(g.e, p.e) - greatest(g.s, p.s) DESC, g.region) = 1),
    ev2 AS (SELECT r.*, ow.owner, o2.to_, r.renderable AND NOT r.cancelled AS is_shown FROM rt r LEFT JOIN ow ON ow.case_id = r.case_id AND ow.idx = r.idx LEFT JOIN o2 ON o2.case_id = ow.case_id AND o2.owner = ow.owner),
    aw AS (SELECT case_id, word_index, max(event_id) AS event_id, max(n) AS planned, count(*) FILTER (is_shown) AS committed, list_sort(list_distinct(coalesce(list(owner) FILTER (owner IS NOT NULL), []))) AS runtime, list_sort(list_distinct(coalesce(list(to_) FILTER (to_ IS NOT NULL), []))) AS mapped FROM ev2 GROUP BY ALL),
    asg AS (SELECT aw.*, gn.region AS gold, planned = committed AS complete, CASE WHEN len(mapped) = 1 THEN mapped[1] - gn.region ELSE 0 END AS delta, planned = committed AND len(runtime) = 1 AND len(mapped) = 1 AND coalesce(mapped[1] = gn.region, false) AS strict FROM aw JOIN gold_n gn ON gn.event_id = aw.event_id)"""


def _assigned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    gold, detected = adapters.as_right(adapters.gold(spark, sf)), adapters.as_right(adapters.predicted(spark, sf))
    words = cases.words(spark, sf)
    starts = words.select("case_id", F.col("word_index").alias("idx"), F.col("start").alias("at"))
    own = regions.owner_of_point(starts, gold, DAY, 0).select("case_id", F.col("idx").alias("word_index"), F.col("owner").alias("gold"))
    return scoring.word_assignment(cases.runtime(spark, sf), detected, gold, own, DAY), detected, gold


@query(f"""{ASSIGNED_SQL}, per AS (SELECT case_id, count(*) AS words, count(*) FILTER (complete) AS complete, count(*) FILTER (len(runtime) > 1) AS split_words, count(*) FILTER (NOT complete) AS incomplete_words, count(*) FILTER (strict) AS strict_successes, count(*) FILTER (complete AND delta < 0) AS early_theft, count(*) FILTER (complete AND delta > 0) AS late_assignment FROM asg GROUP BY 1),
    la AS (SELECT case_id, runtime[1] AS owner, max(word_index) AS last FROM asg WHERE complete AND len(runtime) = 1 GROUP BY ALL), un AS (SELECT case_id, gold, max(word_index) AS until FROM asg GROUP BY ALL),
    ov AS (SELECT la.case_id, count(*) AS overruns, max(last - until) AS max_overrun FROM la JOIN o2 ON o2.case_id = la.case_id AND o2.owner = la.owner JOIN un ON un.case_id = la.case_id AND un.gold = o2.to_ WHERE last > until GROUP BY 1)
    SELECT per.*, coalesce(overruns, 0) AS overruns, coalesce(max_overrun, 0) AS max_overrun FROM per LEFT JOIN ov ON ov.case_id = per.case_id""")
def word_region_assignment(spark: SparkSession, sf: str) -> DataFrame:
    assigned, detected, gold = _assigned(spark, sf)
    return scoring.assignment_report(assigned, detected, gold, DAY)


@query(f"""{ASSIGNED_SQL}, mid AS (SELECT g.case_id, g.word_index, CASE WHEN count(*) = 1 THEN min(p.region) ELSE -1 END AS region FROM gw g JOIN pred p ON p.case_id = g.case_id AND p.s <= (g.s + g.e) // 2 AND (g.s + g.e) // 2 <= p.e + 1000 GROUP BY ALL),
    f AS (SELECT a.case_id, a.word_index, a.gold, a.complete, a.runtime, coalesce(m.region, -1) AS region FROM asg a LEFT JOIN mid m ON m.case_id = a.case_id AND m.word_index = a.word_index),
    b AS (SELECT *, lead(gold) OVER w AS gold2, lead(complete) OVER w AS complete2, lead(runtime) OVER w AS runtime2, lead(region) OVER w AS region2 FROM f WINDOW w AS (PARTITION BY case_id ORDER BY word_index)),
    l AS (SELECT *, gold <> gold2 AS is_gold, complete AND complete2 AND len(runtime) = 1 AND len(runtime2) = 1 AS seen, region >= 0 AND region2 >= 0 AS observed FROM b WHERE gold2 IS NOT NULL),
    x AS (SELECT *, seen AND runtime[1] <> runtime2[1] AS scheduled, observed AND region <> region2 AS detected FROM l)
    SELECT case_id, count(*) AS boundaries, count(*) FILTER (is_gold) AS gold, count(*) FILTER (scheduled) AS scheduled, count(*) FILTER (detected) AS detected, count(*) FILTER (observed AND seen AND is_gold = scheduled AND is_gold = detected) AS exact, count(*) FILTER (is_gold AND NOT detected) AS missed, count(*) FILTER (NOT is_gold AND detected) AS extra,
      count(*) FILTER (is_gold AND len(runtime) = 1 AND len(runtime2) = 1 AND runtime[1] = runtime2[1]) AS post_in_previous, count(*) FILTER (len(runtime) > 1 OR len(runtime2) > 1) AS split_word, count(*) FILTER (NOT complete OR NOT complete2) AS incomplete FROM x GROUP BY 1""")
def boundary_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Boundaries at three levels, gold, scheduler and detection, counted by case."""
    assigned, detected, _ = _assigned(spark, sf)
    middles = cases.words(spark, sf).select("case_id", F.col("word_index").alias("idx"), F.floor((F.col("start") + F.col("end")) / 2).alias("at"))
    physical = regions.owner_of_point(middles, detected, DAY, 1000).select("case_id", F.col("idx").alias("word_index"), F.col("owner").alias("region"))
    b = scoring.boundary_levels(assigned, physical)
    return b.groupBy("case_id").agg(F.count("*").alias("boundaries"), *(F.count_if(c).alias(c) for c in b.columns[2:]))


@query(f"""{TRACK_SQL}, {PRED_SQL}, own AS (SELECT s.case_id, s.idx, s.c, min(p.region) AS region FROM shown s JOIN pred p ON p.case_id = s.case_id AND p.s <= s.c AND s.c <= p.e GROUP BY ALL HAVING count(*) = 1)
    SELECT p.case_id, p.region, count(o.c) AS events, min(o.c) AS first_us, max(o.c) AS last_us, p.e - max(o.c) AS tail_us FROM pred p LEFT JOIN own o ON o.case_id = p.case_id AND o.region = p.region WHERE p.e > p.s GROUP BY p.case_id, p.region, p.e""")
def region_commits(spark: SparkSession, sf: str) -> DataFrame:
    c = scoring.region_commits(cases.runtime(spark, sf), adapters.as_right(adapters.predicted(spark, sf)), DAY)
    return c.select("case_id", F.col("r_idx").alias("region"), "events", F.col("first").alias("first_us"), F.col("last").alias("last_us"), F.col("tail").alias("tail_us"))


LOG_SQL = f"""on_ AS (SELECT case_id, word_index, min_by(c, idx) FILTER (renderable AND NOT cancelled) AS c, count(*) FILTER (renderable AND NOT cancelled) AS committed, max(n) AS n FROM rt GROUP BY ALL),
    er AS (SELECT o.c - g.s AS error, coalesce(committed <> n, true) AS incomplete FROM gw g LEFT JOIN on_ o ON o.case_id = g.case_id AND o.word_index = g.word_index),
    lg AS (SELECT count(*) AS words, count(error) AS visible, count(*) - count(error) AS missing, count(*) FILTER (incomplete) AS incomplete, avg(error) / 1000 AS signed_mean_ms, avg(abs(error)) / 1000 AS mean_abs_ms, quantile_cont(abs(error), 0.5) / 1000 AS median_abs_ms, count(*) FILTER (error > 600000000) AS late FROM er)"""


@query(f"{TRACK_SQL}, {LOG_SQL} SELECT words, visible, missing, incomplete, round(signed_mean_ms, 2) AS signed_mean_ms, round(mean_abs_ms, 2) AS mean_abs_ms, round(median_abs_ms, 3) AS median_abs_ms, late FROM lg")
def log_report(spark: SparkSession, sf: str) -> DataFrame:
    r = scoring.log_report(cases.words(spark, sf), cases.runtime(spark, sf), 600_000.0)
    return r.withColumns({"signed_mean_ms": F.round("signed_mean_ms", 2), "mean_abs_ms": F.round("mean_abs_ms", 2), "median_abs_ms": F.round("median_abs_ms", 3)})


MEASURED = {"word_animation_onset.success_rate": "visible / CAST(words AS DOUBLE)", "word_animation_onset.mean_abs_error_ms": "mean_abs_ms", "guardrails.event_completion_rate": "1 - incomplete / CAST(words AS DOUBLE)", "word_duration.median_abs_error_ms": "median_abs_ms"}
ACCEPTED = {"word_animation_onset.success_rate": 0.926, "word_animation_onset.mean_abs_error_ms": 33.6, "guardrails.event_completion_rate": 1.0, "region_start.success_rate": 0.963}
TOLERANCE = {"max_word_onset_success_drop": 0.05, "max_word_onset_mae_ms_increase": 5000000.0, "max_event_completion_drop": 0.01}


@query(f"""{TRACK_SQL}, {LOG_SQL}, g AS (SELECT * FROM (VALUES {", ".join(map(str, scoring.BASELINE_GATES))}) AS t(metric, direction, name)), a AS ({" UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({v} AS DOUBLE) AS actual FROM lg" for k, v in MEASURED.items())}),
    b AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in ACCEPTED.items())}) AS t(metric, accepted)), t AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in TOLERANCE.items())}) AS t(name, tolerance)),
    r AS (SELECT g.metric, actual, direction, CASE direction WHEN 'min' THEN accepted - tolerance ELSE accepted + tolerance END AS limit_, CASE WHEN actual IS NULL THEN 'metric' WHEN accepted IS NULL THEN 'baseline' WHEN tolerance IS NULL THEN 'tolerance' ELSE '' END AS missing FROM g LEFT JOIN a ON a.metric = g.metric LEFT JOIN b ON b.metric = g.metric LEFT JOIN t ON t.name = g.name)
    SELECT metric, round(actual, 2) AS actual, round(limit_, 6) AS "limit", coalesce(CASE direction WHEN 'min' THEN actual >= limit_ ELSE actual <= limit_ END, false) AS passed, missing FROM r""")
def baseline_gates(spark: SparkSession, sf: str) -> DataFrame:
    """The 23 gates against a baseline; this corpus measures four of their metrics, the others are reported missing."""
    lg = scoring.log_report(cases.words(spark, sf), cases.runtime(spark, sf), 600_000.0)
    summary = lg.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.expr(v).cast("double").alias("value")) for k, v in MEASURED.items()))).alias("m")).select("m.metric", "m.value")
    g = scoring.baseline_gates(summary, spark.createDataFrame(list(ACCEPTED.items()), "metric string, value double"), spark.createDataFrame(list(TOLERANCE.items()), "name string, value double"))
    return g.withColumns({"actual": F.round("actual", 2), "limit": F.round("limit", 6)})


@query("""WITH c AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE contains(c_name, '7') AND (starts_with(c_mktsegment, 'B') OR c_mktsegment IN ('MACHINERY', 'FURNITURE'))),
    done AS (SELECT DISTINCT lower(c_name) AS key FROM customer WHERE c_acctbal < 0 UNION SELECT DISTINCT lower(s_name) FROM supplier),
    kept AS (SELECT * FROM c WHERE lower(c_name) NOT IN (SELECT key FROM done) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')),
    r AS (SELECT c_mktsegment, list_sort(list_distinct(list(c_name))) AS names, arg_max(c_name, (c_acctbal, -c_custkey)) AS richest, count(*) AS n FROM kept GROUP BY 1)
    SELECT c_mktsegment AS bucket, n, richest, array_to_string(names[1:3], '|') AS first_names FROM r""")
def case_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Cases by substring, prefix or list, that have both artefacts and were not imported before (by lower-cased key, of
    either source): by bucket their number, the richest, the first of several, and the first three names, sorted."""
    c = table(spark, sf, "customer")
    wanted = c.where(F.contains("c_name", F.lit("7")) & (F.startswith("c_mktsegment", F.lit("B")) | F.col("c_mktsegment").isin("MACHINERY", "FURNITURE")))
    done = c.where("c_acctbal < 0").select(F.lower("c_name").alias("key")).unionByName(table(spark, sf, "supplier").select(F.lower("s_name").alias("key"))).distinct()
    both = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.size(F.collect_set("o_orderstatus")).alias("kinds")).where("kinds = 2")
    kept = wanted.join(done, F.lower("c_name") == F.col("key"), "left_anti").join(both, "c_custkey", "left_semi")
    r = kept.groupBy(F.col("c_mktsegment").alias("bucket")).agg(F.count("*").alias("n"), F.max_by("c_name", F.struct("c_acctbal", -F.col("c_custkey"))).alias("richest"), F.array_sort(F.collect_set("c_name")).alias("names"))
    return r.select("bucket", "n", "richest", F.array_join(F.slice("names", 1, 3), "|").alias("first_names"))


LABELS_SQL = "lb AS (SELECT *, 'p' || ((event_id + k) % 4) AS pose FROM ph WHERE label NOT IN ('', 'sil') AND pe > ps)"


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """Gold phones with the pose that their place stands for."""
    return drafting.clean_phones(cases.phones(spark, sf)).withColumn("pose", F.concat(F.lit("p"), ((F.col("event_id") + F.col("k")) % 4).cast("string")))


@query(f"""{TRACK_SQL}, {LABELS_SQL}, ls AS (SELECT * FROM lb QUALIFY row_number() OVER (PARTITION BY case_id, word_index ORDER BY ps, k) > 1), es AS (SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY case_id, word_index ORDER BY idx) > 1),
    pr AS (SELECT case_id, count(*) AS predicted FROM es WHERE (case_id, word_index) IN (SELECT (case_id, word_index) FROM ls) GROUP BY 1),
    m AS (SELECT l.case_id, l.ps, l.pe, e.c FROM ls l LEFT JOIN es e ON e.case_id = l.case_id AND e.word_index = l.word_index AND e.k = l.k AND e.pose = l.pose AND abs(2 * e.c - l.ps - l.pe) <= {24 * MINUTE}),
    g AS (SELECT case_id, count(*) AS reference_count, count(c) AS matched_count, floor((coalesce(avg(abs(2 * c - ps - pe)), 0) / 2000) * 1e5 + 0.5) / 1e5 AS centre_ms, floor((coalesce(quantile_cont(abs(2 * c - ps - pe)::DOUBLE, 0.5), 0) / 2000) * 1e5 + 0.5) / 1e5 AS median_centre_ms, floor((coalesce(quantile_cont(abs(2 * c - ps - pe)::DOUBLE, 0.9), 0) / 2000) * 1e5 + 0.5) / 1e5 AS p90_centre_ms,
      floor((coalesce(avg(abs(c - {5 * MINUTE} - ps)), 0) / 1000) * 1e5 + 0.5) / 1e5 AS start_ms, floor((coalesce(avg(abs(c + {5 * MINUTE} - pe)), 0) / 1000) * 1e5 + 0.5) / 1e5 AS end_ms FROM m GROUP BY 1)
    SELECT g.*, reference_count - matched_count AS missing_count, coalesce(predicted, 0) - matched_count AS extra_count FROM g LEFT JOIN pr ON pr.case_id = g.case_id""")
def intra_word_report(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and events within words, without each word's first; a match is at most twelve minutes off."""
    r = scoring.intra_word_report(_labels(spark, sf), cases.runtime(spark, sf), 12 * MINUTE, 5 * MINUTE)
    return r.select(*(stats.half_up(F.col(c), 5).alias(c) if c.endswith("_ms") else c for c in r.columns))


@query(f"""{TRACK_SQL}, {LABELS_SQL}, {GOLD_SQL}, own AS (SELECT g.case_id, g.word_index, n.region FROM gw g JOIN gold_n n ON n.event_id = g.event_id),
    l AS (SELECT lb.*, own.region, ascii(substr(label, 2, 1)) % 2 = 0 AS vowel FROM lb JOIN own ON own.case_id = lb.case_id AND own.word_index = lb.word_index),
    f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY case_id, word_index ORDER BY ps, k) = 1),
    h AS (SELECT f.case_id, f.word_index, f.region, e.c, 2 * e.c - f.ps - f.pe AS error FROM f LEFT JOIN shown e ON e.case_id = f.case_id AND e.word_index = f.word_index AND e.k = f.k),
    hd AS (SELECT *, row_number() OVER w = 1 AND error IS NOT NULL AS head, first_value(error) OVER w AS head_error FROM h WINDOW w AS (PARTITION BY case_id, region ORDER BY error IS NULL, word_index)),
    v AS (SELECT case_id, word_index, ps, pe FROM l WHERE vowel QUALIFY row_number() OVER (PARTITION BY case_id, word_index ORDER BY ps, k) = 1), o AS (SELECT case_id, word_index, min_by(c, idx) AS c FROM shown GROUP BY ALL),
    x AS (SELECT hd.*, CASE WHEN head THEN abs(2 * o.c - v.ps - v.pe) END AS core, head AND hd.region > 0 AS resume, CASE WHEN head AND hd.region > 0 THEN greatest(g.s - hd.c, 0) END AS lead_ FROM hd LEFT JOIN v ON v.case_id = hd.case_id AND v.word_index = hd.word_index LEFT JOIN o ON o.case_id = hd.case_id AND o.word_index = hd.word_index LEFT JOIN gold g ON g.case_id = hd.case_id AND g.region = hd.region)
    SELECT case_id, count(*) AS word_count, count(error) AS word_heads, floor((count(error) / count(*)::DOUBLE) * 1e6 + 0.5) / 1e6 AS word_head_rate, floor((coalesce(avg(abs(error)), 0) / 2000) * 1e4 + 0.5) / 1e4 AS word_head_ms, count(DISTINCT region) AS region_count, count(*) FILTER (head) AS region_heads, floor((coalesce(avg(abs(error)) FILTER (head), 0) / 2000) * 1e4 + 0.5) / 1e4 AS region_head_ms,
      count(core) AS nuclei, floor((coalesce(avg(core), 0) / 2000) * 1e4 + 0.5) / 1e4 AS nucleus_ms, count(*) FILTER (resume) AS resumes, count(*) FILTER (lead_ > 0) AS early_resumes, floor((CASE WHEN count(*) FILTER (resume) > 0 THEN count(*) FILTER (lead_ > 0) / (count(*) FILTER (resume))::DOUBLE ELSE 0 END) * 1e6 + 0.5) / 1e6 AS early_resume_rate,
      floor((coalesce(max(lead_), 0) / 1000) * 1e4 + 0.5) / 1e4 AS early_resume_max_ms, floor((greatest(coalesce(max(head_error - error), 0), 0) / 2000) * 1e4 + 0.5) / 1e4 AS drift_max_ms FROM x GROUP BY 1""")
def focus_report(spark: SparkSession, sf: str) -> DataFrame:
    """Heads of words and regions, nuclei, resumes and drift; labels of even class stand for vowels."""
    gold = adapters.as_right(adapters.gold(spark, sf))
    starts = cases.words(spark, sf).select("case_id", F.col("word_index").alias("idx"), F.col("start").alias("at"))
    own = regions.owner_of_point(starts, gold, DAY, 0).select("case_id", F.col("idx").alias("word_index"), F.col("owner").alias("region"))
    labels = _labels(spark, sf).withColumn("vowel", F.ascii(F.substring("label", 2, 1)) % 2 == 0).join(own, ["case_id", "word_index"])
    r = scoring.focus_report(labels, cases.runtime(spark, sf), gold)
    return r.select(*(stats.half_up(F.col(c), 4 if c.endswith("_ms") else 6).alias(c) if c.endswith(("_ms", "_rate")) else c for c in r.columns))


@query(f"""{TRACK_SQL.replace("WITH", "WITH RECURSIVE", 1)}, x AS (SELECT r.case_id, r.idx, r.c, g.e AS clock FROM rt r JOIN gw g ON g.case_id = r.case_id AND g.word_index = r.word_index),
    d AS (SELECT case_id, idx, CASE WHEN clock - c > {30 * MINUTE} THEN clock + {2 * MINUTE} ELSE c END AS at_, clock - c > {30 * MINUTE} AS moved FROM x WHERE idx = 0
      UNION ALL SELECT x.case_id, x.idx, CASE WHEN x.clock - greatest(x.c, d.at_ + 1) > {30 * MINUTE} THEN x.clock + {2 * MINUTE} ELSE greatest(x.c, d.at_ + 1) END, x.clock - greatest(x.c, d.at_ + 1) > {30 * MINUTE} FROM d JOIN x ON x.case_id = d.case_id AND x.idx = d.idx + 1)
    SELECT case_id, idx, at_ AS "at", moved FROM d""")
def late_rescue(spark: SparkSession, sf: str) -> DataFrame:
    """Where events are shown if the clock stands at their word's end: those over 30 minutes late go two ahead of it."""
    clock = cases.words(spark, sf).select("case_id", "word_index", F.col("end").alias("clock"))
    return scoring.deliver_late(cases.runtime(spark, sf).join(clock, ["case_id", "word_index"]), 30 * MINUTE, 2 * MINUTE)


LIMIT_ACCEPTED = {"word_region_confusion.early_region_thefts": 40.0, "word_region_confusion.late_region_assignments": 3.0, "word_interval_alignment.zero_overlap_words": 1.0}
LIMIT_VALUES = {"max_early_region_thefts_increase": 10.0, "max_late_region_assignments_increase": 100000.0, "max_zero_overlap_words_increase": 0.0, "max_order_violations": 0.0, "min_runtime_event_delivery_rate": 0.98, "min_runtime_word_delivery_rate": 0.9}


def _values(rows) -> str:
    return f"(VALUES {', '.join(map(str, rows))})"


@query(f"""{ASSIGNED_SQL}, a AS (SELECT 'word_region_confusion.early_region_thefts' AS metric, (count(*) FILTER (complete AND delta < 0))::DOUBLE AS actual FROM asg UNION ALL SELECT 'word_region_confusion.late_region_assignments', (count(*) FILTER (complete AND delta > 0))::DOUBLE FROM asg
      UNION ALL SELECT 'guardrails.order_violations', (count(*) FILTER (back))::DOUBLE FROM (SELECT c + 1 < lag(c) OVER (PARTITION BY case_id ORDER BY idx) AS back FROM rt) UNION ALL SELECT 'runtime_delivery.event_delivery_rate', (count(*) FILTER (strength > 0.012)) / count(*)::DOUBLE FROM shown),
    g AS (SELECT 'baseline' AS kind, * FROM {_values(scoring.TAIL_GATES)} AS t(metric, direction, name) UNION ALL SELECT 'absolute', * FROM {_values(scoring.ABSOLUTE_GATES)} AS t(metric, direction, name)),
    b AS (SELECT metric, accepted::DOUBLE AS accepted FROM {_values(LIMIT_ACCEPTED.items())} AS t(metric, accepted)), t AS (SELECT name, v::DOUBLE AS v FROM {_values(LIMIT_VALUES.items())} AS t(name, v)),
    r AS (SELECT kind, g.metric, actual, direction, CASE kind WHEN 'absolute' THEN v ELSE accepted + v END AS lim, CASE WHEN actual IS NULL THEN 'metric' WHEN kind = 'baseline' AND accepted IS NULL THEN 'baseline' WHEN v IS NULL THEN CASE kind WHEN 'absolute' THEN 'threshold' ELSE 'tolerance' END ELSE '' END AS missing
      FROM g LEFT JOIN a ON a.metric = g.metric LEFT JOIN b ON b.metric = g.metric LEFT JOIN t ON t.name = g.name)
    SELECT kind, metric, floor(actual * 1e6 + 0.5) / 1e6 AS actual, lim AS "limit", coalesce(CASE direction WHEN 'min' THEN actual >= lim ELSE actual <= lim END, false) AS passed, missing FROM r""")
def limit_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Gates of confusions and tails over a baseline, and gates with limits of their own; this corpus measures four of the
    metrics, the others are reported missing and fail."""
    assigned, detected, gold = _assigned(spark, sf)
    moved = scoring.assignment_report(assigned, detected, gold, DAY).agg(F.sum("early_theft").alias("early"), F.sum("late_assignment").alias("late"))
    w = Window.partitionBy("case_id").orderBy("idx")
    events = cases.runtime(spark, sf).withColumn("back", F.coalesce(F.col("centre") + 1 < F.lag("centre").over(w), F.lit(False)))
    track = events.agg(F.count_if("back").alias("back"), (F.count_if(scoring.delivery_candidate()) / F.count_if(scoring.rendered())).alias("delivered"))
    of = lambda d, names: d.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(c).cast("double").alias("value")) for k, c in names.items()))).alias("m")).select("m.*")
    summary = of(moved, {"word_region_confusion.early_region_thefts": "early", "word_region_confusion.late_region_assignments": "late"}).union(of(track, {"guardrails.order_violations": "back", "runtime_delivery.event_delivery_rate": "delivered"}))
    accepted, limits = spark.createDataFrame(list(LIMIT_ACCEPTED.items()), "metric string, value double"), spark.createDataFrame(list(LIMIT_VALUES.items()), "name string, value double")
    tails, own = scoring.baseline_gates(summary, accepted, limits, scoring.TAIL_GATES), scoring.absolute_gates(summary, limits)
    both = tails.select(F.lit("baseline").alias("kind"), "*").unionByName(own.select(F.lit("absolute").alias("kind"), "*"))
    return both.withColumn("actual", stats.half_up(F.col("actual"), 6))
