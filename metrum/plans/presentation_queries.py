"""How runtime events are presented: envelopes, samples, leakage into pauses, delivery and phonetic grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.functions.intervals import overlap, ratio
from metrum.operators import envelopes as env
from metrum.operators import regions, runs
from metrum.plans import adapters, cases
from metrum.plans.adapters import DAY, GOLD_SQL, HOUR
from metrum.plans.cases import SECOND
from metrum.session import written

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


STEP, MS = SECOND // 100, SECOND // 1000


def _u(seconds: float) -> int:
    return round(seconds * SECOND)


def _jerk(x: str) -> str:
    c = f"least(greatest({x}, 0e0), 1e0)"
    return f"({c} * {c} * {c} * (10e0 + {c} * (6e0 * {c} - 15e0)))"


def _smooth(x: str) -> str:
    c = f"least(greatest({x}, 0e0), 1e0)"
    return f"({c} * {c} * (3e0 - 2e0 * {c}))"


def _weight_sql(t: str) -> str:
    part = lambda a, b: f"(({t}) - {a}) / greatest({b} - {a}, {_u(0.001)})::DOUBLE"
    beat = f"CASE WHEN ({t}) <= c THEN {_smooth(part('att', 'c'))} ELSE 1e0 - {_smooth(part('c', 'rel'))} END"
    held = f"CASE WHEN ({t}) < ae THEN {_jerk(part('att', 'ae'))} WHEN ({t}) > rs THEN 1e0 - {_jerk(part('rs', 'rel'))} ELSE 1e0 END"
    return f"CASE WHEN ({t}) < att OR ({t}) > rel THEN 0e0 WHEN nucleus THEN {beat} ELSE {held} END * least(greatest(strength, 0e0), 1e0)"


def _joined_sql(a: str, b: str, anchor: str) -> str:
    return f"coalesce(NOT {a}nucleus AND NOT {b}nucleus AND NOT {anchor}anchor AND {a}region = {b}region AND {b}c - {a}c <= {_u(0.18)}, false)"


ENVELOPE_SQL = f"""WITH {cases.WORDS_SQL}, {cases.PRESENTED_SQL},
    nb AS (SELECT *, lag(c) OVER w AS p_c, lag(region) OVER w AS p_region, lag(nucleus) OVER w AS p_nucleus, lead(c) OVER w AS n_c, lead(region) OVER w AS n_region, lead(nucleus) OVER w AS n_nucleus, lead(anchor) OVER w AS n_anchor FROM pr WHERE renderable AND NOT cancelled WINDOW w AS (PARTITION BY case_id ORDER BY idx)),
    e1 AS (SELECT *, greatest(CASE WHEN {_joined_sql('p_', '', '')} AND c > p_c THEN least(a - {_u(0.015)}, c - {_u(0.045)}, (p_c + c) // 2 - {_u(0.02)}) ELSE least(a - {_u(0.015)}, c - {_u(0.045)}) END, ra) AS att0,
      least(CASE WHEN {_joined_sql('', 'n_', 'n_')} AND n_c > c THEN greatest(b + {_u(0.015)}, c + {_u(0.045)}, (n_c + c) // 2 + {_u(0.02)}) ELSE greatest(b + {_u(0.015)}, c + {_u(0.045)}) END, rb) AS rel0 FROM nb),
    e2 AS (SELECT *, CASE WHEN nucleus THEN greatest(c - {_u(0.035)}, ra) ELSE att0 END AS att, CASE WHEN nucleus THEN least(c + {_u(0.035)}, rb) WHEN c - ra <= {_u(0.06)} THEN greatest(rel0, least(ra + {_u(0.12)}, rb)) ELSE rel0 END AS rel FROM e1),
    en AS (SELECT *, least(c, att + {_u(0.045)}) AS ae, greatest(c, rel - {_u(0.045)}) AS rs FROM e2)"""


def _samples_sql(step: int) -> str:
    phase = f"least(greatest((step * {step} - a) / greatest(b - a, {_u(0.001)})::DOUBLE, 0e0), 1e0)"
    return f"""sw AS (SELECT *, {_weight_sql(f'step * {step}')} AS w FROM (SELECT *, unnest(range(-((-att) // {step}), rel // {step} + 1)) AS step FROM en)),
    st AS (SELECT *, {_smooth(f'({phase} - 0.35e0) / 0.4e0')} AS turn FROM sw WHERE w > 0.012e0),
    sm AS (SELECT * FROM (SELECT *, CASE WHEN turns THEN w * (1e0 - 0.78e0 * turn) ELSE w END AS weight, pose AS shown FROM st UNION ALL SELECT *, w * turn AS weight, '12_Ww-Oo-' AS shown FROM st WHERE turns) WHERE weight > 0.012e0)"""


def _enveloped(spark: SparkSession, sf: str) -> DataFrame:
    return env.envelopes(cases.presented(spark, sf).where("renderable AND NOT cancelled"), SECOND)


@query(f"{ENVELOPE_SQL} SELECT case_id, idx, att AS attack, ae AS attack_end, rs AS release_start, rel AS release FROM en")
def event_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Where each rendered event begins, holds and ends, by its neighbours and its region."""
    return _enveloped(spark, sf).select("case_id", "idx", "attack", "attack_end", "release_start", "release")


@query(f"{ENVELOPE_SQL}, {_samples_sql(5 * STEP)} SELECT case_id, step, shown AS pose, count(*) AS events, round(max(weight), 6) AS weight FROM sm GROUP BY ALL")
def track_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The poses shown at each twentieth of a second, with the largest of their events' weights."""
    s = env.samples(written(_enveloped(spark, sf), "envelopes"), SECOND, 5 * STEP)
    return s.groupBy("case_id", "step", "pose").agg(F.count("*").alias("events"), F.round(F.max("weight"), 6).alias("weight"))


LEAK = 5 * MS


@query(f"""{ENVELOPE_SQL}, {GOLD_SQL}, gp AS (SELECT case_id, region AS before_, e AS g0, lead(s) OVER (PARTITION BY case_id ORDER BY region) AS g1 FROM gold QUALIFY g1 IS NOT NULL),
    gs AS (SELECT case_id, before_, g0, unnest(range(0, (g1 - {MS // 2} - g0 + {LEAK - 1}) // {LEAK})) AS step FROM gp), hit AS (SELECT DISTINCT gs.case_id, before_, step FROM gs JOIN en ON en.case_id = gs.case_id AND att <= g0 + step * {LEAK} AND rel >= g0 + step * {LEAK} WHERE {_weight_sql(f'g0 + step * {LEAK}')} > 0.012e0),
    n AS (SELECT case_id, before_, count(*) AS samples FROM gs GROUP BY ALL), h AS (SELECT case_id, before_, count(*) AS active FROM hit GROUP BY ALL)
    SELECT n.case_id, n.before_ AS region_before, samples, coalesce(active, 0) AS active_samples FROM n LEFT JOIN h ON h.case_id = n.case_id AND h.before_ = n.before_""")
def pause_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """How many samples (each 5 ms) of the pauses between regions have an event that is active: ranges of samples by event,
    joined by a sweep, not a row a sample."""
    w = Window.partitionBy("case_id").orderBy("region")
    pauses = adapters.gold(spark, sf).select("case_id", F.col("region").alias("region_before"), F.col("end").alias("p0"), F.lead("start").over(w).alias("p1")).where("p1 IS NOT NULL")
    # Samples lie at p0 + k * LEAK as long as they are half a millisecond before the next region.
    pauses = pauses.withColumn("samples", F.ceil((F.col("p1") - MS // 2 - F.col("p0")) / LEAK)).where("samples > 0")
    e = written(_enveloped(spark, sf), "envelopes")
    left = e.withColumnsRenamed({"start": "e_start", "end": "e_end"}).withColumn("start", F.col("attack")).withColumn("end", F.col("release"))
    right = pauses.select("case_id", F.col("p0").alias("r_start"), F.col("p1").alias("r_end"), "region_before", "p0", "samples")
    met = regions.range_join(left, right, DAY, closed=True).drop("start", "end").withColumnsRenamed({"e_start": "start", "e_end": "end"})
    met = met.withColumn("from_step", F.lit(0).cast("long")).withColumn("to_step", F.col("samples") - 1)
    # A diphthong's poses share its weight, so one is active wherever the weight is: turns make no difference here.
    keys = ("case_id", "region_before", "idx")
    seen = env.visible(met.withColumn("turns", F.lit(False)), SECOND, LEAK, env.LEAST_WEIGHT, True, keys, F.col("p0"))
    active = env.union_length(seen, ["case_id", "region_before"]).withColumnRenamed("n", "active_samples")
    return pauses.join(active, ["case_id", "region_before"], "left").select("case_id", "region_before", "samples", F.coalesce("active_samples", F.lit(0)).alias("active_samples"))


VISIBLE, LEAST_SAMPLES = 0.20, 2
# Delivery of a word: what was seen of its events after they were committed, against the word itself.
_DELIVERED = f"""{ENVELOPE_SQL}, {_samples_sql(STEP)}, fin AS (SELECT case_id, max(greatest(rb, b)) AS stop FROM pr GROUP BY 1),
    dl AS (SELECT sm.case_id, idx, min(step) AS first, max(step) AS last, count(*) AS n FROM sm JOIN fin ON fin.case_id = sm.case_id WHERE weight >= {VISIBLE}e0 AND step * {STEP} + {MS // 2} >= commit_at AND step * {STEP} <= stop GROUP BY ALL),
    ok AS (SELECT * FROM dl WHERE n >= {LEAST_SAMPLES}),
    pl AS (SELECT case_id, word_index, count(*) AS planned FROM pr WHERE renderable AND strength > 0.012e0 GROUP BY ALL),
    cm AS (SELECT p.case_id, p.word_index, count(*) AS committed, count(ok.idx) AS delivered, min(p.idx) AS first_event, max(p.idx) AS last_event, min(ok.first) * {STEP} AS r0, max(ok.last) * {STEP} AS r1, min(a) AS render_start, max(b) AS render_end FROM pr p LEFT JOIN ok ON ok.case_id = p.case_id AND ok.idx = p.idx WHERE renderable AND NOT cancelled AND strength > 0.012e0 GROUP BY ALL),
    dw AS (SELECT g.case_id, g.word_index, g.word, g.sentence, g.region, g.s, g.e, coalesce(planned, 0) AS planned, coalesce(committed, 0) AS committed, coalesce(delivered, 0) AS delivered, coalesce(first_event, -1) AS first_event, coalesce(last_event, -1) AS last_event, r0, r1,
      e - s AS gold, coalesce(r1 - r0, 0) AS shown, CASE WHEN r0 IS NULL THEN 0 ELSE greatest(least(r1, e) - greatest(r0, s), 0) END AS both_, lag(render_end) OVER w AS before_, lead(render_start) OVER w AS after_ FROM gb g LEFT JOIN pl ON pl.case_id = g.case_id AND pl.word_index = g.word_index LEFT JOIN cm ON cm.case_id = g.case_id AND cm.word_index = g.word_index WINDOW w AS (PARTITION BY g.case_id ORDER BY g.word_index)),
    ex AS (SELECT *, r0 IS NOT NULL AS has, delivered = 0 AS missing, CASE WHEN gold > 0 THEN shown / gold::DOUBLE ELSE 0e0 END AS duration_ratio, r0 IS NOT NULL AND abs(shown - gold) <= greatest({_u(0.08)}e0, gold * 0.25e0) AS within FROM dw WHERE planned > 0),
    ey AS (SELECT *, gold > 0 AND shown + {_u(0.05)} < gold AND duration_ratio < 0.75e0 AS compressed, gold > 0 AND shown + {_u(0.08)} < gold AND duration_ratio < 0.5e0 AS severely_compressed, gold > 0 AND shown > gold + {_u(0.05)} AND duration_ratio > 1.25e0 AS stretched FROM ex)"""


def _shown(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All events, and the envelopes of those that are rendered, with from_step and to_step: rendering ends with the case's last
    event, and an event counts from its commit on, give or take half a millisecond. Both are written, as they are read more
    than once and their expressions would be repeated in every use."""
    events = written(cases.presented(spark, sf), "presented")
    stop = F.max(F.greatest("region_end", "end")).over(Window.partitionBy("case_id"))
    shown = env.envelopes(events.withColumn("_stop", stop).where("renderable AND NOT cancelled"), SECOND)
    shown = shown.withColumn("from_step", F.ceil((F.col("commit_at") - MS // 2) / STEP)).withColumn("to_step", F.floor(F.col("_stop") / STEP))
    return events, written(shown, "envelopes")


def _seen(shown: DataFrame) -> DataFrame:
    """case_id, idx, first, last, n of events that are delivered."""
    return env.visible(shown, SECOND, STEP, VISIBLE).where(F.col("n") >= LEAST_SAMPLES)


def _words(spark: SparkSession, sf: str, events: DataFrame, seen: DataFrame) -> DataFrame:
    keys = ["case_id", "word_index"]
    strong = F.col("strength") > env.LEAST_WEIGHT
    planned = events.where("renderable").where(strong).groupBy(*keys).agg(F.count("*").alias("planned"))
    done = events.where("renderable AND NOT cancelled").where(strong).join(seen.drop("n"), ["case_id", "idx"], "left")
    committed = done.groupBy(*keys).agg(
        F.count("*").alias("committed"), F.count("first").alias("delivered"), F.min("idx").alias("first_event"), F.max("idx").alias("last_event"), (F.min("first") * STEP).alias("r0"), (F.max("last") * STEP).alias("r1"), F.min("start").alias("render_start"), F.max("end").alias("render_end"),
    )
    w = Window.partitionBy("case_id").orderBy("word_index")
    whole = cases.sentences(spark, sf).join(planned, keys, "left").join(committed, keys, "left").na.fill(0, ["planned", "committed", "delivered"]).na.fill(-1, ["first_event", "last_event"])
    whole = whole.withColumn("before", F.lag("render_end").over(w)).withColumn("after", F.lead("render_start").over(w)).where("planned > 0")
    told = whole.withColumn("gold", F.col("end") - F.col("start")).withColumn("has", F.col("r0").isNotNull()).withColumn("shown", F.coalesce(F.col("r1") - F.col("r0"), F.lit(0)))
    told = told.withColumn("both", F.when(F.col("has"), overlap(F.col("r0"), F.col("r1"), F.col("start"), F.col("end"))).otherwise(0)).withColumn("duration_ratio", ratio(F.col("shown"), F.col("gold"), 0.0))
    # A word's duration may be off by 80 ms or a quarter; compressed and stretched words are off by more than
    # 50 ms and a quarter, severely compressed ones by 80 ms and a half.
    return (
        told.withColumn("missing", F.col("delivered") == 0)
        .withColumn("within", F.col("has") & (F.abs(F.col("shown") - F.col("gold")) <= F.greatest(F.lit(float(_u(0.08))), F.col("gold") * 0.25)))
        .withColumn("compressed", (F.col("gold") > 0) & (F.col("shown") + _u(0.05) < F.col("gold")) & (F.col("duration_ratio") < 0.75))
        .withColumn("severely_compressed", (F.col("gold") > 0) & (F.col("shown") + _u(0.08) < F.col("gold")) & (F.col("duration_ratio") < 0.5))
        .withColumn("stretched", (F.col("gold") > 0) & (F.col("shown") > F.col("gold") + _u(0.05)) & (F.col("duration_ratio") > 1.25))
    )


@query(f"""{_DELIVERED} SELECT case_id, word_index, word, sentence, region, planned, committed, delivered, first_event, last_event, gold AS gold_us, shown AS shown_us, round(duration_ratio, 6) AS duration_ratio, coalesce(r0 - s, 0) AS onset_error_us, coalesce(r1 - e, 0) AS exit_error_us,
    both_ AS overlap_us, round(CASE WHEN gold > 0 THEN both_ / gold::DOUBLE ELSE 0e0 END, 6) AS coverage, round(CASE WHEN shown > 0 THEN both_ / shown::DOUBLE ELSE 0e0 END, 6) AS precision_, round(CASE WHEN gold + shown - both_ > 0 THEN both_ / (gold + shown - both_)::DOUBLE ELSE 0e0 END, 6) AS iou, within, missing, compressed, severely_compressed, stretched,
    coalesce(r0 - before_, 0) AS previous_gap_us, coalesce(after_ - r1, 0) AS next_gap_us FROM ey""")
def word_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """Each word with planned events: what was delivered of it, when, and how its shown interval meets the spoken one."""
    f = lambda c: F.round(c, 6)
    gap = lambda c: F.coalesce(c, F.lit(0))
    union = F.col("gold") + F.col("shown") - F.col("both")
    events, shown = _shown(spark, sf)
    return _words(spark, sf, events, _seen(shown)).select(
        "case_id", "word_index", "word", "sentence", "region", "planned", "committed", "delivered", "first_event", "last_event", F.col("gold").alias("gold_us"), F.col("shown").alias("shown_us"), f(F.col("duration_ratio")).alias("duration_ratio"), gap(F.col("r0") - F.col("start")).alias("onset_error_us"), gap(F.col("r1") - F.col("end")).alias("exit_error_us"),
        F.col("both").alias("overlap_us"), f(ratio(F.col("both"), F.col("gold"), 0.0)).alias("coverage"), f(ratio(F.col("both"), F.col("shown"), 0.0)).alias("precision_"), f(ratio(F.col("both"), union, 0.0)).alias("iou"), "within", "missing", "compressed", "severely_compressed", "stretched",
        gap(F.col("r0") - F.col("before")).alias("previous_gap_us"), gap(F.col("after") - F.col("r1")).alias("next_gap_us"),
    )


@query(f"""{_DELIVERED}, evs AS (SELECT p.case_id, p.idx, p.sentence, p.a, p.b, p.c, p.commit_at > p.b + {MS} AS late, ok.idx IS NOT NULL AS seen FROM pr p LEFT JOIN ok ON ok.case_id = p.case_id AND ok.idx = p.idx WHERE renderable AND NOT cancelled AND strength > 0.012e0),
    e1s AS (SELECT case_id, count(*) AS committed_events, count(*) FILTER (seen) AS delivered_events, count(*) FILTER (late) AS late_after_window FROM evs GROUP BY 1), ws AS (SELECT case_id, sum(planned)::BIGINT AS planned_events, count(*) AS expected_words, count(*) FILTER (missing) AS missing_words, count(*) FILTER (within) AS durations_within, count(*) FILTER (compressed) AS compressed_words, count(*) FILTER (severely_compressed) AS severely_compressed_words,
      count(*) FILTER (stretched) AS stretched_words, count(*) FILTER (both_ <= {MS // 2}) AS zero_overlap_words, count(*) FILTER (CASE WHEN gold > 0 THEN both_ / gold::DOUBLE ELSE 0e0 END < 0.5e0) AS low_coverage_words, round(coalesce(quantile_cont(duration_ratio, 0.5) FILTER (gold > 0), 0), 6) AS duration_ratio_median FROM ey GROUP BY 1),
    ss AS (SELECT case_id, sentence, min(s) AS s0, max(e) AS s1 FROM ex GROUP BY ALL), se AS (SELECT ss.case_id, ss.sentence, s0, s1, count(evs.idx) AS k, coalesce(max(evs.b) - min(evs.a), 0) AS shown, coalesce(bool_or(seen AND c >= s0 - {MS} AND c <= s1 + {MS}), false) AS inside FROM ss LEFT JOIN evs ON evs.case_id = ss.case_id AND evs.sentence = ss.sentence GROUP BY ALL),
    sg AS (SELECT case_id, count(*) AS expected_sentences, count(*) FILTER (NOT inside) AS missing_sentences, count(*) FILTER (k >= 2 AND s1 - s0 >= {_u(0.3)} AND shown + {_u(0.15)} < s1 - s0 AND shown < 0.65e0 * (s1 - s0)) AS compressed_sentences FROM se GROUP BY 1),
    rg AS (SELECT DISTINCT case_id, region, ra, rb FROM gb), rd AS (SELECT rg.case_id, rg.region, coalesce(bool_or(seen), false) AS seen FROM rg LEFT JOIN evs ON evs.case_id = rg.case_id AND evs.seen AND c >= ra - {MS} AND c <= rb + {MS} GROUP BY ALL), rr AS (SELECT case_id, count(*) AS expected_regions, count(*) FILTER (NOT seen) AS empty_regions FROM rd GROUP BY 1)
    SELECT rr.case_id, coalesce(planned_events, 0) AS planned_events, coalesce(committed_events, 0) AS committed_events, coalesce(delivered_events, 0) AS delivered_events, coalesce(late_after_window, 0) AS late_after_window, coalesce(expected_words, 0) AS expected_words, coalesce(missing_words, 0) AS missing_words, coalesce(durations_within, 0) AS durations_within, coalesce(compressed_words, 0) AS compressed_words, coalesce(severely_compressed_words, 0) AS severely_compressed_words, coalesce(stretched_words, 0) AS stretched_words,
      coalesce(zero_overlap_words, 0) AS zero_overlap_words, coalesce(low_coverage_words, 0) AS low_coverage_words, coalesce(duration_ratio_median, 0) AS duration_ratio_median, coalesce(expected_sentences, 0) AS expected_sentences, coalesce(missing_sentences, 0) AS missing_sentences, coalesce(compressed_sentences, 0) AS compressed_sentences, expected_regions, empty_regions,
      round(CASE WHEN coalesce(planned_events, 0) = 0 THEN 1e0 ELSE coalesce(delivered_events, 0) / planned_events::DOUBLE END, 6) AS event_delivery_rate, round(CASE WHEN coalesce(expected_words, 0) = 0 THEN 1e0 ELSE (expected_words - missing_words) / expected_words::DOUBLE END, 6) AS word_delivery_rate
    FROM rr LEFT JOIN e1s ON e1s.case_id = rr.case_id LEFT JOIN ws ON ws.case_id = rr.case_id LEFT JOIN sg ON sg.case_id = rr.case_id""")
def delivery_grade(spark: SparkSession, sf: str) -> DataFrame:
    """Of each case: events, words, sentences and regions that were planned, delivered, missing, compressed and stretched."""
    events, shown = _shown(spark, sf)
    found = written(_seen(shown), "seen")
    w = written(_words(spark, sf, events, found), "delivery")
    seen = found.select("case_id", "idx", F.lit(True).alias("seen"))
    strong = events.where("renderable AND NOT cancelled").where(F.col("strength") > env.LEAST_WEIGHT)
    e = written(strong.join(seen, ["case_id", "idx"], "left").withColumn("seen", F.coalesce("seen", F.lit(False))).withColumn("late", F.col("commit_at") > F.col("end") + MS), "events")
    of_events = e.groupBy("case_id").agg(F.count("*").alias("committed_events"), F.count_if("seen").alias("delivered_events"), F.count_if("late").alias("late_after_window"))
    low = ratio(F.col("both"), F.col("gold"), 0.0) < 0.5
    of_words = w.groupBy("case_id").agg(
        F.sum("planned").alias("planned_events"), F.count("*").alias("expected_words"), F.count_if("missing").alias("missing_words"), F.count_if("within").alias("durations_within"), F.count_if("compressed").alias("compressed_words"), F.count_if("severely_compressed").alias("severely_compressed_words"),
        F.count_if("stretched").alias("stretched_words"), F.count_if(F.col("both") <= MS // 2).alias("zero_overlap_words"), F.count_if(low).alias("low_coverage_words"), F.round(F.coalesce(F.percentile(F.when(F.col("gold") > 0, F.col("duration_ratio")), F.lit(0.5)), F.lit(0.0)), 6).alias("duration_ratio_median"),
    )
    spans = w.groupBy("case_id", "sentence").agg(F.min("start").alias("s0"), F.max("end").alias("s1"))
    inside = F.col("seen") & (F.col("centre") >= F.col("s0") - MS) & (F.col("centre") <= F.col("s1") + MS)
    of_span = spans.join(e.select("case_id", "sentence", "idx", "start", "end", "centre", "seen"), ["case_id", "sentence"], "left").groupBy("case_id", "sentence", "s0", "s1").agg(F.count("idx").alias("k"), F.coalesce(F.max("end") - F.min("start"), F.lit(0)).alias("shown"), F.coalesce(F.bool_or(inside), F.lit(False)).alias("inside"))
    gold, short = F.col("s1") - F.col("s0"), F.col("shown")
    of_sentences = of_span.groupBy("case_id").agg(F.count("*").alias("expected_sentences"), F.count_if(~F.col("inside")).alias("missing_sentences"), F.count_if((F.col("k") >= 2) & (gold >= _u(0.3)) & (short + _u(0.15) < gold) & (short < 0.65 * gold)).alias("compressed_sentences"))
    areas = cases.sentences(spark, sf).groupBy("case_id", "region").agg(F.min("region_start").alias("r_start"), F.min("region_end").alias("r_end"))
    points = e.where("seen").select("case_id", (F.col("centre") - MS).alias("start"), (F.col("centre") + MS).alias("end"))
    lively = regions.range_join(points, areas, DAY, closed=True).select("case_id", "region").distinct().withColumn("lively", F.lit(True))
    of_regions = areas.join(lively, ["case_id", "region"], "left").groupBy("case_id").agg(F.count("*").alias("expected_regions"), F.count_if(F.col("lively").isNull()).alias("empty_regions"))
    joined = of_regions.join(of_events, "case_id", "left").join(of_words, "case_id", "left").join(of_sentences, "case_id", "left").na.fill(0)
    rate = lambda n, d: F.round(ratio(n, d), 6)
    return joined.withColumn("event_delivery_rate", rate(F.col("delivered_events"), F.col("planned_events"))).withColumn("word_delivery_rate", rate(F.col("expected_words") - F.col("missing_words"), F.col("expected_words")))


SHOWN, SATURATED, DOMINANT, LATE_PEAK = 0.40, 0.90, 0.20, 20 * MS
# Labels: vowels (round ones among them) and bilabials; a label's target is the event of its word and place, if rendered.
_FRAME_PHASE = f"least(greatest((t - a) / greatest(b - a, {_u(0.001)})::DOUBLE, 0e0), 1e0)"
PHONETIC_SQL = f"""{ENVELOPE_SQL}, lb AS (SELECT case_id, idx, word_index, a AS la, b AS lz, (event_id + k) % 5 IN (2, 3) AS vowel, (event_id + k) % 5 = 2 AS round_, (event_id + k) % 5 = 4 AS bilabial, renderable AND NOT cancelled AS supported FROM pr WHERE (event_id + k) % 5 >= 2),
    fr AS (SELECT case_id, idx AS label, word_index AS lw, la + {STEP // 2} + j * {STEP} AS t FROM (SELECT *, unnest(range(0, (lz - la - {STEP // 2} + {STEP - 1}) // {STEP})) AS j FROM lb WHERE supported)),
    fw AS (SELECT fr.case_id, label, lw, t, en.idx, en.word_index, a, b, turns, {_weight_sql('t')} AS w FROM fr JOIN en ON en.case_id = fr.case_id AND att <= t AND rel >= t AND t + {MS // 2} >= commit_at),
    ft AS (SELECT *, {_smooth(f'({_FRAME_PHASE} - 0.35e0) / 0.4e0')} AS turn FROM fw WHERE w > 0.012e0), fx AS (SELECT *, CASE WHEN turns THEN greatest(w * (1e0 - 0.78e0 * turn), w * turn) ELSE w END AS weight FROM ft),
    fa AS (SELECT case_id, label, lw, t, max(weight) FILTER (idx = label) AS target, max({{'w': weight, 'i': -idx, 'word': word_index}}) AS top FROM fx WHERE weight > 0.012e0 GROUP BY ALL),
    fc AS (SELECT case_id, label, count(*) FILTER (target >= {SHOWN}e0) AS visible, count(*) FILTER (target >= {SATURATED}e0) AS saturated, count(*) FILTER (top.w >= {DOMINANT}e0 AND -top.i = label) AS dominant, count(*) FILTER (top.w >= {DOMINANT}e0 AND top.word = lw) AS same_word, count(*) FILTER (top.w >= {DOMINANT}e0 AND top.word <> lw) AS foreign_word FROM fa GROUP BY ALL),
    fn AS (SELECT case_id, label, count(*) AS frames FROM fr GROUP BY ALL), {_samples_sql(STEP)}, fin AS (SELECT case_id, max(greatest(rb, b)) AS stop FROM pr GROUP BY 1),
    pe AS (SELECT sm.case_id, idx, max({{'w': weight, 's': -step}}) AS top FROM sm JOIN fin ON fin.case_id = sm.case_id WHERE step * {STEP} + {MS // 2} >= commit_at AND step * {STEP} <= stop GROUP BY ALL),
    pl_ AS (SELECT lb.case_id, lb.idx, word_index, vowel, round_, bilabial, supported, coalesce(frames, 0) AS frames, coalesce(visible, 0) AS visible, coalesce(saturated, 0) AS saturated, coalesce(dominant, 0) AS dominant, coalesce(same_word, 0) AS same_word, coalesce(foreign_word, 0) AS foreign_word, CASE WHEN bilabial AND supported THEN -pe.top.s * {STEP} - (la + lz) // 2 END AS peak_error_us
      FROM lb LEFT JOIN fn ON fn.case_id = lb.case_id AND fn.label = lb.idx LEFT JOIN fc ON fc.case_id = lb.case_id AND fc.label = lb.idx LEFT JOIN pe ON pe.case_id = lb.case_id AND pe.idx = lb.idx)"""


@query(f"{PHONETIC_SQL} SELECT * FROM pl_")
def phonetic_presentation(spark: SparkSession, sf: str) -> DataFrame:
    """Each vowel's and bilabial's frames: where its event is visible and saturated, which event is the strongest (the first of
    several), and for bilabials when its peak comes. Frames meet envelopes in time buckets of a case."""
    events, shown = _shown(spark, sf)
    of = (F.col("event_id") + F.col("k")) % 5
    labels = events.where(of >= 2).select("case_id", "idx", "word_index", "start", "end", of.isin(2, 3).alias("vowel"), (of == 2).alias("round_"), (of == 4).alias("bilabial"), (F.col("renderable") & ~F.col("cancelled")).alias("supported"))
    count = F.ceil((F.col("end") - F.col("start") - STEP // 2) / STEP)
    frames = labels.where("supported").where(count > 0).select("case_id", F.col("idx").alias("label"), F.col("word_index").alias("of_word"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("j"), (F.col("start") + STEP // 2).alias("t0"))
    frames = frames.select("case_id", "label", "of_word", (F.col("t0") + F.col("j") * STEP).alias("t"))
    # Both sides go to buckets of two hours, a frame to one, an envelope to those it covers.
    width = 2 * HOUR
    spread = shown.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("attack") / width), F.floor(F.greatest("attack", "release") / width))))
    met = frames.withColumn("bucket", F.floor(F.col("t") / width)).join(spread, ["case_id", "bucket"]).where("attack <= t AND release >= t").where(F.col("t") + MS // 2 >= F.col("commit_at"))
    seen = env.weighed(met, F.col("t"), SECOND, "weight", True).where(F.col("weight") > env.LEAST_WEIGHT)
    top = F.max(F.struct("weight", (-F.col("idx")).alias("i"), "word_index")).alias("top")
    each = seen.groupBy("case_id", "label", "of_word", "t").agg(F.max(F.when(F.col("idx") == F.col("label"), F.col("weight"))).alias("target"), top)
    strong = F.col("top.weight") >= DOMINANT
    counts = each.groupBy("case_id", F.col("label").alias("idx")).agg(
        F.count_if(F.col("target") >= SHOWN).alias("visible"), F.count_if(F.col("target") >= SATURATED).alias("saturated"), F.count_if(strong & (-F.col("top.i") == F.col("label"))).alias("dominant"),
        F.count_if(strong & (F.col("top.word_index") == F.col("of_word"))).alias("same_word"), F.count_if(strong & (F.col("top.word_index") != F.col("of_word"))).alias("foreign_word"),
    )
    total = frames.groupBy("case_id", F.col("label").alias("idx")).agg(F.count("*").alias("frames"))
    first = F.greatest(F.ceil(F.col("attack") / STEP), F.col("from_step"))
    last = F.least(F.floor(F.col("release") / STEP), F.col("to_step"))
    lips = shown.where((F.col("event_id") + F.col("k")) % 5 == 4).where(first <= last).withColumn("step", F.explode(F.sequence(first, last)))
    lips = env.weighed(lips, F.col("step") * STEP, SECOND, "weight", True).where(F.col("weight") > env.LEAST_WEIGHT)
    peaks = lips.groupBy("case_id", "idx").agg((-F.max(F.struct("weight", (-F.col("step")).alias("s")))["s"] * STEP).alias("peak"))
    told = labels.join(total, ["case_id", "idx"], "left").join(counts, ["case_id", "idx"], "left").join(peaks, ["case_id", "idx"], "left").na.fill(0, ["frames", "visible", "saturated", "dominant", "same_word", "foreign_word"])
    error = F.when(F.col("bilabial") & F.col("supported"), F.col("peak") - F.floor((F.col("start") + F.col("end")) / 2))
    return told.select("case_id", "idx", "word_index", "vowel", "round_", "bilabial", "supported", "frames", "visible", "saturated", "dominant", "same_word", "foreign_word", error.alias("peak_error_us"))


@query(f"""{PHONETIC_SQL}, g AS (SELECT case_id, count(*) FILTER (vowel) AS vowel_labels, count(*) FILTER (vowel AND supported) AS supported_vowels, coalesce(sum(frames) FILTER (vowel), 0)::BIGINT AS vowel_frames, coalesce(sum(dominant) FILTER (vowel), 0)::BIGINT AS vowel_dominant, coalesce(sum(foreign_word) FILTER (vowel), 0)::BIGINT AS vowel_foreign,
      count(*) FILTER (vowel AND supported AND 2 * dominant < frames OR vowel AND supported AND frames = 0) AS low_dominance_vowels, count(*) FILTER (vowel AND 4 * foreign_word > frames) AS foreign_intrusion_vowels, count(*) FILTER (bilabial) AS bilabial_labels, count(*) FILTER (bilabial AND supported) AS supported_bilabials, coalesce(sum(frames) FILTER (bilabial), 0)::BIGINT AS bilabial_frames,
      coalesce(sum(dominant) FILTER (bilabial), 0)::BIGINT AS bilabial_dominant, count(*) FILTER (peak_error_us > {LATE_PEAK}) AS late_peaks, coalesce(sum(frames) FILTER (round_), 0)::BIGINT AS round_frames, coalesce(sum(saturated) FILTER (round_), 0)::BIGINT AS round_saturated FROM pl_ GROUP BY 1)
    SELECT *, round(CASE WHEN vowel_frames = 0 THEN 1e0 ELSE vowel_dominant / vowel_frames::DOUBLE END, 6) AS vowel_dominance, round(CASE WHEN bilabial_frames = 0 THEN 1e0 ELSE bilabial_dominant / bilabial_frames::DOUBLE END, 6) AS bilabial_dominance, round(CASE WHEN round_frames = 0 THEN 1e0 ELSE round_saturated / round_frames::DOUBLE END, 6) AS round_saturation FROM g""")
def presentation_grade(spark: SparkSession, sf: str) -> DataFrame:
    """Of each case: dominance of vowels and bilabials, intrusion of other words, saturation, late peaks."""
    p = phonetic_presentation(spark, sf)
    v, b, ok = F.col("vowel"), F.col("bilabial"), F.col("supported")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    g = p.groupBy("case_id").agg(
        F.count_if(v).alias("vowel_labels"), F.count_if(v & ok).alias("supported_vowels"), total("frames", v).alias("vowel_frames"), total("dominant", v).alias("vowel_dominant"), total("foreign_word", v).alias("vowel_foreign"),
        F.count_if(v & ok & ((2 * F.col("dominant") < F.col("frames")) | (F.col("frames") == 0))).alias("low_dominance_vowels"), F.count_if(v & (4 * F.col("foreign_word") > F.col("frames"))).alias("foreign_intrusion_vowels"), F.count_if(b).alias("bilabial_labels"), F.count_if(b & ok).alias("supported_bilabials"), total("frames", b).alias("bilabial_frames"),
        total("dominant", b).alias("bilabial_dominant"), F.count_if(F.col("peak_error_us") > LATE_PEAK).alias("late_peaks"), total("frames", F.col("round_")).alias("round_frames"), total("saturated", F.col("round_")).alias("round_saturated"),
    )
    rate = lambda n, d: F.round(ratio(F.col(n), F.col(d)), 6)
    return g.withColumn("vowel_dominance", rate("vowel_dominant", "vowel_frames")).withColumn("bilabial_dominance", rate("bilabial_dominant", "bilabial_frames")).withColumn("round_saturation", rate("round_saturated", "round_frames"))


# Labels lack one event in seven, and one in nine has another pose than planned.
_RUNS_SQL = f"""{ENVELOPE_SQL}, fin AS (SELECT case_id, max(greatest(rb, b)) AS stop FROM pr GROUP BY 1),
    rp AS (SELECT case_id, word_index, idx, k, pose, lag(pose) OVER (PARTITION BY case_id, word_index ORDER BY idx) AS before_ FROM pr WHERE renderable AND strength > 0.012e0),
    rn AS (SELECT *, CAST(sum(CASE WHEN before_ <> pose THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, word_index ORDER BY idx) AS BIGINT) AS run FROM rp), rm AS (SELECT * FROM rn QUALIFY max(run) OVER (PARTITION BY case_id, word_index) > 0),
    lb AS (SELECT case_id, word_index, k, CASE WHEN (event_id + k) % 9 = 4 THEN 'p9' ELSE pose END AS pose, greatest(b - a, 0) AS length FROM pr WHERE (event_id + k) % 7 <> 3),
    rg AS (SELECT rm.case_id, rm.word_index, run, min(rm.pose) AS pose, coalesce(sum(length), 0)::BIGINT AS gold FROM rm LEFT JOIN lb ON lb.case_id = rm.case_id AND lb.word_index = rm.word_index AND lb.k = rm.k AND lb.pose = rm.pose GROUP BY ALL),
    {_samples_sql(STEP)}, rs_ AS (SELECT sm.case_id, rm.word_index, step, run, row_number() OVER (PARTITION BY sm.case_id, rm.word_index, step ORDER BY weight DESC, sm.idx) AS place FROM sm JOIN rm ON rm.case_id = sm.case_id AND rm.idx = sm.idx JOIN fin ON fin.case_id = sm.case_id
      WHERE weight >= 0.02e0 AND strength > 0.012e0 AND step * {STEP} + {MS // 2} >= commit_at AND step * {STEP} <= stop),
    rt_ AS (SELECT case_id, word_index, run, count(*) AS shown FROM rs_ WHERE place = 1 GROUP BY ALL), ra_ AS (SELECT rg.*, coalesce(shown, 0) AS shown FROM rg LEFT JOIN rt_ USING (case_id, word_index, run)),
    rb_ AS (SELECT *, count(*) FILTER (gold > 0) OVER w >= 2 AS gradeable, sum(gold) OVER w AS gold_all, sum(shown) OVER w AS shown_all, max(run) OVER w AS last_ FROM ra_ WINDOW w AS (PARTITION BY case_id, word_index)),
    rc_ AS (SELECT *, CASE WHEN gradeable THEN gold / gold_all::DOUBLE END AS gold_share, CASE WHEN gradeable THEN CASE WHEN shown_all > 0 THEN shown / shown_all::DOUBLE ELSE 0e0 END END AS shown_share FROM rb_),
    rd_ AS (SELECT *, abs(shown_share - gold_share) AS error, CASE WHEN run < last_ THEN abs(sum(shown_share - gold_share) OVER (PARTITION BY case_id, word_index ORDER BY run)) END AS boundary_error, 0.5e0 * sum(abs(shown_share - gold_share)) OVER (PARTITION BY case_id, word_index) AS total_variation FROM rc_)"""


def _run_shares(spark: SparkSession, sf: str) -> DataFrame:
    events, shown = _shown(spark, sf)
    of = F.col("event_id") + F.col("k")
    planned = events.where("renderable").where(F.col("strength") > env.LEAST_WEIGHT).select("case_id", "word_index", "idx", "k", "pose")
    labels = events.where(of % 7 != 3).select("case_id", "word_index", "k", F.when(of % 9 == 4, "p9").otherwise(F.col("pose")).alias("pose"), (F.col("end") - F.col("start")).alias("length"))
    first, last = F.greatest(F.ceil(F.col("attack") / STEP), F.col("from_step")), F.least(F.floor(F.col("release") / STEP), F.col("to_step"))
    strong = shown.where(F.col("strength") > env.LEAST_WEIGHT).where(first <= last).drop("word_index")

    def samples(of: DataFrame) -> DataFrame:
        dealt = strong.join(of, ["case_id", "idx"]).repartition("case_id", "word_index")
        return env.weighed(dealt.withColumn("step", F.explode(F.sequence(first, last))), F.col("step") * STEP, SECOND, "weight", True)

    return runs.shares(planned, labels, samples, ["case_id"])


@query(f"{_RUNS_SQL} SELECT case_id, word_index, run, pose, gold AS gold_us, shown AS shown_steps, gradeable, round(gold_share, 6) AS gold_share, round(shown_share, 6) AS shown_share, round(error, 6) AS error, round(boundary_error, 6) AS boundary_error, round(total_variation, 6) AS total_variation FROM rd_")
def run_shares(spark: SparkSession, sf: str) -> DataFrame:
    """What share of its word each run of a pose has, by the labels and as shown, and the error at each boundary so far."""
    f = lambda c: F.round(c, 6).alias(c)
    return _run_shares(spark, sf).select("case_id", "word_index", "run", "pose", F.col("gold").alias("gold_us"), F.col("shown").alias("shown_steps"), "gradeable", *map(f, ("gold_share", "shown_share", "error", "boundary_error", "total_variation")))


_THREE = ", ".join(f"round(coalesce(avg({c}), 0), 6) AS {n}_mean, round(coalesce(quantile_cont({c}, 0.5), 0), 6) AS {n}_median, round(coalesce(quantile_cont({c}, 0.9), 0), 6) AS {n}_p90" for n, c in (("share_error", "error"), ("boundary_error", "boundary_error"), ("variation", "CASE WHEN run = 0 THEN total_variation END")))


@query(f"""{_RUNS_SQL}, g AS (SELECT case_id, count(*) FILTER (run = 0) AS words, count(*) FILTER (run = 0 AND gradeable) AS gradeable_words, count(*) FILTER (run = 0 AND NOT gradeable) AS ungradeable_words, count(*) FILTER (run = 0 AND gradeable AND shown_all = 0) AS dark_words, count(*) FILTER (gradeable) AS runs, count(*) FILTER (error <= 0.100000001e0) AS near_runs,
      count(*) FILTER (run = 0 AND total_variation > 0.250000001e0) AS severe_words, {_THREE} FROM rd_ GROUP BY 1)
    SELECT *, round(gradeable_words / words::DOUBLE, 6) AS word_coverage, round(CASE WHEN runs > 0 THEN near_runs / runs::DOUBLE ELSE 1e0 END, 6) AS near_rate FROM g""")
def proportion_grade(spark: SparkSession, sf: str) -> DataFrame:
    """Of each case: words of several runs, how near the runs are to their shares, boundaries and total variation."""
    g = runs.grade(_run_shares(spark, sf), ["case_id"])
    return g.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in g.dtypes))
