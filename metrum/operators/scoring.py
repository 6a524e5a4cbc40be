"""Scores of runtime events against gold words and regions: lookups, onsets, assignment to regions, boundaries, gates.

Events: case_id, word_index, k, n (planned events of the word), idx (order of the track), centre, pose, renderable,
cancelled, strength, reason. Times are whole microseconds, so errors are exact; ratios are made last.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.functions import stats
from metrum.functions.intervals import distance
from metrum.operators import regions

# Fixed value: the strength above which an event counts for delivery.
DELIVERED = 0.012


def rendered() -> Column:
    return F.col("renderable") & ~F.col("cancelled")


def delivery_candidate() -> Column:
    return rendered() & (F.col("strength") > DELIVERED)


def rendered_neighbours(events: DataFrame) -> DataFrame:
    """Rendered events with previous and next, the idx of those before and after them; others are passed over."""
    w = Window.partitionBy("case_id").orderBy("idx")
    return events.where(rendered()).withColumn("previous", F.lag("idx").over(w)).withColumn("next", F.lead("idx").over(w))


def last_row_wins(left: DataFrame, right: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """left with columns of right's last row of the same keys; null without one."""
    last = right.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_r"))
    return left.join(last, keys, "left").select(*left.columns, *(F.col(f"_r.{c}").alias(c) for c in columns))


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """left with columns of right's first row of the same keys; null without one."""
    first = right.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_r"))
    return left.join(first, keys, "left").select(*left.columns, *(F.col(f"_r.{c}").alias(c) for c in columns))


def region_at(points: DataFrame, found: DataFrame) -> DataFrame:
    """points (case_id, idx, at) with containing, the first region (r_idx, r_start, r_end: disjoint) that holds the point, or
    -1, and nearest, the region with the least distance, 0 inside, the first of several, or -1 without any. One sort of
    points and starts together: only the regions before and after a point can be its nearest."""
    none = F.lit(None)
    rows = points.select("case_id", "at", "idx", none.cast("struct<i:int,s:bigint,e:bigint>").alias("r"), F.lit(1).alias("kind"))
    rows = rows.unionByName(found.select("case_id", F.col("r_start").alias("at"), none.cast(points.schema["idx"].dataType).alias("idx"), F.struct(F.col("r_idx").cast("int").alias("i"), F.col("r_start").alias("s"), F.col("r_end").alias("e")).alias("r"), F.lit(0).alias("kind")))
    w = Window.partitionBy("case_id").orderBy("at", "kind", "idx")
    seen = rows.withColumn("b", F.last("r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("a", F.first("r", True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("kind = 1")
    off = lambda c: distance(F.col("at"), F.col(f"{c}.s"), F.col(f"{c}.e"))
    nearest = F.when(F.col("b").isNull(), F.coalesce("a.i", F.lit(-1))).when(F.col("a").isNull() | (off("b") <= off("a")), F.col("b.i")).otherwise(F.col("a.i"))
    inside = F.coalesce(F.col("at") <= F.col("b.e"), F.lit(False))
    return seen.select("case_id", "idx", F.when(inside, F.col("b.i")).otherwise(F.lit(-1)).alias("containing"), nearest.alias("nearest"))


def onset_report(words: DataFrame, references: DataFrame, events: DataFrame, lead: int) -> DataFrame:
    """By case: of the words that references (case_id, word_index) name, how many have a rendered event, and how far its
    start, `lead` before its centre, is from the word's. In milliseconds; 0 where nothing is matched."""
    asked = references.select("case_id", "word_index").distinct()
    starts = first_match(asked, events.where(rendered()), ["case_id", "word_index"], "idx", ["centre"]).join(words.select("case_id", "word_index", "start"), ["case_id", "word_index"], "left")
    e = starts.withColumn("error", F.col("centre") - lead - F.col("start"))
    ms = lambda c: c / 1000.0  # noqa: E731 - means are of whole numbers, so they are exact but for the division
    return e.groupBy("case_id").agg(
        F.count("*").alias("reference_count"), F.count("error").alias("matched_count"), (F.count("*") - F.count("error")).alias("missing_count"), ms(stats.mean(F.abs("error"))).alias("mean_abs_ms"), ms(stats.percentile(F.abs("error"), 0.5)).alias("median_abs_ms"),
        ms(stats.percentile(F.abs("error"), 0.9)).alias("p90_abs_ms"), ms(stats.mean(F.when(F.col("error") < 0, -F.col("error")).when(F.col("error") >= 0, 0))).alias("mean_early_ms"), ms(stats.mean(F.when(F.col("error") > 0, F.col("error")).when(F.col("error") <= 0, 0))).alias("mean_late_ms"),
    )


def track_grade(labels: DataFrame, events: DataFrame, half: int, slack: int) -> DataFrame:
    """By case: labels (case_id, word_index, k, start, end) against the rendered event of the same word and place: counts,
    mean errors of centre, start, end and duration in milliseconds, rates of starts and ends `slack` too early and too
    late, and order violations of the whole track. Events last from `half` before to `half` after their centres."""
    w = Window.partitionBy("case_id").orderBy("idx")
    back = F.coalesce(F.col("centre") + 1 < F.lag("centre").over(w), F.lit(False))
    track = events.withColumn("_b", back).groupBy("case_id").agg(F.count_if("_b").alias("order_violations"), F.count_if(rendered()).alias("committed_count"))
    m = labels.join(events.where(rendered()).select("case_id", "word_index", "k", "centre"), ["case_id", "word_index", "k"], "left")
    s, e = F.col("centre") - half, F.col("centre") + half
    ms = lambda c, unit=1000.0: stats.mean(F.abs(c)) / unit
    hit = F.count("centre")
    told = m.groupBy("case_id").agg(
        F.count("*").alias("reference_count"), hit.alias("matched_count"), ms(2 * F.col("centre") - F.col("start") - F.col("end"), 2000.0).alias("centre_ms"), ms(s - F.col("start")).alias("start_ms"), ms(e - F.col("end")).alias("end_ms"), ms(e - s - F.col("end") + F.col("start")).alias("duration_ms"),
        F.when(hit > 0, F.count_if(s + slack < F.col("start")) / hit).otherwise(0.0).alias("early_start_rate"), F.when(hit > 0, F.count_if(e - slack > F.col("end")) / hit).otherwise(0.0).alias("late_tail_rate"),
    )
    return track.join(told, "case_id", "full").na.fill(0).withColumn("missing_count", F.col("reference_count") - F.col("matched_count")).withColumn("extra_count", F.col("committed_count") - F.col("matched_count"))


def word_assignment(events: DataFrame, detected: DataFrame, gold: DataFrame, gold_of_word: DataFrame, width: int) -> DataFrame:
    """One row a word: case_id, word_index, planned, committed, complete, runtime (sorted regions of its rendered events'
    centres), mapped (the gold regions these overlap most), gold (its own), delta (mapped - gold where the word maps to one
    region, else 0), strict (complete, and in one region that maps to its own)."""
    points = events.where(rendered()).select("case_id", F.col("idx"), F.col("centre").alias("at"))
    owner = regions.owner_of_point(points, detected, width, 0)
    spans = detected.select("case_id", F.col("r_idx").alias("idx"), F.col("r_start").alias("start"), F.col("r_end").alias("end"))
    to_gold = regions.best_overlap(spans, gold, width).select("case_id", F.col("idx").alias("owner"), F.col("match").alias("to"))
    own = owner.where("owner >= 0").join(to_gold, ["case_id", "owner"], "left")
    each = events.join(own, ["case_id", "idx"], "left")
    w = each.groupBy("case_id", "word_index").agg(F.max("n").cast("long").alias("planned"), F.count_if(rendered()).alias("committed"), F.array_sort(F.collect_set("owner")).alias("runtime"), F.array_sort(F.collect_set(F.when(F.col("to") >= 0, F.col("to")))).alias("mapped"))
    w = w.join(gold_of_word.select("case_id", "word_index", "gold"), ["case_id", "word_index"], "left").withColumn("complete", (F.col("planned") > 0) & (F.col("planned") == F.col("committed")))
    one = F.size("mapped") == 1
    delta = F.when(one & (F.col("gold") >= 0), F.col("mapped")[0] - F.col("gold")).otherwise(F.lit(0))
    strict = F.col("complete") & (F.size("runtime") == 1) & one & F.coalesce(F.get("mapped", F.lit(0)) == F.col("gold"), F.lit(False))
    return w.withColumn("delta", delta).withColumn("strict", strict)


def assignment_report(assigned: DataFrame, detected: DataFrame, gold: DataFrame, width: int) -> DataFrame:
    """By case: words, complete, split and incomplete ones, strict successes, complete words put into an earlier region
    (theft) or a later one, and overruns: runtime regions whose last complete word of one region lies behind the last word
    of the gold region that they overlap most, and by how many words at most."""
    per = assigned.groupBy("case_id").agg(
        F.count("*").alias("words"), F.count_if("complete").alias("complete"), F.count_if(F.size("runtime") > 1).alias("split_words"), F.count_if((F.col("planned") > 0) & ~F.col("complete")).alias("incomplete_words"), F.count_if("strict").alias("strict_successes"),
        F.count_if(F.col("complete") & (F.col("delta") < 0)).alias("early_theft"), F.count_if(F.col("complete") & (F.col("delta") > 0)).alias("late_assignment"),
    )
    last = assigned.where(F.col("complete") & (F.size("runtime") == 1)).groupBy("case_id", F.col("runtime")[0].alias("idx")).agg(F.max("word_index").alias("last"))
    ends = assigned.where("gold >= 0").groupBy("case_id", F.col("gold").alias("match")).agg(F.max("word_index").alias("until"))
    spans = detected.select("case_id", F.col("r_idx").alias("idx"), F.col("r_start").alias("start"), F.col("r_end").alias("end"))
    mapped = regions.best_overlap(spans, gold, width).select("case_id", "idx", "match")
    over = last.join(mapped, ["case_id", "idx"]).join(ends, ["case_id", "match"]).where("last > until")
    worst = over.groupBy("case_id").agg(F.count("*").alias("overruns"), F.max(F.col("last") - F.col("until")).alias("max_overrun"))
    return per.join(worst, "case_id", "left").na.fill(0)


def boundary_levels(assigned: DataFrame, physical: DataFrame) -> DataFrame:
    """Each word but a case's last, with the next: case_id, word_index, and whether gold parts them (gold), whether the
    scheduler does (scheduled: both words complete and in one region each) and whether detection does (detected; physical:
    case_id, word_index, region of the word's middle, -1 for none); exact: all three seen and equal; missed, extra,
    post_in_previous (gold parts them, the scheduler has both in one region), split_word and incomplete beside it."""
    w = Window.partitionBy("case_id").orderBy("word_index")
    rows = assigned.join(physical.select("case_id", "word_index", "region"), ["case_id", "word_index"], "left")
    here = F.struct("gold", "complete", "runtime", "region")
    both = rows.select("case_id", "word_index", here.alias("b"), F.lead(here).over(w).alias("a")).where("a IS NOT NULL")
    one = lambda c: F.size(f"{c}.runtime") == 1
    gold = (F.col("b.gold") >= 0) & (F.col("a.gold") >= 0) & (F.col("b.gold") != F.col("a.gold"))
    seen = F.col("b.complete") & F.col("a.complete") & one("b") & one("a")
    parted = seen & (F.get("b.runtime", F.lit(0)) != F.get("a.runtime", F.lit(0)))
    observed = (F.col("b.region") >= 0) & (F.col("a.region") >= 0)
    told = both.withColumn("gold", F.coalesce(gold, F.lit(False))).withColumn("observable", seen).withColumn("scheduled", F.coalesce(parted, F.lit(False))).withColumn("observed", F.coalesce(observed, F.lit(False)))
    told = told.withColumn("detected", F.col("observed") & (F.col("b.region") != F.col("a.region")))
    return told.select(
        "case_id", "word_index", "gold", "scheduled", "detected", (F.col("observed") & F.col("observable") & (F.col("gold") == F.col("scheduled")) & (F.col("gold") == F.col("detected"))).alias("exact"), (F.col("gold") & ~F.col("detected")).alias("missed"), (~F.col("gold") & F.col("detected")).alias("extra"),
        (F.col("gold") & one("b") & one("a") & F.coalesce(F.get("b.runtime", F.lit(0)) == F.get("a.runtime", F.lit(0)), F.lit(False))).alias("post_in_previous"), ((F.size("b.runtime") > 1) | (F.size("a.runtime") > 1)).alias("split_word"), (~F.col("b.complete") | ~F.col("a.complete")).alias("incomplete"),
    )


def region_commits(events: DataFrame, detected: DataFrame, width: int) -> DataFrame:
    """Non-empty detected regions (case_id, r_idx, r_start, r_end) with the first and last centre of rendered events within,
    their number, and tail, from the last centre to the region's end; nulls without events."""
    points = events.where(rendered()).select("case_id", "idx", F.col("centre").alias("at"))
    own = regions.owner_of_point(points, detected, width, 0).where("owner >= 0").join(points, ["case_id", "idx"])
    seen = own.groupBy("case_id", F.col("owner").alias("r_idx")).agg(F.count("*").alias("events"), F.min("at").alias("first"), F.max("at").alias("last"))
    return detected.where("r_end > r_start").join(seen, ["case_id", "r_idx"], "left").withColumn("events", F.coalesce("events", F.lit(0))).withColumn("tail", F.col("r_end") - F.col("last"))


def log_report(words: DataFrame, events: DataFrame, late: float) -> DataFrame:
    """One row: words, visible ones (with a rendered event), missing, incomplete ones, signed and absolute mean and median of
    the onset error in milliseconds, and how many are later than `late`."""
    on = events.groupBy("case_id", "word_index").agg(F.min_by("centre", F.when(rendered(), F.col("idx"))).alias("centre"), F.count_if(rendered()).alias("committed"), F.max("n").alias("n"))
    e = words.join(on, ["case_id", "word_index"], "left").withColumn("error", F.col("centre") - F.col("start"))
    return e.agg(
        F.count("*").alias("words"), F.count("error").alias("visible"), (F.count("*") - F.count("error")).alias("missing"), F.count_if(F.coalesce(F.col("committed") != F.col("n"), F.lit(True))).alias("incomplete"), (stats.mean(F.col("error")) / 1000.0).alias("signed_mean_ms"),
        (stats.mean(F.abs("error")) / 1000.0).alias("mean_abs_ms"), (stats.percentile(F.abs("error"), 0.5) / 1000.0).alias("median_abs_ms"), F.count_if(F.col("error") > late * 1000).alias("late"),
    )


# Metrics of the scorecard, the direction in which they may move, and the name of the tolerance.
BASELINE_GATES = [
    ("region_start.success_rate", "min", "max_region_start_success_drop"),
    ("region_start.mean_abs_error_ms", "max", "max_region_start_mae_ms_increase"),
    ("word_animation_onset.success_rate", "min", "max_word_onset_success_drop"),
    ("word_animation_onset.mean_abs_error_ms", "max", "max_word_onset_mae_ms_increase"),
    ("word_interval_alignment.spoken_coverage_mean", "min", "max_word_interval_coverage_drop"),
    ("word_interval_alignment.onset_p95_abs_error_ms", "max", "max_word_interval_onset_p95_ms_increase"),
    ("decoded_viseme_alignment.identity_recall", "min", "max_decoded_viseme_identity_recall_drop"),
    ("decoded_viseme_alignment.identity_precision", "min", "max_decoded_viseme_identity_precision_drop"),
    ("decoded_viseme_alignment.mean_abs_center_error_ms", "max", "max_decoded_viseme_center_mae_ms_increase"),
    ("word_duration.success_rate", "min", "max_word_duration_success_drop"),
    ("word_duration.mean_abs_error_ms", "max", "max_word_duration_mean_mae_ms_increase"),
    ("word_duration.median_abs_error_ms", "max", "max_word_duration_median_mae_ms_increase"),
    ("strict_region_segmentation.exact_boundary_rate", "min", "max_strict_region_drop"),
    ("word_region_assignment.success_rate", "min", "max_word_region_assignment_drop"),
    ("strict_three_level_word_assignment.success_rate", "min", "max_strict_word_assignment_drop"),
    ("pause.clean_rate", "min", "max_pause_clean_drop"),
    ("guardrails.event_completion_rate", "min", "max_event_completion_drop"),
    ("runtime_delivery.compressed_sentences", "max", "max_compressed_sentences_increase"),
    ("presentation_event_visibility.robust_visible_event_rate", "min", "max_presentation_robust_visible_event_rate_drop"),
    ("presentation_event_visibility.robust_boundary_event_rate", "min", "max_presentation_robust_boundary_event_rate_drop"),
    ("phonetic_presentation.vowel_target_dominance_rate", "min", "max_vowel_target_dominance_drop"),
    ("phonetic_presentation.vowel_foreign_word_dominance_rate", "max", "max_vowel_foreign_dominance_increase"),
    ("phonetic_presentation.bilabial_peak_mean_abs_error_ms", "max", "max_bilabial_peak_mae_ms_increase"),
]


# Confusions and tails, which may grow by a tolerance over the baseline.
TAIL_GATES = [
    ("word_region_confusion.early_region_thefts", "max", "max_early_region_thefts_increase"),
    ("word_region_confusion.late_region_assignments", "max", "max_late_region_assignments_increase"),
    ("word_region_confusion.materially_early_intact_words", "max", "max_materially_early_intact_words_increase"),
    ("word_region_confusion.max_intact_word_lead_ms", "max", "max_intact_word_lead_ms_increase"),
    ("word_interval_alignment.zero_overlap_words", "max", "max_zero_overlap_words_increase"),
    ("word_interval_alignment.low_coverage_words", "max", "max_low_coverage_words_increase"),
    ("word_interval_alignment.onsets_over_200ms", "max", "max_onsets_over_200ms_increase"),
    ("phonetic_presentation.late_bilabial_peaks", "max", "max_late_bilabial_peaks_increase"),
]

# Metrics with a limit of their own, its direction and its name.
ABSOLUTE_GATES = [
    ("guardrails.order_violations", "max", "max_order_violations"),
    ("word_duration.coverage_rate", "min", "min_word_duration_coverage_rate"),
    ("word_duration.severely_compressed_words", "max", "max_severely_compressed_words"),
    ("runtime_delivery.event_delivery_rate", "min", "min_runtime_event_delivery_rate"),
    ("runtime_delivery.word_delivery_rate", "min", "min_runtime_word_delivery_rate"),
    ("runtime_delivery.speech_region_delivery_rate", "min", "min_runtime_speech_region_delivery_rate"),
    ("runtime_delivery.sentence_delivery_rate", "min", "min_runtime_sentence_delivery_rate"),
    ("runtime_delivery.late_after_window_events", "max", "max_late_after_window_events"),
    ("runtime_delivery.empty_speech_regions", "max", "max_empty_speech_regions"),
    ("runtime_delivery.missing_sentences", "max", "max_missing_sentences"),
    ("viseme_proportion.word_coverage_rate", "min", "min_viseme_proportion_word_coverage_rate"),
    ("viseme_proportion.run_share_abs_error_median", "max", "max_viseme_run_share_abs_error_median"),
    ("viseme_proportion.boundary_position_abs_error_median", "max", "max_viseme_boundary_position_abs_error_median"),
    ("viseme_proportion.word_total_variation_median", "max", "max_viseme_word_total_variation_median"),
    ("viseme_proportion.zero_runtime_words", "max", "max_viseme_zero_runtime_words"),
    ("presentation_event_visibility.robust_visible_event_rate", "min", "min_presentation_robust_visible_event_rate"),
    ("presentation_event_visibility.robust_boundary_event_rate", "min", "min_presentation_robust_boundary_event_rate"),
]


def absolute_gates(summary: DataFrame, thresholds: DataFrame) -> DataFrame:
    """As baseline_gates, with the thresholds themselves as limits."""
    none = thresholds.select(F.lit("").alias("metric"), F.lit(0.0).alias("value")).where("false")
    told = baseline_gates(summary, none, thresholds, ABSOLUTE_GATES, absolute=True)
    return told.withColumn("missing", F.when(F.col("missing") == "tolerance", "threshold").otherwise(F.col("missing")))


def baseline_gates(summary: DataFrame, baseline: DataFrame, thresholds: DataFrame, gates: list[tuple[str, str, str]] = BASELINE_GATES, absolute: bool = False) -> DataFrame:
    """metric, actual, limit, passed for every gate whose metric, baseline and tolerance are there. summary and baseline:
    (metric, value) by dotted paths; thresholds: (name, value). missing says which of them is not there; such a gate fails."""
    gates = summary.sparkSession.createDataFrame(gates, "metric string, direction string, name string")
    rows = F.broadcast(gates).join(summary.select("metric", F.col("value").alias("actual")), "metric", "left").join(baseline.select("metric", F.col("value").alias("accepted")), "metric", "left").join(thresholds.select("name", F.col("value").alias("tolerance")), "name", "left")
    limit = F.col("tolerance") if absolute else F.when(F.col("direction") == "min", F.col("accepted") - F.col("tolerance")).otherwise(F.col("accepted") + F.col("tolerance"))
    ok = F.when(F.col("direction") == "min", F.col("actual") >= F.col("limit")).otherwise(F.col("actual") <= F.col("limit"))
    missing = F.when(F.col("actual").isNull(), "metric").when(F.col("accepted").isNull() & F.lit(not absolute), "baseline").when(F.col("tolerance").isNull(), "tolerance").otherwise("")
    return rows.withColumn("limit", limit).select("metric", "actual", "limit", F.coalesce(ok, F.lit(False)).alias("passed"), missing.alias("missing"))


def intra_word_report(labels: DataFrame, events: DataFrame, limit: int, half: int) -> DataFrame:
    """By case: labels (case_id, word_index, k, pose, start, end) but each word's first, against rendered events but each
    word's first. A label and an event match by word, place and pose if their centres are at most `limit` apart; places
    grow along the track, so such matches are in order. Counts, and errors in milliseconds, 0 without a match. Words with
    one label take no part, nor do their events; a label's (word_index, k) is that of one event at most."""
    w = Window.partitionBy("case_id", "word_index")
    later = lambda d, *order: d.withColumn("_i", F.row_number().over(w.orderBy(*order))).where("_i > 1").drop("_i")
    keys = ["case_id", "word_index"]
    rest = later(labels, "start", "k")
    shown = later(events.where(rendered()), "idx").select(*keys, "k", "pose", "centre").join(rest.select(*keys).distinct(), keys, "left_semi")
    predicted = shown.groupBy("case_id").agg(F.count("*").alias("predicted"))
    twice = 2 * F.col("centre") - F.col("start") - F.col("end")
    m = rest.join(shown, [*keys, "k", "pose"], "left").withColumn("centre", F.when(F.abs(twice) <= 2 * limit, F.col("centre")))
    off = F.abs(twice)
    told = m.groupBy("case_id").agg(
        F.count("*").alias("reference_count"), F.count("centre").alias("matched_count"), (stats.mean(off) / 2000.0).alias("centre_ms"), (stats.percentile(off, 0.5) / 2000.0).alias("median_centre_ms"), (stats.percentile(off, 0.9) / 2000.0).alias("p90_centre_ms"),
        (stats.mean(F.abs(F.col("centre") - half - F.col("start"))) / 1000.0).alias("start_ms"), (stats.mean(F.abs(F.col("centre") + half - F.col("end"))) / 1000.0).alias("end_ms"),
    )
    told = told.join(predicted, "case_id", "left").withColumn("missing_count", F.col("reference_count") - F.col("matched_count"))
    return told.withColumn("extra_count", F.coalesce("predicted", F.lit(0)) - F.col("matched_count")).drop("predicted")


def focus_report(labels: DataFrame, events: DataFrame, gold: DataFrame) -> DataFrame:
    """By case, how heads are met. labels (case_id, word_index, k, start, end, vowel, region; -1: none) and gold (case_id,
    r_idx, r_start, r_end). A word's head is its first label with the rendered event of its place; a region's head is its
    first word that has one; its nucleus is that word's first vowel label with the word's first rendered event. Errors of
    centres in milliseconds; resumes are heads of regions but the first, and are early by what they lie before the region's
    start; drift is how much earlier a word is than its region's head, at most. Words of no region form one region of their
    own for heads, as region -1."""
    keys = ["case_id", "word_index"]
    shown = events.where(rendered())
    first = labels.groupBy(*keys).agg(F.min_by(F.struct("k", "start", "end", "region"), F.struct("start", "k")).alias("l")).select(*keys, "l.*")
    by_place = shown.groupBy(*keys, "k").agg(F.min_by("centre", "idx").alias("centre"))
    heads = first.join(by_place, [*keys, "k"], "left").withColumn("error", 2 * F.col("centre") - F.col("start") - F.col("end"))
    w = Window.partitionBy("case_id", "region").orderBy(F.col("error").isNull(), "word_index")
    heads = heads.withColumn("head_error", F.first("error").over(w)).withColumn("is_head", (F.row_number().over(w) == 1) & F.col("error").isNotNull())
    nucleus = labels.where("vowel").groupBy(*keys).agg(F.min_by(F.struct("start", "end"), F.struct("start", "k")).alias("v"))
    opening = shown.groupBy(*keys).agg(F.min_by("centre", "idx").alias("opening"))
    starts = gold.select("case_id", F.col("r_idx").alias("region"), "r_start", (F.row_number().over(Window.partitionBy("case_id").orderBy("r_idx")) > 1).alias("again"))
    rows = heads.join(nucleus, keys, "left").join(opening, keys, "left").join(starts, ["case_id", "region"], "left")
    head = F.col("is_head")
    resume = head & F.coalesce("again", F.lit(False))
    lead = F.when(resume, F.greatest(F.col("r_start") - F.col("centre"), F.lit(0)))
    core = F.when(head, F.abs(2 * F.col("opening") - F.col("v.start") - F.col("v.end")))
    rate = lambda part, whole, empty: F.when(whole > 0, part / whole).otherwise(F.lit(empty))
    words, regions_ = F.count("*"), F.count_distinct(F.when(F.col("region") >= 0, F.col("region")))
    return rows.groupBy("case_id").agg(
        words.alias("word_count"), F.count("error").alias("word_heads"), rate(F.count("error"), words, 1.0).alias("word_head_rate"), (stats.mean(F.abs("error")) / 2000.0).alias("word_head_ms"), regions_.alias("region_count"), F.count_if(head).alias("region_heads"),
        (stats.mean(F.abs(F.when(head, F.col("error")))) / 2000.0).alias("region_head_ms"), F.count(core).alias("nuclei"), (stats.mean(core) / 2000.0).alias("nucleus_ms"), F.count_if(resume).alias("resumes"), F.count_if(lead > 0).alias("early_resumes"),
        rate(F.count_if(lead > 0), F.count_if(resume), 0.0).alias("early_resume_rate"), (F.coalesce(F.max(lead), F.lit(0)) / 1000.0).alias("early_resume_max_ms"), (F.greatest(F.coalesce(F.max(F.col("head_error") - F.col("error")), F.lit(0)), F.lit(0)) / 2000.0).alias("drift_max_ms"),
    )


def deliver_late(events: DataFrame, late: int, ahead: int) -> DataFrame:
    """case_id, idx, at, moved of events (case_id, idx, centre, clock): where they are shown. In the order of idx a centre
    is at least one microsecond after the one before; one that then lies more than `late` behind its clock goes `ahead` of
    it. Each depends on the one before, so a case is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        at, moved, last = [], [], None
        for centre, clock in zip(pdf["centre"].tolist(), pdf["clock"].tolist(), strict=True):
            centre = centre if last is None else max(centre, last + 1)
            moved.append(clock - centre > late)
            last = clock + ahead if moved[-1] else centre
            at.append(last)
        return pd.DataFrame({"case_id": pdf["case_id"], "idx": pdf["idx"], "at": at, "moved": moved})

    return events.select("case_id", "idx", "centre", "clock").groupBy("case_id").applyInPandas(run, "case_id long, idx long, at long, moved boolean")
