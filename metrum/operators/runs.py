"""Runs of equal poses in a word: what share of the word each has, by the labels and as it is shown.

Runs are islands of a word's events; a sample of the track counts for the run of its strongest event in the word, so
overlaps count once. Windows hold one word; sums over labels and samples are plain aggregations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.functions.intervals import ratio
from metrum.functions.stats import mean, percentile

# The least weight of a sample, an error of share that is near, and a word's total variation that is severe.
# Shares are quotients, so both bounds hold up to 1e-9.
LEAST_SAMPLE, NEAR, SEVERE, SLACK = 0.020, 0.10, 0.25, 1e-9


def runs_of(events: DataFrame, case: list[str]) -> DataFrame:
    """events (case, word_index, idx, pose, ...) with run: from 0 in each word, new wherever the pose changes. A word's events
    may lie among other words' ones; null is a pose like any other."""
    w = Window.partitionBy(*case, "word_index").orderBy("idx")
    fresh = F.when(F.lag("idx").over(w).isNull(), 0).otherwise((~F.lag("pose").over(w).eqNullSafe(F.col("pose"))).cast("long"))
    return events.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(w)).drop("_fresh")


def shares(events: DataFrame, labels: DataFrame, samples: DataFrame | Callable[[DataFrame], DataFrame], case: list[str]) -> DataFrame:
    """case, word_index, run, pose, gold, shown, gradeable, gold_share, shown_share, error, boundary_error (null for the last
    run), total_variation: of words with two runs or more; the last five are null unless the word is gradeable: two of its
    runs have labels.

    events as in runs_of, with k, the phone's place. labels (case, word_index, k, pose, length): summed by these. samples
    (case, idx, step, weight): the largest weight of a step and word counts, the first event of several; events that are not
    among `events` count for nothing. A word that isn't shown has shares of 0. samples may be a function that gets case,
    word_index, idx and run and gives these with step and weight: rows are then dealt by word before they become samples,
    which are never exchanged."""
    word = [*case, "word_index"]
    found = runs_of(events, case)
    many = found.groupBy(*word).agg(F.max("run").alias("_last")).where("_last > 0")
    found = found.join(many, word)
    label = labels.groupBy(*word, "k", "pose").agg(F.sum(F.greatest("length", F.lit(0))).alias("_gold"))
    # Two events of one phone and pose would both have its label.
    gold = found.join(label, [*word, "k", "pose"], "left").groupBy(*word, "run").agg(F.first("pose").alias("pose"), F.coalesce(F.sum("_gold"), F.lit(0)).alias("gold"))
    of = found.select(*case, "idx", "word_index", "run")
    at = samples(of) if callable(samples) else samples.join(of, [*case, "idx"])
    at = at.where(F.col("weight") >= LEAST_SAMPLE)
    top = at.groupBy(*word, "step").agg(F.max(F.struct("weight", (-F.col("idx")).alias("i"), "run"))["run"].alias("run"))
    shown = top.groupBy(*word, "run").agg(F.count("*").alias("shown"))
    each = gold.join(shown, [*word, "run"], "left").na.fill(0, ["shown"])
    all_, upto = Window.partitionBy(*word), Window.partitionBy(*word).orderBy("run")
    told = each.withColumn("gradeable", F.count_if(F.col("gold") > 0).over(all_) >= 2)
    share = lambda c: F.when(F.col("gradeable"), ratio(F.col(c), F.sum(c).over(all_), 0.0))
    told = told.withColumn("gold_share", share("gold")).withColumn("shown_share", share("shown")).withColumn("error", F.abs(F.col("shown_share") - F.col("gold_share")))
    so_far = F.sum(F.col("shown_share") - F.col("gold_share")).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    last = F.lead("run").over(upto).isNull()
    return told.withColumn("boundary_error", F.when(~last, F.abs(so_far))).withColumn("total_variation", 0.5 * F.sum("error").over(all_))


def grade(found: DataFrame, case: list[str]) -> DataFrame:
    """Of the rows of shares(): words, gradeable and ungradeable ones, their rate, words that aren't shown, runs, runs near
    their share and their rate, severe words, and mean, median and 90th percentile of errors of shares, boundaries and
    words. Rates of nothing are 1, errors of nothing 0."""
    first, ok = F.col("run") == 0, F.col("gradeable")
    words = lambda c: F.count_if(first & c)
    dark = found.withColumn("_dark", F.sum("shown").over(Window.partitionBy(*case, "word_index")) == 0)
    near, severe = F.col("error") <= NEAR + SLACK, F.col("total_variation") > SEVERE + SLACK
    variation = F.when(first, F.col("total_variation"))

    def told(name: str, c: Column) -> list[Column]:
        return [mean(c).alias(f"{name}_mean"), percentile(c, 0.5).alias(f"{name}_median"), percentile(c, 0.9).alias(f"{name}_p90")]

    g = dark.groupBy(*case).agg(
        words(F.lit(True)).alias("words"), words(ok).alias("gradeable_words"), words(~ok).alias("ungradeable_words"), words(ok & F.col("_dark")).alias("dark_words"), F.count_if(ok).alias("runs"), F.count_if(near).alias("near_runs"), words(severe).alias("severe_words"),
        *told("share_error", F.col("error")), *told("boundary_error", F.col("boundary_error")), *told("variation", variation),
    )
    return g.withColumn("word_coverage", ratio(F.col("gradeable_words"), F.col("words"))).withColumn("near_rate", ratio(F.col("near_runs"), F.col("runs")))
