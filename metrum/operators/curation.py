"""Flags, boundaries and synthetic items of drafted annotations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def event_flags(events: DataFrame, gap: float = 0.45, weak: float = 0.6) -> DataFrame:
    """One row a flag of each event (case_id, idx, centre, strength, mapped, reason): up to five kinds; five tests and one
    explode, no join."""
    w = Window.partitionBy("case_id").orderBy("centre", "idx")
    far = F.col("centre") - F.lag("centre").over(w) > gap
    kinds = {
        "no_observed_phone_evidence": ~F.coalesce("mapped", F.lit(False)),
        "final_drain_fallback": F.contains(F.col("reason"), F.lit("final_duration_drain")),
        "boundary_guard_adjustment": F.contains(F.col("reason"), F.lit("guard")),
        "low_strength_viseme": F.col("strength") < weak,
        "large_inter_event_gap": F.coalesce(far, F.lit(False)),
    }
    tested = events.withColumn("_k", F.array(*(F.when(test, F.lit(k)) for k, test in kinds.items())))
    return tested.select("case_id", "idx", F.explode(F.array_compact("_k")).alias("kind"))


def risk(flags: DataFrame, weights: dict[str, int]) -> DataFrame:
    """case_id, flags and risk: the weighted count of flags; kinds without a weight count 1."""
    w = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("kind")], F.lit(1))
    return flags.groupBy("case_id").agg(F.count("*").alias("flags"), F.sum(w).alias("risk"))


def hydrate_boundaries(boundaries: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """boundaries (case_id, idx, word_at, next_at) with start and end of their gap, from words (case_id, place, start,
    end) at these places of the list. Boundaries whose word is not there pass with nulls; without a next word the gap is
    `least` long."""
    left = words.select("case_id", F.col("place").alias("word_at"), F.col("end").alias("_e"))
    right = words.select("case_id", F.col("place").alias("next_at"), F.col("start").alias("_s"))
    both = boundaries.join(left, ["case_id", "word_at"], "left").join(right, ["case_id", "next_at"], "left")
    next_start = F.coalesce("_s", "_e")
    start = F.least("_e", next_start)
    return both.select("case_id", "idx", "word_at", "next_at", F.when(F.col("_e").isNotNull(), start).alias("start"), F.when(F.col("_e").isNotNull(), F.greatest(start + least, next_start)).alias("end"))


def pseudo_phones(words: DataFrame) -> DataFrame:
    """Each word's span (start, end), evenly split over its n phones: case_id, idx, phone_index, start, end."""
    k = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("phone_index")
    step = (F.col("end") - F.col("start")) / F.col("n")
    return words.where("n > 0").select("case_id", "idx", "start", step.alias("_step"), k).select("case_id", "idx", "phone_index", (F.col("start") + F.col("_step") * F.col("phone_index")).alias("start"), (F.col("start") + F.col("_step") * (F.col("phone_index") + 1)).alias("end"))


def with_silences(tokens: DataFrame, margin: float = 0.005) -> DataFrame:
    """tokens (case_id, idx, word, centre, duration) and a silence where the word changes, between the centres of its
    neighbours: in the middle of the gap, kept `margin` off both, or midway if they are too near. One window, one
    explode. A silence follows its left neighbour: idx is the neighbour's, silence true."""
    w = Window.partitionBy("case_id").orderBy("idx")
    lead = lambda c: F.lead(c).over(w)
    gap_start, gap_end = F.col("centre") + F.col("duration") / 2, lead("centre") - lead("duration") / 2
    low, high = F.col("centre") + margin, lead("centre") - margin
    mid = (gap_start + gap_end) / 2
    at = F.when(high > low, F.least(F.greatest(mid, low), high)).otherwise((F.col("centre") + lead("centre")) / 2)
    silence = F.when(lead("word") != F.col("word"), F.struct(F.lit(True).alias("silence"), at.alias("centre"), F.greatest(gap_end - gap_start, F.lit(0.010)).alias("duration")))
    own = F.struct(F.lit(False).alias("silence"), F.col("centre"), F.col("duration"))
    made = tokens.withColumn("_x", F.array_compact(F.array(own, silence)))
    return made.select("case_id", "idx", "word", F.explode("_x").alias("x")).select("case_id", "idx", "word", "x.silence", "x.centre", "x.duration")


def greedy_matches(expected: list[tuple[float, float]], found: list[tuple[float, float]], reach: float) -> list[tuple[int, int]]:
    """Each expected gap in turn takes the nearest gap left that overlaps it or whose centre is within reach; the first
    of equally near ones."""
    free, pairs = dict(enumerate(found)), []
    for i, (s, e) in enumerate(expected):
        near = [(abs((a + b) / 2 - (s + e) / 2), j) for j, (a, b) in free.items() if min(e, b) > max(s, a) or abs((a + b) / 2 - (s + e) / 2) <= reach]
        if near:
            j = min(near)[1]
            del free[j]
            pairs.append((i, j))
    return pairs


def match_gaps(expected: DataFrame, found: DataFrame, reach: float) -> DataFrame:
    """case_id, expected, found: numbers of matched gaps (case_id, idx, start, end). What is left depends on the matches
    before, so a case is one group."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"case_id": [], "expected": [], "found": []})
        x, y = x.sort_values("idx"), y.sort_values("idx")
        spans = lambda d: list(zip(d["start"].astype(float), d["end"].astype(float), strict=True))
        pairs = greedy_matches(spans(x), spans(y), reach)
        return pd.DataFrame({"case_id": [x["case_id"].iloc[0]] * len(pairs), "expected": [int(x["idx"].iloc[i]) for i, _ in pairs], "found": [int(y["idx"].iloc[j]) for _, j in pairs]})

    return expected.groupBy("case_id").cogroup(found.groupBy("case_id")).applyInPandas(run, "case_id long, expected long, found long")


def tail_recovery(events: DataFrame, compressed: float, lead: float, shift: float) -> DataFrame:
    """By case, of rows with tail: how many follow the row before of their word too closely, come too early, or moved far
    from their prior. events: (case_id, idx, word, centre, prior, lead, tail)."""
    w = Window.partitionBy("case_id", "word").orderBy("idx")
    near = F.coalesce(F.col("centre") - F.lag("centre").over(w) < compressed, F.lit(False))
    rows = events.withColumn("_n", near).where("tail")
    return rows.groupBy("case_id").agg(F.count("*").alias("tails"), F.count_if("_n").alias("compressed"), F.count_if(F.col("lead") > lead).alias("early"), F.count_if(F.abs(F.col("centre") - F.coalesce("prior", "centre")) >= shift).alias("shifted"))
