"""Classes of pauses at punctuation. The planner's and the scorecard's commas differ, and both are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.functions import text

# Expected seconds of a pause, and the scorecard's classes of marks.
SECONDS = {"hard_break": 0.200, "soft_list": 0.040}
SCORED = {".": "hard_stop", "!": "hard_stop", "?": "hard_stop", ";": "semicolon", ":": "colon", "": "none"}


def is_hard(mark: Column) -> Column:
    return mark.isin(*text.HARD_MARKS)


def classify(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """tokens (keys, i, word, mark after it) with pause, scored and seconds.

    pause: hard marks break. A comma is soft where its sentence has two commas or more, or a conjunction after it, and
    the next word begins no clause; else it breaks, too. scored: a comma is a list comma if the next mark is a comma one
    word later, a standard one if the next mark is further away or there is none, else other. A sentence ends after a
    hard mark; all of it is running sums and looks ahead over one sort by key."""
    order = Window.partitionBy(*keys).orderBy("i")
    ended = F.sum(is_hard(F.col("mark")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = tokens.withColumn("_s", F.coalesce(ended, F.lit(0))).withColumn("_follows", F.coalesce(F.lead("word").over(order), F.lit("")).isin(*text.CLAUSE_STARTERS))
    # What comes later in a sentence is all of it less what came so far.
    sentence, joins = Window.partitionBy(*keys, "_s").orderBy("i"), F.col("word").isin(*text.LIST_CONJUNCTIONS)
    whole, so_far = sentence.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), sentence.rowsBetween(Window.unboundedPreceding, 0)
    soft = ((F.count_if(F.col("mark") == ",").over(whole) >= 2) | (F.count_if(joins).over(whole) > F.count_if(joins).over(so_far))) & ~F.col("_follows")
    pause = F.when(is_hard(F.col("mark")) | (F.col("mark") == ",") & ~soft, "hard_break").when(F.col("mark") == ",", "soft_list").otherwise("none")
    later = F.first(F.when(F.col("mark") != "", F.struct("i", "mark")), True).over(order.rowsBetween(1, Window.unboundedFollowing))
    comma = F.when(later.isNull() | (later["i"] > F.col("i") + 1), "standard_comma").when(later["mark"] == ",", "list_comma").otherwise("other_comma")
    scored = F.when(F.col("mark") == ",", comma).otherwise(F.coalesce(F.create_map(*(F.lit(x) for kv in SCORED.items() for x in kv))[F.col("mark")], F.lit("other")))
    told = rows.withColumn("pause", pause).withColumn("scored", scored)
    seconds = F.coalesce(F.create_map(*(F.lit(x) for kv in SECONDS.items() for x in kv))[F.col("pause")], F.lit(0.0))
    return told.withColumn("seconds", seconds).drop("_s", "_follows")
