"""Words, phones and runtime events of cases, made from the event stream, and the same in SQL.

An event is a word from its time to the next event's, two hours at most; words have one to three phones and runtime
events, whose centres, poses and flags follow from the event's number, so every rule of the operators has rows that meet
it. All times are whole microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.plans import adapters
from metrum.plans.adapters import EVENTS_SQL, HOUR

MINUTE = HOUR // 60

WORDS_SQL = f"""{EVENTS_SQL}, gw AS (SELECT case_id, event_id, row_number() OVER w - 1 AS word_index, event_type AS word, value, t AS s, least(t + {2 * HOUR}, coalesce(lead(t) OVER w, t + {2 * HOUR})) AS e,
    CASE event_type WHEN 'error' THEN '.' WHEN 'click' THEN ',' ELSE '' END AS mark FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY t, event_id)),
    gk AS (SELECT *, 1 + event_id % 3 AS n, unnest(range(1 + event_id % 3)) AS k FROM gw)"""
PHONES_SQL = f"""ph AS (SELECT case_id, event_id, word_index, word, k, s + ((e - s) * k) // n AS ps, s + ((e - s) * (k + 1)) // n - {10 * MINUTE} AS pe,
    CASE (event_id + k) % 5 WHEN 0 THEN 'sil' WHEN 1 THEN '' ELSE 'P' || ((event_id + k) % 4) || (event_id % 3) END AS label FROM gk)"""
RUNTIME_SQL = f"""rt AS (SELECT case_id, event_id, word_index, word, k, n, row_number() OVER (PARTITION BY case_id ORDER BY word_index, k) - 1 AS idx,
    s + ((e - s) * (2 * k + 1)) // (2 * n) + ((event_id * 37 + k * 11) % 1201 - 600) * 2000000 AS c, 'p' || ((event_id + k) % 4) AS pose, (event_id + k) % 11 <> 0 AS renderable, (event_id + k) % 13 = 0 AS cancelled,
    ((event_id * 7 + k) % 100) / 100e0 AS strength, CASE WHEN (event_id + k) % 9 = 0 THEN 'owned_word_tail_commit' ELSE 'lattice' END AS reason FROM gk)"""


def words(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """case_id, event_id, word_index, word, value, start, end, mark; of these events, if given (see adapters)."""
    w = Window.partitionBy("case_id").orderBy("t", "event_id")
    until = F.col("t") + 2 * HOUR
    mark = F.when(F.col("event_type") == "error", ".").when(F.col("event_type") == "click", ",").otherwise("")
    return (adapters.events(spark, sf) if events is None else events).select(
        "case_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("word_index"), F.col("event_type").alias("word"), "value", F.col("t").alias("start"), F.least(until, F.coalesce(F.lead("t").over(w), until)).alias("end"), mark.alias("mark")
    )


def _share(part: Column, n: Column) -> Column:
    """start + (end - start) * part / n, whole."""
    return F.col("start") + F.floor((F.col("end") - F.col("start")) * part / n).cast("long")


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("event_id") % 3 + 1).cast("long")
    return words(spark, sf).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))


def phones(spark: SparkSession, sf: str) -> DataFrame:
    """case_id, event_id, word_index, word, k, start, end, label."""
    of = F.col("event_id") + F.col("k")
    label = F.when(of % 5 == 0, "sil").when(of % 5 == 1, "").otherwise(F.concat(F.lit("P"), (of % 4).cast("string"), (F.col("event_id") % 3).cast("string")))
    return _parts(spark, sf).select("case_id", "event_id", "word_index", "word", "k", _share(F.col("k"), F.col("n")).alias("s"), (_share(F.col("k") + 1, F.col("n")) - 10 * MINUTE).alias("e"), label.alias("label")).withColumnsRenamed({"s": "start", "e": "end"})


def runtime(spark: SparkSession, sf: str) -> DataFrame:
    """case_id, event_id, word_index, word, k, n, idx, centre, pose, renderable, cancelled, strength, reason."""
    of = F.col("event_id") + F.col("k")
    centre = _share(2 * F.col("k") + 1, 2 * F.col("n")) + ((F.col("event_id") * 37 + F.col("k") * 11) % 1201 - 600) * 2_000_000
    idx = F.row_number().over(Window.partitionBy("case_id").orderBy("word_index", "k")) - 1
    return _parts(spark, sf).select(
        "case_id", "event_id", "word_index", "word", "k", "n", idx.cast("long").alias("idx"), centre.alias("centre"), F.concat(F.lit("p"), (of % 4).cast("string")).alias("pose"), (of % 11 != 0).alias("renderable"), (of % 13 == 0).alias("cancelled"),
        ((F.col("event_id") * 7 + F.col("k")) % 100 / 100.0).alias("strength"), F.when(of % 9 == 0, "owned_word_tail_commit").otherwise("lattice").alias("reason"),
    )


# A second of speech stands for four hours of events, so words of up to two hours are words of up to half a second.
SECOND = 4 * HOUR

PRESENTED_SQL = f"""gf AS (SELECT *, CASE WHEN s - lag(s) OVER w < {12 * HOUR} THEN 0 ELSE 1 END AS fresh, CAST(sum(CASE WHEN mark = '.' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) - CASE WHEN mark = '.' THEN 1 ELSE 0 END AS BIGINT) AS sentence FROM gw WINDOW w AS (PARTITION BY case_id ORDER BY word_index)),
    gr AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY case_id ORDER BY word_index ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS region FROM gf),
    gb AS (SELECT *, min(s) OVER r AS ra, max(s) OVER r + {2 * HOUR} AS rb FROM gr WINDOW r AS (PARTITION BY case_id, region)),
    pk AS (SELECT *, 1 + event_id % 3 AS n, unnest(range(1 + event_id % 3)) AS k FROM gb),
    pr AS (SELECT case_id, event_id, word_index, word, sentence, region, ra, rb, k, n, row_number() OVER (PARTITION BY case_id ORDER BY word_index, k) - 1 AS idx, s + ((e - s) * k) // n AS a, s + ((e - s) * (k + 1)) // n AS b,
      s + ((e - s) * (2 * k + 1)) // (2 * n) + ((event_id * 37 + k * 11) % 1201 - 600) * 2000000 AS c, 'p' || ((event_id + k) % 4) AS pose, (event_id + k) % 11 <> 0 AS renderable, (event_id + k) % 13 = 0 AS cancelled, ((event_id * 7 + k) % 100) / 100e0 AS strength,
      s + ((e - s) * k) // n + ((event_id * 13 + k) % 9 - 6) * {SECOND // 20} AS commit_at, (event_id + k) % 23 = 0 AS nucleus, (event_id + k) % 19 = 0 AS anchor, (event_id + k) % 17 = 0 AS turns FROM pk)"""


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """words with sentence (counted by full stops), region, region_start, region_end: events less than twelve hours apart, the
    last one held for two."""
    w = Window.partitionBy("case_id").orderBy("word_index")
    upto, region = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("case_id", "region")
    stop = F.when(F.col("mark") == ".", 1).otherwise(0)
    fresh = F.when(F.col("start") - F.lag("start").over(w) < 12 * HOUR, 0).otherwise(1)
    told = words(spark, sf).withColumn("sentence", F.sum(stop).over(upto) - stop).withColumn("_fresh", fresh).withColumn("region", F.sum("_fresh").over(upto) - 1)
    return told.drop("_fresh").withColumn("region_start", F.min("start").over(region)).withColumn("region_end", F.max("start").over(region) + 2 * HOUR)


def presented(spark: SparkSession, sf: str) -> DataFrame:
    """runtime events with sentence, region and its bounds, start, end, commit_at, nucleus, anchor, turns."""
    n = (F.col("event_id") % 3 + 1).cast("long")
    p = sentences(spark, sf).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    of = F.col("event_id") + F.col("k")
    idx = F.row_number().over(Window.partitionBy("case_id").orderBy("word_index", "k")) - 1
    start = _share(F.col("k"), F.col("n"))
    return p.select(
        "case_id", "event_id", "word_index", "word", "sentence", "region", "region_start", "region_end", "k", "n", idx.cast("long").alias("idx"), start.alias("_a"), _share(F.col("k") + 1, F.col("n")).alias("_b"),
        (_share(2 * F.col("k") + 1, 2 * F.col("n")) + ((F.col("event_id") * 37 + F.col("k") * 11) % 1201 - 600) * 2_000_000).alias("centre"), F.concat(F.lit("p"), (of % 4).cast("string")).alias("pose"), (of % 11 != 0).alias("renderable"), (of % 13 == 0).alias("cancelled"),
        ((F.col("event_id") * 7 + F.col("k")) % 100 / 100.0).alias("strength"), (start + ((F.col("event_id") * 13 + F.col("k")) % 9 - 6) * (SECOND // 20)).alias("commit_at"), (of % 23 == 0).alias("nucleus"), (of % 19 == 0).alias("anchor"), (of % 17 == 0).alias("turns"),
    ).withColumnsRenamed({"_a": "start", "_b": "end"})
