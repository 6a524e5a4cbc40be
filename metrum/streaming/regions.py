"""Regions of an event stream in Structured Streaming.

The state of a case is the list of its open spans: Spark's session windows, whose events are less than a gap apart. Events of a
micro-batch extend spans, join two of them or open new ones, whatever order they come in. A span is emitted when the
watermark has passed its last event by the gap. Rows that are later than the lateness and no gap behind the watermark still
count: spans that they bring less than a gap from one that was told before are joined to it, and spans numbered, as they are
read. All of it runs in Spark's own operators, so a case costs no call of a Python worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.streaming.tables import ANY_ORDER, END, case_key, event_time, run_to_end, table_stream


def detect(events: DataFrame, gap: int) -> DataFrame:
    """Spans (key, first, last, n) of a stream with key (see case_key), t (microseconds), at, ended, and a watermark. gap: 2
    microseconds at least."""
    if gap < 2:
        raise ValueError("gap: 2 microseconds at least")
    # A session window takes what is just its length away, a span does not. The mark of the end moves the watermark and is no event:
    # only a condition on `at` stays behind the watermark's own operator.
    rows = events.where(F.col("at") < F.lit(END).cast("timestamp"))
    spans = rows.groupBy("key", F.session_window("at", f"{gap - 1} microseconds")).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))
    return spans.select("key", "first", "last", "n")


def regions_of(spans: DataFrame, gap: int, hold: int) -> DataFrame:
    """case_id, region (from 0 in each case), start_us, end_us, n_events, and batch, the latest one, if spans have it."""
    w = Window.partitionBy("key").orderBy("first")
    fresh = F.coalesce((F.col("first") - F.lag("last").over(w) >= gap).cast("int"), F.lit(1))
    told = spans.withColumn("_fresh", fresh).withColumn("region", (F.sum("_fresh").over(w) - 1).cast("int"))
    batch = [F.max("batch").alias("batch")] if "batch" in spans.columns else []
    found = told.groupBy("key", "region").agg(F.min("first").alias("start_us"), (F.max("last") + hold).alias("end_us"), F.sum("n").alias("n_events"), *batch)
    return found.select(F.expr("try_cast(key AS BIGINT)").alias("case_id"), *found.columns[1:])


def regions_of_table(spark: SparkSession, path: str, gap: int, hold: int, files: int = 1000, lateness: str = ANY_ORDER, folder: str | None = None, end: bool = True) -> DataFrame:
    """The stream over a table, a file or a folder of them, `files` a micro-batch: its regions when it has been read to its
    end. lateness: how much later than the latest rows a row may come and is sure to count; the default takes files in any order."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    rows = table_stream(spark, path, files).select(case_key(F.col("user_id")), micros.alias("t"), event_time(micros).alias("at"))
    return regions_of(run_to_end(spark, rows, lambda d: detect(d, gap), folder, lateness, end), gap, hold)
