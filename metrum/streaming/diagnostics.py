"""Diagnostics of a run: what each micro-batch brought to each case, what a stream has seen at its end, which batch told each
region, and the progress of a query.

Counts are taken within a batch and kept by its number; running values are windows over these few rows and not state, so a
batch that runs again changes nothing.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.window import Window

from metrum.streaming.regions import detect, regions_of
from metrum.streaming.tables import ANY_ORDER, case_key, event_time, run_to_end, table_stream


def _rows(spark: SparkSession, path: str, files: int) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return table_stream(spark, path, files).select(case_key(F.col("user_id")), micros.alias("t"), event_time(micros).alias("at"))


def received(spark: SparkSession, path: str, files: int = 1000, folder: str | None = None) -> DataFrame:
    """case_id, batch, rows, first, last (times) of each case and micro-batch that brought rows of it. A second call with the
    same folder goes on with the files that are new."""
    counts = lambda d: d.groupBy("key").agg(F.count("*").alias("rows"), F.min("t").alias("first"), F.max("t").alias("last"))
    kept = run_to_end(spark, _rows(spark, path, files), lambda d: d.where("NOT ended").select("key", "t"), folder, end=False, each=counts)
    return kept.select(F.expr("try_cast(key AS BIGINT)").alias("case_id"), "batch", "rows", "first", "last")


def updates(batches: DataFrame) -> DataFrame:
    """The rows of received() with update (from 1 in each case), rows_so_far, first_so_far, last_so_far, gap (from the latest
    time before this batch to its first; null for the first update) and behind: whether it brought rows from before that."""
    w = Window.partitionBy("case_id").orderBy("batch")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return batches.select(
        "*", F.row_number().over(w).cast("long").alias("update"), F.sum("rows").over(w).alias("rows_so_far"), F.min("first").over(w).alias("first_so_far"), F.max("last").over(w).alias("last_so_far"),
        (F.col("first") - before).alias("gap"), F.coalesce(F.col("first") < before, F.lit(False)).alias("behind"),
    )


def told_regions(spark: SparkSession, path: str, gap: int, hold: int, files: int = 1000, lateness: str = ANY_ORDER, folder: str | None = None, end: bool = True) -> DataFrame:
    """The regions of regions_of_table with batch, the micro-batch that told each."""
    return regions_of(run_to_end(spark, _rows(spark, path, files), lambda d: detect(d, gap), folder, lateness, end, each=lambda d: d), gap, hold)


def tail(batches: DataFrame, told: DataFrame) -> DataFrame:
    """case_id, updates, rows, first, last, regions, shown_from, open_rows: what a stream has seen of each case, how many
    regions it has told, when the first of them begins, and how many rows are in none of those told yet. told: see
    told_regions. Null is a case, too."""
    seen = batches.groupBy("case_id").agg(F.count("*").alias("updates"), F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))
    known = told.groupBy(F.col("case_id").alias("_case")).agg(F.count("*").alias("regions"), F.min("start_us").alias("shown_from"), F.sum("n_events").alias("_in"))
    both = seen.join(known, seen["case_id"].eqNullSafe(known["_case"]), "left").na.fill(0, ["regions", "_in"])
    return both.select("case_id", "updates", "rows", "first", "last", "regions", "shown_from", (F.col("rows") - F.col("_in")).alias("open_rows"))


class Progress(StreamingQueryListener):
    """Keeps one small JSON file up to date: phase (running, done, failed), completed (batches), rows, elapsed_seconds,
    last_batch_seconds, for the queries of a session while it is added to (spark.streams.addListener). The file is replaced as
    a whole; it may lie wherever Spark's file systems write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.began, self.told = time.monotonic(), {"phase": "running", "completed": 0, "rows": 0, "last_batch_seconds": 0.0}

    def _write(self) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        out = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        try:
            out.write(bytearray(json.dumps(self.told | {"elapsed_seconds": round(time.monotonic() - self.began, 3)}, indent=2) + "\n", "utf-8"))
        finally:
            out.close()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.told["phase"] = "running"
        self._write()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        # Idle triggers report the last batch once more, with no rows and no batch of their own.
        if "addBatch" in p.durationMs:
            self.told |= {"completed": self.told["completed"] + 1, "rows": self.told["rows"] + p.numInputRows, "last_batch_seconds": p.durationMs.get("triggerExecution", 0) / 1000}
            self._write()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.told["phase"] = "failed" if event.exception else "done"
        self._write()
