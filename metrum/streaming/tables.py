"""Tables read as streams to their end, in bounded micro-batches, with a last run that lets every timer fire."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrum.session import forget_at_end, shared_folder

#: Later than any row by more than any lateness; pandas' timestamps end in 2262.
END = "2262-01-01 00:00:00"
#: Added to every time: watermarks begin at 1970, and what is not later is dropped. So times from 1911 to 2100 may occur.
SHIFT = 60 * 365 * 86_400_000_000
#: Rows of a table may come in any order within a century, so its watermark stays behind all of them until the end is marked.
ANY_ORDER = "36500 days"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, path: str, files: int) -> DataFrame:
    """The stream of a table, a file or a folder of files, `files` of them a micro-batch."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
    if status.isDirectory():
        return reader.parquet(path)
    # The filter meets the names of files, so it picks one file of its folder and would leave a folder's files out.
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def event_time(micros: Column) -> Column:
    """The time that watermarks and timers go by, for a time in microseconds."""
    return F.timestamp_micros(micros + SHIFT)


def case_key(case: Column) -> Column:
    """A key for keyed state that tells a null case from all others; keys of null are mixed up with others in Python workers."""
    return F.coalesce(case.cast("string"), F.lit("")).alias("key")


def case_of(key: str) -> int | None:
    return int(key) if key else None


def by_batch(path: str, each: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes what is kept of a batch to a folder with its number, in place of what is there."""

    def write(rows: DataFrame, number: int) -> None:
        each(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_to_end(spark: SparkSession, rows: DataFrame, operator: Callable[[DataFrame], DataFrame], folder: str | None = None, lateness: str = ANY_ORDER, end: bool = True, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What the operator emits for the stream `rows` (with `at`, a timestamp), read back from the sink's folder.

    The operator gets rows with `ended` (false) and a watermark `lateness` behind the latest `at`. When all that is there has
    been read, the query is started again from its checkpoint, now with a second source of one row that is `ended` and
    later than all, so the watermark passes every timer. end: false leaves that out, and a later call with the same folder
    goes on where this one stopped. The folder (a new one by default) holds checkpoint, output and the mark of the end.

    each: what to keep of every micro-batch; its rows get `batch`, the batch's number. They replace what an earlier try of the
    same batch has written, so a batch that runs again leaves the table as it was."""
    if folder is None:
        folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
        forget_at_end(spark, folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    none = spark.createDataFrame([], rows.schema)
    none.write.mode("ignore").parquet(f"{folder}/end")
    marks = spark.readStream.schema(none.schema).parquet(f"{folder}/end").withColumn("ended", F.lit(True))
    both = rows.withColumn("ended", F.lit(False)).unionByName(marks).withWatermark("at", lateness)

    def run() -> None:
        out = operator(both).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/log")
        out = out.foreachBatch(by_batch(f"{folder}/out", each)) if each else out.format("parquet").option("path", f"{folder}/out")
        out.trigger(availableNow=True).start().awaitTermination()

    run()
    if end:
        marked = spark.range(1).select(*(F.lit(END).cast("timestamp").alias(f.name) if f.name == "at" else F.lit("").alias(f.name) if f.name == "key" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields))
        marked.write.mode("append").parquet(f"{folder}/end")
        run()
    kept = operator(both).schema
    if each:
        kept = each(spark.createDataFrame([], kept)).schema.add("batch", "long")
    return spark.read.schema(kept).parquet(f"{folder}/out")
