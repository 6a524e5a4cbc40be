"""Session defaults and table access."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "metrum", **conf: str) -> SparkSession:
    """A session with the library's defaults; on a cluster leave master to spark-submit."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    if master:
        cores = os.cpu_count() or 4
        builder = builder.master(master).config("spark.sql.shuffle.partitions", conf.get("spark.sql.shuffle.partitions", str(cores)))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine where that is unset and the master is
    local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="metrum-")
        # One folder a session, not one a call.
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as Parquet in the shared folder, read back, for tables that a query reads more than once; the folder goes when the
    driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/metrum-{uuid.uuid4().hex}-{tag}"
    df.write.parquet(path)
    forget_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget_at_end(spark: SparkSession, path: str) -> None:
    """Remove a folder when the driver ends."""
    atexit.register(_forget, spark, path)


def _forget(spark: SparkSession, path: str) -> None:
    """Remove a folder as long as the session still runs."""
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; a file or a folder of files, on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input files that a task gets whose rows become many more: their sorts hold some hundred times that and more.
DEALT_BYTES = 1 << 19


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys, before they are spread to many more: windows and groups by these keys (and more) then exchange nothing, and the
    number of tasks grows with the input, so that what one of them sorts doesn't. Left to itself Spark joins partitions by
    their compressed bytes."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, min(-(-size // DEALT_BYTES), 20_000)), *keys)
