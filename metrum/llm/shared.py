"""What several operators of this package need: written intermediate tables, bounded Arrow batches, connected components."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that may be broadcast, some 100 MB at most.
BROADCAST_ROWS = 1_000_000
_ARROW_ROWS = 2000
_ARROW_BYTES = 64 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where that is unset, a folder of this machine does for
    a local master, whose executors are on it; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="metrum-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_shipped: dict[tuple[str, str], str] = {}


def ship(spark: SparkSession, path: str) -> str:
    """Sends a file of the driver to all executors; workers open it by the returned name through SparkFiles."""
    app, name = spark.sparkContext.applicationId, os.path.basename(path)
    if _shipped.setdefault((app, name), path) != path:
        raise ValueError(f"another file named {name} was sent before: {_shipped[app, name]}")
    spark.sparkContext.addFile(path)
    return name


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm, sc = spark._jvm, spark.sparkContext
        if sc._jsc is not None and not sc._jsc.sc().isStopped():
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone when Python ends
        pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    The folder goes when the driver ends; the returned table may be read until then.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/metrum-{uuid.uuid4().hex}-{tag}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bound_arrow(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts; a smaller setting of the user's stays. Spark reads these
    settings when a plan runs and has none for a single plan, so they stay set in the session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, _ARROW_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_ARROW_BYTES))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def literals(values: list, kind: str) -> Column:
    """An array in the plan, of constant size there: one string, which the optimizer turns into the array once."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def places(bounds: list[tuple], columns: list[Column], kinds: list[str]) -> Column:
    """How many of the sorted bounds are at or below a row's key (columns, compared in turn), by binary search."""
    if not bounds:
        return F.lit(0)
    n, lists = len(bounds), [literals([b[k] for b in bounds], kind) for k, kind in enumerate(kinds)]

    def step(found: Column, jump: Column) -> Column:
        at = found + jump
        reached = F.lit(True)
        for values, c in reversed(list(zip(lists, columns, strict=True))):
            bound = F.get(values, at - 1)
            reached = (bound < c) | ((bound == c) & reached)
        return F.when((at <= n) & reached, at).otherwise(found)

    jumps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    return F.aggregate(jumps, F.lit(0), step)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Rows (node, component) for every node of edges (u, v: long); component is the smallest node that is reachable.

    Each round hooks every component to its smallest neighbour, halves the depth of the hooks by pointer jumping until
    they point at roots, and contracts the edges. Components with more than one node left at least halve in a round, so
    the rounds are logarithmic. Every table is written in the shared folder; only row counts reach the driver.
    """
    edges = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{tag}-edges")
    labels: DataFrame | None = None
    step = 0
    while not edges.isEmpty():
        step += 1
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("root")), f"{tag}-hook{step}")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = materialize(hooks.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), f"{tag}-jump{step}")
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = hooks.select("node", F.col("root").alias("component"))
        else:
            moved = hooks.select(F.col("node").alias("component"), "root")
            labels = materialize(labels.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component")), f"{tag}-labels{step}")
        at_u, at_v = hooks.select(F.col("node").alias("u"), F.col("root").alias("ru")), hooks.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = materialize(edges.join(at_u, "u").join(at_v, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), f"{tag}-left{step}")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return labels
