"""Dense time grids, envelopes and sequential filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.functions.intervals import min_jerk


def grid(spans: DataFrame, step: int) -> DataFrame:
    """A row for each whole number of steps from start up to end; numbers are integers, so no error adds up."""
    return spans.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end") - F.col("start")) / step))))


def envelope(samples: DataFrame, step: int, edge: int) -> DataFrame:
    """weight: a minimum-jerk rise and fall over `edge` at both ends of the span."""
    at = F.col("step") * step
    return samples.withColumn("weight", F.least(min_jerk(at / float(edge)), min_jerk((F.col("end") - F.col("start") - at) / float(edge))))


def decaying_max(rows: DataFrame, value: str, decay: float, floor: float, partition: list[str], order: list[str]) -> DataFrame:
    """peak: max(decay * the peak before, value), begun from floor, for non-negative values; peak_value and peak_age: the
    value it comes from and how many rows ago that was, null while it is the floor's. In logarithms the decay is a straight
    line, so a running maximum does."""
    w = Window.partitionBy(*partition).orderBy(*order)
    i, k = F.row_number().over(w), float(np.log(decay))
    logs = F.when(F.col(value) > 0, F.struct((F.ln(value) - F.col("_i") * k).alias("log"), F.col("_i").alias("at"), F.col(value).alias("v")))
    run = F.max(logs).over(w.rowsBetween(Window.unboundedPreceding, 0))
    low = F.lit(float(np.log(floor))) + F.col("_i") * k
    seen = rows.withColumn("_i", i).withColumn("_r", run).withColumn("_p", F.col("_r.log") + F.col("_i") * k)
    real = F.coalesce(F.col("_p") >= low, F.lit(False))
    peak = F.when(~real, F.exp(low)).when(F.col("_r.at") == F.col("_i"), F.col("_r.v")).otherwise(F.exp("_p"))
    return seen.withColumn("peak", peak).withColumn("peak_value", F.when(real, F.col("_r.v"))).withColumn("peak_age", F.when(real, F.col("_i") - F.col("_r.at"))).drop("_i", "_r", "_p")


def attack_release(rows: DataFrame, attack: float, release: float, unit: int) -> DataFrame:
    """shown: a first-order filter of value over (t, event_id) of a case, by time constants in units of time."""
    schema = "case_id long, event_id long, shown double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"], kind="stable")
        out, t, last, before = [], pdf["t"].to_numpy(), None, 0
        for at, v in zip(t, pdf["value"].to_numpy(), strict=True):
            if last is None:
                last = v
            else:
                last += (v - last) * (1 - np.exp(-((at - before) / unit) / (attack if v > last else release)))
            before = at
            out.append(last)
        return pd.DataFrame({"case_id": pdf["case_id"], "event_id": pdf["event_id"], "shown": out})

    return rows.select("case_id", "event_id", "t", "value").groupBy("case_id").applyInPandas(run, schema)


def collapse(samples: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """The largest weight of each key, clamped to [0, 1]."""
    return samples.groupBy(*keys).agg(F.least(F.greatest(F.max(weight), F.lit(0.0)), F.lit(1.0)).alias(weight))
