"""Frame-wise detection, weights and the arithmetic of model scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def log_softmax(x: Column) -> Column:
    """Of an array, shifted by its maximum; the sum is 1e-12 at least."""
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform(x, lambda v: v - top - F.ln(F.greatest(total, F.lit(1e-12))))


def mix(a: Column, b: Column, share: float) -> Column:
    """a + share * (b - a), element by element."""
    return F.zip_with(a, b, lambda x, y: x + (y - x) * share)


def widen(x: Column, width: int, extra: int) -> Column:
    """An array of rows of `width`, each given `extra` zeros at its end."""
    rows = F.sequence(F.lit(0), (F.size(x) / width).cast("int") - 1)
    return F.flatten(F.transform(rows, lambda r: F.concat(F.slice(x, r * width + 1, F.lit(width)), F.array_repeat(F.lit(0.0), extra))))


def band_max(rows: DataFrame, value: str, reach: int, partition: list[str], order: list[str]) -> DataFrame:
    """band: the largest value among `reach` rows on either side."""
    return rows.withColumn("band", F.max(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(-reach, reach)))


def standardize(rows: DataFrame, columns: list[str], least: float = 1e-5) -> DataFrame:
    """Each column less its mean, over its population deviation (least at least). The moments are one row."""
    m = rows.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    both = rows.crossJoin(F.broadcast(m))
    return both.select(*(((F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(least))).alias(c) if c in columns else F.col(c) for c in rows.columns))


def hysteresis(active: list[bool], opens: int, closes: int) -> list[tuple[int, int, int, bool]]:
    """(first, last active, times reopened, ended) of regions: `opens` active frames in a row open one, at the first of
    them; `closes` quiet ones end it."""
    out: list[list] = []
    run, quiet, inside = 0, 0, False
    for i, a in enumerate(active):
        if not inside:
            run = run + 1 if a else 0
            if run >= opens:
                out.append([i - run + 1, i, 0, False])
                inside, quiet = True, 0
        elif a:
            out[-1][2] += quiet > 0
            out[-1][1], quiet = i, 0
        else:
            quiet += 1
            if quiet >= closes:
                out[-1][3], inside, run = True, False, 0
    return [tuple(r) for r in out]


def detect(frames: DataFrame, opens: int = 2, closes: int = 12) -> DataFrame:
    """Regions of frames (case_id, frame, active): case_id, region, first, last, reopened, ended; sequential in a case."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        at = pdf["frame"].tolist()
        rows = hysteresis(pdf["active"].tolist(), opens, closes)
        return pd.DataFrame([(pdf["case_id"].iloc[0], k, at[a], at[b], n, e) for k, (a, b, n, e) in enumerate(rows)], columns=["case_id", "region", "first", "last", "reopened", "ended"])

    return frames.groupBy("case_id").applyInPandas(run, "case_id long, region int, first long, last long, reopened int, ended boolean")
