"""The reference tables in the shapes that the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrum.operators import regions
from metrum.session import table

HOUR = 3_600_000_000
DAY = 24 * HOUR


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, event_id, t (whole microseconds), event_type, value."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "event_id", micros.alias("t"), "event_type", "value")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of all events: gaps of 8 hours, ends held for one."""
    return regions.islands(events(spark, sf_dir), 8 * HOUR, HOUR)


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the events other than error and view: gaps of 12 hours, ends held for one."""
    return regions.islands(events(spark, sf_dir).where(~F.col("event_type").isin("error", "view")), 12 * HOUR, HOUR)


def as_right(found: DataFrame) -> DataFrame:
    return found.select("case_id", F.col("region").alias("r_idx"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))


def as_left(found: DataFrame) -> DataFrame:
    return found.select("case_id", F.col("region").alias("idx"), "start", "end")


# The same in SQL, for the oracles.
EVENTS_SQL = "ev AS (SELECT user_id AS case_id, event_id, epoch_us(ts) AS t, event_type, value FROM events)"


def islands_sql(name: str, gap_hours: int, where: str = "true", hold_hours: int = 1) -> str:
    return f"""
        {name}_f AS (SELECT *, CASE WHEN t - lag(t) OVER w >= {gap_hours * HOUR} OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
                     FROM ev WHERE {where} WINDOW w AS (PARTITION BY case_id ORDER BY t, event_id)),
        {name}_n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY case_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS region FROM {name}_f),
        {name} AS (SELECT case_id, region, min(t) AS s, max(t) + {hold_hours * HOUR} AS e, count(*) AS n FROM {name}_n GROUP BY case_id, region)"""


GOLD_SQL = islands_sql("gold", 8)
PRED_SQL = islands_sql("pred", 12, "event_type NOT IN ('error', 'view')")
