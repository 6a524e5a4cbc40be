"""What micro-batches brought, what they told, and their progress."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from metrum.plans.adapters import HOUR
from metrum.streaming import diagnostics, regions, tables
from tests.test_streaming import events, files, rows_of  # noqa: F401


def _micros(rows):
    return [int(t.value // 1000) for t in rows["ts"]]


def test_updates_and_tail_over_many_batches(spark, events, tmp_path):  # noqa: F811
    order = random.Random(3).sample(range(6), 6)
    (tmp_path / "in").mkdir()
    files(spark, events, tmp_path / "in", order, 6)
    got = diagnostics.received(spark, str(tmp_path / "in"), 1, str(tmp_path / "r"))
    assert got.select("batch").distinct().count() == 6 and got.agg(F.sum("rows")).first()[0] == len(events)
    u = [r for r in diagnostics.updates(got).collect() if r.case_id == 3]
    seen, last = 0, None
    for r in sorted(u, key=lambda r: r.batch):
        seen += r.rows
        assert r.rows_so_far == seen and r.behind == (last is not None and r["first"] < last) and r.gap == (None if last is None else r["first"] - last)
        last = max(x for x in (last, r["last"]) if x is not None)
        assert r.last_so_far == last
    assert [r.update for r in sorted(u, key=lambda r: r.batch)] == list(range(1, len(u) + 1)) and any(r.behind for r in diagnostics.updates(got).collect())
    told = diagnostics.told_regions(spark, str(tmp_path / "in"), 8 * HOUR, HOUR, 2)
    assert rows_of(told.drop("batch")) == rows_of(regions.regions_of_table(spark, str(tmp_path / "in"), 8 * HOUR, HOUR, 2))
    t = {r.case_id: r for r in diagnostics.tail(got, told).collect()}
    assert None in t and all(r.open_rows == 0 for r in t.values()) and sum(r.rows for r in t.values()) == len(events)
    mine = events[events["user_id"] == 3]
    assert (t[3].rows, t[3]["first"], t[3]["last"], t[3].updates) == (len(mine), min(_micros(mine)), max(_micros(mine)), len(u))
    # As long as the end isn't marked, open regions hold rows.
    early = diagnostics.told_regions(spark, str(tmp_path / "in"), 8 * HOUR, HOUR, 2, end=False)
    assert all(r.open_rows == r.rows for r in diagnostics.tail(got, early).collect())


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    write = tables.by_batch(str(tmp_path / "out"), lambda d: d)
    rows = spark.range(10)
    write(rows, 0)
    write(rows.withColumn("id", F.col("id") + 10), 1)
    before = rows_of(spark.read.parquet(str(tmp_path / "out")))
    write(rows.repartition(5), 0)
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == before and len(before) == 20


def test_going_on_with_new_files(spark, events, tmp_path):  # noqa: F811
    (tmp_path / "in").mkdir()
    path, folder = str(tmp_path / "in"), str(tmp_path / "r")
    files(spark, events, path, range(2), 4)
    first = rows_of(diagnostics.received(spark, path, 1, folder))
    files(spark, events, path, range(2, 4), 4)
    after = rows_of(diagnostics.received(spark, path, 1, folder))
    assert set(first) < set(after) and sum(r[2] for r in after) == len(events)


@pytest.mark.parametrize("broken", [False, True])
def test_progress(spark, events, tmp_path, broken):  # noqa: F811
    (tmp_path / "in").mkdir()
    files(spark, events, tmp_path / "in", range(3), 3)
    listener = diagnostics.Progress(spark, str(tmp_path / "progress.json"))
    spark.streams.addListener(listener)
    try:
        rows = tables.table_stream(spark, str(tmp_path / "in"), 1).select(F.col("event_id"), F.current_timestamp().alias("at"))
        bad = lambda d: d.withColumn("event_id", F.when(F.col("event_id") >= 0, F.raise_error(F.lit("broken")).cast("long")))
        try:
            tables.run_to_end(spark, rows, bad if broken else (lambda d: d), str(tmp_path / "s"), end=False, each=lambda d: d)
        except Exception:
            assert broken
        until = time.time() + 20
        while time.time() < until and listener.told["phase"] == "running":
            time.sleep(0.1)
        time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    told = json.loads((tmp_path / "progress.json").read_text())
    assert told["phase"] == ("failed" if broken else "done") and told["elapsed_seconds"] > 0
    assert (told["completed"], told["rows"]) == ((0, 0) if broken else (3, len(events)))
