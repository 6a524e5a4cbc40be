"""Streams over tables of many files, in several micro-batches, in and out of order, and started again from a checkpoint."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrum.operators import alignment
from metrum.plans.adapters import HOUR
from metrum.streaming import commit, regions

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def events(spark):
    """Events in order of time, a repeated row and a row without a case among them."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    return e.unionByName(e.limit(1)).unionByName(e.limit(2).withColumn("user_id", F.lit(None).cast("long"))).orderBy("ts", "event_id").toPandas()


def files(spark, events, folder, order, n):
    """The events as n files, in their order, written in the given order (files are read by their time)."""
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    parts = np.array_split(np.arange(len(events)), n)
    for k in order:
        events.iloc[parts[k]].astype({"user_id": "Int64"}).to_parquet(f"{folder}/part-{k:05d}.parquet", coerce_timestamps="us")
    return schema


def want_regions(spark, path):
    from metrum.operators.regions import islands

    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    e = spark.read.parquet(path).select(F.col("user_id").alias("case_id"), "event_id", micros.alias("t"))
    return rows_of(islands(e, 8 * HOUR, HOUR).select("case_id", "region", "start", "end", "n"))


def test_regions_of_a_folder_in_any_order(spark, events, tmp_path):
    order = random.Random(1).sample(range(9), 9)
    files(spark, events, tmp_path, order, 9)
    got = regions.regions_of_table(spark, str(tmp_path), 8 * HOUR, HOUR, files=2)
    assert rows_of(got) == want_regions(spark, str(tmp_path)) and got.where("case_id IS NULL").count() > 0


def test_regions_in_order_start_again_from_the_checkpoint(spark, events, tmp_path):
    (tmp_path / "in").mkdir()
    path, out = str(tmp_path / "in"), str(tmp_path / "state")
    files(spark, events, path, range(4), 8)
    early = rows_of(regions.regions_of_table(spark, path, 8 * HOUR, HOUR, 2, "1 minute", out, end=False))
    files(spark, events, path, range(4, 8), 8)
    late = rows_of(regions.regions_of_table(spark, path, 8 * HOUR, HOUR, 2, "1 minute", out))
    assert early and set(early) < set(late) and late == want_regions(spark, path)


STAY = [math.log(0.8)] * 6
PAUSE = [False, True, False, True, False, False]


def want_commits(events, lag, pause, quiet_below, complete):
    out = []
    for case, e in events.groupby("user_id", dropna=False):
        e = e.sort_values("event_id", kind="stable")
        v = e["value"].to_numpy(float)
        states = alignment.fixed_lag(alignment.level_scores(v, v.min(), v.max(), 6), np.array(STAY), lag, np.array(pause), v < quiet_below, complete)
        numbers = e["event_id"].tolist()
        numbers += [numbers[-1] + k + 1 for k in range(len(states) - len(numbers))]
        out += [(None if np.isnan(case) else int(case), int(n), int(s)) for n, s in zip(numbers, states, strict=True)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("ordered", [True, False])
def test_commits_in_many_batches(spark, events, tmp_path, ordered):
    (tmp_path / "in").mkdir()
    (tmp_path / "all").mkdir()
    path, out = str(tmp_path / "in"), str(tmp_path / "state")
    by_frame = events.drop_duplicates(["user_id", "event_id"]).sort_values(["event_id", "user_id"])
    lateness = "0 seconds" if ordered else "36500 days"
    order = list(range(6)) if ordered else random.Random(2).sample(range(6), 6)
    run = lambda end: commit.commits_of_events(spark, path, STAY, 4, PAUSE, 30.0, True, 1, lateness, out, end, str(tmp_path / "all"))
    files(spark, by_frame, tmp_path / "all", [0], 1)
    files(spark, by_frame, path, order[:3], 6)
    first = rows_of(run(False))
    files(spark, by_frame, path, order[3:], 6)
    got = rows_of(run(True).select("case_id", "frame", "committed"))
    # In order, frames are decided as they come; else when the end is known.
    assert bool(first) == ordered and {r[:3] for r in first} <= set(got)
    assert got == want_commits(by_frame, 4, PAUSE, 30.0, True)


def plain_fixed_lag(scores, stay, lag, pause, quiet, complete):
    """The rules step by step, with the whole history at hand."""
    n, states = scores.shape
    go, best, back, done, held, settled = np.log1p(-np.exp(stay)), None, [], [], None, -1
    for t in range(n):
        if t == 0:
            best, back = [scores[0, 0]] + [-np.inf] * (states - 1), [[0] * states]
        else:
            now, came = [], []
            for s in range(states):
                a, b = best[s] + stay[s], best[s - 1] + go[s - 1] if s else -np.inf
                now.append(max(a, b) + scores[t, s])
                came.append(int(b > a))
            best, back = now, [*back, came]
        while t - len(done) >= lag:
            at = int(np.argmax(best))
            for u in range(t, len(done), -1):
                at -= back[u][at]
            last = done[-1] if done else None
            at = at if last is None else min(max(at, last), last + 1)
            crossing = at > 0 and pause[at - 1] and not pause[at] and at - 1 != settled and (last is None or last <= at - 1)
            heard = any(quiet[len(done) : t + 1])
            if crossing or held is not None:
                if heard:
                    at = max(at - 1, last if last is not None else 0) if crossing else at
                elif t - len(done) < lag + 3:
                    held = at if held is None else held
                    break
                else:
                    at = held if held is not None else at
                    settled = at - 1
            held = None
            done.append(at if last is None else min(max(at, last), last + 1))
    at, tail = int(np.argmax(best)), []
    for u in range(n - 1, len(done) - 1, -1):
        tail = [at, *tail]
        at -= back[u][at]
    first = done[-1] if done else 0
    if complete and tail and tail[-1] < states - 1 and states - 1 - first <= len(tail):
        tail = [first + (k + 1) * (states - 1 - first) // len(tail) for k in range(len(tail))]
    for s in tail:
        done.append(s if not done else min(max(s, done[-1]), done[-1] + 1))
    return done + (list(range(done[-1] + 1, states)) if complete else [])


def test_fixed_lag_against_plain_loops():
    r = np.random.default_rng(4)
    held = 0
    for k in range(300):
        n, states, lag = int(r.integers(1, 40)), int(r.integers(1, 7)), int(r.integers(0, 8))
        scores, stay = np.log(r.random((n, states)) ** 3), np.log(r.uniform(0.5, 0.9, states))
        pause, quiet = r.random(states) < 0.4, r.random(n) < r.choice([0, 0.05, 0.3])
        complete = bool(k % 2)
        got = alignment.fixed_lag(scores, stay, lag, pause, quiet, complete)
        assert got == plain_fixed_lag(scores, stay, lag, pause, quiet, complete)
        held += got != alignment.fixed_lag(scores, stay, lag, None, None, complete)
        # Storing the state between any two frames changes nothing.
        machine, out = None, []
        for t in range(n):
            machine = alignment.FixedLag(stay, lag, pause, machine)
            out += machine.push(scores[t], bool(quiet[t]))
            machine = machine.kept
        rest, tail = alignment.FixedLag(stay, lag, pause, machine).finish(complete)
        assert out + rest + tail == got
    assert held > 20


def test_spans_told_in_spark_are_joined_and_numbered_as_read(spark, tmp_path):
    stream = spark.readStream.schema("key string, t long, at timestamp, ended boolean").parquet(str(tmp_path)).withWatermark("at", "1 minute")
    plan = regions.detect(stream, 10)._jdf.queryExecution().analyzed().toString()
    assert "Pandas" not in plan and "PySpark" not in plan
    # A row that was late, but no gap behind the watermark, makes a span of its own next to one told before; 10 away is a gap.
    spans = spark.createDataFrame([("1", 9, 9, 1, 4), ("1", 0, 5, 2, 3), ("1", 19, 20, 2, 5), ("", 2, 2, 1, 3)], "key string, first long, last long, n long, batch long")
    assert rows_of(regions.regions_of(spans, 10, 3)) == sorted([(1, 0, 0, 12, 3, 4), (1, 1, 19, 23, 2, 5), (None, 0, 2, 5, 1, 3)], key=repr)
