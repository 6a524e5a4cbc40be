"""Frames and windows of sample streams: sample by sample, and however the samples are dealt to rows."""

import io
import wave
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from metrum.operators import alignment, framing
from metrum.sources import files

SCHEMA = "case_id string, block int, samples array<double>, rate int"


def goertzel(x, rate, hz):
    """By the recurrence."""
    n = len(x)
    if hz >= rate / 2 or n <= 2:
        return 0.0
    c = 2 * np.cos(2 * np.pi * np.floor(0.5 + n * hz / rate) / n)
    q1 = q2 = 0.0
    for i, s in enumerate(x):
        q1, q2 = c * q1 - q2 + s * (0.54 - 0.46 * np.cos(2 * np.pi * i / (n - 1))), q1
    return max(q1 * q1 + q2 * q2 - c * q1 * q2, 0.0)


def period(x, rate, longest, steps):
    best, low, high = 0.0, max(int(0.0025 * rate + 0.5), 1), min(int(longest * rate + 0.5), len(x) - 2)
    for lag in range(low, high + 1, max((high - low) // steps, 1)):
        ab = sum(a * b for a, b in zip(x, x[lag:]))
        aa, bb = sum(a * a for a in x[: len(x) - lag]), sum(b * b for b in x[lag:])
        best = max(best, ab / np.sqrt(max(aa * bb, 1e-8)))
    return min(best, 1.0)


def plain(x, rate):
    hop, width = int(0.01 * rate + 0.5), int(0.03 * rate + 0.5)
    out, peak, last, before = [], 1e-4, None, None
    for k in range(len(x) // hop):
        h, half = x[k * hop : (k + 1) * hop], rate / 2
        rms = np.sqrt(sum(s * s for s in h) / hop)
        peak = max(peak * 0.995, rms)
        delta = 0.0 if last is None else rms - last
        last = rms
        e = [goertzel(h, rate, hz) for hz in framing.BANDS]
        t = max(sum(e), 1e-6)
        centroid = min(sum(a * b for a, b in zip(e, framing.BANDS)) / t / half, 1.0)
        p = period(h, rate, 0.008, 6) if sum(s * s for s in h) > 1e-7 else 0.0
        row = [np.log(max(rms, 1e-6)), min(rms / max(peak, 1e-4), 1), delta, max(delta, 0) / max(peak, 1e-4), sum((a < 0) != (b < 0) for a, b in zip(h, h[1:])) / hop, sum(e[:2]) / t, sum(e[2:4]) / t, sum(e[4:]) / t, centroid, p]
        if (k + 1) * hop >= width:
            w = x[(k + 1) * hop - width : (k + 1) * hop]
            e = [goertzel(w, rate, hz) for hz in framing.RICH_BANDS]
            t = max(sum(e), 1e-6)
            share = [a / t for a in e]
            flux = 0.0 if before is None else min(2 * sum(max(a - b, 0) for a, b in zip(share, before)), 1)
            before, cum, roll, c = share, 0.0, None, min(sum(a * b for a, b in zip(e, framing.RICH_BANDS)) / t / half, 1.0)
            for a, hz in zip(e, framing.RICH_BANDS):
                cum += a
                if cum >= 0.85 * t and roll is None:
                    roll = min(hz / half, 1.0)
            row += [sum(e[:3]) / t, sum(e[3:7]) / t, sum(e[7:]) / t, c, c if roll is None else roll, min(np.exp(np.mean(np.log(np.array(e) + 1e-9))) / max(t / 12, 1e-9), 1), flux, period(w, rate, 0.0125, 24)]
        else:
            row += [*row[5:9], centroid, 0.0, 0.0, p]
        out.append(row)
    return np.array(out).reshape(-1, 18)


def rows(df, case):
    got = df.where(F.col("case_id") == case).orderBy("frame").collect()
    assert [r.frame for r in got] == list(range(len(got)))
    return np.array([list(r)[2:] for r in got], float).reshape(-1, 18)


def test_frames_equal_plain_loops_for_any_blocks(spark):
    r = np.random.default_rng(1)
    t = np.arange(3170) / 16000
    sounds = {"tone": np.sin(2 * np.pi * 440 * t) * np.linspace(0, 0.8, len(t)), "noise": r.normal(0, 0.1, 1700), "silence": np.zeros(700), "short": r.normal(0, 0.1, 100)}
    for cut in (1, 37):
        blocks = []
        for case, x in sounds.items():
            at = [0, *sorted(r.integers(0, len(x), cut - 1).tolist()), len(x)]
            blocks += [(case, k, x[a:b].tolist(), 16000) for k, (a, b) in enumerate(zip(at, at[1:]))]
        blocks += [("tone", 10**6, None, 16000), ("none", 0, [], 16000), ("none", 1, [1.0], None)]
        got = framing.frame_features(spark.createDataFrame(blocks, SCHEMA).repartition(7))
        for case, x in sounds.items():
            assert np.allclose(rows(got, case), plain(x.tolist(), 16000), atol=1e-9), case
        assert rows(got, "none").shape == (0, 18) and rows(got, "short").shape == (0, 18)


def test_a_new_rate_begins_anew(spark):
    x = np.random.default_rng(2).normal(0, 0.1, 2000)
    got = rows(framing.frame_features(spark.createDataFrame([("a", 0, x[:1005].tolist(), 16000), ("a", 1, x[1005:].tolist(), 8000)], SCHEMA)), "a")
    one, two = plain(x[:1005].tolist(), 16000), plain(x[1005:].tolist(), 8000)
    assert len(got) == len(one) + len(two) and np.allclose(got[: len(one)], one, atol=1e-9)
    # Loudness goes on, all else is that of the new rate alone.
    assert np.allclose(got[len(one) :, 4:], two[:, 4:], atol=1e-9) and got[len(one), 2] != 0


def test_features_of_wav_files(spark, tmp_path):
    x = (np.sin(np.arange(2400) / 9) * 9000).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(16000)
        f.writeframes(np.stack([x, x // 2], axis=1).tobytes())
    (tmp_path / "one.wav").write_bytes(out.getvalue())
    read = files.read_wav(spark, str(tmp_path)).withColumn("block", F.lit(0))
    mono = np.stack([x, x // 2], axis=1).mean(axis=1) / 32768
    assert np.allclose(rows(framing.frame_features(read), "one"), plain(mono.astype(np.float32).astype(float).tolist(), 16000), atol=1e-6)


def test_forward_sums_all_paths(spark):
    r = np.random.default_rng(3)
    lengths = np.array([1, 3, 6, 2])
    scores, stay = np.log(r.random((4, 6, 3))), np.log(r.uniform(0.3, 0.9, 3))
    got = alignment.forward(scores, lengths, stay)
    for k, n in enumerate(lengths):
        total = 0.0
        for steps in product([0, 1], repeat=n - 1):
            path = np.cumsum([0, *steps])
            if path[-1] == 2:
                total += np.exp(sum(scores[k, t, s] for t, s in enumerate(path)) + sum(stay[s] if go == 0 else np.log1p(-np.exp(stay[s])) for s, go in zip(path, steps)))
        assert got[k] == -np.inf if total == 0 else abs(got[k] - np.log(total)) < 1e-12
    rows = [(c, i, float(v)) for c, n in ((1, 40), (2, 2), (None, 9)) for i, v in enumerate(r.random(n))]
    found = {x.case_id: (x.frames, x.log_likelihood) for x in alignment.forward_cases(spark.createDataFrame(rows, "case_id long, frame long, value double"), 3).collect()}
    assert found[2] == (2, None) and found[1][0] == 40 and found[1][1] < 0 and found[None][0] == 9
