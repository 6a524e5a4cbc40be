"""Streams of samples cut into frames, with the features of each frame and of the window that ends with it.

Samples come in rows (blocks) of any length. One sort brings a case's blocks together in their order; the samples that fill no
frame yet, the last window, and what a frame needs of the one before are carried from row to row, so how samples are dealt
to rows makes no difference, and memory is that of one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seconds of a frame and of a window; bands of both, in Hz; where low and middle bands end; periods looked at; the
# share of energy below the rolloff; decay and least value of the running peak.
FRAME, WINDOW = 0.010, 0.030
BANDS, LOW, MIDDLE = (300.0, 700.0, 1200.0, 2400.0, 4000.0, 6500.0), 2, 4
RICH_BANDS, RICH_LOW, RICH_MIDDLE = (250.0, 400.0, 630.0, 1000.0, 1400.0, 2000.0, 2800.0, 3600.0, 4500.0, 5400.0, 6300.0, 7200.0), 1000.0, 3500.0
PERIOD, LONGEST, RICH_LONGEST, PERIODS, RICH_PERIODS = 0.0025, 0.0080, 0.0125, 6, 24
ROLLOFF, DECAY, FLOOR = 0.85, 0.995, 1e-4
FEATURES = (
    "log_rms rms_norm delta_rms flux zcr low mid high centroid periodicity rich_low rich_mid rich_high rich_centroid rich_rolloff rich_flatness rich_flux rich_periodicity"
).split()


def _round(x: float) -> int:
    return int(np.floor(x + 0.5))


def energies(x: np.ndarray, rate: int, bands: tuple[float, ...]) -> np.ndarray:
    """Of each row at the whole number of periods nearest to each band, after a Hamming window; 0 from half the rate on."""
    n = x.shape[1]
    i = np.arange(n)
    k = np.floor(0.5 + n * np.array(bands) / rate)
    wave = np.exp(-2j * np.pi * np.outer(i, k) / n) * (np.array(bands) < rate / 2) * (n > 2)
    return np.abs((x * (0.54 - 0.46 * np.cos(2 * np.pi * i / max(n - 1, 1)))) @ wave) ** 2


def periodicity(x: np.ndarray, rate: int, longest: float, steps: int, floor: float) -> np.ndarray:
    """The largest normalised autocorrelation over some lags between a shortest and a longest period, within 0 and 1."""
    n, best = x.shape[1], np.zeros(len(x))
    low, high = max(_round(PERIOD * rate), 1), min(_round(longest * rate), n - 2)
    for lag in range(low, high + 1, max((high - low) // steps, 1)):
        a, b = x[:, :-lag], x[:, lag:]
        best = np.maximum(best, (a * b).sum(axis=1) / np.sqrt(np.maximum((a * a).sum(axis=1) * (b * b).sum(axis=1), floor)))
    return np.minimum(best, 1.0)


class Framer:
    """The frames of one case, block after block."""

    def __init__(self) -> None:
        self.rate, self.frame = 0, 0
        self.rms: float | None = None
        self.peak = FLOOR
        self._begin(0)

    def _begin(self, rate: int) -> None:
        """A new rate: samples that fill no frame are dropped, and no window reaches back."""
        self.rate, self.pending, self.window, self.before = rate, np.zeros(0), np.zeros(0), None

    def push(self, samples: np.ndarray, rate: int) -> np.ndarray:
        """Rows of FEATURES of the frames that these samples complete."""
        if rate != self.rate:
            self._begin(rate)
        hop = max(_round(FRAME * rate), 1)
        width = max(_round(WINDOW * rate), hop)
        x = np.concatenate([self.pending, samples])
        n = len(x) // hop
        self.pending = x[n * hop :]
        if not n:
            return np.zeros((0, len(FEATURES)))
        frames = x[: n * hop].reshape(n, hop)
        rms = np.sqrt((frames * frames).mean(axis=1))
        peak = np.empty(n)
        for k in range(n):
            self.peak = peak[k] = max(self.peak * DECAY, rms[k])
        delta = np.diff(rms, prepend=rms[0] if self.rms is None else self.rms)
        e, half = energies(frames, rate, BANDS), max(rate * 0.5, 1.0)
        total = np.maximum(e.sum(axis=1), 1e-6)
        centroid = np.minimum(e @ np.array(BANDS) / total / half, 1.0)
        base = [e[:, :LOW].sum(axis=1) / total, e[:, LOW:MIDDLE].sum(axis=1) / total, e[:, MIDDLE:].sum(axis=1) / total, centroid]
        loud = (frames * frames).sum(axis=1) > 1e-7
        low, high = max(_round(PERIOD * rate), 1), min(_round(LONGEST * rate), hop - 2)
        period = np.where(loud, periodicity(frames, rate, LONGEST, PERIODS, 1e-8), 0.0) if high > low else np.zeros(n)
        zcr = ((frames[:, 1:] < 0) != (frames[:, :-1] < 0)).sum(axis=1) / hop
        rich = np.stack([*base[:3], centroid, centroid, np.zeros(n), np.zeros(n), period], axis=1)
        seen = np.concatenate([self.window, x[: n * hop]])
        # Windows end with frames; the first ones may have too few samples.
        ends = len(self.window) + hop * np.arange(1, n + 1)
        full = ends >= width
        if full.any():
            rich[full] = self._rich(sliding_window_view(seen, width)[ends[full] - width], rate, half)
        self.window, self.rms, self.frame = seen[max(len(seen) - width, 0) :], float(rms[-1]), self.frame + n
        return np.column_stack([np.log(np.maximum(rms, 1e-6)), np.minimum(rms / np.maximum(peak, FLOOR), 1.0), delta, np.maximum(delta, 0) / np.maximum(peak, FLOOR), zcr, *base, period, rich])

    def _rich(self, windows: np.ndarray, rate: int, half: float) -> np.ndarray:
        bands = np.array(RICH_BANDS)
        out = []
        for lo in range(0, len(windows), 256):
            w = windows[lo : lo + 256]
            e = energies(w, rate, RICH_BANDS)
            total = np.maximum(e.sum(axis=1), 1e-6)
            share = e / total[:, None]
            before = np.concatenate([share[:1] if self.before is None else self.before[None], share[:-1]])
            self.before = share[-1]
            flat = np.exp(np.log(e + 1e-9).mean(axis=1)) / np.maximum(total / len(bands), 1e-9)
            reached = np.cumsum(e, axis=1) >= ROLLOFF * total[:, None]
            centroid = np.minimum(e @ bands / total / half, 1.0)
            base = [np.minimum(e[:, pick].sum(axis=1) / total, 1.0) for pick in (bands < RICH_LOW, (bands >= RICH_LOW) & (bands < RICH_MIDDLE), bands >= RICH_MIDDLE)]
            # Windows without energy reach no band: their rolloff is the centroid's place, as before any window.
            rolloff = np.where(reached.any(axis=1), np.minimum(bands[np.argmax(reached, axis=1)] / half, 1.0), centroid)
            flux = np.minimum(2.0 * np.maximum(share - before, 0).sum(axis=1), 1.0)
            out.append(np.column_stack([*base, centroid, rolloff, np.minimum(flat, 1.0), flux, periodicity(w, rate, RICH_LONGEST, RICH_PERIODS, 1e-8)]))
        return np.concatenate(out)


def frame_features(blocks: DataFrame, case: str = "case_id", order: str = "block", samples: str = "samples", rate: str = "rate") -> DataFrame:
    """case_id, frame (from 0) and FEATURES of each whole frame. blocks: case, order (no ties: with them, the order of equal
    ones is open), samples, rate. Null samples and rows without samples or rate are skipped; a new rate begins anew."""
    kind = blocks.schema[case].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, framer = object(), Framer()
        for b in batches:
            rows = zip(b.column("c").to_pylist(), b.column("r").to_pylist(), b.column("s"), strict=True)
            cases, numbers, found = [], [], [np.zeros((0, len(FEATURES)))]
            for (c, r), part in groupby(rows, key=lambda row: (row[0], row[1])):
                if c != now:
                    now, framer = c, Framer()
                x = np.concatenate([np.zeros(0)] + [np.array([v for v in row[2].as_py() if v is not None], float) for row in part if row[2].as_py() is not None])
                if r and r > 0:
                    first = framer.frame
                    got = framer.push(x, r)
                    cases += [c] * len(got)
                    numbers += range(first, first + len(got))
                    found.append(got)
            table = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(cases, b.schema.field("c").type), pa.array(numbers, pa.int64()), *(pa.array(table[:, k]) for k in range(len(FEATURES)))], names=["case_id", "frame", *FEATURES])

    rows = blocks.select(F.col(case).alias("c"), F.col(order).alias("o"), F.col(rate).cast("int").alias("r"), F.col(samples).cast("array<double>").alias("s"))
    return rows.repartition("c").sortWithinPartitions("c", "o").mapInArrow(run, f"case_id {kind}, frame long, " + ", ".join(f"{f} double" for f in FEATURES))
