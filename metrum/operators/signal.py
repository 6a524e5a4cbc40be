"""Features of fixed-length frames, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def goertzel(frames: np.ndarray, bands: list[float]) -> np.ndarray:
    """Energy of each frame at each frequency (in cycles a frame), after a Hamming window."""
    n = frames.shape[1]
    i = np.arange(n)
    x = frames * (0.54 - 0.46 * np.cos(2 * np.pi * i / max(n - 1, 1)))
    wave = np.exp(-2j * np.pi * np.outer(i, bands) / n)
    return np.abs(x @ wave) ** 2 / n


def periodicity(frames: np.ndarray, low: int, high: int) -> np.ndarray:
    """The largest normalised autocorrelation over lags low to high, at least 0."""
    best = np.zeros(len(frames))
    for lag in range(low, high + 1):
        a, b = frames[:, :-lag], frames[:, lag:]
        norm = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        best = np.maximum(best, np.where(norm > 0, (a * b).sum(axis=1) / np.maximum(norm, 1e-12), 0))
    return best


def features(frames: DataFrame, key: str, vector: str, bands: list[float]) -> DataFrame:
    """key, rms, zero_crossings, energies, centroid, flatness, rolloff (band below which 85 % lies), periodicity. Frames
    that are null or of another length than the first of a batch's are given no row."""
    kind = frames.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b[vector].map(lambda v: v is not None and len(v) > 0)]
            for _, part in b.groupby(b[vector].map(len)):
                x = np.array(part[vector].tolist(), float)
                e = goertzel(x, bands)
                total = np.maximum(e.sum(axis=1), 1e-12)
                yield pd.DataFrame({
                    key: part[key].to_numpy(), "rms": np.sqrt((x * x).mean(axis=1)), "zero_crossings": (np.signbit(x[:, 1:]) != np.signbit(x[:, :-1])).sum(axis=1).astype(np.int64), "energies": list(e),
                    "centroid": (e * np.array(bands)).sum(axis=1) / total, "flatness": np.exp(np.log(np.maximum(e, 1e-12)).mean(axis=1)) / np.maximum(e.mean(axis=1), 1e-12),
                    "rolloff": (np.cumsum(e, axis=1) < 0.85 * total[:, None]).sum(axis=1).astype(np.int64), "periodicity": periodicity(x, 2, min(16, x.shape[1] - 1)),
                })

    schema = f"{key} {kind}, rms double, zero_crossings long, energies array<double>, centroid double, flatness double, rolloff long, periodicity double"
    return frames.select(key, vector).mapInPandas(run, schema)
