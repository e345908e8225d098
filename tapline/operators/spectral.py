"""Spectral shape of inter-arrival times.

Windows arrive as arrays of bounded length; the transform itself is numpy inside an Arrow UDF.
Windows beyond the bound take the distributed transform in bigfft.py.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPECTRAL = ["dominant_frequency", "spectral_flatness", "harmonic_ratio", "spectral_centroid", "periodicity_score"]
SPECTRAL_TYPE = "struct<" + ",".join(f"{c}:double" for c in SPECTRAL) + ">"


def summarise(magnitude: np.ndarray, freqs: np.ndarray) -> tuple[float, ...]:
    """Five shape measures of a one-sided magnitude spectrum without its constant term."""
    if not len(magnitude) or magnitude.max() == 0:
        return (0.0,) * 5
    peak = int(magnitude.argmax())
    total, mean = magnitude.sum(), magnitude.mean()
    geometric = np.exp(np.log(magnitude + 1e-12).mean())
    return (float(freqs[peak]), float(geometric / (mean + 1e-12)), float(magnitude[peak] / (total + 1e-12)),
            float((freqs * magnitude).sum() / (total + 1e-12)), float(magnitude[peak] / (mean + 1e-12)))


def gaps(times: np.ndarray, mode: str) -> np.ndarray:
    if mode == "double":
        return np.diff(times / 1e6)
    return np.diff(times) / 1e6


def gap_spectrum(iats: np.ndarray, mode: str = "exact") -> tuple[float, ...]:
    n = len(iats)
    if n < 4 or (mode != "double" and not np.ptp(iats)):
        return (0.0,) * 5
    mean = float(iats.mean())
    magnitude = np.abs(np.fft.rfft(iats - mean))[1:]
    return summarise(magnitude, np.fft.rfftfreq(n, d=max(mean, 1e-6))[1:])


def spectral_of_times(times: Column, mode: str = "exact") -> Column:
    """Spectral struct of sorted arrival times in microseconds; null in, null out."""

    @F.pandas_udf(SPECTRAL_TYPE)
    def run(col: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 5 if t is None else gap_spectrum(gaps(np.asarray(t, dtype="int64"), mode), mode)
                for t in col]
        return pd.DataFrame(rows, columns=SPECTRAL, dtype="float64")

    return run(times)


def histogram_peak(counts: Column, duration_s: Column) -> Column:
    """Dominant frequency of an arrival histogram of at most 256 bins; of equal magnitudes (to six places) the lowest."""

    @F.pandas_udf("double")
    def run(col: pd.Series, dur: pd.Series) -> pd.Series:
        out = []
        for bins, d in zip(col, dur):
            if bins is None or d <= 0:
                out.append(0.0)
                continue
            h = np.asarray(bins, dtype="float64")
            mag = np.round(np.abs(np.fft.rfft(h - h.mean())), 6)
            freqs = np.fft.rfftfreq(len(h), d=d / len(h))
            out.append(float(freqs[int(mag[1:].argmax()) + 1]) if len(mag) > 1 else 0.0)
        return pd.Series(out)

    return run(counts, duration_s)
