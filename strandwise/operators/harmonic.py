"""Harmonic models: fundamental by autocorrelation, amplitudes and phases of its multiples, and an exact residual."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def autocorrelation(samples: DataFrame, low: int, high: int, size: int = 4096) -> DataFrame:
    """(series, lag, r): normalised autocorrelation at lags low to high; lags that no pair of samples has are left out.

    A series is cut into slices of size samples, each with the high samples after it; a slice is one vectorised group that
    returns its three sums for each lag. idx counts from 0 without gaps."""
    slice_ = F.floor(F.col("idx") / size)
    back = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("idx") - high - size + 1) / size)).cast("long"), slice_.cast("long"))
    rows = samples.select("series", "idx", F.col("v").cast("double").alias("v"), F.explode(back).alias("s"))
    kind = samples.schema["series"].dataType.simpleString()

    def sums(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        x, start = group.v.to_numpy(), key[1] * size
        n = int((group.idx < start + size).sum())
        lags = [k for k in range(low, high + 1) if k < len(x)]
        first = [(x[: min(n, len(x) - k)], x[k : k + min(n, len(x) - k)]) for k in lags]
        return pd.DataFrame([(key[0], k, a @ b, a @ a, b @ b) for k, (a, b) in zip(lags, first, strict=True)], columns=["series", "lag", "xy", "xx", "yy"])

    found = rows.groupBy("series", "s").applyInPandas(sums, f"series {kind}, lag int, xy double, xx double, yy double")
    total = found.groupBy("series", "lag").agg(*(F.sum(c).alias(c) for c in ("xy", "xx", "yy")))
    return total.select("series", "lag", F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(0.0).alias("r"))


def fundamental(correlations: DataFrame, least: float = 0.3) -> DataFrame:
    """(series, lag, r): each series' best lag, the smallest of equals; lag 0 if r is below least."""
    best = correlations.groupBy("series").agg(F.max(F.struct(F.round("r", 9).alias("r"), (-F.col("lag")).alias("l"))).alias("b"))
    return best.select("series", F.when(F.col("b.r") >= least, -F.col("b.l")).otherwise(0).alias("lag"), F.col("b.r").alias("r"))


def goertzel(samples: DataFrame, period: float, count: int) -> DataFrame:
    """(series, k, amplitude, phase) of the harmonics k = 1 to count of one period in samples, at phase 0 of sample 0."""
    angle = F.col("k") * F.col("idx") * (2 * math.pi / period)
    rows = samples.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(count))))
    sums = rows.groupBy("series", "k").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(-F.col("v") * F.sin(angle)).alias("im"), F.count("*").alias("n"))
    return sums.select("series", "k", (F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) * 2 / F.col("n")).alias("amplitude"), F.atan2("im", "re").alias("phase"))


def synthesise(n: int, w: float, amplitudes: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Whole samples of the model, halves rounded away from zero."""
    at = np.arange(n, dtype=np.float64)
    total = np.zeros(n)
    for k, (a, p) in enumerate(zip(amplitudes, phases, strict=True), 1):
        total += a * np.cos(w * k * at + p)
    return (np.sign(total) * np.floor(np.abs(total) + 0.5)).astype(np.int64)


def analyse(blocks: DataFrame, count: int, rate: int) -> DataFrame:
    """blocks (samples) with model, a struct of the frequency as radians a sample, amplitudes and phases as floats:
    null where no period between rate / 2000 and rate / 50 samples stands out or the model would add energy."""

    @F.pandas_udf("struct<w float, amplitudes array<float>, phases array<float>>")
    def fit(col: pd.Series) -> pd.DataFrame:
        out = []
        for x in col:
            x = np.asarray(x, np.float64)
            n, low, high = len(x), max(1, rate // 2000), min(rate // 50, len(x) - 1)
            model = (None, None, None)
            if n >= 32 and low <= high:
                r = [float(x[:-k] @ x[k:]) / max(math.sqrt(float(x[:-k] @ x[:-k]) * float(x[k:] @ x[k:])), 1e-12) for k in range(low, high + 1)]
                if max(r) >= 0.3:
                    w = float(np.float32(2 * math.pi / (low + int(np.argmax(r)))))
                    top = min(count, int(math.pi / w))
                    y = np.array([(x * np.exp(-1j * w * k * np.arange(n))).sum() for k in range(1, top + 1)])
                    a, p = (2 * np.abs(y) / n).astype(np.float32), np.angle(y).astype(np.float32)
                    if ((x - synthesise(n, w, a.astype(float), p.astype(float))) ** 2).sum() < (x**2).sum():
                        model = (w, a.tolist(), p.tolist())
            out.append(model)
        return pd.DataFrame(out, columns=["w", "amplitudes", "phases"])

    return blocks.withColumn("model", fit.asNondeterministic()("samples"))


def _shift(sign: int):
    @F.pandas_udf("array<long>")
    def moved(samples: pd.Series, w: pd.Series, a: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for x, w_, a_, p_ in zip(samples, w, a, p, strict=True):
            x = np.asarray(x, np.int64)
            out.append(x if a_ is None or not len(a_) else x + sign * synthesise(len(x), float(w_), np.asarray(a_, float), np.asarray(p_, float)))
        return pd.Series(out)

    # Else Spark filters by the samples before they are exploded, and runs this and the fit once more for that.
    return moved.asNondeterministic()


def residual(modelled: DataFrame) -> DataFrame:
    """samples less what their model makes, whole numbers; the same code adds it back in reconstruct."""
    return modelled.withColumn("samples", _shift(-1)("samples", "model.w", "model.amplitudes", "model.phases"))


def reconstruct(modelled: DataFrame) -> DataFrame:
    return modelled.withColumn("samples", _shift(1)("samples", "model.w", "model.amplitudes", "model.phases"))
