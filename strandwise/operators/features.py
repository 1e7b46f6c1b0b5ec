"""Features of windows of a signal and the segmentation that they lead to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CodecConfig
from .scan import neighbours

PIECE = 1 << 16  # values after which a worker hands blocks on


def window_features(samples: DataFrame, win: int) -> DataFrame:
    """(series, win, n, energy, zcr): mean square and share of sign changes of each tumbling window."""
    signs = neighbours(samples, ["series"], lambda w: {"p": F.lag("v").over(w)}, before=1)
    flip = ((F.col("v") < 0) != (F.col("p") < 0)) & (F.col("idx") % win > 0)
    rows = signs.groupBy("series", F.expr(f"idx div {win}").alias("win")).agg(F.count("*").alias("n"), (F.sum(F.col("v").cast("double") * F.col("v")) / F.count("*")).alias("energy"), F.sum(flip.cast("int")).alias("flips"))
    return rows.select("series", "win", "n", "energy", F.when(F.col("n") > 1, F.col("flips") / (F.col("n") - 1)).otherwise(0.0).alias("zcr"))


def local_entropy(samples: DataFrame, win: int, bins: int = 64) -> DataFrame:
    """(series, win, entropy): bits of the equal-width histogram of each window; 0 if it is constant."""
    rows = samples.withColumn("win", F.expr(f"idx div {win}"))
    ends = rows.groupBy("series", "win").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = rows.join(ends, ["series", "win"]).groupBy("series", "win", "n", place.alias("bin")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("n")
    return counts.groupBy("series", "win").agg(F.sum(-p * F.log2(p)).alias("entropy"))


def changes(features: DataFrame) -> DataFrame:
    """features with energy_change and zcr_change against the window before (null for a series' first)."""

    def make(w):
        e, z = F.lag("energy").over(w), F.lag("zcr").over(w)
        return {"energy_change": F.abs(F.col("energy") - e) / F.greatest(e, F.lit(1.0)), "zcr_change": F.abs(F.col("zcr") - z)}

    return neighbours(features, ["series"], make, before=1, pos="win")


def _windows(samples: DataFrame, win: int) -> DataFrame:
    """(series, win, n, m): samples of each tumbling window and the magnitudes of its discrete Fourier transform, padded
    with zeros to the next power of two. Vectorised over Arrow batches, one row of samples a window."""
    items = samples.groupBy("series", F.expr(f"idx div {win}").alias("win")).agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("a"))
    size = 1 << max(0, win - 1).bit_length()

    @F.pandas_udf("array<double>")
    def magnitudes(col: pd.Series) -> pd.Series:
        return pd.Series([np.abs(np.fft.rfft(np.asarray(x, np.float64), size)) for x in col])

    # Else Spark filters by the result before it is exploded, and runs the function once more for that.
    once = magnitudes.asNondeterministic()
    return items.select("series", "win", F.size("a").alias("n"), once(F.transform("a", lambda x: x["v"].cast("double"))).alias("m"))


def spectrum(samples: DataFrame, win: int) -> DataFrame:
    """(series, win, bin, magnitude): the magnitude spectrum of each window. An empty table gives no rows."""
    return _windows(samples, win).select("series", "win", F.posexplode("m").alias("bin", "magnitude"))


def transform(blocks: DataFrame, inverse: bool = False) -> DataFrame:
    """blocks (re, im arrays of equal length) with their discrete Fourier transform, both padded with zeros to the next power
    of two; the inverse divides by the length. Null or empty arrays give empty ones."""

    def turn(a, b) -> tuple[np.ndarray, np.ndarray]:
        x = np.asarray([] if a is None else a, np.float64) + 1j * np.asarray([] if b is None else b, np.float64)
        y = (np.fft.ifft if inverse else np.fft.fft)(x, 1 << max(0, len(x) - 1).bit_length()) if len(x) else x
        return y.real, y.imag

    @F.pandas_udf("struct<re array<double>, im array<double>>")
    def turned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for re, im in batches:
            out, held = [], 0
            for a, b in zip(re, im, strict=True):
                out.append(turn(a, b))
                held += len(out[-1][0])
                if held >= PIECE:  # handed on as soon as some are there, whatever the batch
                    yield pd.DataFrame(out, columns=["re", "im"])
                    out, held = [], 0
            if out or not len(re):
                yield pd.DataFrame(out, columns=["re", "im"])

    # Else Spark filters by the result before it is exploded, and runs the function once more for that.
    return blocks.withColumn("t_", turned.asNondeterministic()("re", "im")).withColumn("re", F.col("t_.re")).withColumn("im", F.col("t_.im")).drop("t_")


def flux(samples: DataFrame, win: int) -> DataFrame:
    """(series, win, flux): distance of each window's magnitude spectrum from that of the window before, by sample; needs two
    samples on each side, else 0."""

    def make(w):
        gap = F.zip_with("m", F.lag("m").over(w), lambda x, y: (x - y) * (x - y))
        return {"flux": F.when((F.col("n") >= 2) & (F.lag("n").over(w) >= 2), F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)) / win).otherwise(0.0)}

    return neighbours(_windows(samples, win), ["series"], make, before=1, pos="win").select("series", "win", "flux")


def boundaries(samples: DataFrame, cfg: CodecConfig, with_flux: bool = True) -> DataFrame:
    """(series, win, edge): whether a segment may start at the window, by the change of energy, sign changes or spectrum."""
    rows = changes(window_features(samples, cfg.window))
    edge = (F.col("energy_change").cast("float") > F.lit(cfg.energy_threshold).cast("float")) | (F.col("zcr_change").cast("float") > F.lit(cfg.zcr_threshold).cast("float"))
    if with_flux:
        rows = rows.join(flux(samples, cfg.window), ["series", "win"])
        edge = edge | (F.col("flux").cast("float") > F.lit(cfg.flux_threshold).cast("float"))
    return rows.select("series", "win", F.coalesce(edge, F.lit(False)).alias("edge"))


def segments(edges: DataFrame, lengths: DataFrame, cfg: CodecConfig) -> DataFrame:
    """(series, seg, offset, length): from each start the first edge at least min_block away ends a segment, or max_block.

    The choice is sequential, but over edges only: each possible start has one successor, found by a join on ranges of
    windows; the chain from 0 is then followed in one pass over a series' flags, packed as one array of windows.
    """
    win = cfg.window
    marks = edges.filter("edge").groupBy("series").agg(F.sort_array(F.collect_list("win")).alias("marks"))
    rows = lengths.join(marks, "series", "left")

    @F.pandas_udf("struct<offset array<long>, length array<long>>")
    def cuts(marks: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for edge, total in zip(marks, n, strict=True):
            edge, at, own = np.asarray(edge if edge is not None else [], np.int64) * win, 0, []
            while at < total:
                own.append(at)
                i = np.searchsorted(edge, at + max(cfg.min_block, win))
                at = min(int(edge[i]) if i < len(edge) else total, at + cfg.max_block)
            out.append((np.array(own, np.int64), np.diff(np.array(own, np.int64), append=total)))
        return pd.DataFrame(out, columns=["offset", "length"])

    # Else Spark filters by the result before it is exploded, and runs the function once more for that. A row takes its own
    # offset and length along, not its series' array.
    rows = rows.select("series", cuts.asNondeterministic()("marks", "n").alias("s"))
    both = F.zip_with("s.offset", "s.length", lambda offset, length: F.struct(offset.alias("offset"), length.alias("length")))
    return rows.select("series", F.posexplode(both).alias("seg", "e")).select("series", "seg", "e.offset", "e.length")
