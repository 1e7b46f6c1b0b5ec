"""The reversible CDF 5/3 wavelet on rows (series, idx, v), by lifting: odd samples lose the mean of their neighbours,
even ones gain a quarter of the neighbouring differences. Divisions round down; edges repeat the nearest term."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import neighbours


def forward(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, band, idx, v): one level; band 0 is the approximation, 1 the detail. A series of one sample has no detail."""
    keys = keys or ["series"]
    lag, lead = (lambda c, w: F.lag(c).over(w)), (lambda c, w: F.lead(c).over(w))
    odd = F.col("idx") % 2 == 1

    def details(w) -> dict[str, Column]:
        return {"d": F.when(odd, F.col("v") - F.shiftright(lag("v", w) + F.coalesce(lead("v", w), lag("v", w)), 1))}

    def smooth(w) -> dict[str, Column]:
        near = F.coalesce(lead("d", w), lag("d", w), F.lit(0)), F.coalesce(lag("d", w), lead("d", w), F.lit(0))
        return {"s": F.when(~odd, F.col("v") + F.shiftright(near[0] + near[1] + 2, 2))}

    rows = neighbours(neighbours(samples, keys, details, 1, 1), keys, smooth, 1, 1)
    return rows.select(*keys, odd.cast("int").alias("band"), F.expr("idx div 2").alias("idx"), F.when(odd, F.col("d")).otherwise(F.col("s")).cast("long").alias("v"))


def inverse(bands: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, idx, v) from the two bands of one level."""
    keys = keys or ["series"]
    lag, lead = (lambda c, w: F.lag(c).over(w)), (lambda c, w: F.lead(c).over(w))
    rows = bands.select(*keys, (F.col("idx") * 2 + F.col("band")).alias("idx"), "v")
    odd = F.col("idx") % 2 == 1

    def evens(w) -> dict[str, Column]:
        near = F.coalesce(lead("v", w), lag("v", w), F.lit(0)), F.coalesce(lag("v", w), lead("v", w), F.lit(0))
        return {"e": F.when(~odd, F.col("v") - F.shiftright(near[0] + near[1] + 2, 2))}

    def odds(w) -> dict[str, Column]:
        return {"o": F.when(odd, F.col("v") + F.shiftright(lag("e", w) + F.coalesce(lead("e", w), lag("e", w)), 1))}

    rows = neighbours(neighbours(rows, keys, evens, 1, 1), keys, odds, 1, 1)
    return rows.select(*keys, "idx", F.coalesce("o", "e").cast("long").alias("v"))


def decompose(samples: DataFrame, levels: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, band, idx, v): band 0 is the last approximation, band b the details of level b (1 the finest). A series
    stops at two samples at least; what is left is its approximation."""
    keys = keys or ["series"]
    rest, out = samples, None
    for level in range(1, levels + 1):
        both = forward(rest, keys)
        detail = both.filter("band = 1").select(*keys, F.lit(level).alias("band"), "idx", "v")
        out = detail if out is None else out.union(detail)
        rest = both.filter("band = 0").drop("band")
    rest = rest.select(*keys, F.lit(0).alias("band"), "idx", "v")
    return rest if out is None else rest.union(out)


def compose(bands: DataFrame, levels: int, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["series"]
    rest = bands.filter("band = 0")
    for level in range(levels, 0, -1):
        detail = bands.filter(F.col("band") == level).withColumn("band", F.lit(1))
        rest = inverse(rest.unionByName(detail), keys).withColumn("band", F.lit(0))
    return rest.drop("band")


def band_sizes(n: Column, levels: int) -> Column:
    """array of the sizes of band 0 and bands 1 to levels, of n samples."""
    sizes, rest = [], n
    for _ in range(levels):
        sizes.append((rest / 2).cast("long"))
        rest = rest - sizes[-1]
    return F.array(rest, *sizes)


def _near(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms before and after each of n places between those of x, edges repeated."""
    at = np.arange(n)
    return x[np.clip(at - 1, 0, len(x) - 1)], x[np.clip(at, 0, len(x) - 1)]


def decompose_blocks(levels: int):
    """A column function: array of samples to arrays of bands, band 0 the approximation, then the details from the finest.
    The same as decompose for a block that one row holds; sums wrap, so any 64-bit pattern survives."""

    @F.pandas_udf("array<array<long>>")
    def bands(col: pd.Series) -> pd.Series:
        out = []
        for x in col:
            rest, details = np.asarray(x, np.int64), []
            for _ in range(levels):
                even, odd = rest[::2], rest[1::2]
                if len(odd):
                    odd = odd - ((even[: len(odd)] + even[np.minimum(np.arange(len(odd)) + 1, len(even) - 1)]) >> 1)
                    before, after = _near(odd, len(even))
                    even = even + ((before + after + 2) >> 2)
                details.append(odd)
                rest = even
            out.append([rest, *details])
        return pd.Series(out)

    return bands


def compose_blocks():
    """The inverse of decompose_blocks."""

    @F.pandas_udf("array<long>")
    def samples(col: pd.Series) -> pd.Series:
        out = []
        for bands in col:
            rest = np.asarray(bands[0], np.int64)
            for odd in list(bands)[:0:-1]:
                odd = np.asarray(odd, np.int64)
                if len(odd):
                    before, after = _near(odd, len(rest))
                    even = rest - ((before + after + 2) >> 2)
                    x = np.empty(len(even) + len(odd), np.int64)
                    x[::2] = even
                    x[1::2] = odd + ((even[: len(odd)] + even[np.minimum(np.arange(len(odd)) + 1, len(even) - 1)]) >> 1)
                    rest = x
            out.append(rest)
        return pd.Series(out)

    return samples
