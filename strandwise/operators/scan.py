"""Ordered operations on long series that no single task has to hold: positions are cut into slices.

Neighbour terms copy the rows at a slice's rim into the next slice; running terms add what the slices before hold, of
which there is one row each. So a series that holds most of all rows is spread like any other.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

SLICE = 4096


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the folder that spark.checkpoint.dir names or the session was given. Where there is
    none, one of our own if all runs in this process (tests), else ValueError, since executors elsewhere can't read a
    folder of one machine."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        local = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        named = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="spark-") if local else None)
        if not named:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint()


def _free(df: DataFrame, *names: str) -> list[str]:
    """names, lengthened until df has no such column."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def neighbours(df: DataFrame, keys: list[str], make: Callable[..., dict[str, Column]], before: int = 0, after: int = 0, pos: str = "idx", size: int = SLICE) -> DataFrame:
    """df with the columns that make(window) returns, where the window is ordered by pos and sees at least before rows
    earlier and after rows later of the same keys. pos counts from 0 without gaps; rows without pos are left out; null
    keys are a series of their own. An empty table gives no rows."""
    p, s, own = _free(df, "_p", "_s", "_own")
    at, slice_ = F.col(pos) % size, F.floor(F.col(pos) / size)
    place = lambda where, mine: F.struct(where.alias("s"), F.lit(mine).alias("own"))
    late = F.when(at >= size - before, F.array(place(slice_ + 1, False))) if before else None
    early = F.when((at < after) & (slice_ > 0), F.array(place(slice_ - 1, False))) if after else None
    none = F.array().cast("array<struct<s:bigint,own:boolean>>")
    places = F.concat(F.array(place(slice_, True)), *[F.coalesce(x, none) for x in (late, early) if x is not None])
    out = df.filter(F.col(pos).isNotNull()).withColumn(p, F.explode(places)).select(*df.columns, F.col(f"{p}.s").alias(s), F.col(f"{p}.own").alias(own))
    window = W.partitionBy(*keys, s).orderBy(pos)
    return out.withColumns(make(window)).filter(own).drop(s, own)


def _earlier(keys: list[str], s: str) -> WindowSpec:
    """The slices before each, of a table with a row for each slice."""
    return W.partitionBy(*keys).orderBy(s).rowsBetween(W.unboundedPreceding, -1)


def running_sum(df: DataFrame, keys: list[str], value: Column, name: str, pos: str = "idx", size: int = SLICE) -> DataFrame:
    """df with the sum of value over all earlier rows of the same keys (the row itself left out); a null value adds nothing,
    and rows with a null key or no pos are left out. A column of df called name is replaced. An empty table gives no rows."""
    v, s, t, b, i = _free(df, "_v", "_s", "_t", "_b", "_i")
    rows = df.withColumn(v, value).withColumn(s, F.floor(F.col(pos) / size))
    totals = rows.groupBy(*keys, s).agg(F.sum(v).alias(t))
    totals = totals.withColumn(b, F.coalesce(F.sum(t).over(_earlier(keys, s)), F.lit(0))).drop(t)
    inside = F.coalesce(F.sum(v).over(W.partitionBy(*keys, s).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = rows.withColumn(i, inside).join(totals, [*keys, s])
    return joined.select(*[c for c in df.columns if c != name], (F.col(i) + F.col(b)).alias(name))


def last_before(df: DataFrame, keys: list[str], value: Column, name: str, pos: str = "idx", size: int = SLICE) -> DataFrame:
    """df with the last value that isn't null of an earlier row of the same keys, null where there is none; rows with a
    null key or no pos are left out. A column of df called name is replaced. An empty table gives no rows."""
    v, s, t, b, i = _free(df, "_v", "_s", "_t", "_b", "_i")
    rows = df.withColumn(v, value).withColumn(s, F.floor(F.col(pos) / size))
    lasts = rows.groupBy(*keys, s).agg(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(pos))).alias(t))
    lasts = lasts.withColumn(b, F.last(t, ignorenulls=True).over(_earlier(keys, s))).drop(t)
    inside = F.last(v, ignorenulls=True).over(W.partitionBy(*keys, s).orderBy(pos).rowsBetween(W.unboundedPreceding, -1))
    joined = rows.withColumn(i, inside).join(lasts, [*keys, s])
    return joined.select(*[c for c in df.columns if c != name], F.coalesce(i, b).alias(name))


def _part(x: Column, bounds: Column, low: int, high: int) -> Column:
    """How many of bounds[low:high], in order, are x or less, plus low: a tree of comparisons, which is generated code."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(x < bounds[mid], _part(x, bounds, low, mid)).otherwise(_part(x, bounds, mid + 1, high))


def number(df: DataFrame, keys: list[str], order: str, name: str = "idx", ranges: int = 64) -> DataFrame:
    """df with the rank from 0 of each row in its keys by order, a number. Rows are dealt into parts between quantiles of
    order, which are counted first, so that no key's rows are sorted in one task, however order is spread. Rows without
    order come last; ties are in any order; rows with a null key are left out. A column of df called name is replaced. An
    empty table gives no rows."""
    s, n, b, i, c = _free(df, "_s", "_n", "_b", "_i", "_cuts")
    cuts = F.percentile_approx(order, F.array(*[F.lit(j / ranges) for j in range(1, ranges)]), F.lit(20 * ranges))
    ends = df.agg(cuts.alias(c))  # one row
    rows = df.crossJoin(F.broadcast(ends)).withColumn(s, _part(F.col(order), F.col(c), 0, ranges - 1)).drop(c)
    counts = rows.groupBy(*keys, s).agg(F.count("*").alias(n))
    counts = counts.withColumn(b, F.coalesce(F.sum(n).over(_earlier(keys, s)), F.lit(0))).drop(n)
    rows = rows.withColumn(i, F.row_number().over(W.partitionBy(*keys, s).orderBy(F.col(order).asc_nulls_last())) - 1)
    joined = rows.join(counts, [*keys, s])
    return joined.select(*[x for x in df.columns if x != name], (F.col(i) + F.col(b)).alias(name))
