"""Zero runs between non-zero values, and bit planes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.intcode import bit_len, unzigzag, zigzag
from .scan import last_before, running_sum


def encode(samples: DataFrame) -> DataFrame:
    """(series, pos, idx, run, v): each non-zero value with the zeros before it, in order from pos 0, and one last row
    with a null v for the zeros at the end."""
    size = samples.groupBy("series").agg(F.max("idx").alias("top"))
    ends = size.select("series", (F.col("top") + 1).alias("idx"), F.lit(None).cast("long").alias("v"))
    rows = samples.filter("v <> 0").select("series", "idx", "v").union(ends)
    rows = last_before(rows, ["series"], F.col("idx"), "prev")
    rows = rows.withColumn("run", F.col("idx") - F.coalesce("prev", F.lit(-1)) - 1).drop("prev")
    return running_sum(rows, ["series"], F.lit(1), "pos").select("series", F.col("pos").cast("long").alias("pos"), F.col("run").cast("long").alias("run"), "v")


def decode(islands: DataFrame) -> DataFrame:
    """The samples of encode's rows, zeros included."""
    rows = running_sum(islands, ["series"], F.col("run") + 1, "start", pos="pos")
    zeros = rows.filter("run > 0").select("series", F.explode(F.expr("sequence(start, start + run - 1)")).alias("idx"), F.lit(0).cast("long").alias("v"))
    return zeros.union(rows.filter("v is not null").select("series", (F.col("start") + F.col("run")).alias("idx"), "v"))


def planes(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, plane, pos, bit) of values (keys, pos, z), z unsigned: the highest bit is plane 0; as many planes as the
    largest z of the keys has bits, one at least."""
    most = values.groupBy(*keys).agg(F.greatest(F.lit(1), F.max(bit_len(F.col("z")))).alias("n"))
    rows = values.join(most, keys).withColumn("plane", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select(*keys, "plane", "pos", F.expr("int(shiftrightunsigned(z, n - 1 - plane) & 1L)").alias("bit"))


def from_planes(bits: DataFrame, keys: list[str]) -> DataFrame:
    most = bits.groupBy(*keys).agg((F.max("plane") + 1).alias("n"))
    rows = bits.join(most, keys)
    return rows.groupBy(*keys, "pos").agg(F.bit_or(F.expr("shiftleft(bigint(bit), n - 1 - plane)")).alias("z"))


def symbols(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, pos, z) of rows (keys, idx, v) whose keys hold a block each: kind 0 the zero runs, one more than
    there are non-zero values, kind 1 the values in zigzag."""
    ends = rows.groupBy(*keys).agg((F.max("idx") + 1).alias("idx")).withColumn("v", F.lit(None).cast("long"))
    w = W.partitionBy(*keys).orderBy("idx")
    found = rows.filter("v <> 0").select(*keys, "idx", "v").unionByName(ends)
    found = found.select(*keys, "v", (F.row_number().over(w) - 1).alias("pos"), (F.col("idx") - F.coalesce(F.lag("idx").over(w), F.lit(-1)) - 1).cast("long").alias("run"))
    run, value = F.struct(F.lit(0).alias("kind"), F.col("run").alias("z")), F.struct(F.lit(1).alias("kind"), zigzag(F.col("v")).alias("z"))
    return found.select(*keys, "pos", F.explode(F.when(F.col("v").isNull(), F.array(run)).otherwise(F.array(run, value))).alias("e")).select(*keys, "e.kind", "pos", "e.z")


def arrays(coded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, c): the arrays of values that symbols was given, zeros included; a key that had none is missing."""
    both = coded.groupBy(*keys, "pos").agg(F.max(F.when(F.col("kind") == 0, F.col("z"))).alias("run"), F.max(F.when(F.col("kind") == 1, F.col("z"))).alias("z"))
    items = both.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "run", "z"))).alias("a"))
    parts = F.transform("a", lambda x: F.concat(F.array_repeat(F.lit(0).cast("long"), x["run"].cast("int")), F.when(x["z"].isNull(), F.array().cast("array<bigint>")).otherwise(F.array(unzigzag(x["z"])))))
    return items.select(*keys, F.flatten(parts).alias("c"))
