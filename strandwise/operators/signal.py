"""Signals as rows (series, idx, v): reading them from events, reshaping, slicing and joining back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import number, running_sum


def from_events(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(series, idx, v): value in hundredths, in the order of event_id within key. Events that lack one of the three are left
    out."""
    rows = events.dropna(subset=[key, "event_id", "value"]).select(F.col(key).alias("series"), "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    return number(rows, ["series"], "event_id").select("series", "idx", "v")


def planar(frames: DataFrame, channels: int) -> DataFrame:
    """(channel, idx, v) from interleaved rows (pos, v)."""
    return frames.select((F.col("pos") % channels).cast("int").alias("channel"), F.expr(f"pos div {channels}").alias("idx"), "v")


def interleaved(samples: DataFrame, channels: int) -> DataFrame:
    """(pos, v) from (channel, idx, v)."""
    return samples.select((F.col("idx") * channels + F.col("channel")).alias("pos"), "v")


def mono(samples: DataFrame) -> DataFrame:
    """(idx, v): the channels' mean at each idx, toward zero."""
    return samples.groupBy("idx").agg(F.sum("v").alias("s"), F.count("*").alias("n")).select("idx", F.expr("s div n").alias("v"))


def offsets(segments: DataFrame) -> DataFrame:
    """segments (series, seg, length) with offset, the sum of the lengths before."""
    return running_sum(segments, ["series"], F.col("length"), "offset", pos="seg")


def blocks(samples: DataFrame, length: int) -> DataFrame:
    """(series, block, offset, samples): arrays of length samples in order, the last shorter."""
    at = samples.withColumn("block", F.expr(f"idx div {length}"))
    items = at.groupBy("series", "block").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("a"))
    return items.select("series", "block", (F.col("block") * length).alias("offset"), F.transform("a", lambda x: x["v"]).alias("samples"))


def scatter(blocked: DataFrame) -> DataFrame:
    """The samples of blocks, back as rows."""
    return blocked.select("series", "offset", F.posexplode("samples").alias("pos", "v")).select("series", (F.col("offset") + F.col("pos")).alias("idx"), "v")


def synthetic(spark, n: int, rate: int = 44_100, channels: int = 2, seed: int = 0) -> DataFrame:
    """(series, idx, v) of test tones: 440 Hz times the channel plus 880 Hz and noise of 200, silent between 20,000 and
    25,000."""
    t = F.lit(2.0 * 3.141592653589793) * F.col("idx") / rate
    tone = F.sin(t * 440 * (F.col("series") + 1)) * 8000 + F.sin(t * 880) * 3000 + F.floor(F.rand(seed) * 401) - 200
    rows = spark.range(n * channels).select((F.col("id") % channels).alias("series"), F.expr(f"id div {channels}").alias("idx"))
    return rows.select("series", "idx", F.when((F.col("idx") > 20_000) & (F.col("idx") < 25_000), 0).otherwise(tone).cast("long").alias("v"))
