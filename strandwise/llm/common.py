"""Helpers that the training-data operators share: shared-folder checkpoints, text blocks and 64-bit mixing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE = (9, 10, 11, 12, 13, 32)
WORD = r"[^\x20\x09-\x0D]+"
BATCH = 4 << 20  # bytes of an Arrow batch


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that spark.checkpoint.dir names or the session was given. Where there
    is none, one of our own if all runs in this process (tests), else ValueError, since a folder of one machine would
    lose what executors elsewhere write."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="spark-") if re.fullmatch(r"local(\[.*\])?", sc.master) else None)
        if not named:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage is cut and its size known."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := shared_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that no helper column has, and these names by column."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH bytes, since each batch is held whole on both sides of a Python worker;
    a limit that the caller has chosen stays. Only queries and the pipeline call this."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default
        spark.conf.set(name, str(BATCH))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about limit bytes of the text column, so that work arrays stay small."""
    sizes = np.diff(utf8(batch.column(column))[1])
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
