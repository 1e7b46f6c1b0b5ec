"""WAV and raw PCM files as tables of sample blocks, and back. Samples are whole numbers; floats are carried as their bit
patterns."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import cut

FRAMES = 65_536  # frames of a block
FORMATS = {"int16": ("<i2", 2), "int24": (None, 3), "int32": ("<i4", 4), "float32": ("<i4", 4), "float64": ("<i8", 8)}
PROBE = "path string, sample_rate long, channels int, frames long, format string, container string, truncated boolean"


def _format(tag: int, bits: int) -> str:
    kind = {(1, 16): "int16", (1, 24): "int24", (1, 32): "int32", (3, 32): "float32", (3, 64): "float64"}.get((tag, bits))
    if kind is None:
        raise ValueError(f"unsupported format {tag} with {bits} bits")
    return kind


def parse(data: bytes) -> dict:
    """The header's facts and where the samples lie; sizes beyond the file's end count as truncated. ValueError for what is no
    WAV file, for unsupported formats and for chunks that are cut short."""
    return _parse(lambda at, n: data[at : at + n], len(data))


def _parse(read: Callable[[int, int], bytes], length: int) -> dict:
    """The same from a function that reads n bytes at a place: samples are stepped over."""
    start = read(0, 12)
    if start[:4] not in (b"RIFF", b"RF64") or start[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, fmt, big = 12, None, None
    while at + 8 <= length:
        head = read(at, 8)
        name, size = head[:4], struct.unpack_from("<I", head, 4)[0]
        body = at + 8
        if name == b"ds64":
            if len(data := read(body, 16)) < 16:
                raise ValueError("a ds64 chunk is cut short")
            big = struct.unpack_from("<Q", data, 8)[0]
        elif name == b"fmt ":
            if len(data := read(body, min(size, 40))) < 16:
                raise ValueError("a format chunk is cut short")
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data)
            if tag == 0xFFFE:
                if len(data) < 26:
                    raise ValueError("a format chunk is cut short")
                tag = struct.unpack_from("<H", data, 24)[0]
            if not channels:
                raise ValueError("no channels")
            fmt = (_format(tag, bits), channels, rate)
        elif name == b"data":
            if fmt is None:
                raise ValueError("samples before their format")
            size = big if size == 0xFFFFFFFF and big is not None else size
            width = FORMATS[fmt[0]][1] * fmt[1]
            held = min(size, length - body)
            return {"sample_rate": fmt[2], "channels": fmt[1], "frames": held // width, "format": fmt[0], "container": start[:4].decode(), "truncated": held < size, "body": body}
        at = body + size + size % 2
    raise ValueError("no samples")


def samples(data: bytes, fmt: str) -> np.ndarray:
    kind, width = FORMATS[fmt]
    if kind:
        return np.frombuffer(data, kind).astype(np.int64)
    b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int64)
    v = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
    return v - ((v >> 23) << 24)


def pack(values: np.ndarray, fmt: str) -> bytes:
    kind, width = FORMATS[fmt]
    if kind:
        return values.astype(kind).tobytes()
    return np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :3].tobytes()


def header(rate: int, channels: int, frames: int, fmt: str) -> bytes:
    width = FORMATS[fmt][1]
    size, tag = frames * channels * width, 3 if fmt.startswith("float") else 1
    body = struct.pack("<4sIHHIIHH", b"fmt ", 16, tag, channels, rate, rate * channels * width, channels * width, 8 * width)
    if size + 44 <= 0xFFFFFFFF:
        return struct.pack("<4sI4s", b"RIFF", 36 + size + size % 2, b"WAVE") + body + struct.pack("<4sI", b"data", size)
    big = struct.pack("<4sIQQQI", b"ds64", 28, size + 72, size, frames, 0)
    return struct.pack("<4sI4s", b"RF64", 0xFFFFFFFF, b"WAVE") + big + body + struct.pack("<4sI", b"data", 0xFFFFFFFF)


def _place(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path as Spark names it, which is not quoted, and the path there."""
    scheme, colon, rest = path.partition(":/")
    if not colon or scheme == "file":
        return pa_fs.LocalFileSystem(), "/" + rest.lstrip("/") if colon else path
    return pa_fs.FileSystem.from_uri(f"{scheme}:/{quote(rest)}")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files: names and sizes alone, so files of any size do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.repartition(4 * spark.sparkContext.defaultParallelism, "path")


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """One row of header facts and the samples' place for each file; only headers are read."""

    def run(batches):
        for batch in batches:
            out = []
            for p, n in zip(batch.path, batch.length, strict=True):
                fs, inner = _place(p)
                with fs.open_input_file(inner) as f:

                    def read(at: int, size: int) -> bytes:
                        f.seek(at)
                        return f.read(size)

                    out.append({"path": p} | _parse(read, int(n)))
            yield pd.DataFrame(out, columns=["path", "sample_rate", "channels", "frames", "format", "container", "truncated", "body"])

    return _files(spark, path).mapInPandas(run, f"{PROBE}, body long")


def probe(spark: SparkSession, path: str) -> DataFrame:
    """One row of header facts for each file under path; samples aren't read. An empty folder gives no rows."""
    return _heads(spark, path).drop("body")


def _ranges(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, channel, block, offset, samples) of files (path, channels, frames, format, body): each block of FRAMES frames
    is read by its own range, so that the blocks of one long file are spread over tasks."""
    blocks = files.filter("frames > 0").withColumn("block", F.explode(F.expr(f"sequence(0L, (frames - 1) div {FRAMES})")))
    blocks = blocks.select("path", "channels", "frames", "format", "body", "block").repartition(4 * spark.sparkContext.defaultParallelism, "path", "block")

    def run(batches):
        for batch in batches:
            for r in batch.itertuples():
                width, start = FORMATS[r.format][1] * r.channels, r.block * FRAMES
                fs, inner = _place(r.path)
                with fs.open_input_file(inner) as f:
                    f.seek(r.body + start * width)
                    v = samples(f.read((min(r.frames, start + FRAMES) - start) * width), r.format).reshape(-1, r.channels)
                yield pd.DataFrame([{"path": r.path, "channel": i, "block": r.block, "offset": start, "samples": v[:, i]} for i in range(r.channels)])

    return blocks.mapInPandas(run, "path string, channel int, block int, offset long, samples array<long>")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, channel, block, offset, samples): blocks of FRAMES frames, one array for each channel. A last incomplete frame
    is left out; files of any size are read by ranges."""
    return _ranges(spark, _heads(spark, path))


def read_raw(spark: SparkSession, path: str, channels: int, fmt: str) -> DataFrame:
    """(path, channel, block, offset, samples) of headerless PCM; a last incomplete frame is left out."""
    width = FORMATS[fmt][1] * channels
    files = _files(spark, path).select("path", F.lit(channels).alias("channels"), F.expr(f"length div {width}").alias("frames"), F.lit(fmt).alias("format"), F.lit(0).alias("body"))
    return _ranges(spark, files)


def write(blocks: DataFrame, files: DataFrame, out: str, raw: bool = False) -> DataFrame:
    """Writes a file for each path of files (path, sample_rate, channels, frames, format) from blocks (path, channel, block,
    samples) to the folder out, which exists, under the path's last part; returns (path, bytes) of those written, once they
    are. ValueError where two have one name or samples lack. raw leaves the header out.

    A file is one stream, so one task writes it, block by block in order: the task holds one block, whatever the file's
    size. It appears under its name only when it is whole, so a task that is lost leaves no part of a file.
    """
    named = files.select("path", "sample_rate", "channels", "frames", "format", F.element_at(F.split("path", "/"), -1).alias("name"))
    if not named.groupBy("name").count().filter("count > 1").isEmpty():
        raise ValueError("two files have one name")
    rows = blocks.select("path", "channel", "block", "samples").join(named, "path").repartition("name").sortWithinPartitions("name", "block", "channel")
    return cut(rows.mapInPandas(lambda batches: _written(batches, out, raw), "path string, bytes long"))


def _written(batches: Iterator[pd.DataFrame], out: str, raw: bool) -> Iterator[pd.DataFrame]:
    attempt = TaskContext.get().taskAttemptId()
    name, file, held, count = None, None, [], 0

    def close() -> pd.DataFrame:
        if held or count != file.frames:
            raise ValueError(f"{name} lacks samples")
        size = stream.tell()
        if not raw and size % 2:
            stream.write(b"\0")
            size += 1
        stream.close()
        fs.move(temporary, f"{inner}/{name}")
        return pd.DataFrame([[f"{out}/{name}", size]], columns=["path", "bytes"])

    fs, inner = _place(out)
    for batch in batches:
        for r in batch.itertuples():
            if r.name != name:
                if name is not None:
                    yield close()
                name, file, count = r.name, r, 0
                temporary = f"{inner}/.{name}.{attempt}"
                stream = fs.open_output_stream(temporary)
                if not raw:
                    stream.write(header(r.sample_rate, r.channels, r.frames, r.format))
            held.append(np.asarray(r.samples, np.int64))
            if len(held) == r.channels:
                stream.write(pack(np.stack(held, 1).ravel(), r.format))
                count += len(held[0])
                held = []
    if name is not None:
        yield close()
