"""Operator 8: media columns over a chunk store with content-defined chunks.

A payload is cut where a rolling gear hash of its last 32 bytes has its top bits zero. Chunks whose digest occurs
more than once go to a pool, where a Spark aggregation keeps one of each digest; all others stay in their document's
manifest. A manifest lists its chunks in order; reading joins the pooled ones back by digest, checks every digest and
puts the media together. Which digests repeat is told by a bit table, which grows with their number up to a bound: a
false hit only sends a single chunk to the pool. The stored form is a WAV file of 8-bit mono samples.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, cut, utf8

UNIT = 576  # the payload is a multiple of so many bytes
LEAST, MEAN_BITS, MOST = 256, 10, 4096  # bytes of a chunk: least, mean as a power of two over the least, most
ROOM, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28  # bits of the table for each digest that repeats, and its bounds
RATE = 8000
_GEAR = np.random.default_rng(23).integers(0, 2**32, 256, dtype=np.uint32)


def payloads(column: pa.Array) -> list[bytes]:
    data, at = utf8(column)
    raw = data.tobytes()
    return [(b := raw[i:j]) + b"\xff" * (-len(b) % UNIT if b else UNIT) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def chunks(items: list[bytes]) -> list[list[bytes]]:
    """Each payload's chunks in order. A cut lies LEAST bytes into a chunk at least, so no hash sees another payload."""
    data = np.frombuffer(b"".join(items), np.uint8)
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        later = h[width:] + (h[:-width] << np.uint32(width))
        h = np.concatenate((h[:width], later))
    marks = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    ends = np.cumsum([len(x) for x in items])
    lows = np.searchsorted(marks, ends - [len(x) for x in items])
    highs = np.searchsorted(marks, ends)
    out = []
    for x, end, a, b in zip(items, ends.tolist(), lows.tolist(), highs.tolist(), strict=True):
        start, base, own = 0, end - len(x), []
        for m in (marks[a:b] - base).tolist():
            while m - start > MOST:
                own.append(x[start : start + MOST])
                start += MOST
            if m - start >= LEAST:
                own.append(x[start:m])
                start = m
        while start < len(x):
            own.append(x[start : start + MOST])
            start += MOST
        out.append(own)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _key(d: bytes) -> int:
    return int.from_bytes(d[:8], "big", signed=True)


def header(n: int) -> bytes:
    """Of a WAV file with n 8-bit mono samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def _keyed(batches):
    for batch in batches:
        for part in blocks(batch, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([_key(digest(c)) for own in chunks(payloads(part.column("text"))) for c in own], pa.int64())], ["key"])


def store(docs: DataFrame, path: str) -> None:
    """Writes docs (doc_id, text) as path/manifests and path/pool. Null texts count as empty; an empty text is UNIT
    bytes 255; very long texts are cut a block at a time; repeated rows get a manifest each over the same chunks; an empty
    table gives empty tables. Other columns, whatever their names, are ignored."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    often = cut(texts.select("text").mapInArrow(_keyed, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    size = min(MOST_BITS, max(LEAST_BITS, ROOM * often.count()))
    bits = often.select(F.pmod("key", F.lit(size)).alias("bit"))
    words = bits.selectExpr("int(bit div 64) as w", "shiftleft(1L, int(bit % 64)) as b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(size // 64 + 1, np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast(table)

    def repeats(d: bytes) -> int:
        at = _key(d) % size
        return int(held.value[at >> 6]) >> (at & 63) & 1

    def manifests(batches):
        kind = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))
        for batch in batches:
            for part in blocks(batch, "text"):
                sizes = np.diff(utf8(part.column("text"))[1])
                items = payloads(part.column("text"))
                lists = [[{"digest": (d := digest(c)), "data": None if repeats(d) else c} for c in own] for own in chunks(items)]
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array(sizes), pa.array([header(len(x)) for x in items], pa.binary()), pa.array(lists, kind)], ["rid", "doc_id", "n_bytes", "header", "chunks"])

    def pooled(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                found = {d: c for own in chunks(payloads(part.column("text"))) for c in own if repeats(d := digest(c))}
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.binary())], ["digest", "data"])

    rows = texts.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(manifests, "rid long, doc_id long, n_bytes long, header binary, chunks array<struct<digest binary, data binary>>")
    rows.write.option("compression", "zstd").parquet(f"{path}/manifests")
    pool = texts.select("text").mapInArrow(pooled, "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data"))
    pool.write.option("compression", "zstd").parquet(f"{path}/pool")
    held.destroy()


def feature(samples: np.ndarray) -> str:
    """Whole-number features of 8-bit samples, 128 being silence: count, mean and power by the thousand, crossings of
    silence, and the number of distinct levels."""
    x = samples.astype(np.int64) - 128
    n = max(1, len(x))
    return f"n={len(x)};mean={int(x.sum()) * 1000 // n};power={int((x * x).sum()) * 1000 // n};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};levels={int((np.bincount(samples, minlength=256) > 0).sum())}"


def load(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_bytes, media, feature) of each manifest, read back from the store. A chunk that is missing or doesn't
    have its digest raises ValueError."""
    rows = spark.read.parquet(f"{path}/manifests")
    lacks = F.exists("chunks", lambda c: c["data"].isNull())
    refs = rows.filter(lacks).select("rid", F.posexplode("chunks").alias("pos", "c")).filter("c.data is null").select("rid", "pos", "c.digest")
    found = refs.join(spark.read.parquet(f"{path}/pool"), "digest").groupBy("rid").agg(F.collect_list(F.struct("pos", "data")).alias("more"))
    split = rows.filter(lacks).join(found, "rid", "left")
    whole = rows.filter(~lacks).withColumn("more", F.lit(None).cast("array<struct<pos int, data binary>>"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                media, features = [], []
                for head, own, more in zip(*(part.column(c).to_pylist() for c in ("header", "chunks", "more")), strict=True):
                    late = {x["pos"]: x["data"] for x in more or ()}
                    body = []
                    for i, c in enumerate(own):
                        data = late.get(i) if c["data"] is None else c["data"]
                        if data is None or digest(data) != c["digest"]:
                            raise ValueError(f"chunk {c['digest'].hex()} is missing or damaged")
                        body.append(data)
                    media.append(head + b"".join(body))
                    features.append(feature(np.frombuffer(media[-1], np.uint8)[len(head) :]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(media, pa.binary()), pa.array(features)], ["doc_id", "n_bytes", "media", "feature"])

    cols = ["doc_id", "n_bytes", "header", "chunks", "more"]
    return whole.select(*cols).union(split.select(*cols)).mapInArrow(run, "doc_id long, n_bytes long, media binary, feature string")
