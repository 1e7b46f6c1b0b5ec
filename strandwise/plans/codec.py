"""Encoding a signal to coded frames and back: segments, references or harmonic models, wavelet, islands, buckets or bit
planes and range coding, each a DataFrame step. Frames are tables (Parquet is the store), and decoding restores every
sample."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CodecConfig
from ..functions.intcode import varint_bytes
from ..operators import entropy, features, harmonic, scan, signal, similarity, wavelet
from ..sources import wav

# A context is a series, band, kind of symbol and plane. Kinds: buckets of zero runs, buckets of values, bits of a plane.
CONTEXT = ["series", "band", "kind", "plane"]
RUNS, VALUES, PLANES = 0, 1, 2
TOP_PLANE = 24  # planes from here on share a context
PIECE = 1 << 18  # values after which a worker hands streams on
Progress = Callable[[float, str], None]


@dataclass(frozen=True)
class Frames:
    """segments (series, seg, offset, length), models (id, series, seg, ref, model), bands (series, seg, band, n, planes:
    non-zero values and their bit planes) and codes (context, slice, n, counts, payload, extra: the buckets' low bits)."""

    segments: DataFrame
    models: DataFrame
    bands: DataFrame
    codes: DataFrame

    def write(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.parquet(f"{path}/{f.name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Frames:
        return cls(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)))


def segment(samples: DataFrame, cfg: CodecConfig) -> DataFrame:
    lengths = samples.groupBy("series").agg(F.count("*").alias("n"))
    return features.segments(features.boundaries(samples, cfg), lengths, cfg)


def cut(samples: DataFrame, segments: DataFrame, grid: int) -> DataFrame:
    """(id, series, seg, samples): each segment's samples, by a join on the grid cells that a segment covers."""
    cells = segments.withColumn("cell", F.explode(F.expr(f"sequence(offset div {grid}, (offset + length - 1) div {grid})")))
    rows = samples.withColumn("cell", F.expr(f"idx div {grid}")).join(cells, ["series", "cell"]).filter("idx >= offset and idx < offset + length")
    items = rows.groupBy("series", "seg").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("a"))
    return items.select(F.concat_ws("/", "series", F.lpad("seg", 10, "0")).alias("id"), "series", "seg", F.transform("a", lambda x: x["v"]).alias("samples"))


def link(blocks: DataFrame, cfg: CodecConfig) -> DataFrame:
    """(tgt, ref, similarity) among blocks of one series and length."""
    vectors = scan.cut(similarity.block_features(blocks.select("series", F.col("id").alias("block"), "samples")).withColumnRenamed("block", "id"))
    signed = similarity.signatures(vectors, cfg.lsh_tables, cfg.lsh_bits, similarity.BINS).join(vectors.select("id", "series", "length"), "id")
    return similarity.references(signed, vectors, cfg.similarity, ["series", "length"])


def bit_lengths(z: np.ndarray) -> np.ndarray:
    """Bits of unsigned 64-bit values, 0 for 0."""
    out, rest = np.zeros(len(z), np.int64), z.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >= np.uint64(1) << np.uint64(step)
        out[high] += step
        rest[high] >>= np.uint64(step)
    return out + (z > 0)


def pack(z: np.ndarray, widths: np.ndarray) -> bytes:
    """The lowest widths[i] bits of each z[i] in order, highest first, filled up to a byte with zeros."""
    own = np.repeat(np.arange(len(z)), widths)
    place = np.repeat(np.cumsum(widths), widths) - np.arange(len(own)) - 1
    return np.packbits(((z[own] >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).tobytes()


def unpack(data: bytes, widths: np.ndarray) -> np.ndarray:
    total = int(widths.sum())
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=total).astype(np.uint64)
    place = np.repeat(np.cumsum(widths), widths) - np.arange(total) - 1
    out = np.zeros(len(widths), np.uint64)
    np.bitwise_or.at(out, np.repeat(np.arange(len(widths)), widths), bits << place.astype(np.uint64))
    return out


def streams(blocks: DataFrame, cfg: CodecConfig) -> DataFrame:
    """(series, seg, band, kind, p, n, planes, z) of blocks (series, seg, samples): for each band its zero runs, then its
    non-zero values in zigzag or each plane p of them, highest first, as z. n and planes are those of the values."""
    kind = f"series {blocks.schema['series'].dataType.simpleString()}, seg {blocks.schema['seg'].dataType.simpleString()}"
    shape = f"{kind}, band int, kind int, p int, n long, planes int, z array<long>"

    def rows(series, seg, bands):
        for band, c in enumerate(bands):
            at = np.flatnonzero(c)
            z = ((c[at] << 1) ^ (c[at] >> 63)).view(np.uint64)
            planes = int(bit_lengths(z).max(initial=0)) if cfg.bitplane else 0
            yield series, seg, band, RUNS, 0, len(at), planes, np.diff(at, prepend=-1, append=len(c)) - 1
            if cfg.bitplane:
                for p in range(planes):
                    yield series, seg, band, PLANES, p, len(at), planes, ((z >> np.uint64(planes - 1 - p)) & np.uint64(1)).view(np.int64)
            elif len(at):
                yield series, seg, band, VALUES, 0, len(at), 0, z.view(np.int64)

    def run(batches):
        # Streams take up to 64 times their samples' room, so they go on as soon as some are there, whatever the batch.
        frame = lambda out: pd.DataFrame(out, columns=["series", "seg", "band", "kind", "p", "n", "planes", "z"])
        for batch in batches:
            out, held = [], 0
            for block in zip(batch.series, batch.seg, batch.bands, strict=True):
                for row in rows(*block):
                    out.append(row)
                    held += len(row[-1])
                    if held >= PIECE:
                        yield frame(out)
                        out, held = [], 0
            yield frame(out)

    return blocks.select("series", "seg", wavelet.decompose_blocks(cfg.wavelet_levels)("samples").alias("bands")).mapInPandas(run, shape)


def placed(rows: DataFrame, slice_len: int) -> DataFrame:
    """rows (series, seg, band, kind, p, count) with plane, and a row for each slice of its context that a stream reaches
    into: slice, place there, and the part (skip, take) of the stream that lies in it."""
    rows = rows.withColumn("plane", F.least("p", F.lit(TOP_PLANE))).withColumn("order", F.col("seg").cast("long") * 64 + F.col("p"))
    rows = scan.running_sum(rows, CONTEXT, F.col("count"), "start", pos="order", size=1 << 18).drop("order").filter("count > 0")
    rows = rows.withColumn("slice", F.explode(F.expr(f"sequence(start div {slice_len}, (start + count - 1) div {slice_len})")))
    low, high = F.greatest("start", F.col("slice") * slice_len), F.least(F.col("start") + F.col("count"), (F.col("slice") + 1) * slice_len)
    rows = rows.withColumn("skip", (low - F.col("start")).cast("int")).withColumn("take", (high - low).cast("int"))
    return rows.withColumn("place", (low - F.col("slice") * slice_len).cast("int")).drop("start")


def pack_codes(rows: DataFrame, cfg: CodecConfig) -> DataFrame:
    """The codes of streams: each slice of a context is one group, so that no group grows with its context."""
    parts = placed(rows.withColumn("count", F.size("z").cast("long")), cfg.slice_len).select(*CONTEXT, "slice", "place", F.expr("slice(z, skip + 1, take)").alias("z"))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select(*CONTEXT, "slice").schema)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        z = np.concatenate(group.sort_values("place").z.to_list()).view(np.uint64)
        symbols = z.view(np.int64) if key[2] == PLANES else bit_lengths(z)
        counts = np.bincount(symbols).tolist()
        payload = entropy.rans_encode(symbols.tolist(), entropy.frequencies(counts))
        extra = b"" if key[2] == PLANES else pack(z, np.maximum(symbols - 1, 0))
        return pd.DataFrame([[*key, len(z), counts, payload, extra]], columns=[*CONTEXT, "slice", "n", "counts", "payload", "extra"])

    return parts.groupBy(*CONTEXT, "slice").applyInPandas(run, f"{names}, n long, counts array<long>, payload binary, extra binary")


def unpack_codes(codes: DataFrame, bands: DataFrame, cfg: CodecConfig) -> DataFrame:
    """(series, seg, band, kind, p, skip, z): the parts of all streams, whose lengths bands tells. ValueError where a slice is
    damaged."""
    each = [F.struct(F.lit(RUNS).alias("kind"), F.lit(0).alias("p"), (F.col("n") + 1).alias("count"))]
    if not cfg.bitplane:
        each.append(F.struct(F.lit(VALUES).alias("kind"), F.lit(0).alias("p"), F.col("n").alias("count")))
    rows = bands.select("series", "seg", "band", F.explode(F.array(*each)).alias("e")).select("series", "seg", "band", "e.*")
    if cfg.bitplane:
        planes = bands.filter("planes > 0").select("series", "seg", "band", F.lit(PLANES).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("planes") - 1)).alias("p"), F.col("n").alias("count"))
        rows = rows.union(planes)
    parts = placed(rows, cfg.slice_len)
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select("series", "seg", "band", "kind", "p", "skip").schema)

    def run(key: tuple, mine: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("place")
        if len(held) != 1 or int(held.n.iloc[0]) != int(mine["take"].sum()):
            raise ValueError("codes don't fit the bands")
        code = held.iloc[0]
        symbols = np.array(entropy.rans_decode(code.payload, entropy.frequencies([int(c) for c in code.counts]), int(code.n)), np.int64)
        if key[2] == PLANES:
            z = symbols
        else:
            z = unpack(code.extra, np.maximum(symbols - 1, 0)) | np.where(symbols > 0, np.uint64(1) << np.maximum(symbols - 1, 0).astype(np.uint64), np.uint64(0))
            z = z.view(np.int64)
        mine = mine.assign(z=np.split(z, np.cumsum(mine["take"].to_numpy())[:-1]))
        return mine[["series", "seg", "band", "kind", "p", "skip", "z"]]

    keys = [*CONTEXT, "slice"]
    return parts.groupBy(*keys).cogroup(codes.groupBy(*keys)).applyInPandas(run, f"{names}, z array<long>")


def assemble(parts: DataFrame) -> DataFrame:
    """(series, seg, samples): a block's streams put together, one row a block: planes to values, islands to bands, bands to
    samples."""
    items = parts.groupBy("series", "seg").agg(F.sort_array(F.collect_list(F.struct("band", "kind", "p", "skip", "z"))).alias("a"))

    @F.pandas_udf("array<array<long>>")
    def bands(col: pd.Series) -> pd.Series:
        out = []
        for parts_ in col:
            found: dict[tuple[int, int, int], list[np.ndarray]] = {}
            for x in parts_:
                found.setdefault((x["band"], x["kind"], x["p"]), []).append(np.asarray(x["z"], np.int64))
            own = []
            for band in range(max(k[0] for k in found) + 1):
                run = np.concatenate(found[band, RUNS, 0])
                z = np.zeros(len(run) - 1, np.uint64)
                if (band, VALUES, 0) in found:
                    z = np.concatenate(found[band, VALUES, 0]).view(np.uint64)
                for _, p in sorted((p, p) for b, k, p in found if b == band and k == PLANES):
                    z = (z << np.uint64(1)) | np.concatenate(found[band, PLANES, p]).view(np.uint64)
                c = np.zeros(int(run.sum()) + len(z), np.int64)
                c[np.cumsum(run[:-1] + 1) - 1] = ((z >> np.uint64(1)) ^ (np.uint64(0) - (z & np.uint64(1)))).view(np.int64)
                own.append(c)
            out.append(own)
        return pd.Series(out)

    # Else Spark filters by the samples before they are exploded, and runs both functions once more for that.
    return items.select("series", "seg", wavelet.compose_blocks().asNondeterministic()(bands.asNondeterministic()("a")).alias("samples"))


def encode(samples: DataFrame, cfg: CodecConfig, rate: int = 44_100, progress: Progress | None = None) -> Frames:
    """samples is (series, idx, v), idx from 0 without gaps, any 64-bit v. An empty signal gives empty frames; a series of
    any length is cut into blocks of cfg.max_block at most. progress, if given, is called on the driver with a share
    done and a phase's name, as each phase is planned or written."""
    tell = progress or (lambda share, phase: None)
    tell(0.0, "segmentation")
    samples = scan.cut(samples)
    segments = scan.cut(segment(samples, cfg))
    blocks = scan.cut(cut(samples, segments, cfg.min_block))
    tell(0.3, "block-graph")
    if cfg.graph:
        edges = link(blocks, cfg)
        blocks = blocks.select("id", "series", "seg").join(similarity.differences(blocks.select("id", "samples"), edges), "id")
    else:
        blocks = blocks.withColumn("ref", F.lit(None).cast("string"))
    if cfg.harmonic:
        alone = harmonic.residual(harmonic.analyse(blocks.filter("ref is null"), cfg.max_harmonics, rate))
        linked = blocks.filter("ref is not null").withColumn("model", F.lit(None).cast(alone.schema["model"].dataType))
        blocks = alone.unionByName(linked)
    else:
        blocks = blocks.withColumn("model", F.lit(None).cast("struct<w float, amplitudes array<float>, phases array<float>>"))
    blocks = scan.cut(blocks)
    tell(0.6, "transform")
    rows = scan.cut(streams(blocks, cfg))
    tell(0.75, "entropy-coding")
    bands = rows.filter(F.col("kind") == RUNS).select("series", "seg", "band", "n", "planes")
    codes = scan.cut(pack_codes(rows, cfg))
    tell(1.0, "done")
    return Frames(segments, blocks.select("id", "series", "seg", "ref", "model"), bands, codes)


def decode(frames: Frames, cfg: CodecConfig) -> DataFrame:
    """(series, idx, v)."""
    blocks = assemble(unpack_codes(frames.codes, frames.bands, cfg)).join(frames.models, ["series", "seg"])
    blocks = harmonic.reconstruct(blocks) if cfg.harmonic else blocks
    whole = similarity.restore(scan.cut(blocks.select("id", "ref", "samples"))) if cfg.graph else blocks.select("id", "samples")
    placed_ = whole.join(frames.models.select("id", "series", "seg"), "id").join(frames.segments, ["series", "seg"])
    return signal.scatter(placed_.select("series", "offset", "samples"))


def sizes(frames: Frames) -> DataFrame:
    """(series, payload_bytes, extra_bytes, table_bytes, meta_bytes, model_bytes, total_bytes): what a series takes in all:
    range-coded symbols, low bits, counts of the tables, lengths of segments and bands with references, and models."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    varint = lambda c: varint_bytes(F.col(c).cast("long"))
    table = F.aggregate("counts", F.lit(0), lambda a, x: a + varint_bytes(x))
    coded = frames.codes.groupBy("series").agg(whole(F.length("payload")).alias("payload_bytes"), whole(F.length("extra")).alias("extra_bytes"), whole(table + 4 + varint("n")).alias("table_bytes"))
    lengths = frames.segments.groupBy("series").agg(whole(varint("length")).alias("a"))
    counts = frames.bands.groupBy("series").agg(whole(varint("n") + F.lit(1)).alias("b"))
    model = F.when(F.col("model.amplitudes").isNull(), F.lit(1)).otherwise(4 + 8 * F.size("model.amplitudes"))
    models = frames.models.groupBy("series").agg(whole(model).alias("model_bytes"), whole(F.when(F.col("ref").isNotNull(), F.lit(4)).otherwise(F.lit(0))).alias("c"))
    rows = lengths.join(coded, "series", "left").join(counts, "series", "left").join(models, "series", "left").na.fill(0)
    rows = rows.withColumn("meta_bytes", F.col("a") + F.col("b") + F.col("c"))
    parts = ["payload_bytes", "extra_bytes", "table_bytes", "meta_bytes", "model_bytes"]
    return rows.select("series", *parts, sum((F.col(c) for c in parts), F.lit(0).cast("long")).alias("total_bytes"))


def encode_files(spark: SparkSession, path: str, out: str, cfg: CodecConfig, progress: Progress | None = None) -> None:
    """Encodes the WAV files under path to frames under the folder out. A channel is a series. Files of several sample rates
    must be encoded apart: ValueError; so are unsupported formats and damaged headers."""
    files = scan.cut(wav.probe(spark, path))
    rates = [r[0] for r in files.select("sample_rate").distinct().limit(2).collect()]
    if len(rates) > 1:
        raise ValueError("files of one sample rate at a time")
    name = F.concat_ws("#", "path", F.col("channel").cast("string"))
    rows = wav.read(spark, path).select(name.alias("series"), "offset", "samples")
    encode(signal.scatter(rows), cfg, rates[0] if rates else 44_100, progress).write(out)
    files.write.parquet(f"{out}/files")


def decode_files(spark: SparkSession, path: str, out: str, cfg: CodecConfig) -> DataFrame:
    """Writes the WAV files of the frames under path to the folder out, which exists, and returns (path, bytes)."""
    files = spark.read.parquet(f"{path}/files").filter("frames > 0")
    parts = F.split("series", "#")
    rows = decode(Frames.read(spark, path), cfg).withColumn("file", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "#")).withColumn("channel", F.element_at(parts, -1).cast("int"))
    items = rows.groupBy("file", "channel", F.expr(f"int(idx div {wav.FRAMES})").alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("a"))
    blocks = items.select(F.col("file").alias("path"), "channel", "block", F.transform("a", lambda x: x["v"]).alias("samples"))
    return wav.write(scan.cut(blocks), files, out)
