"""Similar blocks: features, signed random projections, bucket joins, the best earlier reference, and what it saves."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import dot
from .scan import cut

BINS = 32


def block_features(blocks: DataFrame, bins: int = BINS) -> DataFrame:
    """(series, block, length, vec) of blocks (series, block, samples): unit vector of the root mean squares of bins equal
    parts (of one sample at least); what is over at the end is left out, what lacks is 0. An empty or null block has a
    vector of zeros."""
    part = F.greatest(F.lit(1), F.floor(F.size("samples") / bins)).cast("int")
    power = lambda b: F.aggregate(F.slice("samples", b * part + 1, part), F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    level = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.when(b * part < F.size("samples"), F.sqrt(power(b) / F.least(part, F.size("samples") - b * part))).otherwise(F.lit(0.0)))
    # Levels and their norm are columns, so that each is computed once a block and not once a component.
    rows = blocks.select("series", "block", F.size("samples").alias("length"), level.alias("level")).withColumn("norm", F.sqrt(dot("level", "level")))
    unit = F.when(F.col("norm") > 1e-9, F.transform("level", lambda x: x / F.col("norm"))).otherwise(F.col("level"))
    return rows.select("series", "block", "length", unit.alias("vec"))


def planes(tables: int, bits: int, dims: int) -> np.ndarray:
    """[table, bit, component] of the hyperplanes, whole numbers from -1000 to 1000: the same on every engine."""
    t, b, d = np.ogrid[:tables, :bits, :dims]
    mixed = (t * 7919 + b * 104729 + d * 1299709 + 12345) % 1000003
    return (mixed * mixed) % 2001 - 1000


def signatures(vectors: DataFrame, tables: int, bits: int, dims: int, scale: float = 1e4) -> DataFrame:
    """(id, tbl, hash) of vectors (id, vec): a bit for each hyperplane, set where the dot product isn't negative. Components
    are taken as whole multiples of 1 / scale, so that a sum's sign can't depend on its order. Vectors that are null, hold
    a null or are not of dims components have no rows."""
    side = planes(tables, bits, dims).reshape(tables * bits, dims)

    @F.pandas_udf("array<long>")
    def hashed(col: pd.Series) -> pd.Series:
        if not len(col):
            return pd.Series([], dtype=object)
        signs = (np.stack(col.to_list()) @ side.T >= 0).reshape(len(col), tables, bits)
        return pd.Series(list((signs << np.arange(bits)).sum(2)))

    whole = F.transform("vec", lambda x: F.round(x.cast("double") * scale).cast("long"))
    # Else Spark filters by the result before it is exploded, and runs the function once more for that.
    once = hashed.asNondeterministic()
    rows = vectors.filter((F.size("vec") == dims) & ~F.exists("vec", lambda x: x.isNull())).select("id", once(whole).alias("h"))
    return rows.select("id", F.posexplode("h").alias("tbl", "hash"))


def _dealt(signed: DataFrame, keys: list[str], block: int) -> DataFrame:
    """signed with part and pair (x, y): each bucket's members are dealt into parts of about block, and a member goes to each
    pair of parts that its own is in, so that a group of keys and pair is bounded whatever the bucket's size. A bucket of one
    has no rows."""
    parts = signed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys, F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = signed.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("x"), F.greatest("part", j).alias("y")))
    return dealt.withColumn("pair", F.explode(met)).drop("parts")


def candidates(signed: DataFrame, by: list[str] | None = None, vectors: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """(by, ref, tgt, first_table): pairs ref < tgt that share a bucket of some table, and of the columns by, once each; with
    vectors (id, vec) also their cosine as similarity, 0 where either squared norm is 1e-12 or less.

    A pair is returned by the first bucket that both are in, which each member's own list of buckets tells, so pairs are never
    gathered to be counted once; vectors travel with members, not with pairs."""
    by = by or []
    keys = [*by, "tbl", "hash"]
    # Nothing else is kept of repeated rows.
    own = signed.select(*by, "id", F.struct(F.col("tbl").cast("long").alias("tbl"), F.col("hash").cast("long").alias("hash")).alias("b"))
    own = own.filter("b.tbl is not null and b.hash is not null").groupBy(*by, "id").agg(F.collect_set("b").alias("buckets"))
    rows = own.select(*by, "id", F.explode("buckets").alias("b"), F.transform("buckets", lambda x: x["tbl"]).alias("tbls"), F.transform("buckets", lambda x: x["hash"]).alias("hashes"))
    dealt = _dealt(rows.select(*by, "id", F.col("b.tbl").alias("tbl"), F.col("b.hash").alias("hash"), "tbls", "hashes"), keys, block)
    scored = vectors is not None
    if scored:
        dealt = dealt.join(vectors.select("id", "vec"), "id")
    # A row is a group, so that a batch holds many small ones.
    groups = dealt.groupBy(*keys, "pair").agg(F.collect_list(F.struct("id", "part", "tbls", "hashes", *(["vec"] if scored else []))).alias("members"))
    kinds = {c: signed.schema[c].dataType.simpleString() for c in by} | {"ref": signed.schema["id"].dataType.simpleString()}
    shape = kinds | {"tgt": kinds["ref"], "first_table": "long"} | ({"similarity": "double"} if scored else {})

    def run(batches):
        for batch in batches:
            lists, at = batch.column("members"), {n: i for i, n in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                group, key = lists.slice(row, 1).flatten(), batch.slice(row, 1)
                bucket, pair = (key.column(at["tbl"])[0].as_py(), key.column(at["hash"])[0].as_py()), key.column(at["pair"])[0].as_py()
                ref, tgt, sim = _meeting(dict(zip((f.name for f in group.type), group.flatten(), strict=True)), bucket, pair["x"] == pair["y"], scored)
                ids = group.field("id")
                same = [key.column(at[c]).take(pa.array(np.zeros(len(ref), np.int64))) for c in by]
                own = [*same, ids.take(pa.array(ref)), ids.take(pa.array(tgt)), pa.array(np.full(len(ref), bucket[0]))]
                if len(ref):
                    yield pa.RecordBatch.from_arrays([*own, *([pa.array(sim)] if scored else [])], list(shape))

    found = groups.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in shape.items()))
    return found.withColumn("first_table", F.col("first_table").cast(signed.schema["tbl"].dataType))


def _meeting(group: dict[str, pa.Array], bucket: tuple[int, int], same: bool, scored: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (ref, tgt) of the pairs of a group (id, part, tbls, hashes, vec) that share no earlier bucket than this, and their
    cosines: those within one part if same, else those of one part with the other."""
    part = group["part"].to_numpy()
    order = np.unique(group["id"].to_numpy(zero_copy_only=False), return_inverse=True)[1].reshape(-1)
    a, b = np.flatnonzero(part == part.min()), np.flatnonzero(part > part.min())
    met = np.ones((len(a), len(b)), bool)  # members of different parts have different ids
    if same:
        b, met = a, order[a][:, None] < order[a][None, :]
    # Earlier buckets, numbered in the group and put in a member's own slots.
    held = np.stack([group["tbls"].flatten().to_numpy(), group["hashes"].flatten().to_numpy()], 1)
    member = np.repeat(np.arange(len(part)), np.diff(group["tbls"].offsets.to_numpy()))
    early = (held[:, 0] < bucket[0]) | ((held[:, 0] == bucket[0]) & (held[:, 1] < bucket[1]))
    member, held = member[early], held[early]
    tables, tbl = np.unique(held[:, 0], return_inverse=True)
    number = np.unique(held[:, 1], return_inverse=True)[1].reshape(-1) + len(held) * tbl
    count = np.bincount(member, minlength=len(part))
    # A slot for each table, unless repeated ids have several buckets of one.
    plain = len(np.unique(member * len(tables) + tbl)) == len(member)
    place = tbl if plain else np.arange(len(member)) - np.repeat(np.cumsum(count) - count, count)
    slots = np.full((len(part), int(place.max(initial=-1)) + 1), -1, np.int64)
    slots[member, place] = number
    for i in range(slots.shape[1]):
        x = np.where(slots[a, i] < 0, -2, slots[a, i])[:, None]
        for j in (i,) if plain else range(slots.shape[1]):
            met &= x != slots[b, j][None, :]
    u, v = np.nonzero(met)
    u, v, sim = a[u], b[v], np.zeros(0)
    if scored and len(u):
        x = group["vec"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
        square = (x * x).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = (x[a] @ x[b].T)[met] / np.sqrt(square[u] * square[v])
        sim = np.where((square[u] <= 1e-12) | (square[v] <= 1e-12), 0.0, sim)
    later = order[u] > order[v]
    return np.where(later, v, u), np.where(later, u, v), sim


def references(signed: DataFrame, vectors: DataFrame, least: float, by: list[str] | None = None, block: int = 512) -> DataFrame:
    """(tgt, ref, similarity): each target's most similar earlier vector among those that share a bucket with it (and the
    columns by), if the cosine, rounded to 9 digits, is least or more; ties go to the earlier table, then the smaller ref.

    signed is (id, tbl, hash, by...), vectors (id, vec). A bucket's members are dealt into blocks; each pair of blocks is one
    group, which returns the best of each of its targets, so that neither a bucket nor its pairs are ever held whole.
    """
    keys = [*(by or []), "tbl", "hash"]
    dealt = _dealt(signed, keys, block).join(vectors.select("id", "vec"), "id")

    def best(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x, ids = np.stack(group.vec.to_list()).astype(np.float64), group.id.to_numpy()
        square = (x * x).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.where((square[:, None] > 1e-12) & (square[None, :] > 1e-12), (x @ x.T) / np.sqrt(square[:, None] * square[None, :]), 0.0)
        sim = np.where(ids[None, :] < ids[:, None], np.round(sim, 9), -np.inf)
        at = sim.argmax(1)
        top = sim[np.arange(len(ids)), at]
        good = np.flatnonzero(top >= least)
        return pd.DataFrame({"tgt": ids[good], "ref": ids[at[good]], "similarity": top[good], "tbl": int(group.tbl.iloc[0])})

    kind = signed.schema["id"].dataType.simpleString()
    found = dealt.select(*keys, "pair", "id", "vec").groupBy(*keys, "pair").applyInPandas(best, f"tgt {kind}, ref {kind}, similarity double, tbl int")
    rank = F.row_number().over(W.partitionBy("tgt").orderBy(F.desc("similarity"), "tbl", "ref"))
    return found.withColumn("r", rank).filter("r = 1").select("tgt", "ref", "similarity")


def differences(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """blocks (id, samples) with ref and samples less those of the reference, where there is one."""
    refs = edges.select(F.col("tgt").alias("id"), "ref")
    other = blocks.select(F.col("id").alias("ref"), F.col("samples").alias("base"))
    out = blocks.join(refs, "id", "left").join(other, "ref", "left")
    return out.select("id", "ref", F.when(F.col("base").isNull(), F.col("samples")).otherwise(F.zip_with("samples", "base", lambda x, y: x - y)).alias("samples"))


def restore(deltas: DataFrame, rounds: int = 32) -> DataFrame:
    """(id, samples) of blocks stored as differences: chains are halved each round by adding a block's reference and
    pointing to that one's own, so a chain of n takes about log2(n) rounds; differences add up in any order."""
    rows = deltas
    for _ in range(rounds):
        if rows.filter("ref is not null").isEmpty():
            return rows.select("id", "samples")
        up = rows.select(F.col("id").alias("ref"), F.col("ref").alias("up"), F.col("samples").alias("base"))
        joined = rows.join(up, "ref", "left")
        rows = cut(joined.select("id", F.col("up").alias("ref"), F.when(F.col("base").isNull(), F.col("samples")).otherwise(F.zip_with("samples", "base", lambda x, y: x + y)).alias("samples")))
    raise ValueError("a chain of references doesn't end")
