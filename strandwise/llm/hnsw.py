"""Operator 3: nearest neighbours by a hierarchical navigable small-world graph per shard.

Equal vectors form one class, so that a very common vector is one node; classes are dealt into shards by hash. A shard's
graph is built level by level from the top: nodes join in batches, each found its neighbours by a beam search over what
is there, chosen for diversity, with links back. The graph is stored as flat neighbour arrays, one row a shard. Queries,
in blocks, search every shard; shard results are merged and scored by exact cosine in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_path

SHARD = 8192  # classes of a shard
BLOCK = 16_384  # query classes of a block


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The best width nodes found from each query's entry nodes, best first: (ids or -1, similarities)."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x)), bool)
    entry = entry[:, :width]
    sims = np.where(entry >= 0, np.einsum("qed,qd->qe", x[entry], q), -np.inf)
    seen[rows, entry] |= entry >= 0
    ids = np.full((n, width), -1)
    best = np.full((n, width), -np.inf, np.float32)
    done = np.zeros((n, width), bool)
    ids[:, : entry.shape[1]], best[:, : entry.shape[1]] = entry, sims
    for _ in range(8 * width):
        open_ = np.where(done | (ids < 0), -np.inf, best)
        take = np.argpartition(-open_, min(2, width - 1), 1)[:, :2] if width > 2 else np.argsort(-open_, 1)[:, :1]
        live = np.take_along_axis(open_, take, 1) > -np.inf
        act = np.flatnonzero(live.any(1))
        if not len(act):
            break
        take, live = take[act], live[act]
        done[act[:, None], take] = True
        near = links[np.where(live, ids[act[:, None], take], 0)]
        near = np.where(live[:, :, None], near, -1).reshape(len(act), -1)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[act[:, None], near]] = -1
        near = -np.sort(-near, 1)[:, : max(1, int((near >= 0).sum(1).max()))]
        a, b = np.nonzero(near >= 0)
        seen[act[a], near[a, b]] = True
        s = np.full(near.shape, -np.inf, np.float32)
        s[a, b] = np.einsum("ed,ed->e", x[near[a, b]], q[act[a]])
        all_ids, all_s = np.concatenate((ids[act], near), 1), np.concatenate((best[act], s), 1)
        all_done = np.concatenate((done[act], np.zeros(near.shape, bool)), 1)
        top = np.argpartition(-all_s, width - 1, 1)[:, :width]
        ids[act], best[act], done[act] = (np.take_along_axis(y, top, 1) for y in (all_ids, all_s, all_done))
    order = np.argsort(-best, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)


def _choose(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """m of each row's candidates (best first, -1 for none): those nearer to the row's node than to any chosen before,
    then the nearest of the rest."""
    near = x[ids]
    pair = near @ near.transpose(0, 2, 1)
    n, width = ids.shape
    blocked, taken = np.zeros((n, width), bool), np.zeros((n, width), bool)
    for j in range(width):
        ok = (ids[:, j] >= 0) & ~blocked[:, j] & (taken.sum(1) < m)
        taken[:, j] = ok
        blocked |= ok[:, None] & (pair[:, j] > sims)
    rank = np.where(ids < 0, 3 * width, np.where(taken, 0, width) + np.arange(width))
    order = np.argsort(rank, 1, kind="stable")[:, :m]
    return np.take_along_axis(ids, order, 1)


def build(x: np.ndarray, m: int = 16, width: int = 64, batch: int = 256, seed: int = 29) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Flat neighbour arrays over unit vectors: (order, levels), where order lists all nodes, each level is
    (number of nodes, links) over a prefix of that order, top level first; -1 fills free places."""
    n = len(x)
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(n)) / math.log(m)).astype(int)
    order = np.lexsort((rng.permutation(n), -level))
    x, level = x[order].astype(np.float32), level[order]
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for top in range(int(level[0]), -1, -1):
        size, most = int((level >= top).sum()), 2 * m if top == 0 else m
        links, at = np.full((size, most), -1), 1
        while at < size:
            new = np.arange(at, min(size, at + min(batch, max(1, at // 2))))
            entry = descend(x, levels, x[new])
            entry = np.where(entry < at, entry, 0)
            ids, sims = _beam(x[:at], links[:at], x[new], entry, min(width, at))
            if len(new) > 1 and at < 4 * batch:  # those that join together are far from each other else
                peers = x[new] @ x[new].T
                np.fill_diagonal(peers, -np.inf)
                peers[np.triu_indices(len(new))] = -np.inf
                ids = np.concatenate((ids, np.where(peers > -np.inf, new[None, :], -1)), 1)
                sims = np.concatenate((sims, peers), 1)
                best = np.argsort(-sims, 1, kind="stable")[:, :width]
                ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            mine = _choose(x, ids, sims, m)
            links[new, : mine.shape[1]] = mine
            back = np.stack((mine.ravel(), np.repeat(new, mine.shape[1])), 1)
            back = back[back[:, 0] >= 0]
            back = back[np.argsort(back[:, 0], kind="stable")]
            nodes, first, counts = np.unique(back[:, 0], return_index=True, return_counts=True)
            for s in range(0, len(nodes), 512):
                own, c = nodes[s : s + 512], counts[s : s + 512]
                extra = np.full((len(own), int(c.max())), -1)
                rows = np.repeat(np.arange(len(own)), c)
                extra[rows, np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)] = back[first[s] : first[s] + c.sum(), 1]
                every = np.concatenate((links[own], extra), 1)
                sim = np.where(every >= 0, np.einsum("nkd,nd->nk", x[every], x[own]), -np.inf)
                rank = np.argsort(-sim, 1, kind="stable")[:, : most + 32]
                every, sim = np.take_along_axis(every, rank, 1), np.take_along_axis(sim, rank, 1)
                full = (every >= 0).sum(1) > most
                kept = every[:, :most]
                if full.any():
                    kept[full] = _choose(x, every[full], sim[full], most)
                links[own, : kept.shape[1]] = kept
            at = int(new[-1]) + 1
        levels.append((np.array(size), links.astype(np.int32)))
    return order, levels


def descend(x: np.ndarray, levels: list, q: np.ndarray, width: int = 4) -> np.ndarray:
    entry = np.zeros((len(q), 1), int)
    for size, links in levels:
        entry = _beam(x[: int(size)], links, q, entry, min(width, int(size)))[0]
    return entry


def search(x: np.ndarray, levels: list, q: np.ndarray, k: int, width: int) -> np.ndarray:
    """The k best nodes found for each query, best first, -1 for none; x in the graph's order."""
    out = []
    for s in range(0, len(q), 512):
        part = q[s : s + 512].astype(np.float32)
        entry = descend(x, levels[:-1], part)
        out.append(_beam(x, levels[-1][1], part, entry, min(max(width, k), len(x)))[0][:, :k])
    return np.concatenate(out)


def direction(v: Column) -> Column:
    """v over its largest component: the same doubles for vectors that are exact multiples of each other. Zeros lose their
    sign; what can't be divided is null."""
    top = F.array_max(F.transform(v, lambda e: F.abs(e)))
    return F.transform(v, lambda e: F.try_divide(e, top) + F.lit(0.0))


def classes(vectors: DataFrame, keep: int) -> DataFrame:
    """(cls, dim, v, ids) of the valid vectors of one direction in vectors (vec_id, embedding): the class's keep smallest
    distinct ids. Longer lists can't matter: a query takes fewer from one class, as all its cosines are equal."""
    v = F.col("embedding").cast("array<double>")
    good = F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False))
    rows = vectors.filter(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("long"), v.alias("v"))
    rows = rows.withColumn("v", direction(F.col("v"))).withColumn("cls", F.concat_ws("-", F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))
    first = W.partitionBy("cls").orderBy("vec_id")
    rows = rows.dropDuplicates(["cls", "vec_id"]).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= keep)
    return rows.groupBy("cls").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("cls", F.size("v").alias("dim"), "v", "ids")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, width: int = 128, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries (vec_id, embedding) the k rows of vectors of largest
    cosine found, rows of the query's own id left out, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part on either side; vectors of
    different lengths aren't compared. Fewer than k candidates give fewer rows. Rows repeated with one id and direction
    count once, on either side; an id with several directions is a candidate, and a query, with each. Components of any
    finite size are scaled first, so no norm overflows. Extra columns are ignored, clashing ones too; an empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    classes(vectors, k + 1).write.parquet(path := shared_path(spark, "classes"))
    known = spark.read.parquet(path)
    counts = known.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = known.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("cls"), F.col("shards")).cast("int"))

    def index(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cls")
        x = np.stack(group.v.to_list()).astype(np.float64)
        order, levels = build(x / np.linalg.norm(x, axis=1, keepdims=True))
        sizes = np.array([int(s) for s, _ in levels] + [links.shape[1] for _, links in levels], np.int32)
        row = {"dim": group.dim.iloc[0], "shard": group.shard.iloc[0], "names": group.cls.to_numpy()[order].tolist(), "vectors": x[order].tobytes()}
        return pd.DataFrame([row | {"sizes": sizes.tobytes(), "links": b"".join(links.tobytes() for _, links in levels)}])

    shape = "dim int, shard int, names array<string>, vectors binary, sizes binary, links binary"
    # So many parts, and named ones, that Spark doesn't put small shards together in one task.
    parts = 4 * (counts.agg(F.sum("shards")).first()[0] or 1)
    dealt.select("dim", "shard", "cls", "v").repartition(parts, "dim", "shard").groupBy("dim", "shard").applyInPandas(index, shape).write.parquet(path := shared_path(spark, "graph"))
    graph = spark.read.parquet(path)

    asked = queries.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("query_id"), "embedding")
    v = direction(F.col("embedding").cast("array<double>"))
    asked = asked.withColumn("q", F.concat_ws("-", F.xxhash64(v), F.xxhash64(F.lit(1), v))).select("query_id", "q").distinct()
    texts = asked.select("q").distinct().join(known, F.col("q") == F.col("cls")).select("dim", "q", "v")
    blocks = texts.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sets = texts.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("q", F.lit(3)), F.col("blocks")).cast("int"))
    sets = sets.join(counts, "dim").select("dim", "q", "v", "block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    parts = graph.join(blocks, "dim").select("dim", "shard", "names", "vectors", "sizes", "links", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def find(mine: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(held):
            return pd.DataFrame({"q": [], "cls": [], "score": []}).astype({"q": str, "cls": str, "score": float})
        g = held.iloc[0]
        names = np.asarray(g.names)
        x = np.frombuffer(g.vectors, np.float64).reshape(len(names), -1)
        norm = np.linalg.norm(x, axis=1)
        sizes, at, levels = np.frombuffer(g.sizes, np.int32), 0, []
        flat = np.frombuffer(g.links, np.int32)
        for size, most in zip(sizes[: len(sizes) // 2], sizes[len(sizes) // 2 :], strict=True):
            levels.append((size, flat[at : at + size * most].reshape(size, most)))
            at += size * most
        q = np.stack(mine.v.to_list()).astype(np.float64)
        size = np.linalg.norm(q, axis=1)
        ids = search((x / norm[:, None]).astype(np.float32), levels, q / size[:, None], k + 1, width)
        a, b = np.nonzero(ids >= 0)
        c = ids[a, b]
        score = np.einsum("nd,nd->n", q[a], x[c]) / (size[a] * norm[c])
        return pd.DataFrame({"q": mine.q.to_numpy()[a], "cls": names[c], "score": score})

    key = ["dim", "shard", "block"]
    found = sets.groupBy(*key).cogroup(parts.groupBy(*key)).applyInPandas(find, "q string, cls string, score double")
    best = W.partitionBy("q").orderBy(F.desc("score"), "cls")
    merged = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).join(known.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("vec_id"))
    rank = W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    out = asked.join(merged, "q").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
