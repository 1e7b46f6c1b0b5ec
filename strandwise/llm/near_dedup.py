"""Operator 7: MinHash near-duplicates by a signature-coordinate inverted join.

Every document's set of word shingles gets a signature of H minima. Each coordinate-value pair is a posting list.
Two sets that agree in t of H coordinates share one of each other's H - t + 1 rarest postings, so only this prefix
is posted (values that one set alone holds come first and cost nothing). Long lists are skipped: they first link
their members to a few heads, and only members that are still in different components meet each other, in long
lists by blocks. Every pair that meets, in whatever way, is judged alike: collisions are counted over the whole
signatures, and pairs at the match threshold or above are confirmed on full shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, blocks, cut, mix, written
from .components import connected_components
from .shingles import minhashes, shingle_sets

HEADS = 3  # heads of a list: its first members in so many orders of all documents
LIST = 64  # members up to which an open list is settled pair by pair
SHARE = 2048  # members of a list that meet its heads in one group
BLOCK_SETS, BLOCK_HASHES = 256, 1 << 17  # sets of a block and their shingles, at most in the mean
ROOM = 16  # bits of the filter for each text that is looked for, within the two bounds
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def match_threshold(hashes: int, similarity: float, miss: float) -> int:
    """The largest t such that a pair at the similarity agrees in fewer than t coordinates with chance miss at most."""
    total = 0.0
    for t in range(hashes + 1):
        total += math.comb(hashes, t) * similarity**t * (1 - similarity) ** (hashes - t)
        if total > miss:
            return max(1, t)
    return hashes


def _fingerprint(s: np.ndarray) -> np.uint64:
    return mix(np.array([mix(s).sum() ^ np.uint64(len(s))], np.uint64))[0]


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): th, a hash of the text, names it where doc_id can't."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text"))


def signatures(docs: DataFrame, k: int, hashes: int) -> DataFrame:
    """(doc_id, th, n_shingles, fp, sig) of each row: text hash, set size, a fingerprint of the set, its signature keys."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                fp, sig = np.zeros(len(n), np.uint64), np.zeros((0, hashes), np.uint64)
                if len(some):
                    sig = minhashes([sets[i] for i in some], hashes)
                    fp[some] = [_fingerprint(sets[i]) for i in some]
                ends = np.zeros(len(n) + 1, np.int32)
                np.cumsum(np.where(n > 0, hashes, 0), out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(n), pa.array(fp.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel().view(np.int64)))],
                    ["doc_id", "th", "n_shingles", "fp", "sig"],
                )

    return _texts(docs).mapInArrow(run, "doc_id long, th long, n_shingles long, fp long, sig array<long>")


def full_sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(fp, n, sig, s): the classes in needed (fp, th, n, sig) with their whole shingle sets, computed anew from a text.

    A bit table, which grows with needed up to MOST_BITS, tells most other texts apart before any work; the join
    after it is exact.
    """
    spark = docs.sparkSession
    size = min(MOST_BITS, max(LEAST_BITS, ROOM * needed.count()))
    bits = needed.select(F.pmod("th", F.lit(size)).alias("i")).selectExpr("int(i div 64) as w", "shiftleft(1L, int(i % 64)) as b")
    words = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(size // 64 + 1, np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            at = np.mod(batch.column("th").to_numpy(), size)
            hit = (held.value[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
            for part in blocks(batch.filter(pa.array(hit.astype(bool))), "text"):
                sets = shingle_sets(part.column("text"), k)
                ends = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in sets], out=ends[1:])
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("th"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["th", "s"])

    sets = _texts(docs).select("th", "text").mapInArrow(run, "th long, s array<long>")
    # Texts that are copies of each other are looked for by one hash, and one of them is enough.
    found = written(sets.join(needed, "th").select("fp", "n", "sig", "s").dropDuplicates(["fp"]), "sets")
    held.destroy()
    return found


def meet_in_blocks(members: DataFrame, sets: DataFrame, percent: int, t: int) -> DataFrame:
    """Links (a, b) between members (fp, c, cluster) of one cluster but different components c: pairs that agree in t
    coordinates and whose full sets are similar enough.

    A cluster's members are dealt into blocks by a bound on their sets' number and size; those of its largest component
    needn't meet each other. Each pair of blocks is one group, which returns a forest of its links, never its pairs.
    """
    members = members.join(sets.select("fp", "n"), "fp")
    sizes = members.groupBy("cluster", "c").agg(F.count("*").alias("m"), F.sum("n").alias("x"))
    largest = sizes.groupBy("cluster").agg(F.sum("m").alias("n"), F.sum("x").alias("y"), F.max(F.struct("m", "c", "x")).alias("top"))
    dealt_in = lambda m, x: F.ceil(F.greatest(m / BLOCK_SETS, x / BLOCK_HASHES)).cast("int")
    most, rest = dealt_in(F.col("top.m"), F.col("top.x")), dealt_in(F.col("n") - F.col("top.m"), F.col("y") - F.col("top.x"))
    largest = cut(largest.select("cluster", F.col("top.c").alias("top"), most.alias("most"), rest.alias("rest")).filter("rest > 0"))
    dealt = members.join(largest, "cluster").withColumn("big", F.col("c") == F.col("top"))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("fp"), F.when(F.col("big"), F.col("most")).otherwise(F.col("rest"))).cast("int"))
    rest, most = F.sequence(F.lit(0), F.col("rest") - 1), F.sequence(F.lit(0), F.col("most") - 1)
    with_rest = F.transform(rest, lambda j: F.struct(F.lit(False).alias("k"), F.least("i", j).alias("x"), F.greatest("i", j).alias("y")))
    with_most = F.transform(most, lambda j: F.struct(F.lit(True).alias("k"), F.col("i").alias("x"), j.alias("y")))
    from_most = F.transform(rest, lambda j: F.struct(F.lit(True).alias("k"), j.alias("x"), F.col("i").alias("y")))
    pair = F.explode(F.when(F.col("big"), from_most).otherwise(F.concat(with_rest, with_most))).alias("pair")
    dealt = dealt.select("fp", "c", "cluster", pair).join(sets.select("fp", "sig", "s"), "fp")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("fp")
        sig, held, c, fp = np.stack(group.sig.to_list()), group.s.to_list(), group.c.to_numpy(), group.fp.to_numpy()
        root = {x: x for x in c.tolist()}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i in range(len(fp)):
            near = np.flatnonzero(((sig[i + 1 :] == sig[i]).sum(1) >= t) & (c[i + 1 :] != c[i])) + i + 1
            for j in near.tolist():
                if (u := find(int(c[i]))) == (v := find(int(c[j]))):
                    continue  # linked by others meanwhile
                x, y = len(held[i]), len(held[j])
                if 100 * min(x, y) < percent * max(x, y):
                    continue
                common = len(np.intersect1d(held[i], held[j], assume_unique=True))
                if 100 * common >= percent * (x + y - common):
                    root[u] = v
                    out.append((int(fp[i]), int(fp[j])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("cluster", "pair").applyInPandas(run, "a long, b long")


def _clusters(long: DataFrame) -> DataFrame:
    """(fp, c, cluster) of the members (key, fp, c) of long open lists: lists with common members are one cluster, unless they
    hold fewer pairs one by one than together."""
    heads = long.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("m"))
    linked = connected_components(long.join(heads, "key").select("a", F.col("fp").alias("b")))
    named = cut(long.join(linked, F.col("fp") == F.col("node"), "left").select("key", "fp", "c", F.coalesce("label", "fp").alias("label")))
    lists = named.groupBy("label", "key").agg(F.count("*").alias("m")).groupBy("label").agg(F.sum(F.col("m") * F.col("m")).alias("apart"))
    whole = named.select("label", "fp").distinct().groupBy("label").agg((F.count("*") * F.count("*")).alias("together"))
    named = named.join(cut(lists.join(whole, "label").filter("apart < together").select("label", F.lit(True).alias("split"))), "label", "left")
    return named.select("fp", "c", F.when(F.col("split"), F.xxhash64("key", F.lit(1))).otherwise(F.col("label")).alias("cluster")).distinct()


def _groups(docs: DataFrame, k: int, percent: int, hashes: int, miss: float) -> DataFrame:
    """(doc_id, th, n_shingles, grp, component_id) of each row: grp names its component, null for an empty set."""
    t = match_threshold(hashes, percent / 100, miss)
    rows = written(signatures(docs, k, hashes), "signatures")
    ids = rows.select("doc_id", "th", "n_shingles", "fp")
    classes = written(rows.filter("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("id"), F.min("th").alias("th"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")

    # Counts are written, so that the join with them is one of two plain exchanges, whose hot keys Spark splits.
    posted = classes.select("fp", F.explode("sig").alias("key"))
    shared = written(posted.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "shared")
    rare = posted.join(shared, "key").groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("m", "key"))).alias("p")).filter(F.size("p") >= t)
    prefix = written(rare.select("fp", F.explode(F.slice("p", F.lit(1), F.size("p") - (t - 1))).alias("e")).select("fp", "e.key", "e.m"), "prefix")
    sets = full_sets(docs, classes.join(prefix.select("fp").distinct(), "fp").select("fp", "th", "n", "sig"), k)

    share = (F.col("m") / SHARE).cast("int")
    mine = F.pmod(F.xxhash64("fp"), share + 1).cast("int").alias("z")

    def dealt(lists: DataFrame) -> DataFrame:
        """lists (key, m, ...) with a row for each share z of their members, so that no list is one task's work."""
        return lists.withColumn("z", F.explode(F.sequence(F.lit(0), share)))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that agree in t coordinates and whose full sets are similar enough."""
        side = lambda x, *cols: sets.select(F.col("fp").alias(x), *(F.col(c).alias(f"{c}{x}") for c in cols))
        near = pairs.join(side("a", "n", "sig"), "a").join(side("b", "n", "sig"), "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        near = cut(near.filter(F.size(F.array_intersect("siga", "sigb")) >= t).select("a", "b", "na", "nb"))
        common = F.size(F.array_intersect("sa", "sb"))
        return near.join(side("a", "s"), "a").join(side("b", "s"), "b").filter(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")

    # Stars: the members of each list meet its heads. Pairs grow with the postings, not with their square.
    order = lambda i: F.min(F.struct(F.xxhash64("fp", F.lit(i)).alias("h"), "fp"))["fp"]
    tops = prefix.groupBy("key", "m").agg(F.array_distinct(F.array(*map(order, range(HEADS)))).alias("heads"), F.count("*").alias("n")).filter("n > 1")
    met = prefix.select("key", "fp", mine).join(dealt(tops).select("key", "z", F.explode("heads").alias("head")), ["key", "z"]).filter("head <> fp")
    pairs = cut(met.select(F.least("head", "fp").alias("a"), F.greatest("head", "fp").alias("b")).distinct())
    links = cut(confirmed(pairs))
    label = connected_components(links)

    # What is still open: lists that hold several components.
    named = written(prefix.join(label, prefix.fp == label.node, "left").select("key", "m", "fp", F.coalesce("label", "fp").alias("c")), "named")
    several = named.groupBy("key", "m").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).filter("c0 < c1")
    inside = written(named.select("key", "fp", "c", mine).join(dealt(several).select("key", "z", "n"), ["key", "z"]).select("key", "fp", "c", "n"), "open")
    x, y = (inside.filter(f"n <= {LIST}").select("key", F.col("fp").alias(i), F.col("c").alias(f"c{i}")) for i in "ab")
    cross = x.join(y, "key").filter("ca <> cb and a < b").select("a", "b").distinct()
    more = cut(confirmed(cut(cross.join(pairs, ["a", "b"], "left_anti"))))
    long = inside.filter(f"n > {LIST}").select("key", "fp", "c")
    if not long.isEmpty():
        more = more.union(cut(meet_in_blocks(_clusters(long), sets, percent, t)))
    if not more.isEmpty():
        label = connected_components(links.union(more))

    label = cut(classes.select("fp", "id").join(label, classes.fp == label.node).select("fp", "id", "label"))
    component = label.join(cut(label.groupBy("label").agg(F.min("id").alias("component_id"))), "label").select("fp", "label", "component_id")
    named = written(classes.select("fp", "id").join(component, "fp", "left").select("fp", F.coalesce("label", "fp").alias("grp"), F.coalesce("component_id", "id").alias("component_id")), "groups")
    full = ids.filter("n_shingles > 0").join(named, "fp").select("doc_id", "th", "n_shingles", "grp", "component_id")
    none = ids.filter("n_shingles = 0").select("doc_id", "th", "n_shingles", F.lit(None).cast("long").alias("grp"), F.col("doc_id").alias("component_id"))
    return full.union(none)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, hashes: int = 48, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text).

    Documents link when 100 * intersection >= percent * union of their distinct k-word shingle sets (A-Z folded);
    component_id is the smallest doc_id reachable, kept says doc_id = component_id. A pair at exactly the limit is
    missed with chance miss; of no group is a member capped or sampled.

    Null, empty or white texts have an empty set, link with nothing and are kept. Fewer than k words are one
    shingle. Very long texts are one set like any other. Repeated rows each get their row, in one component, and ties
    can't arise. A row without doc_id links and bridges like others, but has kept false; a component of such rows alone
    has a null component_id. Other columns, whatever their names, are ignored. An empty table gives no rows.
    """
    out = _groups(docs, k, percent, hashes, miss)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, hashes: int = 48, miss: float = 1e-6) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id (rows without one come last), of
    equals that of the smallest text hash. Rows with an empty set all stay; of rows repeated with one doc_id and text
    one stays. Columns are those of docs."""
    found = _groups(docs, k, percent, hashes, miss).filter("grp is not null")
    rows = written(found.groupBy("grp", "doc_id", "th").agg(F.count("*").alias("n")), "members")
    rank = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th")
    best = written(rows.groupBy("grp").agg(F.min(rank).alias("best"), F.count("*").alias("size"), F.max("n").alias("most")).filter("size > 1 or most > 1"), "best")
    marks = rows.join(best, "grp").select(F.col("doc_id").alias("doc_id_"), F.col("th").alias("th_"), "n", (rank == F.col("best")).alias("stays"))
    out, at = aside(docs)
    same = (F.xxhash64(F.col(at["text"]).cast("string")) == F.col("th_")) & F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("doc_id_"))
    out = out.join(marks, same, "left").filter("stays is null or stays")
    once = out.filter("n > 1").dropDuplicates([at["doc_id"], at["text"]])
    back = [F.col(a).alias(c) for c, a in at.items()]
    return out.filter("n is null or n = 1").select(*back).union(once.select(*back))
