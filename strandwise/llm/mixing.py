"""Operator 6: mixing sources to target weights by entropy balancing, in DataFrame functions alone.

Among all document rates between 0 and a cap that give each source its target of words, the mix takes those nearest to
one copy each in relative entropy: rate = min(cap, exp(tilt * size / mean size)). The convex dual has one multiplier
for each source; Newton steps on it, kept inside a bracket, are each one distributed sum over (source, size) counts.
Rates are rounded to copies by carrying the error from large to small documents inside hashed chunks of a source, so
that a chunk's words miss their target by about half its smallest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, aside, cut

CHUNK = 512  # documents that are rounded together
TILT = 1e5  # bound of the multipliers


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """sources (source, source_size, ...) with target: all words shared by the repeating weights in the order of
    source (code points, null last), at most cap times source_size each, what is over reshared by weight."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    table = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    # Sources reach their cap in the order of size over weight; the first that doesn't sets the level of all after it.
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everywhere = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everywhere) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    table = table.withColumn("level", left / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    table = table.withColumn("level", F.when(F.col("level") * F.col("weight") <= cap * F.col("source_size"), F.col("level")))
    level = F.first("level", ignorenulls=True).over(everywhere)
    return table.withColumn("level", level).withColumn("target", F.least(F.lit(float(cap)) * F.col("source_size"), F.col("level") * F.col("weight"))).drop("level", "weight")


def rates(state: DataFrame, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("mean"))))


def balance(counts: DataFrame, sources: DataFrame, cap: float, steps: int = 200, near: float = 1e-9) -> DataFrame:
    """sources with tilt, the dual's solution, from counts (source, size, n): words within near of the target, or a
    thousandth of a word. RuntimeError if that takes more than steps; bisection alone needs about 70."""
    state = sources.withColumn("tilt", F.lit(0.0)).withColumn("low", F.lit(-TILT)).withColumn("high", F.lit(TILT)).withColumn("miss", F.lit(1.0))
    for _ in range(steps):
        rows = counts.join(state.select(F.col("source").alias("s"), "tilt", "mean"), F.col("source").eqNullSafe(F.col("s")))
        rate, share = rates(rows, cap), F.col("n") * F.col("size")
        # Sums of fixed-point numbers agree in any order, so reruns agree.
        fixed = lambda x: F.sum(F.round(x, 6).cast("decimal(38,6)")).cast("double")
        sums = rows.groupBy("s").agg(fixed(share * rate).alias("f"), fixed(F.when(rate < cap, share * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("d"))
        state = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        state = state.withColumn("low", F.when(F.col("f") < F.col("target"), F.greatest("low", "tilt")).otherwise(F.col("low")))
        state = state.withColumn("high", F.when(F.col("f") > F.col("target"), F.least("high", "tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") + F.when((F.col("d") > 0) & (F.col("f") > 0) & (F.col("target") > 0), F.log(F.col("target") / F.col("f")) * F.col("f") / F.col("d"))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        # Near a bracket's far end, halve the exponent of the width and not the width.
        wide = F.greatest(F.lit(1.0), F.abs("tilt")) * 4
        bisect = F.greatest(F.col("tilt") - wide, F.least(F.col("tilt") + wide, (F.col("low") + F.col("high")) / 2))
        state = state.withColumn("miss", F.when((F.col("target") <= 0) | (F.col("target") >= cap * F.col("source_size")) | (F.abs(F.col("f") - F.col("target")) <= 1e-3), 0.0).otherwise(F.abs(F.col("f") / F.col("target") - 1)))
        state = state.withColumn("tilt", F.when(F.col("miss") <= near, F.col("tilt")).when(inside, newton).otherwise(bisect))
        state = cut(state.drop("f", "d"))
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= near:
            break
    else:
        raise RuntimeError("the balance did not settle")
    full = (F.col("target") >= cap * F.col("source_size")) & (F.col("source_size") > 0)
    return state.withColumn("tilt", F.when(full, F.lit(TILT)).otherwise(F.round("tilt", 9))).drop("low", "high", "miss")


def _plan(docs: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    """(doc_id, th, source, size, source_size, target, m, copies) for each of the different rows of docs, m times there; th
    is a hash of the text."""
    sized = cut(docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("source").cast("string"), words(F.col("text")).alias("size")))
    counts = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    sources = sources.withColumn("mean", F.greatest(F.lit(1.0), F.col("source_size") / F.col("docs")))
    state = balance(counts, cut(targets(sources, weights, cap)), cap)

    items = sized.groupBy("source", "doc_id", "th", "size").agg(F.count("*").alias("m"))
    items = items.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", F.when(F.col("tilt") >= TILT, F.lit(float(cap))).otherwise(rates(state, cap)))
    spread = F.xxhash64("doc_id", "th")
    chunk = F.pmod(spread, F.ceil(F.col("docs") / CHUNK).cast("long"))
    item = F.struct((-F.col("size")).alias("key"), spread.alias("h"), "doc_id", "th", "size", "m", "rate")
    groups = items.groupBy("source", "source_size", "target", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<doc_id:bigint,th:bigint,size:bigint,m:bigint,copies:bigint>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        own = (x["size"] * x["m"]).cast("double")
        want = x["rate"] * own + acc["carry"]
        copies = F.when(x["size"] == 0, F.lit(1)).otherwise(F.greatest(F.lit(0), F.least(F.lit(cap), F.floor(want / own + 0.5)))).cast("long")
        row = F.struct(*(x[c].alias(c) for c in ("doc_id", "th", "size", "m")), copies.alias("copies"))
        return F.struct((want - copies * own).alias("carry"), F.array_append(acc["out"], row).alias("out"))

    return groups.select("source", "source_size", "target", F.explode(F.aggregate("items", start, add)["out"]).alias("x")).select("source", "source_size", "target", "x.*")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs (doc_id, source, text).

    size is the number of words of the whole text (0 if null or empty); taken = copies * size; copies is 0 to cap.
    Rows repeated with one doc_id and text take equally many copies each; ties in size go by a hash. Documents without
    words take one copy, of no words. A null source is a source of its own, the last; rows without doc_id are told apart by
    their texts; a very long text is one document. An empty table gives no rows. Other columns, whatever their names,
    are ignored. Equal inputs give equal plans.
    """
    rows = _plan(docs, weights, cap).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """docs with each row repeated by its copies in the plan; columns as they were."""
    plan = _plan(docs, weights, cap).filter("copies > 0").select(F.col("doc_id").alias("id"), "th", F.col("source").alias("site"), "copies")
    out, at = aside(docs)
    text, doc_id, source = (F.col(at[c]) for c in ("text", "doc_id", "source"))
    same = (F.xxhash64(text.cast("string")) == F.col("th")) & doc_id.cast("long").eqNullSafe(F.col("id")) & source.cast("string").eqNullSafe(F.col("site"))
    out = out.join(plan, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*(F.col(a).alias(c) for c, a in at.items()))
