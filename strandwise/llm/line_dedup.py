"""Operator 4: line deduplication by site-relative frequency, in DataFrame functions alone.

A line's ratio is the share of its host's pages that hold it. Lines over the ratio are boilerplate there and are
dropped; elsewhere the same line stays. The ratios of one host add up to its mean number of lines a page, so a host
has at most that mean divided by the limit such lines, and one short array for each host carries them to its pages.
Counting shuffles hashes of lines and never texts; the arrays are broadcast while there are few in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, written

FEW = 200_000  # boilerplate lines of all hosts up to which their hashes are broadcast, about 10 MB
SHARES = 64  # parts of a host's pages beyond that


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"))


def boilerplate(docs: DataFrame, host: str, ratio: float, least: int = 2, distinct_pages: bool = False) -> DataFrame:
    """(host, k): the 128-bit keys of each host's boilerplate lines. With distinct_pages, a host's pages with one text count
    once, so that a large group of copies doesn't make its own lines boilerplate."""
    pages = docs.filter("text is not null").select(F.col(host).alias("host"), F.xxhash64("text").alias("page"), F.array_distinct(F.split("text", "\n")).alias("lines"))
    keys = F.transform(F.filter("lines", lambda x: F.trim(x) != ""), _key)
    if distinct_pages:
        lines = pages.select("host", "page", F.explode(keys).alias("k")).distinct()
        totals = pages.select("host", "page").distinct()
    else:
        lines, totals = pages.select("host", F.explode(keys).alias("k")), pages
    counts = lines.groupBy("host", "k").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    totals = totals.groupBy(F.col("host").alias("site")).agg(F.count("*").alias("pages"))
    return counts.join(totals, F.col("host").eqNullSafe(F.col("site"))).filter(F.col("n") > ratio * F.col("pages")).select("host", "k")


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = 0.02, least: int = 2, distinct_pages: bool = False, keep_stubs: bool = False) -> DataFrame:
    """docs with text cleaned and the columns n_lines and n_dropped.

    A line is dropped where more than ratio of its host's pages, and least pages or more, hold it; by default that is
    two, as a line of one page repeats nothing. Opt-ins: distinct_pages counts pages of one text once; keep_stubs leaves a
    page of nothing but boilerplate whole, for document deduplication to judge.

    Blank lines never count as boilerplate. Null texts stay null with 0 lines, empty ones have one line; a null host is a
    host of its own; repeated rows are each cleaned; very long texts are pages like others; a share of exactly ratio stays;
    an empty table gives no rows. Columns of docs called n_lines or n_dropped are replaced, others of any name stay.
    """
    bad = written(boilerplate(docs, host, ratio, least, distinct_pages), "boilerplate")
    lists = bad.groupBy("host").agg(F.collect_list("k").alias("bad"), F.collect_list("k.h").alias("bad_h"))
    out, at = aside(docs)
    text, site = F.col(at["text"]), F.col(at[host])
    if bad.count() <= FEW:
        out = out.join(F.broadcast(lists), site.eqNullSafe(F.col("host")), "left")
    else:
        lists = lists.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        out = out.join(lists, site.eqNullSafe(F.col("host")) & (F.pmod(F.xxhash64(text), F.lit(SHARES)).cast("int") == F.col("share")), "left")
    out = out.withColumn("lines", F.split(text, "\n"))
    # One hash is looked for first; the second makes sure.
    gone = lambda x: F.array_contains(F.col("bad_h"), F.xxhash64(x)) & F.array_contains(F.col("bad"), _key(x))
    out = out.withColumn("left", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~gone(x))))
    if keep_stubs:
        out = out.withColumn("left", F.when(F.exists("left", lambda x: F.trim(x) != ""), F.col("left")).otherwise(F.col("lines")))
    n = F.when(text.isNull(), F.lit(0)).otherwise(F.size("lines"))
    dropped = F.when(text.isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("left"))
    clean = F.when(dropped > 0, F.array_join("left", "\n")).otherwise(text)
    kept = [(clean if c == "text" else F.col(at[c])).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*kept, n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
