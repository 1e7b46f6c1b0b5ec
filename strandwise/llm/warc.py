"""Operator 9: WARC not-modified revisits resolved to the responses they stand for, in DataFrame functions alone.

A revisit of profile server-not-modified holds no body: it stands for the latest earlier full response of its canonical
URL. The as-of join is made of windows: each URL's records are cut into time slices, the last response of each slice is
carried to later slices, and inside a slice the last response before each revisit is found, so that a URL that holds
a large share of all records is no single group. Validators are then compared and permitted headers merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, written

SLICES = 4096  # time slices over the whole range of the records

# Query parameters that don't tell resources apart, and fields that a 304 must not replace.
TRACKING = ("fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
KEPT = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """host/path?parameters: scheme, user, www., default port, fragment, tracking parameters and a last slash dropped,
    host in lower case, parameters sorted. Null stays null; what is no URL is only trimmed."""
    url = F.trim(url)
    shape = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, shape, 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, shape, 2), "/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(url, shape, 3), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    query = F.array_join(F.sort_array(pairs), "&")
    return F.when(url.rlike(shape), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise(url)


def fields(block: Column) -> Column:
    """The header fields of a raw block, array<struct<name, value>>: names in lower case, lines without a colon left
    out, order and repeats kept; none for null."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: F.instr(x, ":") > 1)
    return F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(x.substr(F.instr(x, ":") + 1, F.length(x))).alias("value")))


def _first(found: Column, name: str) -> Column:
    return F.try_element_at(F.filter(found, lambda x: x["name"] == name), F.lit(1))["value"]


def merged(old: Column, new: Column) -> Column:
    """old with every field that new holds and may replace taken from new: kept fields first, then new ones."""
    fresh = F.filter(new, lambda x: ~x["name"].isin(*KEPT))
    return F.concat(F.filter(old, lambda x: ~F.exists(fresh, lambda y: y["name"] == x["name"])), fresh)


def resolve(records: DataFrame) -> DataFrame:
    """One row for each server-not-modified revisit of records (record_id, type, url, ts, status, profile, headers,
    body): record_id, state, response_id, headers (merged fields) and body.

    Earlier means a smaller (ts, record_id). A response is full if its type is response and its status 200. ETags are
    compared weakly; if either side lacks one, Last-Modified is; if either lacks both, the response is taken
    (state unchecked). Otherwise the state is resolved, or mismatch with no headers and body; no_response has no
    response_id. Revisits without url or ts are no_response; responses without them, or without record_id, are left
    out. Repeated revisits each get a row; of responses repeated with one record_id one is taken; of equal times the
    larger record_id is the later. Null and empty header blocks have no fields; bodies of any length move once. An empty
    table gives no rows. Extra columns, whatever their names, are ignored.
    """
    found = fields(F.col("headers"))
    rows = records.select("record_id", "ts", "body", canonical_url(F.col("url")).alias("site"), found.alias("fields"), (F.col("type") == "response").alias("full"), "type", "status", "profile")
    full = rows.filter("type = 'response' and status = 200 and site is not null and ts is not null and record_id is not null")
    revisits = rows.filter((F.col("type") == "revisit") & F.col("profile").contains("server-not-modified")).drop("body")

    span = records.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    keys = full.select("site", "ts", "record_id", F.lit(True).alias("full")).union(revisits.filter("site is not null and ts is not null").select("site", "ts", "record_id", F.lit(False)).distinct())
    keys = keys.join(F.broadcast(span)).withColumn("slice", F.expr(f"(ts - t0) div ((t1 - t0) div {SLICES} + 1)"))  # span has one row
    mine = F.when(F.col("full"), F.struct("ts", "record_id"))
    lasts = keys.groupBy("site", "slice").agg(F.max(mine).alias("last"))
    carried = lasts.withColumn("carried", F.last("last", ignorenulls=True).over(W.partitionBy("site").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))).drop("last")
    inside = W.partitionBy("site", "slice").orderBy("ts", "record_id", "full").rowsBetween(W.unboundedPreceding, -1)
    asof = keys.withColumn("here", F.last(mine, ignorenulls=True).over(inside)).filter("not full").join(carried, ["site", "slice"])
    asof = asof.select(F.col("record_id").alias("rid"), F.col("ts").alias("rts"), F.col("site").alias("rsite"), F.coalesce("here", "carried")["record_id"].alias("response_id"))

    same = F.col("record_id").eqNullSafe(F.col("rid")) & (F.col("ts") == F.col("rts")) & (F.col("site") == F.col("rsite"))
    found = cut(revisits.join(asof, same, "left").select("record_id", F.col("fields").alias("new"), "response_id"))
    # Only responses that are asked for move with their bodies; what joins them is written, so that Spark splits the
    # revisits of a response that many share. Revisits without one take no part.
    asked = found.filter("response_id is not null")
    needed = asked.select("response_id").distinct()
    held = full.select(F.col("record_id").alias("response_id"), F.col("fields").alias("old"), "body").join(needed, "response_id", "left_semi").dropDuplicates(["response_id"])
    out = asked.join(written(held, "responses"), "response_id")
    plain = lambda c: F.regexp_replace(c, "^W/", "")
    etags = plain(_first(F.col("new"), "etag")) == plain(_first(F.col("old"), "etag"))
    dates = _first(F.col("new"), "last-modified") == _first(F.col("old"), "last-modified")
    agree = F.coalesce(etags, dates)
    state = F.when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    out = out.withColumn("state", state)
    good = F.col("state").isin("resolved", "unchecked")
    out = out.select("record_id", "state", "response_id", F.when(good, merged(F.col("old"), F.col("new"))).alias("headers"), F.when(good, F.col("body")).alias("body"))
    none = found.filter("response_id is null").select("record_id", F.lit("no_response").alias("state"), "response_id")
    return out.unionByName(none, allowMissingColumns=True)


def captures(pages: DataFrame) -> DataFrame:
    """WARC records from pages (page_id, url, html), to have some to resolve: a full response of each page and one
    revisit of its URL, which for some pages comes before the response, lacks validators or names another ETag."""
    p, n = F.col("page_id"), F.length("html").cast("string")
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    lines = lambda *x: F.concat_ws("\r\n", *x)
    response = lines(F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), n), F.concat(F.lit("ETag: "), tag), F.concat(F.lit("Date: t"), p), F.lit("Cache-Control: no-cache"))
    revisit = lines(F.when(p % 5 == 4, F.lit('ETag: "other"')).when(p % 5 != 3, F.concat(F.lit("ETag: W/"), tag)), F.lit("Content-Length: 0"), F.concat(F.lit("date: t"), p + 1), F.lit("Cache-Control: max-age=60"), F.lit("X-Cache: HIT"))
    common = [F.col("url")]
    full = pages.select((p * 2).alias("record_id"), F.lit("response").alias("type"), *common, (p * 10).alias("ts"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("profile"), response.alias("headers"), F.col("html").alias("body"))
    again = pages.select(p * 2 + 1, F.lit("revisit"), *common, F.when(p % 7 == 6, p * 10 - 5).otherwise(p * 10 + 5), F.lit(304), F.lit("http://netpreserve.org/warc/1.1/revisit/server-not-modified"), revisit, F.lit(None).cast("string"))
    return full.union(again)
