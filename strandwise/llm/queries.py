"""The numbered queries and, where SQL can express them, the SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, media, secrets, warc
from .common import read_table, shared_path
from .hnsw import nearest
from .language import language_id
from .line_dedup import line_dedup
from .mixing import mix_plan
from .near_dedup import near_duplicates
from .toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.learn(docs)).drop("text")
    base = F.filter("found", lambda x: x["kind"] != "format")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("format"), F.sha2(joined(base), 256).alias("base_sha256"), joined("found").alias("spans"))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    how = (path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), *how, with_decoded=True)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media.store(read_table(spark, sf_dir, "documents"), path := shared_path(spark, "media"))
    payload = F.expr("substring(media, 45)")
    return media.load(spark, path).select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(media, length(media) - 31, 32)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve(warc.captures(read_table(spark, sf_dir, "pages")))
    joined = F.array_join(F.transform("headers", lambda x: F.concat_ws(": ", x["name"], x["value"])), "\n")
    return out.select("record_id", "state", F.coalesce("response_id", F.lit(-1)).alias("response_id"), F.md5(joined).alias("headers_md5"), F.md5("body").alias("body_md5"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": op2_secrets,
    "op3_hnsw": op3_hnsw,
    "op4_line_dedup": op4_line_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_mixing": op6_mixing,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_media": op8_media,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
}

SQL = {
    "op4_line_dedup": r"""
        WITH pages AS (SELECT source, text FROM documents WHERE text IS NOT NULL),
        totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
        lines AS (
            SELECT source, line, count(*) AS n
            FROM (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages)
            WHERE trim(line) <> '' GROUP BY source, line
        ), bad AS (
            SELECT l.source, list(l.line) AS bad FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
            WHERE l.n >= 2 AND l.n > CAST(0.02 AS DOUBLE) * t.pages GROUP BY l.source
        ), done AS (
            SELECT doc_id, string_split(text, chr(10)) AS lines, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(b.bad, []), x)) AS kept
            FROM documents d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source
        )
        SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped,
            length(CASE WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END) AS kept_chars,
            md5(CASE WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END) AS kept_md5
        FROM done
    """,
    "op7_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
            FROM words
        ), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        links AS (
            SELECT p.a, p.b
            FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
            JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b
            WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)
        ), reach AS (
            SELECT a AS doc_id, a AS other FROM links
            UNION
            SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
        ), low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, coalesce(l.component_id, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN low l USING (doc_id)
    """,
    "op9_warc": r"""
        WITH split AS (
            SELECT page_id, html, trim(url) AS url, regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['h', 'p', 'q']) AS u
            FROM pages
        ), sites AS (
            SELECT page_id, html, regexp_replace(regexp_replace(lower(u.h), ':(80|443)$', ''), '^www\.', '') || regexp_replace(u.p, '/+$', '') ||
                CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS site
            FROM (SELECT *, list_sort(list_filter(string_split(u.q, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN
                ('fbclid', 'gclid', 'ref', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'))) AS q FROM split)
        ), full_ AS (SELECT page_id, html, site, page_id * 10 AS ts FROM sites),
        again AS (
            SELECT page_id, html, site, CASE WHEN page_id % 7 = 6 THEN page_id * 10 - 5 ELSE page_id * 10 + 5 END AS ts,
                CASE WHEN page_id % 5 = 4 THEN '"other"' WHEN page_id % 5 <> 3 THEN '"' || md5(html) || '"' END AS tag
            FROM sites
        ), found AS (
            SELECT a.page_id, a.tag, f.page_id AS response, f.html AS body, CASE WHEN f.page_id IS NULL THEN 'no_response'
                WHEN a.tag IS NULL THEN 'unchecked' WHEN a.tag = '"' || md5(f.html) || '"' THEN 'resolved' ELSE 'mismatch' END AS state
            FROM again a ASOF LEFT JOIN full_ f ON a.site = f.site AND a.ts >= f.ts
        )
        SELECT page_id * 2 + 1 AS record_id, state, coalesce(response * 2, -1) AS response_id,
            CASE WHEN state IN ('resolved', 'unchecked') THEN md5(
                'content-type: text/html' || chr(10) || 'content-length: ' || length(body) || chr(10) ||
                CASE WHEN tag IS NULL THEN 'etag: "' || md5(body) || '"' ELSE 'etag: W/' || tag END || chr(10) ||
                'date: t' || (page_id + 1) || chr(10) || 'cache-control: max-age=60' || chr(10) || 'x-cache: HIT') END AS headers_md5,
            CASE WHEN state IN ('resolved', 'unchecked') THEN md5(body) END AS body_md5
        FROM found
    """,
}
