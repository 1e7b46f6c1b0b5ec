"""The corpus pipeline: toxic documents go, boilerplate lines go, one near-duplicate of each group stays, sources are
mixed to their weights, and what is left is encoded as tokens. Each stage is written as Parquet and read again.

Stages take documents with nulls in any column: a null or empty text is no toxic one, has no lines, is no copy, has no
words (one copy stays) and no tokens; a null source is a source of its own. Rows repeated with one doc_id and text leave
one at near-dedup. Very long texts are taken whole. All but the last return COLUMNS; other columns, whatever their
names, don't go on. An empty table gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import bpe
from strandwise.llm.common import read_table, shared_path, small_batches
from strandwise.llm.line_dedup import line_dedup
from strandwise.llm.mixing import mix
from strandwise.llm.near_dedup import drop_near_duplicates
from strandwise.llm.toxicity import toxicity

#: Share of its source's pages over which a line is boilerplate. On the tables given, lines planted as boilerplate are held
#: by 0.01 to 0.1 of the pages, while short sentences met by chance are held by 0.005 or less.
LINE_RATIO = 0.01
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the limit, by a model learned from the labels of these documents."""
    return toxicity(docs, read_table(spark, sf_dir, "labels")).filter("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text. Pages of one text count once and a page
    of boilerplate alone stays, as copies are near-dedup's to judge; 5 pages or more must hold a line, so that clean
    documents of a small source keep theirs."""
    small_batches(spark)
    return line_dedup(docs, ratio=LINE_RATIO, least=5, distinct_pages=True, keep_stubs=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more. Of rows repeated
    with one doc_id and text one stays; so does one of a group of rows without doc_id."""
    small_batches(spark)
    return drop_near_duplicates(docs, k=5, percent=80).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the copies that the mix takes of them."""
    small_batches(spark)
    return mix(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the token ids' digest and that of the bytes they decode to."""
    small_batches(spark)
    how = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.encode(docs.select("doc_id", "source", "text"), *how, with_decoded=True)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Learned scores, components and rates can't be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := shared_path(spark, name))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
