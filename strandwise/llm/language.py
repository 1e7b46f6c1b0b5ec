"""Operator 10: language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, each
permuted (rolled) by its place; a text's profile bundles (adds) the vectors of all its trigrams; a language's
prototype adds its learning texts' unit profiles. A text gets the language of the largest cosine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix

DIM = 512
GRAMS = 4096  # trigrams whose vectors are held at once
MOST = 4096  # letters whose vectors a worker remembers


@lru_cache(1)
def alphabet() -> np.ndarray:
    """Each code point's letter, as the code point of its lower case; 0 for what is no letter."""
    out = np.zeros(0x110000, np.int64)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def letters(points: np.ndarray) -> np.ndarray:
    """Each letter's own random vector of +1 and -1, drawn from its code point; that of 0, the border, too."""
    words = mix(points.astype(np.uint64)[:, None] * np.uint64(DIM // 64) + np.arange(DIM // 64, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


class Table:
    """The vectors of the letters that a worker has met, permuted for each place; over MOST letters it begins anew."""

    def __init__(self):
        self.row = np.full(0x110000, -1, np.int32)
        self.begin(np.zeros(1, np.int64))

    def begin(self, points: np.ndarray) -> None:
        self.points, v = points, letters(points)
        self.row[points] = np.arange(len(points))
        self.first, self.second, self.third = np.roll(v, 2, 1), np.roll(v, 1, 1), v

    def at(self, s: np.ndarray) -> np.ndarray:
        """The rows of the letters s."""
        out = self.row[s]
        if (out < 0).any():
            new = np.unique(s[out < 0])
            if len(self.points) + len(new) > MOST:
                self.row[self.points] = -1
                self.begin(np.unique(np.append(s, 0)))
            else:
                self.begin(np.append(self.points, new))
            out = self.row[s]
        return out.astype(np.int64)


table = lru_cache(1)(Table)


def profile(text: str | None) -> np.ndarray | None:
    """The bundled trigrams of a whole text; None if it has no letter."""
    s = alphabet()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not s.any():
        return None
    s = np.concatenate(([0], s, [0]))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]  # a run of other characters is one border
    held = table()
    at = held.at(s)
    n = len(held.points)
    grams, counts = np.unique((at[:-2] * n + at[1:-1]) * n + at[2:], return_counts=True)
    out = np.zeros(DIM)
    for i in range(0, len(grams), GRAMS):
        g = grams[i : i + GRAMS]
        bound = held.first[g // n**2] * held.second[g // n % n] * held.third[g % n]
        out += counts[i : i + GRAMS].astype(np.float32) @ bound.astype(np.float32)
    return out


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """A vector for each lang of docs (text, lang): sums made in the tasks, then by Spark; one short vector for each
    language reaches the driver."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in blocks(batch, "text"):
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    p = profile(text)
                    if p is not None:
                        sums[lang] = sums.get(lang, 0) + p / max(np.linalg.norm(p), 1e-9)
        for lang, v in sums.items():
            # Whole numbers add up alike in any order.
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(np.round(v * 1e6).astype(np.int64))], ["lang", "i", "x"])

    rows = docs.select("text", "lang").mapInArrow(run, "lang string, i int, x long").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect():
        v = np.array([e.x for e in r.v], np.float64)
        out[r.lang] = v / max(np.linalg.norm(v), 1e-9)
    return out


def identify(docs: DataFrame, known: dict[str, np.ndarray]) -> DataFrame:
    """docs with lang_pred and score (the cosine, 0 at least); und with score 0 for texts that are null or have no
    letter, or if no language is known. Ties go to the name that sorts first."""
    docs = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    names = sorted(known)
    held = docs.sparkSession.sparkContext.broadcast(np.array([known[n] for n in names]).reshape(len(names), DIM))

    def run(batches):
        table = held.value
        for batch in batches:
            for part in blocks(batch, "text"):
                langs, scores = [], []
                for text in part.column("text").to_pylist():
                    p = profile(text)
                    near = table @ p if p is not None and names else None
                    best = int(near.argmax()) if near is not None else -1
                    langs.append(names[best] if best >= 0 else "und")
                    scores.append(min(1.0, max(0.0, float(near[best] / max(np.linalg.norm(p), 1e-9)))) if best >= 0 else 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs), pa.array(scores, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema)


def language_id(docs: DataFrame, sample: int = 20_000) -> DataFrame:
    """docs with held_out, lang_pred and score.

    Learns from text and non-null lang of rows whose crc32(doc_id as text) mod 5 is not 0 (held_out says it is; a
    null doc_id is not held out), about sample rows of each language, chosen by a hash of doc_id. Empty tables,
    or none to learn from, give und, as do null, empty and letterless texts; very long ones are profiled whole. Ties go to
    the name that sorts first. Repeated rows get equal answers. Columns of docs called held_out, lang_pred or score are
    replaced, others of any name stay.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    open_ = docs.filter(~out & F.col("lang").isNotNull())
    # A number for each language, not for each row.
    counts = {r[0]: r[1] for r in open_.groupBy("lang").count().collect()}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(sample / n)) for k, n in counts.items()], F.lit(0.0)) if counts else F.lit(0.0)
    chosen = open_.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    return identify(docs, prototypes(chosen)).withColumn("held_out", out)
