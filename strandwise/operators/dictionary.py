"""Sparse codes over a dictionary of unit vectors: matching pursuit, and learning the dictionary by K-SVD steps whose
atoms are updated in parallel, one group an atom."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import normalise


def initial(signals: DataFrame, atoms: int) -> DataFrame:
    """(atom, vec): unit vectors of the atoms signals whose hashes are lowest; a dictionary's size is a setting."""
    rows = signals.filter(F.exists("vec", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(atoms)
    # Numbering so few rows may take one task.
    return rows.select((F.row_number().over(W.orderBy(F.xxhash64("id"), "id")) - 1).alias("atom"), normalise(F.col("vec").cast("array<double>"), 1e-12).alias("vec"))


MOST_ATOMS = 65_536


def _table(atoms: DataFrame) -> np.ndarray:
    """The atoms in order, for the driver: a dictionary's size is a setting, and one over MOST_ATOMS raises ValueError."""
    rows = atoms.orderBy("atom").limit(MOST_ATOMS + 1).collect()
    if len(rows) > MOST_ATOMS:
        raise ValueError(f"more than {MOST_ATOMS} atoms")
    return np.array([r.vec for r in rows], np.float64)


def first_atom(signals: DataFrame, atoms: DataFrame) -> DataFrame:
    """(id, atom, coef): the atom of largest absolute dot product with each signal (rounded to 6 digits), the lowest of
    equals. Null signals have none and are left out; without atoms there are no rows."""
    table = _table(atoms)
    if not len(table):
        return signals.limit(0).select("id", F.lit(0).alias("atom"), F.lit(0.0).alias("coef"))
    held = signals.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("struct<atom int, coef double>")
    def best(col: pd.Series) -> pd.DataFrame:
        d = np.stack(col.to_list()).astype(np.float64) @ held.value.T if len(col) else np.zeros((0, 1))
        at = np.round(np.abs(d), 6).argmax(1)
        return pd.DataFrame({"atom": at.astype(np.int32), "coef": d[np.arange(len(at)), at]})

    return signals.filter("vec is not null").select("id", best(F.col("vec").cast("array<double>")).alias("b")).select("id", "b.atom", "b.coef")


def encode(signals: DataFrame, atoms: DataFrame, sparsity: int) -> DataFrame:
    """signals (id, vec) with terms, array<struct<atom, coef>>, by greedy matching pursuit without re-fitting: up to
    sparsity steps, each atom once, stopping below 1e-9; and left, what the terms leave of vec."""
    held = signals.sparkSession.sparkContext.broadcast(_table(atoms))

    @F.pandas_udf("struct<terms array<struct<atom int, coef double>>, left array<double>>")
    def pursue(col: pd.Series) -> pd.DataFrame:
        out = []
        for x in col:
            left, used, terms = np.array(x, np.float64), np.zeros(len(held.value), bool), []
            for _ in range(min(sparsity, len(used))):
                d = held.value @ left
                i = int(np.argmax(np.where(used, -1.0, np.abs(d))))
                if abs(d[i]) < 1e-9:
                    break
                used[i] = True
                left -= d[i] * held.value[i]
                terms.append({"atom": i, "coef": float(d[i])})
            out.append((terms, left))
        return pd.DataFrame(out, columns=["terms", "left"])

    coded = signals.withColumn("coded_", pursue(F.col("vec").cast("array<double>")))
    return coded.withColumn("terms", F.col("coded_.terms")).withColumn("left", F.col("coded_.left")).drop("coded_")


def decode(coded: DataFrame, atoms: DataFrame, with_left: bool = False) -> DataFrame:
    """(id, vec): the sums of each signal's terms, in joins and grouped sums; with_left adds what they left, which restores
    the signal up to the rounding of doubles."""
    terms = coded.select("id", F.explode("terms").alias("t")).select("id", "t.atom", "t.coef").join(atoms.withColumnRenamed("vec", "a"), "atom")
    parts = terms.select("id", "coef", F.posexplode("a").alias("pos", "x")).groupBy("id", "pos").agg(F.sum(F.col("coef") * F.col("x")).alias("x"))
    sums = parts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("p")).select("id", F.transform("p", lambda e: e["x"]).alias("sum"))
    rows = coded.select("id", "left").join(sums, "id", "left")
    total = F.coalesce("sum", F.transform("left", lambda x: F.lit(0.0)))
    return rows.select("id", (F.zip_with(total, "left", lambda x, y: x + y) if with_left else total).alias("vec"))


def learn(signals: DataFrame, atoms: int, iterations: int, sparsity: int | None = None) -> DataFrame:
    """(atom, vec) after iterations of coding all signals and turning each atom to the main direction of what its users
    lack without it. An atom's users are summed as second moments in parts, so no group holds all of them."""
    sparsity = sparsity or max(1, atoms // 64)
    spark, table = signals.sparkSession, initial(signals, atoms)
    for _ in range(iterations):
        held = spark.sparkContext.broadcast(_table(table))
        coded = encode(signals, table, sparsity)

        def moments(batches):
            d = held.value
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for vec, terms in zip(batch.vec, batch.terms, strict=True):
                    left = np.asarray(vec, np.float64) - sum((t["coef"] * d[t["atom"]] for t in terms), np.zeros(d.shape[1]))
                    for t in terms:
                        e = left + t["coef"] * d[t["atom"]]
                        sums[t["atom"]] = sums.get(t["atom"], 0) + np.outer(e, e)
            for atom, m in sums.items():
                yield pd.DataFrame({"atom": atom, "pos": np.arange(m.size), "x": m.ravel()})

        sums = coded.select("vec", "terms").mapInPandas(moments, "atom int, pos int, x double").groupBy("atom", "pos").agg(F.sum("x").alias("x"))

        def turn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            x = group.sort_values("pos").x.to_numpy()
            m = x.reshape(int(round(len(x) ** 0.5)), -1)
            v = held.value[key[0]]
            for _ in range(10):
                w = m @ v
                if (size := np.linalg.norm(w)) < 1e-12:
                    break
                v = w / size
            return pd.DataFrame({"atom": [key[0]], "vec": [v.tolist()]})

        turned = sums.groupBy("atom").applyInPandas(turn, "atom int, vec array<double>")
        kept = table.join(turned.select("atom"), "atom", "left_anti")
        rows = [(r.atom, list(r.vec)) for r in turned.unionByName(kept.select("atom", "vec")).collect()]
        table = spark.createDataFrame(rows, "atom int, vec array<double>")
    return table
