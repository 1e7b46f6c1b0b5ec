"""Symbol statistics by context, probability tables, and range coding of slices of a context."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import running_sum

# Fixed values of the coder: the probabilities' bits and the least state.
BITS = 14
LOW = 1 << 23


def histogram(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, symbol, n)."""
    return symbols.groupBy(*keys, "symbol").agg(F.count("*").alias("n"))


def entropy_bits(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, bits): symbols of a context and the bits that an ideal coder takes for them."""
    total = counts.groupBy(*keys).agg(F.sum("n").alias("t"))
    rows = counts.join(total, keys)
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(-F.col("n") * F.log2(F.col("n") / F.col("t"))).alias("bits"))


def frequencies(counts: list[int]) -> list[int]:
    """Frequencies that add up to 2**BITS: in proportion, rounded down, one at least for each symbol that was counted and none
    for the others. What lacks goes to the largest; what is over is taken one by one from the largest of the time that is
    over one (the lowest symbol of equals). No counts: all alike, the remainder to the first symbols."""
    total, n, whole = sum(counts), len(counts), 1 << BITS
    if not n:
        return []
    if not total:
        return [whole // n + (i < whole % n) for i in range(n)]
    out = [max(1, c * whole // total) if c else 0 for c in counts]
    gap = whole - sum(out)
    if gap > 0:
        out[out.index(max(out))] += gap
    for _ in range(-gap):
        if (high := max(out)) <= 1:
            raise ValueError("more symbols than frequencies")
        out[out.index(high)] -= 1
    return out


def tables(counts: DataFrame, keys: list[str], alphabet: int | None = None, contexts: DataFrame | None = None) -> DataFrame:
    """(keys, symbol, freq, start): the normalised table of each context over all symbols from 0 to its largest, or to
    alphabet - 1 (symbols beyond it aren't counted). Contexts (keys) that have no counts get the uniform table of the
    alphabet, as an adaptive model does for what it hasn't met."""
    if alphabet is not None:
        counts = counts.filter(F.col("symbol").between(0, alphabet - 1))
    packed = counts.groupBy(*keys).agg(F.max("symbol").alias("top"), F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("m"))
    if contexts is not None:
        packed = contexts.select(*keys).distinct().join(packed, keys, "left")
    top = F.lit(alphabet - 1) if alphabet is not None else F.coalesce("top", F.lit(0))
    dense = packed.withColumn("c", F.transform(F.sequence(F.lit(0), top), lambda s: F.coalesce(F.element_at("m", s), F.lit(0)).cast("long")))

    @F.pandas_udf("array<long>")
    def normal(col: pd.Series) -> pd.Series:
        return pd.Series([frequencies([int(c) for c in x]) for x in col])

    rows = dense.select(*keys, normal("c").alias("f"))
    cumulative = F.aggregate("f", F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    rows = rows.withColumn("s", cumulative).select(*keys, "s", F.posexplode("f").alias("symbol", "freq"))
    return rows.select(*keys, "symbol", "freq", F.col("s")[F.col("symbol")].alias("start"))


def adaptive_counts(symbols: DataFrame, keys: list[str], alphabet: int) -> DataFrame:
    """symbols (keys, pos, symbol) with seen, how often the symbol came before in its context: what an adaptive model
    knows when it codes it. Symbols outside the alphabet aren't counted (seen is null)."""
    rows = symbols.filter(F.col("symbol").between(0, alphabet - 1))
    seen = running_sum(rows, [*keys, "symbol"], F.lit(1), "seen", pos="pos")
    return seen.unionByName(symbols.filter(~F.col("symbol").between(0, alphabet - 1)).withColumn("seen", F.lit(None).cast("long")))


def rans_encode(symbols: list[int], freq: list[int]) -> bytes:
    start = np.concatenate(([0], np.cumsum(freq))).tolist()
    x, out = LOW, bytearray()
    for s in reversed(symbols):
        f = freq[s]
        top = ((LOW >> BITS) << 8) * f
        while x >= top:
            out.append(x & 255)
            x >>= 8
        x = (x // f << BITS) + x % f + start[s]
    return x.to_bytes(4, "big") + bytes(reversed(out))


def rans_decode(data: bytes, freq: list[int], n: int) -> list[int]:
    start = np.concatenate(([0], np.cumsum(freq))).tolist()
    lookup = np.repeat(np.arange(len(freq)), freq).tolist()
    x, at, out, mask = int.from_bytes(data[:4], "big"), 4, [], (1 << BITS) - 1
    for _ in range(n):
        low = x & mask
        s = lookup[low]
        out.append(s)
        x = freq[s] * (x >> BITS) + low - start[s]
        while x < LOW and at < len(data):
            x = (x << 8) | data[at]
            at += 1
    if x != LOW:
        raise ValueError("corrupt symbols")
    return out


def encode(symbols: DataFrame, keys: list[str], slice_len: int = 1 << 16) -> DataFrame:
    """(keys, slice, n, counts, payload) of symbols (keys, pos, symbol): each context is cut into slices of slice_len
    positions, and each slice is one group, so that the group's size is bounded whatever the context's."""
    rows = symbols.withColumn("slice", F.expr(f"int(pos div {slice_len})"))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys, "slice").schema)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("pos").symbol.astype(int).tolist()
        counts = np.bincount(own).tolist()
        return pd.DataFrame([[*key, len(own), counts, rans_encode(own, frequencies(counts))]], columns=[*keys, "slice", "n", "counts", "payload"])

    return rows.groupBy(*keys, "slice").applyInPandas(run, f"{names}, n long, counts array<long>, payload binary")


def decode(coded: DataFrame, keys: list[str], slice_len: int = 1 << 16) -> DataFrame:
    """The symbols of encode's rows; ValueError where a payload doesn't end where it began."""

    @F.pandas_udf("array<int>")
    def symbols(payload: pd.Series, counts: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([rans_decode(p, frequencies([int(x) for x in c]), int(m)) for p, c, m in zip(payload, counts, n, strict=True)])

    rows = coded.select(*keys, "slice", F.posexplode(symbols("payload", "counts", "n")).alias("p", "symbol"))
    return rows.select(*keys, (F.col("slice").cast("long") * slice_len + F.col("p")).alias("pos"), "symbol")
