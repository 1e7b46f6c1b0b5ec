"""Integer coding as column expressions: they stay inside generated code and push no rows through Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2 ... as 0, 1, 2, 3 ..., exact for every 64-bit value (the result is an unsigned pattern)."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("long")))


def bit_len(z: Column) -> Column:
    """Bits of an unsigned pattern; 0 for 0."""
    return F.when(z == 0, 0).otherwise(F.length(F.bin(z))).cast("int")


def bucket(z: Column) -> Column:
    return bit_len(z)


def mantissa(z: Column) -> Column:
    """The bits of z below its leading one."""
    b = bit_len(z)
    return F.when(b <= 1, F.lit(0)).otherwise(z.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b - 1))).cast("long")


def join_bucket(b: Column, m: Column) -> Column:
    """The inverse of bucket and mantissa."""
    return F.when(b == 0, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), b - 1).bitwiseOR(m)).cast("long")


def varint_bytes(z: Column) -> Column:
    """Bytes of the LEB128 form of an unsigned pattern."""
    return F.greatest(F.lit(1), F.ceil(bit_len(z) / 7)).cast("int")


def plane_clamp(p: Column) -> Column:
    return F.least(p, F.lit(24))


def floor_div4(x: Column) -> Column:
    return F.shiftright(x, 2)


def bytes_per_sample(fmt: Column) -> Column:
    return F.when(fmt == "int16", 2).when(fmt == "int24", 3).when(fmt.isin("int32", "float32"), 4).when(fmt == "float64", 8)


def bit_depth(fmt: Column) -> Column:
    return bytes_per_sample(fmt) * 8


def next_pow2(n: Column) -> Column:
    return F.when(n <= 1, 1).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bit_len((n - 1).cast("long")))).cast("long")
