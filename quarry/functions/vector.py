"""Vector functions as Columns over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda n, x: n + x)


def let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once a row; a higher-order function computes what it closes over once an element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalise(v: Column) -> Column:
    scaled = lambda v, norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))
    return let(v, lambda v: let(F.sqrt(dot(v, v)), lambda norm: scaled(v, norm)))


def matryoshka(v: Column, dim: int, layernorm: bool = False) -> Column:
    """The first ``dim`` values, of the vector scaled to mean 0 and deviation 1 if asked, with length 1."""

    def head(v: Column, mean: Column) -> Column:
        sd = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(v)) + 1e-5
        return let(sd, lambda sd: F.transform(F.slice(v, 1, dim), lambda x: (x - mean) / sd))

    if not layernorm:
        return l2_normalise(F.slice(v, 1, dim))
    return l2_normalise(let(v, lambda v: let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v), lambda mean: head(v, mean))))


def sign_code(v: Column, dim: int) -> Column:
    """One bit per value (1 if positive), most significant first, in 64-bit words."""
    bits = F.transform(v, lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    words = [F.aggregate(F.slice(bits, 64 * w + 1, 64), F.lit(0).cast("long"), lambda n, b: F.shiftleft(n, 1).bitwiseOR(b)) for w in range((dim + 63) // 64)]
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda n, x: n + x)


def quantise(v: Column) -> Column:
    """``struct<scale, q array<tinyint>>``: 8-bit steps of the largest absolute value, halves to even."""
    step = lambda x, scale: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.bround(x / scale))).cast("tinyint")
    both = lambda v, scale: F.struct(scale.alias("scale"), F.transform(v, lambda x: step(x, scale)).alias("q"))
    return let(v, lambda v: let(F.array_max(F.transform(v, lambda x: F.abs(x))) / 127.0 + 1e-12, lambda scale: both(v, scale)))


def dequantised_dot(query: Column, q: Column, scale: Column) -> Column:
    return dot(query, q.cast("array<double>")) * scale
