"""Vector functions as Catalyst expressions; sums are made in doubles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Over the length of the shorter one."""
    return _sum(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: F.coalesce(p["a"].cast("double") * p["b"].cast("double"), F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 1.0).otherwise(1 - dot(a, b) / scale)


def normalize(a: Column) -> Column:
    return F.transform(F.array(F.struct(a.alias("v"), norm(a).alias("n"))), lambda p: F.transform(p["v"], lambda x: F.when(p["n"] == 0, x.cast("double")).otherwise(x.cast("double") / p["n"])))[0]


def average(vectors: Column) -> Column:
    """Mean of equally long vectors, normalised."""
    first = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    return normalize(F.aggregate(vectors, first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double"))))


def sign_bits(v: Column, dim: int) -> Column:
    """One bit for each positive component, packed in 64-bit words."""
    words = []
    for w in range(-(-dim // 64)):
        bits = [F.when(F.get(v, F.lit(i)) > 0, F.lit(1 << (i % 64) if i % 64 < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(64 * w, min(dim, 64 * w + 64))]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
