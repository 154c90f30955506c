"""Numeric columns: hash-based uniforms, clamps and vector arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone, whatever the partitioning."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_normal(*key: Column) -> Column:
    """Standard normal draw from two hash uniforms (Box-Muller)."""
    u = F.lit(1.0) - hash_uniform(*key, F.lit("a"))
    v = hash_uniform(*key, F.lit("b"))
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def settled(x: Column, digits: int = 4) -> Column:
    """Round a sum or mean of doubles. Nine digits first, so that the order of summation cannot tip a tie."""
    return F.round(F.round(x, 9), digits)


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
