"""Scalar expressions shared by several operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column, digits: int = 6) -> Column:
    """Round for output; adding zero folds a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def half_even(c: Column) -> Column:
    """Nearest integer, ties to even."""
    return F.bround(c, 0).cast("long")


def clip(c: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.greatest(lo, F.least(hi, c))


def uniform(lo, hi, seed: int) -> Column:
    return F.rand(seed) * (hi - lo) + lo


def div(a: Column, b) -> Column:
    """Floor division of integer columns (also right for negative values)."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.floor(a / b).cast("long")


def hash_uniform(seed: int, *cols: str | Column) -> Column:
    """Reproducible number in [0, 1) from a row key: the same on every retry of a task, and in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), *cols)), 1, 13), 16, 10).cast("long") / float(1 << 52)


def hash_normal(seed: int, *cols: str | Column) -> Column:
    """Reproducible standard normal from a row key (Box–Muller)."""
    u = F.greatest(hash_uniform(seed, *cols), F.lit(1e-300))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * hash_uniform(seed + 7919, *cols))


def order_key(v: Column) -> Column:
    """A long that orders doubles as their values do: the bit pattern of a number from 0 up, mirrored below; NaN comes last.

    Null is taken as 0. A formula from powers of two gives the same and is so long that the JVM leaves it uncompiled.
    """
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(v, F.lit(0.0))).cast("long")
    return F.when(bits < 0, F.lit(-(1 << 63)) - bits).otherwise(bits)
