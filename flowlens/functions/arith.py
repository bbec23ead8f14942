"""ANSI-safe arithmetic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES_PER_MB = 1024 * 1024


def rate(numerator, denominator) -> Column:
    """``numerator / (denominator + 1)``; NULL instead of an error on /0."""
    return F.try_divide(F.col(numerator) if isinstance(numerator, str) else numerator,
                        (F.col(denominator) if isinstance(denominator, str) else denominator) + F.lit(1))


def to_mb(c) -> Column:
    """Bytes to mebibytes (double)."""
    return (F.col(c) if isinstance(c, str) else c) / F.lit(float(BYTES_PER_MB))


def flag(cond: Column) -> Column:
    """Boolean condition to a 0/1 int; NULL (unknown) counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))
