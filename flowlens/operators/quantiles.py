"""Exact quantiles without a sort and without a counter per distinct value.

The value of a rank is found by narrowing a bracket: a mergeable sketch of the
rows inside it proposes two pivots around the rank, one pass counts exactly the
rows below and at each, and the part that holds the rank is the next bracket.
With a rank error of 1 / ``ACCURACY`` a round leaves about 6 / ``ACCURACY`` of the
rows, so a trillion rows take three rounds; the last bracket, at most ``SLICE``
rows, is sorted on the driver. Every pass is a partial aggregate: no task sees
more than a sketch, or the slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
SLICE = 10_000


def _inside(df: DataFrame, low, high) -> DataFrame:
    """The rows strictly between two values (None: no bound); NaN is above all numbers."""
    if low is not None:
        df = df.where(F.col("v") > F.lit(low))
    return df.where(F.col("v") < F.lit(high)) if high is not None else df


def value_at(df: DataFrame, rank: int, rows: int, slice_rows: int = SLICE, accuracy: int = ACCURACY):
    """The value of 0-based ``rank`` among the ``rows`` non-NULL doubles ``v`` of ``df``."""
    low = high = None
    below = 0                                    # rows at or under `low`
    while rows > slice_rows:
        part = _inside(df, low, high)
        at, step = (rank - below) / rows, 3 / accuracy
        proposed = part.agg(F.percentile_approx("v", [max(0.0, at - step), min(1.0, at + step)], accuracy)).first()[0]
        counts = part.agg(*[c for p in proposed for c in (F.count_if(F.col("v") < F.lit(p)),
                                                          F.count_if(F.col("v") <= F.lit(p)))]).first()
        under, upto, narrowed = 0, rows, (low, high)
        for p, less, most in zip(proposed, counts[0::2], counts[1::2]):
            if below + less <= rank < below + most:
                return p                         # the rank falls among the rows equal to a pivot
            if below + most <= rank and most > under:
                under, narrowed = most, (p, narrowed[1])
            elif rank < below + less and less < upto:
                upto, narrowed = less, (narrowed[0], p)
        low, high = narrowed
        below, rows = below + under, upto - under
    values = sorted(r[0] for r in _inside(df, low, high).collect())      # at most slice_rows
    return values[rank - below]


def exact_quantile(df: DataFrame, column: str, q: float, slice_rows: int = SLICE, accuracy: int = ACCURACY):
    """The exact ``q`` quantile (linear interpolation) of a column, as
    ``percentile`` gives it; None without values. Reads ``df`` once for the count
    and twice per round: give it a stored table."""
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n = v.count()
    if n == 0:
        return None
    place = q * (n - 1)
    lower = int(place)
    first = value_at(v, lower, n, slice_rows, accuracy)
    if lower == place:
        return first
    if v.where(F.col("v") <= F.lit(first)).count() > lower + 1:
        return first
    second = v.where(F.col("v") > F.lit(first)).agg(F.min("v")).first()[0]
    return (lower + 1 - place) * first + (place - lower) * second
