"""Timestamp parsing, tumbling buckets and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Divisors from a numeric epoch value to seconds, and the largest value each
# unit may take under ``unit='auto'`` (2e9 s is the year 2033).
UNIT_DIVISOR = {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9}
AUTO_LIMITS = [(2e9, "s"), (2e12, "ms"), (2e15, "us")]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def auto_unit(max_value) -> str:
    """Unit of numeric epoch values judged from the column maximum."""
    if max_value is None:
        return "s"
    for limit, unit in AUTO_LIMITS:
        if max_value <= limit:
            return unit
    return "ns"


def parse_timestamp(c, unit: str = "s", numeric: bool = False) -> Column:
    """Numeric epoch (in ``unit``) or ISO text to ``TimestampType``.

    Unparseable values become NULL (never an error).
    """
    col = _c(c)
    num = col.try_cast("double")
    micros = F.round(num * F.lit(1e6 / UNIT_DIVISOR[unit])).try_cast("long")
    from_num = F.timestamp_micros(micros)
    if numeric:
        return from_num
    return F.coalesce(from_num, F.try_to_timestamp(col.cast("string")))


def epoch_seconds(ts) -> Column:
    """Timestamp to whole epoch seconds (BIGINT)."""
    return F.unix_seconds(_c(ts))


def time_bucket(ts, width_s: int) -> Column:
    """Start of the epoch-aligned tumbling bucket of ``width_s`` seconds.

    Pure arithmetic (no ``window`` struct), so NULL timestamps stay NULL
    instead of being filtered.
    """
    micros = F.unix_micros(_c(ts))
    width = F.lit(int(width_s) * 1_000_000)
    return F.timestamp_micros(micros - F.pmod(micros, width))


def dt_hour(ts) -> Column:
    return F.hour(_c(ts))


def dt_weekday(ts) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts))


def dt_diff_seconds(later, earlier) -> Column:
    """Fractional seconds between two timestamps."""
    return (F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))) / F.lit(1e6)
