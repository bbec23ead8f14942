"""Timestamp normalisation and row numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.timefns import auto_unit, parse_timestamp

SYNTHETIC_START = "2024-01-01 00:00:00"


def normalize_timestamp(df: DataFrame, col: str = "timestamp", unit: str = "auto") -> DataFrame:
    """Make ``col`` a ``TimestampType`` column.

    * timestamp / timestamp_ntz input passes through (cast only);
    * numeric or text input: numbers are epoch values in ``unit``
      (``s, ms, us, ns``); ``auto`` judges the unit from the column maximum
      (one small aggregate); text that is not a number is parsed as ISO date
      time. Anything unparseable becomes NULL.

    A streaming source must name the unit (no global maximum exists).
    """
    if col not in df.columns:
        return df
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df.withColumn(col, F.col(col).cast("timestamp"))
    numeric = isinstance(dtype, T.NumericType)
    if unit == "auto":
        if df.isStreaming:
            raise ValueError("unit='auto' needs a batch input; name the unit for a stream")
        mx = df.agg(F.max(F.col(col).try_cast("double")).alias("m")).first()["m"]
        unit = auto_unit(mx)
    return df.withColumn(col, parse_timestamp(col, unit=unit, numeric=numeric))


def _number_or_text(col: str) -> list:
    """Sort keys of a column that may be text: numeric values first, by value."""
    c = F.col(f"`{col}`")
    return [c.try_cast("double").asc_nulls_last(), c.cast("string").asc_nulls_last()]


def sequential_index(df: DataFrame, name: str = "row_index", order_by: str | None = None) -> DataFrame:
    """Number rows 0..n-1 in their current order, or by ``order_by`` (numbers by
    value, also as text), without a single-partition sort.

    The rows are stored once with their partition number and their position
    in it, so every consumer sees the same numbering. Per-partition counts
    (one row per partition, a bounded size) give the offsets.
    """
    from flowlens.operators.common import materialize
    ordered = df.orderBy(*_number_or_text(order_by)) if order_by else df
    tagged = materialize(
        ordered.withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)),
        "numbered")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid", "left")
    return out.withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_pos")).drop("_pid", "_pos", "_off")


def synthesize_timestamp(df: DataFrame, col: str = "timestamp", order_by: str | None = None) -> DataFrame:
    """Opt-in: replace ``col`` by 2024-01-01 plus one minute per row, in file
    order or in that of ``order_by``."""
    idx = sequential_index(df, "_seq", order_by)
    start = F.unix_micros(F.to_timestamp(F.lit(SYNTHETIC_START)))
    return idx.withColumn(col, F.timestamp_micros(start + F.col("_seq") * 60_000_000)).drop("_seq")
