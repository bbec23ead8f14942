"""Preprocessing and the 14 derived flow features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.arith import flag, rate
from flowlens.functions.protocol import ics_protocol_name, is_ics_port
from flowlens.functions.timefns import dt_hour, dt_weekday
from flowlens.operators.timestamps import normalize_timestamp
from flowlens.schema import FEATURE_EXCLUDE, NO_TIME_DAY_OF_WEEK, NO_TIME_HOUR, TRAINING_FEATURES

DERIVED_FEATURES = [
    "is_ics_protocol", "ics_protocol", "bytes_per_packet", "packets_per_second",
    "bytes_per_second", "hour", "day_of_week", "is_night", "is_weekend",
    "is_high_port", "is_well_known", "is_tcp", "is_udp", "unique_destinations",
]


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Names of numeric (not boolean) columns, in schema order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def fill_missing(df: DataFrame) -> DataFrame:
    """Numeric NULL (and NaN) -> 0; the timestamp is left alone."""
    cols = numeric_columns(df, exclude=("timestamp",))
    return df.fillna(0, subset=cols) if cols else df


# --- one Column per feature ------------------------------------------------

def feat_is_ics() -> Column:
    return flag(is_ics_port("dst_port"))


def feat_ics_protocol() -> Column:
    return ics_protocol_name("dst_port")


def feat_bytes_per_packet() -> Column:
    return F.coalesce(rate("bytes", "packets"), F.lit(0.0))


def feat_packets_per_second() -> Column:
    return F.coalesce(rate("packets", "duration"), F.lit(0.0))


def feat_bytes_per_second() -> Column:
    return F.coalesce(rate("bytes", "duration"), F.lit(0.0))


def feat_hour(has_time: bool = True) -> Column:
    return dt_hour("timestamp") if has_time else F.lit(NO_TIME_HOUR)


def feat_day_of_week(has_time: bool = True) -> Column:
    return dt_weekday("timestamp") if has_time else F.lit(NO_TIME_DAY_OF_WEEK)


def night_flag(hour: Column) -> Column:
    """22:00-06:59 inclusive at both ends."""
    return flag((hour >= 22) | (hour <= 6))


def weekend_flag(day_of_week: Column) -> Column:
    return flag(day_of_week >= 5)


def feat_is_night(has_time: bool = True) -> Column:
    return night_flag(dt_hour("timestamp")) if has_time else F.lit(0)


def feat_is_weekend(has_time: bool = True) -> Column:
    return weekend_flag(dt_weekday("timestamp")) if has_time else F.lit(0)


def feat_is_high_port() -> Column:
    return flag(F.col("dst_port") > 10000)


def feat_is_well_known() -> Column:
    return flag(F.col("dst_port") < 1024)


def feat_is_tcp() -> Column:
    return flag(F.upper("protocol") == "TCP")


def feat_is_udp() -> Column:
    return flag(F.upper("protocol") == "UDP")


def default_protocol(df: DataFrame) -> DataFrame:
    """Add ``protocol = 'TCP'`` when the input has no protocol column."""
    return df if "protocol" in df.columns else df.withColumn("protocol", F.lit("TCP"))


def has_timestamp(df: DataFrame) -> bool:
    return ("timestamp" in df.columns and isinstance(
        df.schema["timestamp"].dataType, (T.TimestampType, T.TimestampNTZType)))


def source_fanout(df: DataFrame) -> DataFrame:
    """Distinct destinations per source over the whole input (``src_ip, n``).

    ``countDistinct`` is planned as a dedup on (src_ip, dst_ip) followed by a
    count per source, so a hot source is spread over the first shuffle.
    """
    return (df.where(F.col("src_ip").isNotNull())
              .groupBy("src_ip")
              .agg(F.countDistinct("dst_ip").alias("unique_destinations")))


def split_key(col: str) -> Column:
    """A second join key made of the first. A side that was just grouped by
    ``col`` is then shuffled once more for the join, which is what Spark needs
    to split a hot key's partition (a join right on an aggregate's own
    partitioning is never split)."""
    return F.xxhash64(col)


def join_fanout(df: DataFrame, stored: bool = False) -> DataFrame:
    """Left lookup of :func:`source_fanout` on every row (NULL for NULL sources).

    No broadcast hint: the per-source table grows with the number of
    sources; AQE turns the join into a broadcast at run time when the
    measured side is small and splits skewed partitions otherwise
    (:func:`split_key`). AQE has shuffled every row by then, as both sides
    start together; with ``stored`` the per-source table is written first (an
    eager job), so its size is known when the join is planned and a small one
    leaves the rows where they are.
    """
    fan = source_fanout(df)
    if stored:
        from flowlens.operators.common import materialize
        # grouped again: Spark then knows the sources as unique, and still drops an unread lookup
        fan = materialize(fan, "source-fanout").groupBy("src_ip") \
            .agg(F.max("unique_destinations").alias("unique_destinations"))
    fan = fan.withColumn("_split", split_key("src_ip"))
    cols = df.columns
    return df.withColumn("_split", split_key("src_ip")).join(fan, ["src_ip", "_split"], "left") \
        .select(*cols, "unique_destinations")


def row_features(df: DataFrame) -> DataFrame:
    """The 13 derived columns that follow from a flow alone."""
    t = has_timestamp(df)
    return df.withColumns({
        "is_ics_protocol": feat_is_ics(),
        "ics_protocol": feat_ics_protocol(),
        "bytes_per_packet": feat_bytes_per_packet(),
        "packets_per_second": feat_packets_per_second(),
        "bytes_per_second": feat_bytes_per_second(),
        "hour": feat_hour(t),
        "day_of_week": feat_day_of_week(t),
        "is_night": feat_is_night(t),
        "is_weekend": feat_is_weekend(t),
        "is_high_port": feat_is_high_port(),
        "is_well_known": feat_is_well_known(),
        "is_tcp": feat_is_tcp(),
        "is_udp": feat_is_udp(),
    })


def extract_features(df: DataFrame, stored_fanout: bool = False) -> DataFrame:
    """All 14 derived columns, in the reference's order; ``stored_fanout`` as in :func:`join_fanout`."""
    return join_fanout(row_features(default_protocol(df)), stored_fanout)


def preprocess(df: DataFrame, unit: str = "auto", stored_fanout: bool = False) -> DataFrame:
    """Timestamp normalisation, numeric fill, features. No sort: row order
    carries no meaning in a distributed table (order only at output)."""
    return extract_features(fill_missing(normalize_timestamp(df, unit=unit)), stored_fanout)


def select_numeric(df: DataFrame) -> list[str]:
    """Automatic feature list: numeric columns minus ids, time and labels."""
    return numeric_columns(df, exclude=FEATURE_EXCLUDE)


def select_features(df: DataFrame, wanted=TRAINING_FEATURES) -> list[str]:
    """The fixed training list intersected with the available columns."""
    return [c for c in wanted if c in df.columns]
