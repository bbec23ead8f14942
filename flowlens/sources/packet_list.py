"""Packet-list CSV export (No, Time, Source, Destination, Protocol, Length,
Info) to the flow schema, one row per packet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.ports import extract_ports

# Accepted header spellings, first match wins.
TIME_ALIASES = ["Time", "time"]
SOURCE_ALIASES = ["Source", "source", "src"]
DESTINATION_ALIASES = ["Destination", "destination", "dst"]
PROTOCOL_ALIASES = ["Protocol", "protocol"]
LENGTH_ALIASES = ["Length", "length"]
INFO_ALIASES = ["Info", "info"]
DEFAULT_LENGTH = 1000
DEFAULT_DURATION = 0.1


def _first(df: DataFrame, aliases):
    for name in aliases:
        if name in df.columns:
            return F.col(f"`{name}`")
    return None


def read_packet_list(spark: SparkSession, path: str) -> DataFrame:
    """Read the export as text columns; conversion is :func:`convert_packet_list`."""
    return spark.read.option("header", True).csv(path)


def convert_packet_list(df: DataFrame, order_by: str | None = None,
                        base_time=None) -> DataFrame:
    """Map a packet-list export to ``timestamp, src_ip, dst_ip, protocol, bytes,
    src_port, dst_port, packets, duration``.

    Missing source or destination raises ``ValueError``. Missing time numbers
    rows 0..n-1 in file order (or by ``order_by``, e.g. the ``No`` column);
    ``base_time`` (seconds) is added to relative times. Missing protocol is
    ``'TCP'``, missing length 1000; ports come from the info text.
    """
    src = _first(df, SOURCE_ALIASES)
    dst = _first(df, DESTINATION_ALIASES)
    if src is None:
        raise ValueError("Source IP column not found")
    if dst is None:
        raise ValueError("Destination IP column not found")
    time = _first(df, TIME_ALIASES)
    if time is None:
        # Rows are numbered 0..n-1 in file order (distributed numbering).
        from flowlens.operators.timestamps import sequential_index
        df = sequential_index(df, "_row", order_by)
        time = F.col("_row").cast("double")
    elif base_time is not None:
        time = time.try_cast("double") + F.lit(float(base_time))
    proto = _first(df, PROTOCOL_ALIASES)
    length = _first(df, LENGTH_ALIASES)
    info = _first(df, INFO_ALIASES)
    ports = extract_ports(info) if info is not None else F.struct(
        F.lit(0).cast("long").alias("src_port"), F.lit(0).cast("long").alias("dst_port"))
    return df.select(
        time.alias("timestamp"),
        src.cast("string").alias("src_ip"),
        dst.cast("string").alias("dst_ip"),
        (proto.cast("string") if proto is not None else F.lit("TCP")).alias("protocol"),
        (length.try_cast("long") if length is not None else F.lit(DEFAULT_LENGTH).cast("long")).alias("bytes"),
        ports.getField("src_port").alias("src_port"),
        ports.getField("dst_port").alias("dst_port"),
        F.lit(1).cast("long").alias("packets"),
        F.lit(DEFAULT_DURATION).alias("duration"),
    )


def converted_summary(converted: DataFrame) -> DataFrame:
    """Distinct sources / destinations / protocols and total bytes (1 row)."""
    return converted.agg(
        F.countDistinct("src_ip").alias("unique_sources"),
        F.countDistinct("dst_ip").alias("unique_destinations"),
        F.countDistinct("protocol").alias("unique_protocols"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"),
    )
