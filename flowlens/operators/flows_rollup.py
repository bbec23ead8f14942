"""Packets to flows by 5-tuple."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.timefns import dt_diff_seconds

FIVE_TUPLE = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
SINGLE_PACKET_DURATION = 1.0


def agg_flows(packets: DataFrame) -> DataFrame:
    """One row per (src_ip, dst_ip, src_port, dst_port, protocol): first
    packet time, byte and packet sums, duration = last - first in fractional
    seconds (0 becomes 1.0). Unidirectional, no idle timeout.

    Packets with a NULL in the key are left out. A plain group-by: partial aggregation runs map-side, so a flow with very
    many packets costs one row per map task in the shuffle.
    """
    g = (packets.dropna(subset=FIVE_TUPLE).groupBy(*FIVE_TUPLE)
                .agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"),
                     F.sum("bytes").cast("long").alias("bytes"),
                     F.sum("packets").cast("long").alias("packets")))
    dur = dt_diff_seconds("_last", "_first")
    return g.select(
        F.col("_first").alias("timestamp"), *FIVE_TUPLE, "bytes", "packets",
        F.when(dur == 0, F.lit(SINGLE_PACKET_DURATION)).otherwise(dur).alias("duration"))
