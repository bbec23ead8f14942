"""Whole-input statistics as one aggregate (1-row DataFrame)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stats(df: DataFrame) -> DataFrame:
    """count, distinct sources / destinations, ICS flows, total and mean bytes,
    first and last timestamp. Absent columns give 0 (time range: NULL)."""
    cols = set(df.columns)
    zero = F.lit(0).cast("long")
    aggs = [
        F.count(F.lit(1)).alias("total_flows"),
        (F.countDistinct("src_ip") if "src_ip" in cols else zero).alias("unique_sources"),
        (F.countDistinct("dst_ip") if "dst_ip" in cols else zero).alias("unique_destinations"),
        (F.coalesce(F.sum("is_ics_protocol").cast("long"), zero) if "is_ics_protocol" in cols
         else zero).alias("ics_flows"),
        (F.coalesce(F.sum("bytes").cast("long"), zero) if "bytes" in cols else zero).alias("total_bytes"),
        (F.coalesce(F.avg("bytes"), F.lit(0.0)) if "bytes" in cols else F.lit(0.0)).alias("avg_bytes_per_flow"),
    ]
    if "timestamp" in cols:
        aggs.append(F.struct(F.min("timestamp").alias("start"),
                             F.max("timestamp").alias("end")).alias("time_range"))
    return df.agg(*aggs)
