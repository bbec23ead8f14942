"""Spreading an input that has fewer splits than the cluster has cores.

A Parquet row group is the unit of a scan split, so a file written as one row
group is read by one task. Nothing is spread by default, whatever the size: a
caller who knows the input asks for a number of partitions, by argument or by
the session setting ``spark.flowlens.inputPartitions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INPUT_PARTITIONS = "spark.flowlens.inputPartitions"


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` hash-partitioned on its row values into ``partitions`` (default:
    the session setting; unset means unchanged). Hashing is deterministic
    under task retries without the sort that round-robin needs."""
    partitions = partitions or int(df.sparkSession.conf.get(INPUT_PARTITIONS, "0"))
    if not partitions or df.isStreaming:
        return df
    keys = [F.col(f"`{f.name}`") for f in df.schema.fields
            if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return df.repartition(partitions, *keys)
