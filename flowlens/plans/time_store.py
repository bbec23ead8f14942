"""Flow tables stored in time order, with each file's time range beside them.

Rows are range-partitioned by time and all other columns, so an instant that
holds a third of the rows is still spread and the order is total: rows that
compare equal are equal. Files follow each other in time by name. A manifest
holds each file's rows and its least and greatest time: a read of a time range
opens only the files that overlap it, and a row's position in the order is its
file's offset plus its place there, without a sort. (A scan may read small files
in any order.) Data and manifest are swapped in together.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.plans.staged import recover, swap_in


def sort_time(df: DataFrame, col: str = "timestamp", partitions: int | None = None) -> DataFrame:
    """``df`` in order of ``col`` (NULL last), ties by the other columns in their order."""
    order = [F.asc_nulls_last(col), *(F.asc_nulls_last(f"`{c}`") for c in df.columns if c != col)]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def write_sorted(df: DataFrame, path: str, col: str = "timestamp", partitions: int | None = None) -> str:
    """Store ``df`` in time order at ``path``: ``data`` and ``manifest``."""
    spark = df.sparkSession

    def write(folder: str) -> None:
        data = posixpath.join(folder, "data")
        sort_time(df, col, partitions).write.parquet(data)
        name = F.col("_metadata.file_name").alias("file")
        spark.read.parquet(data).select(name, F.unix_micros(F.col(col).cast("timestamp")).alias("t")) \
            .groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("t").alias("first"), F.max("t").alias("last")) \
            .coalesce(1).write.parquet(posixpath.join(folder, "manifest"))
    return swap_in(spark, path, write)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(file, rows, first, last)`` in order of time; times are epoch microseconds."""
    recover(spark, path)
    return spark.read.parquet(posixpath.join(path, "manifest")).orderBy("file")


def read_sorted(spark: SparkSession, path: str, start=None, end=None, col: str = "timestamp") -> DataFrame:
    """Rows of the stored table, of ``start <= col < end`` if given (epoch seconds);
    rows without a time belong to no range. Files outside it are not opened."""
    data = posixpath.join(path, "data")
    if start is None and end is None:
        recover(spark, path)
        return spark.read.parquet(data)
    files, rows = manifest(spark, path), F.unix_micros(F.col(col).cast("timestamp"))
    keep = F.lit(True)
    if start is not None:
        low = int(start * 1_000_000)
        files, keep = files.where(F.col("last") >= low), keep & (rows >= low)
    if end is not None:
        high = int(end * 1_000_000)
        files, keep = files.where(F.col("first") < high), keep & (rows < high)
    names = [r["file"] for r in files.collect()]             # of one range
    if not names:
        return spark.read.parquet(data).limit(0)
    return spark.read.parquet(*[posixpath.join(data, n) for n in names]).where(keep)


def numbered(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """The stored rows with their position in the order, from 0."""
    recover(spark, path)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)            # one row per file
    offsets = manifest(spark, path).select(F.col("file").alias("_file"),
                                           F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_offset"))
    data = spark.read.parquet(posixpath.join(path, "data"))
    columns = [f"`{c}`" for c in data.columns]
    return data.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at")) \
        .join(offsets, "_file").select(*columns, (F.col("_offset") + F.col("_at")).alias(name))
