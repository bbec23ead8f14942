"""Result tables. One directory per table, replaced as a whole when its new
content is complete (:mod:`flowlens.plans.staged`); nothing else in the output
folder is touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.plans.staged import recover, swap_in

# Timestamps of CSV results: to the microsecond, as captures have them.
CSV_TIMESTAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _csv_safe(df: DataFrame) -> DataFrame:
    """CSV cannot hold arrays or structs: encode them as JSON text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write ``df`` to ``path`` (a directory) as csv, parquet or json."""
    if fmt == "csv":
        writer = _csv_safe(df).write.option("header", True).option("timestampFormat", CSV_TIMESTAMP).csv
    elif fmt == "parquet":
        writer = df.write.parquet
    elif fmt == "json":
        writer = df.write.json
    else:
        raise ValueError(f"unknown sink format {fmt!r}")
    return swap_in(df.sparkSession, path, writer)


def read_table(spark, path: str, fmt: str, schema) -> DataFrame:
    """Read a table written by :func:`write_table` back with its schema."""
    recover(spark, path)
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).option("timestampFormat", CSV_TIMESTAMP).csv(path)
    if fmt == "json":
        return spark.read.schema(schema).json(path)
    return spark.read.parquet(path)


def sink_anomalies(scored: DataFrame, path: str, fmt: str = "csv") -> str:
    return write_table(scored.where(F.col("is_anomaly") == 1), path, fmt)


def sink_lateral(lateral: DataFrame, path: str, fmt: str = "csv") -> str:
    return write_table(lateral.where(F.col("is_lateral_movement") == 1), path, fmt)


def sink_exfil(exfil: DataFrame, path: str, fmt: str = "csv") -> str:
    return write_table(exfil.where(F.col("is_exfiltration") == 1), path, fmt)


def sink_ics(findings: DataFrame, path: str, fmt: str = "csv") -> str:
    return write_table(findings, path, fmt)


def sink_json_summary(summary: DataFrame, path: str) -> str:
    """The one-row nested summary as a JSON document (one part file)."""
    return write_table(summary.coalesce(1), path, "json")


def sink_rejects(rejects: DataFrame, path: str) -> str:
    """The records that could not be read, one JSON line each."""
    return write_table(rejects, path, "json")


def load_counts(report: dict):
    """Counts of :func:`flowlens.sources.rejects.load_checked` as a struct column."""
    return F.struct(*[F.lit(int(v)).cast("long").alias(k) for k, v in report.items()])


def sink_train_metadata(spark, path: str, n_rows: int, features: list, contamination: float,
                        statistics: DataFrame, report: dict | None = None) -> str:
    """rows, features, contamination and data statistics as one JSON row; with
    ``report`` the counts of rejected rows and unread values (``input``)."""
    meta = statistics.select(
        F.lit(int(n_rows)).cast("long").alias("training_samples"),
        F.array(*[F.lit(f) for f in features]).alias("features"),
        F.lit(float(contamination)).alias("contamination"),
        F.struct(*statistics.columns).alias("data_statistics"),
        *([load_counts(report).alias("input")] if report else []))
    return write_table(meta.coalesce(1), path, "json")


def sink_converted(converted: DataFrame, path: str) -> str:
    return write_table(converted, path, "csv")
