"""Shared building blocks of the detectors."""

from __future__ import annotations

import gc
import os
import time
import uuid
from collections.abc import Iterable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.timefns import time_bucket
from flowlens.operators.features import has_timestamp

# Scores are compared after rounding to this many places, so a group sitting
# exactly on a threshold does not flip with the summation order.
SCORE_PLACES = 9
NO_TIME_WINDOW = 0  # epoch second used as the single window without timestamps
# Rows that a group-by with distinct counts shuffles at once (it writes each several
# times), and the most portions, each of which reads the input.
PORTION_ROWS = 10_000_000
MAX_PORTIONS = 16


_CREATED: list = []   # paths written by materialize() in this process, oldest first
_RUN: ContextVar[list | None] = ContextVar("flowlens_run_tables", default=None)
_TIDY: ContextVar[bool] = ContextVar("flowlens_tidy", default=False)     # inside settled()
_TIDY_EVERY_S = 3.0
_LAST_RELEASE = [0.0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder
    (``spark.checkpoint.dir``) and return a frame reading it back.

    Used for the grouped tables that several whole-input scalars read: the
    aggregation over the input then runs once instead of once per consumer
    (column pruning makes the consumers' plans differ, so exchange reuse
    cannot merge them), and the lineage is cut, so a lost executor costs a
    re-read rather than a re-aggregation. The table stays until
    :func:`drop_tables` or the end of the :class:`Scratch` it was written in.
    """
    from flowlens.session import checkpoint_dir
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"flowlens-{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    track_table(path)
    if _TIDY.get():
        tidy(spark)
    return _read_stored(spark, df.schema, path)


def _read_stored(spark, schema, path: str) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out.stored_path = path
    return out


def portions(df: DataFrame, *keys) -> list[DataFrame]:
    """``df`` cut by a hash of ``keys`` into parts of about :data:`PORTION_ROWS` rows, at most
    :data:`MAX_PORTIONS`: a group that has the keys among its own is in one part. Rows are
    counted once."""
    parts = min(MAX_PORTIONS, -(-df.count() // PORTION_ROWS))
    if parts <= 1:
        return [df]
    part = F.pmod(F.xxhash64(*keys), F.lit(parts))
    return [df.where(part == i) for i in range(parts)]


def group_portions(df: DataFrame, width_s: int) -> list[DataFrame]:
    """:func:`portions` of flows by source and time window (by source without times)."""
    return portions(df, "src_ip", *([time_bucket("timestamp", width_s)] if has_timestamp(df) else []))


def materialize_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """:func:`materialize` of the rows of all ``parts``, written one after the
    other: the shuffle files of a part are freed before the next one's are made."""
    first = None
    for part in parts:
        if first is None:
            first = materialize(part, name)
        else:
            release_shuffles(first.sparkSession)
            part.write.mode("append").parquet(first.stored_path)
    return _read_stored(first.sparkSession, first.schema, first.stored_path)    # lists the files of all parts


def drop_stored(table: DataFrame) -> None:
    """Delete the folder of a frame that :func:`materialize` returned, which nothing reads any more."""
    drop_tables(table.sparkSession, [table.stored_path])


def track_table(path: str) -> None:
    """Count a folder this process wrote among the intermediate tables."""
    _CREATED.append(path)
    if _RUN.get() is not None:
        _RUN.get().append(path)


class Scratch:
    """Deletes the intermediate tables written inside it, and only those, at
    its end (also on failure): ``with Scratch(spark): ...``. Runs on other
    threads and nested ones keep their own lists."""

    def __init__(self, spark, keep: bool = False):
        self.spark, self.keep = spark, keep

    def __enter__(self):
        self.paths: list = []
        self.kept: list = []
        self.token = _RUN.set(self.paths)
        return self

    def keep_table(self, table: DataFrame) -> None:
        """Hand a stored frame to whoever is outside; a frame that was not
        stored inside is theirs already."""
        path = getattr(table, "stored_path", None)
        if path in self.paths:
            self.paths.remove(path)
            self.kept.append(path)

    def __exit__(self, *exc):
        _RUN.reset(self.token)
        if self.keep:
            self.kept, self.paths = self.kept + self.paths, []
        drop_tables(self.spark, self.paths)
        if _RUN.get() is not None:
            _RUN.get().extend(self.kept)
        return False


def settled(spark, name: str, build) -> DataFrame:
    """Store the frame that ``build()`` returns and delete the intermediate
    tables written on the way to it (also on failure): only the result stays,
    until :func:`drop_tables` or the end of the caller's :class:`Scratch`. Shuffle
    files of its finished jobs are freed as it goes on."""
    tidy = _TIDY.set(True)
    try:
        with Scratch(spark) as run:
            out = materialize(build(), name)
            run.keep_table(out)
    finally:
        _TIDY.reset(tidy)
    release_shuffles(spark)
    return out


def release_shuffles(spark) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so when
    their plans are collected as garbage, here and in the driver's JVM, which a
    driver with a large heap may put off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _LAST_RELEASE[0] = time.monotonic()


def tidy(spark) -> None:
    """:func:`release_shuffles`, at most every few seconds."""
    if time.monotonic() - _LAST_RELEASE[0] > _TIDY_EVERY_S:
        release_shuffles(spark)


def created_tables() -> list:
    """Intermediate tables written so far (for :func:`drop_tables`)."""
    return list(_CREATED)


def drop_tables(spark, paths) -> int:
    """Delete intermediate tables this process wrote with :func:`materialize`
    (only those: any other path is ignored), through the Hadoop file system
    so it works on any shared store. Returns the number deleted."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for p in paths:
        if p not in _CREATED:
            continue
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).delete(hp, True):
            n += 1
        _CREATED.remove(p)
    return n


def with_scalars(df: DataFrame, *aggs: Column) -> DataFrame:
    """Attach whole-input aggregates (max, mean, std, quantile) to every row.

    The aggregate is a single row -- a proven size bound -- so it is
    broadcast and joined without a key (no unpartitioned window, which would
    pull all rows into one task).
    """
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def add_time_window(df: DataFrame, width_s: int, name: str = "time_window") -> DataFrame:
    """Tumbling epoch-aligned window start; a constant when there is no time."""
    if has_timestamp(df):
        return df.withColumn(name, time_bucket("timestamp", width_s))
    return df.withColumn(name, F.timestamp_seconds(F.lit(NO_TIME_WINDOW)))


def above_sigma(score: str, k: float, mean_col: str = "_mean", std_col: str = "_std") -> Column:
    """``score > mean + k * std`` on rounded values; NULL std (one group) -> False."""
    thr = F.col(mean_col) + F.lit(float(k)) * F.col(std_col)
    return F.coalesce(F.round(F.col(score), SCORE_PLACES) > F.round(thr, SCORE_PLACES),
                      F.lit(False))


def moments(score: str) -> list[Column]:
    return [F.avg(score).alias("_mean"), F.stddev_samp(score).alias("_std")]


def quantiles(q: float, **columns: str) -> list[Column]:
    """Exact ``q`` quantile (linear interpolation) of each column, by output name."""
    return [F.percentile(c, q).alias(name) for name, c in columns.items()]


def weighted_sum(weights) -> Column:
    """Sum of column x weight, added left to right in the listed order."""
    expr = None
    for col, w in weights:
        term = F.col(col) * w
        expr = term if expr is None else expr + term
    return expr


def distinct_count(col: str, exact: bool = True, rsd: float = 0.01) -> Column:
    """Distinct non-null values of ``col``: exact by default; with
    ``exact=False`` a HyperLogLog++ estimate (relative sd ``rsd``), which
    needs no row expansion, for very large inputs."""
    return F.countDistinct(col) if exact else F.approx_count_distinct(col, rsd)
