"""Spark session defaults and the shared checkpoint location."""

from __future__ import annotations

import os
import re
import tempfile
import threading
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock for windows, ANSI on (the
# operators use try_* functions where pandas would yield inf/NaN), AQE for
# runtime coalescing, skew splitting and broadcast conversion.
_CKPT_LOCK = threading.Lock()

# Batches are bounded in bytes as well as in rows: executors hold one or two of
# each Python step and column batch of nested vectors outside the sort and
# aggregation memory that Spark accounts for.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.parquet.columnarReaderBatchSize": "256",
}

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app_name: str = "flowlens",
              shuffle_partitions: int | None = None,
              extra_conf: dict | None = None) -> SparkSession:
    """Return the active session, or build one with :data:`SESSION_CONF`.

    On a cluster the master and sizing come from ``spark-submit``; only the
    semantic settings above are forced.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in SESSION_CONF.items():
        if not k.startswith("spark.ui."):
            spark.conf.set(k, v)
    return spark


@contextmanager
def small_batches(spark: SparkSession):
    """:data:`BATCH_CONF` for the plans that run inside."""
    before = {k: spark.conf.get(k) for k in BATCH_CONF}
    for k, v in BATCH_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster). When it is unset,
    a local session (``local``, ``local[n]``) gets a fresh scratch folder; any
    other master raises, as a machine-local folder is not shared.
    """
    sc = spark.sparkContext
    with _CKPT_LOCK:
        current = sc.getCheckpointDir()
        if current:
            return current
        path = sc.getConf().get("spark.checkpoint.dir", None)
        if not path:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="flowlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path


def cluster_conf(input_bytes: int, total_cores: int, split_bytes: int = 256 * 1024 * 1024,
                 shuffle_ratio: float = 0.1) -> dict:
    """Suggested sizing for ``input_bytes`` of flows on ``total_cores`` cores.

    Scan splits of ``split_bytes``; shuffle partitions sized for the
    post-partial-aggregation shuffle (``shuffle_ratio`` of the input, about
    200 MB each, at least two per core), which AQE coalesces when smaller;
    skew splitting above 256 MB and 5x the median partition.
    """
    shuffle_bytes = max(1, int(input_bytes * shuffle_ratio))
    partitions = max(2 * total_cores, shuffle_bytes // (200 * 1024 * 1024))
    return {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.shuffle.partitions": str(int(partitions)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * 1024 * 1024),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }
