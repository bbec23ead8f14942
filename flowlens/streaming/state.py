"""State of the streams on disk.

Spark keeps a stateful operator's rows in the executors' heap by default. A
stream whose windows stay open for long holds a row per (window, source,
contact) there, which grows with the flows and ends in garbage collection. The
RocksDB provider keeps them in files beside the shuffle files, in a bounded
share of native memory per executor, and a copy in the checkpoint. A run that
ends by itself keeps no other copy than that from one trigger to the next.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"
_SETTINGS = {
    PROVIDER: ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "1000",
    # a count of the state's rows would look every key up before it is written
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.minBatchesToRetain": "2",
}
UNLOAD = "spark.sql.streaming.stateStore.unloadOnCommit"


@contextmanager
def state_on_disk(spark: SparkSession, partitions: int | None = None, unload: bool = False):
    """Start a query inside: it takes its state settings from the session then
    (a restart takes those of its checkpoint). ``partitions``: of its state;
    ``unload``: a task's working copy of the state goes with the task."""
    settings = _SETTINGS | {UNLOAD: str(unload).lower()} | ({PARTITIONS: str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
