"""Closed (source, window) groups of a flow stream, equal to the batch groups.

One stateful aggregation keeps a row per (window, source, destination, port), at
most one per flow, in append mode: a window's rows leave the state once, all in
the same trigger, when the watermark has passed its end. That trigger brings
them together by (window, source) in one more shuffle; inside its tasks each
becomes a row for its destination and one for its port, which are de-duplicated
and counted. So no group is scored twice, state is dropped with its window, and
a scanner's state is spread by what it contacted, not held under its address.

A trigger's groups are written beside ``groups`` and moved there when they are
complete (:func:`_put`), so a trigger repeated after a failure adds none twice.

Late rows (their window ended before the watermark) are dropped by Spark. How
many: :func:`late_flows`, the flows read less the flows of all emitted groups,
which also counts the windows still open, so it is exact once the stream is
drained; Spark's own count (rows of the aggregation) is in the progress of the
query.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.timefns import dt_hour, dt_weekday
from flowlens.operators.common import tidy
from flowlens.operators.exfil import flt_outbound, flt_suspicious_protocol
from flowlens.operators.features import night_flag, weekend_flag
from flowlens.schema import EXFIL_WINDOW_S, LATERAL_WINDOW_S
from flowlens.streaming.state import state_on_disk

DEFAULT_DELAY = "10 minutes"
FLOWS_READ = "flows_read"


def _closed_pairs(flows: DataFrame, width_s: int, delay: str, sums: list) -> DataFrame:
    """(window, source, destination, port) rows of a stream's closed windows, with ``sums``."""
    return (flows.withWatermark("timestamp", delay).where(F.col("src_ip").isNotNull())
            .groupBy(F.window("timestamp", f"{width_s} seconds").alias("window"), "src_ip", "dst_ip", "dst_port")
            .agg(F.count(F.lit(1)).alias("_flows"), *sums))


def _by_contact(pairs: DataFrame, sums: list) -> DataFrame:
    """(window, source, contact) rows of closed pairs, a group's in one task, with
    ``sums``, which ride on the destination's rows only: each flow has exactly one."""
    contacts = F.explode(F.array(
        F.struct(F.lit("dst").alias("kind"), F.col("dst_ip").cast("string").alias("value")),
        F.struct(F.lit("port").alias("kind"), F.col("dst_port").cast("string").alias("value"))))
    return (pairs.withColumn("time_window", F.col("window.start")).drop("window").repartition("time_window", "src_ip")
            .select("*", contacts.alias("_contact"))
            .groupBy("time_window", "src_ip", F.col("_contact.kind").alias("_kind"), F.col("_contact.value").alias("_value"))
            .agg(F.sum("_flows").alias("_flows"), *sums))


def _distinct(kind: str):
    return F.count_if((F.col("_kind") == kind) & F.col("_value").isNotNull()).cast("long")


def _carried(how, name: str):
    return how(F.when(F.col("_kind") == "dst", F.col(name)))


def _again(how, *names: str) -> list:
    return [how(n).alias(n) for n in names]


def stream_lateral_pairs(flows: DataFrame, delay: str = DEFAULT_DELAY, width_s: int = LATERAL_WINDOW_S) -> DataFrame:
    """What :func:`lateral_groups` needs of a stream's closed windows."""
    rows = flows.select("timestamp", "src_ip", "dst_ip", "dst_port", "packets", "bytes", "duration")
    return _closed_pairs(rows, width_s, delay, [
        F.sum("packets").alias("_packets"), F.sum("bytes").alias("_bytes"),
        F.sum("duration").alias("_duration"), F.count("duration").alias("_durations")])


def lateral_groups(pairs: DataFrame) -> DataFrame:
    """As :func:`flowlens.operators.lateral.agg_lateral`, with ``flows``, the rows in the group."""
    return (_by_contact(pairs, _again(F.sum, "_packets", "_bytes", "_duration", "_durations"))
            .groupBy("time_window", "src_ip")
            .agg(_distinct("dst").alias("unique_dsts"), _distinct("port").alias("unique_ports"),
                 _carried(F.sum, "_packets").cast("long").alias("packets"),
                 _carried(F.sum, "_bytes").cast("long").alias("bytes"),
                 F.try_divide(_carried(F.sum, "_duration"), _carried(F.sum, "_durations")).alias("avg_duration"),
                 _carried(F.sum, "_flows").alias("flows"))
            .select("src_ip", "time_window", "unique_dsts", "unique_ports", "packets", "bytes", "avg_duration", "flows"))


def stream_exfil_pairs(flows: DataFrame, delay: str = DEFAULT_DELAY, width_s: int = EXFIL_WINDOW_S) -> DataFrame:
    """What :func:`exfil_groups` needs of a stream's closed windows."""
    rows = flows if "protocol" in flows.columns else flows.withColumn("protocol", F.lit("TCP"))
    rows = rows.select("timestamp", "src_ip", "dst_ip", "dst_port", "protocol", "bytes", "packets", "duration") \
        .where(flt_outbound())
    return _closed_pairs(rows, width_s, delay, [
        F.sum("packets").alias("_packets"), F.sum("bytes").alias("_bytes"), F.sum("duration").alias("_duration"),
        F.max(night_flag(dt_hour("timestamp"))).alias("_night"),
        F.max(weekend_flag(dt_weekday("timestamp"))).alias("_weekend"),
        F.count_if(flt_suspicious_protocol()).alias("_suspicious")])


def exfil_groups(pairs: DataFrame) -> DataFrame:
    """As :func:`flowlens.operators.exfil.agg_exfil`, with ``flows``, the rows in the group."""
    return (_by_contact(pairs, [*_again(F.sum, "_packets", "_bytes", "_duration", "_suspicious"),
                                *_again(F.max, "_night", "_weekend")])
            .groupBy("time_window", "src_ip")
            .agg(_carried(F.sum, "_bytes").cast("long").alias("bytes_out"),
                 _carried(F.sum, "_packets").cast("long").alias("packets_out"),
                 _distinct("dst").alias("unique_external_dsts"), _distinct("port").alias("unique_ports"),
                 _carried(F.sum, "_duration").alias("total_duration"),
                 F.max("_night").alias("is_night"), F.max("_weekend").alias("is_weekend"),
                 _carried(F.sum, "_suspicious").cast("long").alias("suspicious_protocol_count"),
                 _carried(F.sum, "_flows").alias("flows"))
            .select("src_ip", "time_window", "bytes_out", "packets_out", "unique_external_dsts", "unique_ports",
                    "total_duration", "is_night", "is_weekend", "suspicious_protocol_count", "flows"))


GROUP_STREAMS = {"lateral": (stream_lateral_pairs, lateral_groups), "exfil": (stream_exfil_pairs, exfil_groups)}


def _put(groups: DataFrame, batch: int, out_dir: str) -> None:
    """Add a trigger's groups to ``out_dir/groups`` as a whole and once: the complete
    folder of the trigger is renamed into place, then its files are moved, and it
    stays, empty, as the sign that they were. A trigger that is repeated finds it."""
    hadoop, spark = groups.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path, groups.sparkSession
    done, target = (hadoop(os.path.join(out_dir, name)) for name in (f"_group_batches/{batch}", "groups"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(done):
        groups.write.format("noop").mode("overwrite").save()      # the state of this trigger
    else:
        writing = hadoop(os.path.join(out_dir, f"_group_batches/.{batch}"))
        groups.write.mode("overwrite").parquet(writing.toString())
        if not fs.rename(writing, done):
            raise OSError(f"{writing.toString()} can't be renamed")
    fs.mkdirs(target)
    for file in fs.listStatus(done):
        name = file.getPath().getName()
        if name.startswith("part-") and not fs.rename(file.getPath(), hadoop(target, name)):
            raise OSError(f"{name} can't be moved to {target.toString()}")
    tidy(spark)


def start_groups(flows: DataFrame, kind: str, out_dir: str, delay: str = DEFAULT_DELAY,
                 available_now: bool = False, checkpoint: str | None = None):
    """Write the closed groups of a flow stream (``kind``: lateral or exfil) to
    ``out_dir/groups``, each once, also over restarts with the same checkpoint
    (``out_dir/_groups_checkpoint`` by default). Returns the ``StreamingQuery``."""
    pairs, groups = GROUP_STREAMS[kind]
    read = flows.where(flt_outbound()) if kind == "exfil" else flows
    read = read.where("timestamp is not null and src_ip is not null") \
        .observe(FLOWS_READ, F.count(F.lit(1)).alias("flows"))
    writer = pairs(read, delay).writeStream.outputMode("append") \
        .foreachBatch(lambda closed, batch: _put(groups(closed), batch, out_dir)) \
        .option("checkpointLocation", checkpoint or os.path.join(out_dir, "_groups_checkpoint"))
    with state_on_disk(flows.sparkSession, unload=available_now):
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def progress_rows(query) -> list:
    """``(batch, watermark, flows read, rows dropped as late)`` of the query's recent triggers."""
    out = []
    for p in query.recentProgress:
        seen = p.observedMetrics.get(FLOWS_READ)
        out.append((p.batchId, p.eventTime.get("watermark"), seen["flows"] if seen else 0,
                    sum(s.numRowsDroppedByWatermark for s in p.stateOperators)))
    return out


def late_flows(spark: SparkSession, flows_read: int, out_dir: str) -> int:
    """Flows read less those of the emitted groups: dropped as late, or in windows still open."""
    return flows_read - (spark.read.parquet(os.path.join(out_dir, "groups")).agg(F.sum("flows")).first()[0] or 0)
