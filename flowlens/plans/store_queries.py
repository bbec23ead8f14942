"""Registered queries of stored results, streams, exact order statistics and the
trained end-to-end job.

Each writes what it reads back (tables, models, streams) under the shared
checkpoint folder, from the driver's tables. The trained reports have no oracle
SQL: a forest's random draws are not SQL.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import distinct_sketches as sketches
from flowlens.operators import exfil, lateral
from flowlens.operators.common import drop_tables, materialize, release_shuffles, settled, track_table
from flowlens.operators.forest import iforest_score, model_load, model_save, risk_band, score_summary
from flowlens.operators.quantiles import exact_quantile
from flowlens.operators.summary import attack_summary, protocol_counts, recommendations
from flowlens.operators.topk import report_exfil, report_lateral, topk_anomalies
from flowlens.plans import model_queries as M
from flowlens.plans import oracle_sql as O
from flowlens.plans import sinks, time_store
from flowlens.plans.catalog import hashable, out_path
from flowlens.plans.staged import _fs
from flowlens.sources.fixtures import flows_from_lineitem
from flowlens.streaming import flagged_groups, start_groups, start_thresholds

DAY_S = 86_400
FIRST_DAY = 1_704_067_200        # 2024-01-01, the first day of the flow fixture
TRIGGER_BYTES = 1 << 30          # of flow files, whose rows a trigger of a stream shuffles at once
TRIGGERS = 8                     # at most about so many, as each reads the state


def _micro_flows(spark: SparkSession, sf: str) -> DataFrame:
    """The flows at times with microseconds."""
    return flows_from_lineitem(spark, sf).withColumn(
        "timestamp", F.timestamp_micros(F.unix_micros("timestamp") + (F.col("src_port") * 7919 + F.col("bytes")) % 1_000_000))


def _micros(df: DataFrame) -> DataFrame:
    return df.select(F.unix_micros("timestamp").alias("micros"), "src_ip", "dst_ip", "src_port", "dst_port", "bytes")


_MICROS_CTE = f"""{O.FLOWS_CTE}, exact AS (SELECT epoch(timestamp)::BIGINT * 1000000
    + (src_port * 7919 + bytes) % 1000000 AS micros, src_ip, dst_ip, src_port, dst_port, bytes FROM flows)"""


def q_sink_csv_micros(spark, sf):
    """CSV results keep the microseconds of their times."""
    f = _micro_flows(spark, sf)
    path = sinks.write_table(f, out_path(spark, "micros"), "csv")
    return _micros(sinks.read_table(spark, path, "csv", f.schema))


def q_sort_time(spark, sf):
    """Positions of every instant's rows in the time-sorted table."""
    path = time_store.write_sorted(_micro_flows(spark, sf), out_path(spark, "sorted"), partitions=16)
    return time_store.numbered(spark, path, "i").groupBy(F.unix_micros("timestamp").alias("micros")) \
        .agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n"))


def q_sort_time_range(spark, sf):
    """The second day, read from the files of the sorted table that hold it."""
    path = time_store.write_sorted(_micro_flows(spark, sf), out_path(spark, "sorted"), partitions=16)
    return _micros(time_store.read_sorted(spark, path, FIRST_DAY + DAY_S, FIRST_DAY + 2 * DAY_S))


def q_exact_quantile(spark, sf):
    """Quantiles by narrowed brackets (a slice of 100 rows, so that brackets are needed)."""
    f = materialize(flows_from_lineitem(spark, sf).select("bytes", "duration"), "quantile-columns")
    out = [(c, q, exact_quantile(f, c, q, slice_rows=100)) for c in ("bytes", "duration") for q in (0.0, 0.05, 0.5, 0.999)]
    return hashable(spark.createDataFrame(out, "name string, q double, quantile double"))


def q_protocol_counts(spark, sf):
    return protocol_counts(flows_from_lineitem(spark, sf))


def q_distinct_sketches(spark, sf):
    """Sketches of every hour merged over 24 hours: exact sums, and whether the
    estimates lie within four standard errors (and one) of the exact counts."""
    f = flows_from_lineitem(spark, sf)
    path = sketches.store_sketches(f, out_path(spark, "sketches"))
    merged = sketches.merged_counts(spark, path, hours=24)
    exact = lateral.agg_lateral(f, DAY_S).select("src_ip", "time_window", F.col("unique_dsts").alias("d"),
                                                 F.col("unique_ports").alias("p"))
    bound = 4 * sketches.standard_error()
    near = [F.abs(F.col(est) - F.col(true)) <= 1 + bound * F.col(true)
            for est, true in (("unique_dsts", "d"), ("unique_ports", "p"))]
    return hashable(merged.join(exact, ["src_ip", "time_window"]).select(
        "src_ip", "time_window", "flows", "bytes", "packets", near[0].alias("dsts_near"), near[1].alias("ports_near")))


def q_report_lateral(spark, sf):
    return hashable(report_lateral(lateral.detect_lateral(flows_from_lineitem(spark, sf))))


def q_report_exfil(spark, sf):
    return hashable(report_exfil(exfil.detect_exfil(flows_from_lineitem(spark, sf))))


def q_sink_json_summary(spark, sf):
    """The summary written as a JSON document and read back."""
    summary = M._summary(spark, sf)
    path = sinks.sink_json_summary(summary, out_path(spark, "summary"))
    return M.flat_summary(spark.read.schema(summary.schema).json(path))


def q_model_save_load(spark, sf):
    """A forest saved, loaded and applied."""
    path = out_path(spark, "model")
    model_save(M._literal_forest(), spark, path)
    return hashable(iforest_score(model_load(spark, path), flows_from_lineitem(spark, sf))
                    .select("src_ip", "dst_port", "bytes", "anomaly_score", "is_anomaly"))


def _streamed(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """The flows as a stream of files; a row far in the future then closes every window."""
    flows, folder = flows_from_lineitem(spark, sf), out_path(spark, f"stream-{kind}")
    landing, out = os.path.join(folder, "landing"), os.path.join(folder, "out")
    future = flows.limit(1).withColumns({"timestamp": F.lit("2099-01-01").cast("timestamp"), "src_ip": F.lit("10.9.9.9"),
                                         "dst_ip": F.lit("203.0.113.9")})
    for part in (flows, future):
        part.write.mode("append").parquet(landing)
        fs, hadoop = _fs(spark, landing)
        at_once = max(TRIGGER_BYTES, fs.getContentSummary(hadoop(landing)).getLength() // TRIGGERS)
        arrived = spark.readStream.schema(flows.schema).options(cleanSource="delete", maxBytesPerTrigger=at_once) \
            .parquet(landing)
        start_groups(arrived, kind, out, delay="30 days", available_now=True).awaitTermination()
        release_shuffles(spark)
    for consumed in (landing, os.path.join(out, "_groups_checkpoint")):
        track_table(consumed)
        drop_tables(spark, [consumed])
    start_thresholds(spark, kind, out, available_now=True).awaitTermination()
    return hashable(flagged_groups(spark, kind, out))


def q_stream_lateral(spark, sf):
    return _streamed(spark, sf, "lateral")


def q_stream_exfil(spark, sf):
    return _streamed(spark, sf, "exfil")


def q_trained_score_summary(spark, sf):
    """Train and score, then the anomaly rate."""
    return hashable(score_summary(M._scored(spark, sf)))


def q_trained_risk_band(spark, sf):
    return M._scored(spark, sf).groupBy(risk_band().alias("risk_band")).agg(F.count(F.lit(1)).alias("flows"))


def q_trained_topk_anomalies(spark, sf):
    return hashable(topk_anomalies(M._scored(spark, sf), 10))


def _trained_summary(spark, sf) -> DataFrame:
    from flowlens.plans.concurrent import run_detectors
    scored, features = M._scored(spark, sf), M._trained_on(spark, sf)

    def build() -> DataFrame:
        detected = run_detectors(features)
        release_shuffles(spark)
        return attack_summary(scored, *detected)
    return settled(spark, "trained-summary", build)


def q_trained_attack_summary(spark, sf):
    """Train, score, detect, report."""
    return M.flat_summary(_trained_summary(spark, sf))


def q_trained_recommendations(spark, sf):
    return recommendations(_trained_summary(spark, sf))


STORE_QUERIES = {
    "sink_csv_micros": q_sink_csv_micros, "sort_time": q_sort_time, "sort_time_range": q_sort_time_range,
    "exact_quantile": q_exact_quantile, "protocol_counts": q_protocol_counts,
    "distinct_sketches": q_distinct_sketches, "report_lateral": q_report_lateral, "report_exfil": q_report_exfil,
    "sink_json_summary": q_sink_json_summary, "model_save_load": q_model_save_load,
    "stream_lateral": q_stream_lateral, "stream_exfil": q_stream_exfil,
    "trained_score_summary": q_trained_score_summary, "trained_risk_band": q_trained_risk_band,
    "trained_topk_anomalies": q_trained_topk_anomalies, "trained_attack_summary": q_trained_attack_summary,
    "trained_recommendations": q_trained_recommendations,
}

STORE_ORACLE = {
    "sink_csv_micros": f"WITH {_MICROS_CTE} SELECT * FROM exact",
    "sort_time": f"""WITH {_MICROS_CTE}, n AS (SELECT micros, count(*) AS n FROM exact GROUP BY micros)
        SELECT micros, CAST(sum(n) OVER (ORDER BY micros) - n AS BIGINT) AS first,
          CAST(sum(n) OVER (ORDER BY micros) - 1 AS BIGINT) AS last, n FROM n""",
    "sort_time_range": f"""WITH {_MICROS_CTE} SELECT * FROM exact
        WHERE micros >= {(FIRST_DAY + DAY_S) * 1_000_000} AND micros < {(FIRST_DAY + 2 * DAY_S) * 1_000_000}""",
    "exact_quantile": f"WITH {O.FLOWS_CTE} " + " UNION ALL ".join(
        f"SELECT '{c}' AS name, {q}::DOUBLE AS q, round(quantile_cont({c}::DOUBLE, {q}), 6) AS quantile FROM flows"
        for c in ("bytes", "duration") for q in (0.0, 0.05, 0.5, 0.999)),
    "protocol_counts": f"WITH {O.FLOWS_CTE} SELECT protocol, count(*) AS count FROM flows GROUP BY protocol",
    "distinct_sketches": f"""WITH {O.FLOWS_CTE} SELECT src_ip, epoch(timestamp)::BIGINT // 86400 * 86400 AS time_window,
        count(*) AS flows, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets,
        true AS dsts_near, true AS ports_near FROM flows GROUP BY 1, 2""",
    "report_lateral": f"""WITH {O.LATERAL_CTE} SELECT src_ip, unique_dsts, unique_ports, round(lateral_score, 6) AS lateral_score,
        is_port_scan, is_host_scan FROM lat_out WHERE is_lateral_movement = 1
        ORDER BY lat_out.lateral_score DESC, src_ip, time_window LIMIT 5""",
    "report_exfil": f"""WITH {O.EXFIL_CTE} SELECT src_ip, round(mb_transferred, 6) AS mb_transferred, unique_external_dsts,
        round(exfil_score, 6) AS exfil_score, is_large_transfer, is_unusual_time FROM exfil WHERE is_exfiltration = 1
        ORDER BY exfil.exfil_score DESC, src_ip, time_window LIMIT 5""",
    "sink_json_summary": M.MODEL_ORACLE["attack_summary"],
    "model_save_load": M.MODEL_ORACLE["iforest_score_literal"],
    "stream_lateral": f"WITH {O.LATERAL_CTE} SELECT {O.LATERAL_OUT} FROM lat_out",
    "stream_exfil": f"WITH {O.EXFIL_CTE} SELECT {O.EXFIL_OUT} FROM exfil",
}
