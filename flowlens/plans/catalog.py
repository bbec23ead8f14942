"""Registered queries: one per operator of the inventory, each reading the
driver's tables (through the fixture views) and returning a DataFrame.

Output conventions shared with :mod:`flowlens.plans.oracle_sql`: doubles
rounded to 6 places, timestamps as epoch seconds (BIGINT), arrays as
comma-joined text. :func:`hashable` applies them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.ip import is_private_ip
from flowlens.functions.protocol import proto_label
from flowlens.functions.timefns import time_bucket
from flowlens.operators import exfil as ex
from flowlens.operators import ics
from flowlens.operators import lateral as lat
from flowlens.operators.common import materialize, moments
from flowlens.operators.features import (default_protocol, extract_features, fill_missing, join_fanout, preprocess,
                                         select_features, select_numeric)
from flowlens.operators.flows_rollup import agg_flows
from flowlens.operators.stats import stats
from flowlens.operators.summary import agg_value_counts, bytes_at_risk, threat_counts, topk_destinations
from flowlens.operators.timestamps import normalize_timestamp, synthesize_timestamp
from flowlens.operators.topk import head_findings, topk_exfil, topk_lateral
from flowlens.plans import oracle_sql as O
from flowlens.plans import sinks
from flowlens.sources.fixtures import (assets_from_supplier, flows_from_lineitem, packet_list_from_lineitem,
                                       packets_from_lineitem, read_table)
from flowlens.schema import TRAINING_FEATURES
from flowlens.sources.packet_list import convert_packet_list, converted_summary

Query = Callable[[SparkSession, str], DataFrame]


def hashable(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, timestamps to epoch seconds, arrays to text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, places)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_seconds(c.cast("timestamp"))
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _flows(spark, sf):
    return flows_from_lineitem(spark, sf)


def _features(spark, sf):
    return extract_features(_flows(spark, sf))


# --- sources / projections ----------------------------------------------------

def q_extract_features(spark, sf):
    return hashable(_features(spark, sf))


def q_preprocess(spark, sf):
    # raw text timestamps: epoch seconds for even source ports, ISO text otherwise
    raw = _flows(spark, sf).withColumn(
        "timestamp",
        F.when(F.col("src_port") % 2 == 0, F.unix_seconds("timestamp").cast("string"))
         .otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")))
    return hashable(preprocess(raw))


def _round_trip(spark, sf, fmt):
    """The fixture written as text files under the shared checkpoint folder
    (timestamps as epoch-second text) and read back with the flow reader. The
    text is parsed once: the preprocessing reads its rows several times."""
    from flowlens.session import checkpoint_dir
    from flowlens.sources.flows import read_flows
    path = os.path.join(checkpoint_dir(spark), f"flowlens-src-{fmt}-{uuid.uuid4().hex[:12]}.{fmt}")
    out = _flows(spark, sf).withColumn("timestamp", F.unix_seconds("timestamp").cast("string"))
    (out.write.option("header", True).csv(path) if fmt == "csv" else out.write.json(path))
    return materialize(read_flows(spark, path), f"src-{fmt}")


def q_src_csv(spark, sf):
    return hashable(preprocess(_round_trip(spark, sf, "csv"), stored_fanout=True))


def q_src_json(spark, sf):
    return hashable(preprocess(_round_trip(spark, sf, "json"), stored_fanout=True))


def q_scale_fit(spark, sf):
    from flowlens.operators.forest import scale_fit
    n, means, stds = scale_fit(_features(spark, sf), TRAINING_FEATURES)
    row, names = [n], ["n long"]
    for c, m, d in zip(TRAINING_FEATURES, means, stds):
        row += [m, d]
        names += [f"mean_{c} double", f"std_{c} double"]
    return hashable(spark.createDataFrame([tuple(row)], ", ".join(names)))


def q_norm_timestamp(spark, sf):
    raw = _flows(spark, sf).select(
        "src_ip", "dst_ip", "src_port",
        F.when(F.col("src_port") % 3 == 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
         .when(F.col("src_port") % 3 == 1, F.unix_seconds("timestamp").cast("string"))
         .otherwise(F.lit("n/a")).alias("timestamp"))
    return hashable(normalize_timestamp(raw))


def q_fill_missing(spark, sf):
    f = _flows(spark, sf)
    holes = f.select(
        "timestamp", "src_ip", "dst_ip",
        F.when(F.col("src_port") % 5 == 0, F.lit(None)).otherwise(F.col("src_port")).alias("src_port"),
        "dst_port", "protocol",
        F.when(F.col("packets") % 7 == 0, F.lit(None)).otherwise(F.col("bytes")).alias("bytes"),
        "packets",
        F.when(F.col("bytes") % 3 == 0, F.lit(None)).otherwise(F.col("duration")).alias("duration"))
    return hashable(fill_missing(holes))


def q_join_fanout(spark, sf):
    return hashable(join_fanout(_flows(spark, sf)).select(
        "src_ip", "dst_ip", "dst_port", "unique_destinations"))


def q_select_features(spark, sf):
    f = _features(spark, sf)
    return hashable(f.select(*select_features(f)))


def q_select_numeric(spark, sf):
    f = _features(spark, sf)
    return hashable(f.select(*select_numeric(f)))


def q_stats(spark, sf):
    s = stats(_features(spark, sf))
    return hashable(s.select("total_flows", "unique_sources", "unique_destinations", "ics_flows",
                             "total_bytes", "avg_bytes_per_flow",
                             F.col("time_range.start").alias("time_start"),
                             F.col("time_range.end").alias("time_end")))


# Addresses of every range around the private ones, from the part keys.
_ADDRESSES = ["'172.' || CAST(l_partkey % 40 AS VARCHAR(10)) || '.0.1'",
              "'192.' || CAST(160 + l_partkey % 12 AS VARCHAR(10)) || '.1.1'",
              "CAST(l_partkey % 256 AS VARCHAR(10)) || '.168.0.9'", "'127.0.0.' || CAST(l_partkey % 256 AS VARCHAR(10))",
              "'10.' || CAST(l_partkey % 256 AS VARCHAR(10)) || '.1'", "'host' || CAST(l_partkey % 9 AS VARCHAR(10))"]


def q_is_private_ip(spark, sf):
    f = _flows(spark, sf)
    made = read_table(spark, sf, "lineitem").select(F.explode(F.array(*[F.expr(e) for e in _ADDRESSES])).alias("ip"))
    ips = f.select(F.col("src_ip").alias("ip")).union(f.select(F.col("dst_ip").alias("ip"))).union(made).distinct()
    return ips.select("ip", is_private_ip("ip").alias("is_private"))


def q_proto_label(spark, sf):
    p = packets_from_lineitem(spark, sf).select((F.col("dst_port") % 64).alias("proto")).distinct()
    return p.select(F.col("proto").cast("long").alias("proto"), proto_label("proto").alias("label"))


def q_time_windows(spark, sf):
    f = _flows(spark, sf)
    return hashable(f.select("src_ip", "dst_ip", "src_port",
                             time_bucket("timestamp", 300).alias("win_5m"),
                             time_bucket("timestamp", 600).alias("win_10m"),
                             time_bucket("timestamp", 1800).alias("win_30m")))


# --- packets ----------------------------------------------------------------------

def q_agg_flows(spark, sf):
    return hashable(agg_flows(packets_from_lineitem(spark, sf)))


def q_src_packets(spark, sf):
    """Packets view written as pcap bytes per partition, decoded, rolled up.
    A capture carries the transport only, so application names map to TCP."""
    from flowlens.sources.capture_fixtures import packets_to_captures
    from flowlens.sources.packets import decode_binary
    pk = packets_from_lineitem(spark, sf).withColumn(
        "protocol", F.when(F.col("protocol").isin("UDP", "ICMP"), F.col("protocol")).otherwise(F.lit("TCP")))
    caps = packets_to_captures(pk)
    return hashable(agg_flows(decode_binary(caps)))


def q_src_packet_list(spark, sf):
    return hashable(convert_packet_list(packet_list_from_lineitem(spark, sf)))


# Info texts with no, one, too large and two numbers, by packet length.
_INFO = """CASE WHEN bytes % 5 = 1 THEN 'Standard query' WHEN bytes % 5 = 2 THEN 'to port ' || CAST(dst_port AS VARCHAR(10))
  WHEN bytes % 5 = 3 THEN CAST(65000 + dst_port % 20000 AS VARCHAR(10)) || ' > ' || CAST(dst_port AS VARCHAR(10))
  ELSE CAST(src_port AS VARCHAR(10)) || ' > ' || CAST(dst_port AS VARCHAR(10)) || ' [ACK] Seq=1' END"""


def q_extract_ports(spark, sf):
    from flowlens.functions.ports import extract_ports
    pl = packets_from_lineitem(spark, sf).select(F.expr(_INFO).alias("Info"))
    p = extract_ports("Info")
    return pl.select("Info", p.getField("src_port").alias("src_port"), p.getField("dst_port").alias("dst_port"))


def q_order_packet_list(spark, sf):
    """A packet list without times, numbered by its text column ``No``."""
    pl = packet_list_from_lineitem(spark, sf).drop("Time")
    first = F.split("Info", " ")
    keyed = pl.withColumn("No", F.concat_ws("", F.col("Length"), F.lpad(first[0], 5, "0"), F.lpad(first[2], 5, "0")))
    out = convert_packet_list(keyed, order_by="No")
    return hashable(out.agg(F.count("*").alias("n"), F.countDistinct("timestamp").alias("numbers"),
                            F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
                    .crossJoin(F.broadcast(out.where("timestamp < 100").agg(F.sum("bytes").alias("first_bytes")))))


def q_synthesize_timestamp(spark, sf):
    f = synthesize_timestamp(_flows(spark, sf).withColumn("_no", F.col("bytes").cast("string")), order_by="_no")
    return hashable(f.agg(F.count("*").alias("n"), F.countDistinct("timestamp").alias("times"),
                          F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
                          F.sum(F.when(F.col("timestamp") < "2024-01-01 01:40:00", F.col("bytes"))).alias("first_bytes")))


def q_agg_converted_summary(spark, sf):
    return converted_summary(convert_packet_list(packet_list_from_lineitem(spark, sf)))


# --- lateral / exfil ---------------------------------------------------------------

def q_agg_lateral(spark, sf):
    return hashable(lat.agg_lateral(_flows(spark, sf)))


def q_detect_lateral(spark, sf):
    return hashable(lat.detect_lateral(_flows(spark, sf)))


def out_path(spark, name):
    from flowlens.session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), f"flowlens-out-{name}-{uuid.uuid4().hex[:12]}")


def q_sink_lateral(spark, sf):
    return hashable(spark.read.parquet(sinks.sink_lateral(
        lat.detect_lateral(_flows(spark, sf)), out_path(spark, "lateral"), "parquet")))


def q_topk_lateral(spark, sf):
    return hashable(topk_lateral(lat.detect_lateral(_flows(spark, sf)), 5))


def q_flt_outbound(spark, sf):
    return hashable(_flows(spark, sf).where(ex.flt_outbound()))


def q_agg_exfil(spark, sf):
    return hashable(ex.agg_exfil(_flows(spark, sf)))


def q_detect_exfil(spark, sf):
    return hashable(ex.detect_exfil(_flows(spark, sf)))


def q_sink_exfil(spark, sf):
    return hashable(spark.read.parquet(sinks.sink_exfil(
        ex.detect_exfil(_flows(spark, sf)), out_path(spark, "exfil"), "parquet")))


def q_sink_csv(spark, sf):
    f = _flows(spark, sf)
    path = sinks.write_table(f, out_path(spark, "csv"), "csv")
    return hashable(sinks.read_table(spark, path, "csv", f.schema))


def q_sink_converted(spark, sf):
    out = convert_packet_list(packet_list_from_lineitem(spark, sf))
    path = sinks.sink_converted(out, out_path(spark, "converted"))
    return hashable(sinks.read_table(spark, path, "csv", out.schema))


def q_sink_ics(spark, sf):
    return hashable(spark.read.parquet(sinks.sink_ics(
        ics.detect_ics(_features(spark, sf)), out_path(spark, "ics"), "parquet")))


def q_out_overwrite(spark, sf):
    """A table written twice holds the second run's rows only."""
    f, path = _flows(spark, sf), out_path(spark, "twice")
    sinks.write_table(f, path, "parquet")
    return hashable(spark.read.parquet(sinks.write_table(f.where("dst_port = 502"), path, "parquet")))


def q_sink_train_metadata(spark, sf):
    f = _features(spark, sf)
    n = f.count()
    path = sinks.sink_train_metadata(spark, out_path(spark, "metadata"), n, select_features(f), 0.05, stats(f))
    return hashable(spark.read.json(path).select(
        "training_samples", "features", "contamination", F.col("data_statistics.total_flows").alias("total_flows"),
        F.col("data_statistics.unique_sources").alias("unique_sources"),
        F.col("data_statistics.total_bytes").alias("total_bytes")))


def q_default_protocol(spark, sf):
    return hashable(default_protocol(_flows(spark, sf).drop("protocol")).select("src_ip", "dst_port", "protocol"))


def q_topk_exfil(spark, sf):
    return hashable(topk_exfil(ex.detect_exfil(_flows(spark, sf)), 5))


def q_exfil_bytes_at_risk(spark, sf):
    f = _flows(spark, sf)
    return bytes_at_risk(f, ex.detect_exfil(f))


def q_topk_destinations(spark, sf):
    f = _flows(spark, sf)
    return topk_destinations(f, ex.detect_exfil(f), 3)


# --- ICS -----------------------------------------------------------------------------

def q_flt_ics(spark, sf):
    return hashable(_features(spark, sf).where(ics.flt_ics()))


def q_flt_external_ics(spark, sf):
    return hashable(_features(spark, sf).where(ics.flt_external_ics()))


def q_flt_night_ics(spark, sf):
    return hashable(_features(spark, sf).where(ics.flt_night_ics()))


def q_flt_weekend_ics(spark, sf):
    return hashable(_features(spark, sf).where(ics.flt_weekend_ics()))


def _rule(rule_type):
    def q(spark, sf):
        found = ics.detect_ics(_features(spark, sf))
        return hashable(found.where(F.col("type") == rule_type))
    q.__name__ = f"q_rule_{rule_type}"
    return q


def q_agg_ics_diversity(spark, sf):
    return ics.agg_ics_diversity(_features(spark, sf))


def q_ics_high_diversity(spark, sf):
    return ics.ics_high_diversity_devices(_features(spark, sf))


def q_ics_external_ips(spark, sf):
    return hashable(ics.external_ips_first_seen(_features(spark, sf)))


def q_agg_ics_volume(spark, sf):
    return hashable(ics.agg_ics_volume(_features(spark, sf)))


def q_ics_traffic_spike(spark, sf):
    return hashable(ics.ics_volume_spikes(_features(spark, sf)))


def q_agg_ics_port(spark, sf):
    return ics.agg_ics_port(_features(spark, sf))


def q_ics_unusual_protocol(spark, sf):
    return ics.ics_unusual_ports(_features(spark, sf))


def q_agg_quantile(spark, sf):
    return hashable(ics.port_quantiles(ics.agg_ics_port(_features(spark, sf))))


def _flagged_features(spark, sf):
    """Features whose ICS flag a caller has cleared on some flows to ICS ports."""
    return _features(spark, sf).withColumn(
        "is_ics_protocol", F.when(F.col("src_port") % 7 == 0, F.lit(0)).otherwise(F.col("is_ics_protocol")))


def q_ics_unauthorized(spark, sf):
    found = ics.detect_ics(_flagged_features(spark, sf))
    return hashable(found.where(F.col("type") == "unauthorized_access"))


def q_flt_unauthorized(spark, sf):
    return hashable(_flagged_features(spark, sf).where(ics.flt_unauthorized()).select("src_ip", "dst_ip", "dst_port"))


def q_detect_ics(spark, sf):
    return hashable(ics.detect_ics(_features(spark, sf)))


def q_flt_critical(spark, sf):
    return hashable(ics.flt_critical(ics.detect_ics(_features(spark, sf))))


def q_head_findings(spark, sf):
    return hashable(head_findings(ics.detect_ics(_features(spark, sf)), 10))


def q_agg_severity_counts(spark, sf):
    return ics.agg_severity_counts(ics.detect_ics(_features(spark, sf)))


def q_join_assets(spark, sf):
    f = _features(spark, sf)
    found = ics.detect_ics(f, assets=assets_from_supplier(spark, sf))
    return hashable(found.where(F.col("type") == "unauthorized_access"))


# --- summary pieces --------------------------------------------------------------------

def q_agg_value_counts(spark, sf):
    return agg_value_counts(_flows(spark, sf), "protocol")


def q_agg_moments(spark, sf):
    g = lat.detect_lateral(_flows(spark, sf)).agg(*moments("lateral_score"))
    return hashable(g.select(F.col("_mean").alias("mean_score"), F.col("_std").alias("std_score")))


def q_threat_counts(spark, sf):
    from flowlens.plans.concurrent import run_detectors
    f = _features(spark, sf)
    return threat_counts(f, *run_detectors(f))


QUERIES: dict[str, Query] = {
    "extract_features": q_extract_features,
    "preprocess": q_preprocess,
    "norm_timestamp": q_norm_timestamp,
    "src_csv": q_src_csv,
    "src_json": q_src_json,
    "scale_fit": q_scale_fit,
    "fill_missing": q_fill_missing,
    "join_fanout": q_join_fanout,
    "select_features": q_select_features,
    "select_numeric": q_select_numeric,
    "stats": q_stats,
    "is_private_ip": q_is_private_ip,
    "proto_label": q_proto_label,
    "time_windows": q_time_windows,
    "agg_flows": q_agg_flows,
    "src_packets": q_src_packets,
    "src_packet_list": q_src_packet_list,
    "extract_ports": q_extract_ports,
    "order_packet_list": q_order_packet_list,
    "synthesize_timestamp": q_synthesize_timestamp,
    "agg_converted_summary": q_agg_converted_summary,
    "agg_lateral": q_agg_lateral,
    "detect_lateral": q_detect_lateral,
    "sink_lateral": q_sink_lateral,
    "topk_lateral": q_topk_lateral,
    "flt_outbound": q_flt_outbound,
    "agg_exfil": q_agg_exfil,
    "detect_exfil": q_detect_exfil,
    "sink_exfil": q_sink_exfil,
    "sink_csv": q_sink_csv,
    "sink_converted": q_sink_converted,
    "sink_ics": q_sink_ics,
    "sink_train_metadata": q_sink_train_metadata,
    "out_overwrite": q_out_overwrite,
    "default_protocol": q_default_protocol,
    "topk_exfil": q_topk_exfil,
    "exfil_bytes_at_risk": q_exfil_bytes_at_risk,
    "topk_destinations": q_topk_destinations,
    "flt_ics": q_flt_ics,
    "flt_external_ics": q_flt_external_ics,
    "flt_night_ics": q_flt_night_ics,
    "flt_weekend_ics": q_flt_weekend_ics,
    "ics_unusual_time": _rule("unusual_time"),
    "ics_weekend": _rule("weekend_activity"),
    "ics_external": _rule("external_communication"),
    "ics_unauthorized": q_ics_unauthorized,
    "flt_unauthorized": q_flt_unauthorized,
    "agg_ics_diversity": q_agg_ics_diversity,
    "ics_high_diversity": q_ics_high_diversity,
    "ics_external_ips": q_ics_external_ips,
    "agg_ics_volume": q_agg_ics_volume,
    "ics_traffic_spike": q_ics_traffic_spike,
    "agg_ics_port": q_agg_ics_port,
    "ics_unusual_protocol": q_ics_unusual_protocol,
    "agg_quantile": q_agg_quantile,
    "detect_ics": q_detect_ics,
    "flt_critical": q_flt_critical,
    "head_findings": q_head_findings,
    "agg_severity_counts": q_agg_severity_counts,
    "join_assets": q_join_assets,
    "agg_value_counts": q_agg_value_counts,
    "agg_moments": q_agg_moments,
    "threat_counts": q_threat_counts,
}


ORACLE: dict[str, str] = {
    "extract_features": f"WITH {O.FEATURES_CTE} SELECT {O.FEATURE_OUT} FROM features",
    "preprocess": f"WITH {O.FEATURES_CTE} SELECT {O.FEATURE_OUT} FROM features",
    "src_csv": f"WITH {O.FEATURES_CTE} SELECT {O.FEATURE_OUT} FROM features",
    "src_json": f"WITH {O.FEATURES_CTE} SELECT {O.FEATURE_OUT} FROM features",
    "scale_fit": f"WITH {O.FEATURES_CTE} SELECT count(*) AS n, " + ", ".join(
        f"round(avg(CAST({c} AS DOUBLE)), 6) AS mean_{c}, round(CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 "
        f"THEN 1.0 ELSE stddev_pop(CAST({c} AS DOUBLE)) END, 6) AS std_{c}"
        for c in ["bytes", "packets", "duration", "bytes_per_packet", "packets_per_second", "bytes_per_second",
                  "is_ics_protocol", "is_high_port", "is_tcp", "is_udp", "unique_destinations", "hour",
                  "is_night", "is_weekend"]) + " FROM features",
    "norm_timestamp": f"""WITH {O.FLOWS_CTE} SELECT src_ip, dst_ip, src_port,
        CASE WHEN src_port % 3 = 2 THEN NULL ELSE epoch(timestamp)::BIGINT END AS timestamp FROM flows""",
    "fill_missing": f"""WITH {O.FLOWS_CTE} SELECT epoch(timestamp)::BIGINT AS timestamp, src_ip, dst_ip,
        CASE WHEN src_port % 5 = 0 THEN 0 ELSE src_port END AS src_port, dst_port, protocol,
        CASE WHEN packets % 7 = 0 THEN 0 ELSE bytes END AS bytes, packets,
        round(CASE WHEN bytes % 3 = 0 THEN 0.0 ELSE duration END, 6) AS duration FROM flows""",
    "join_fanout": f"""WITH {O.FEATURES_CTE} SELECT src_ip, dst_ip, dst_port, unique_destinations FROM features""",
    "select_features": f"""WITH {O.FEATURES_CTE} SELECT bytes, packets, round(duration, 6) AS duration,
        round(bytes_per_packet, 6) AS bytes_per_packet, round(packets_per_second, 6) AS packets_per_second,
        round(bytes_per_second, 6) AS bytes_per_second, is_ics_protocol, is_high_port, is_tcp, is_udp,
        unique_destinations, hour, is_night, is_weekend FROM features""",
    "select_numeric": f"""WITH {O.FEATURES_CTE} SELECT src_port, dst_port, bytes, packets, round(duration, 6) AS duration,
        is_ics_protocol, round(bytes_per_packet, 6) AS bytes_per_packet,
        round(packets_per_second, 6) AS packets_per_second, round(bytes_per_second, 6) AS bytes_per_second,
        hour, day_of_week, is_night, is_weekend, is_high_port, is_well_known, is_tcp, is_udp,
        unique_destinations FROM features""",
    "stats": f"""WITH {O.FEATURES_CTE} SELECT count(*) AS total_flows, count(DISTINCT src_ip) AS unique_sources,
        count(DISTINCT dst_ip) AS unique_destinations, CAST(COALESCE(sum(is_ics_protocol), 0) AS BIGINT) AS ics_flows,
        CAST(COALESCE(sum(bytes), 0) AS BIGINT) AS total_bytes, round(COALESCE(avg(bytes), 0.0), 6) AS avg_bytes_per_flow,
        epoch(min(timestamp))::BIGINT AS time_start, epoch(max(timestamp))::BIGINT AS time_end FROM features""",
    "is_private_ip": f"""WITH {O.FLOWS_CTE}, ips AS (SELECT src_ip AS ip FROM flows UNION SELECT dst_ip FROM flows
        UNION SELECT unnest([{", ".join(_ADDRESSES)}]) FROM lineitem)
        SELECT ip, {O.private('ip')} AS is_private FROM ips""",
    "proto_label": f"""WITH {O.PACKETS_CTE}, p AS (SELECT DISTINCT CAST(dst_port % 64 AS BIGINT) AS proto FROM packets)
        SELECT proto, CASE WHEN proto = 6 THEN 'TCP' WHEN proto = 17 THEN 'UDP' WHEN proto = 1 THEN 'ICMP'
        ELSE 'IP_' || CAST(proto AS VARCHAR) END AS label FROM p""",
    "time_windows": f"""WITH {O.FLOWS_CTE} SELECT src_ip, dst_ip, src_port, {O.bucket(300)} AS win_5m,
        {O.bucket(600)} AS win_10m, {O.bucket(1800)} AS win_30m FROM flows""",
    "agg_flows": f"""WITH {O.PACKETS_CTE} SELECT epoch(min(timestamp))::BIGINT AS timestamp, src_ip, dst_ip, src_port,
        dst_port, protocol, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets,
        round(CASE WHEN max(timestamp) = min(timestamp) THEN 1.0
              ELSE epoch(max(timestamp)) - epoch(min(timestamp)) END, 6) AS duration
        FROM packets GROUP BY src_ip, dst_ip, src_port, dst_port, protocol""",
    "src_packets": f"""WITH {O.PACKETS_CTE}, wire AS (SELECT timestamp, src_ip, dst_ip, src_port, dst_port,
        CASE WHEN protocol IN ('UDP', 'ICMP') THEN protocol ELSE 'TCP' END AS protocol, bytes, packets FROM packets)
        SELECT epoch(min(timestamp))::BIGINT AS timestamp, src_ip, dst_ip,
        src_port, dst_port, protocol, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets,
        round(CASE WHEN max(timestamp) = min(timestamp) THEN 1.0
              ELSE epoch(max(timestamp)) - epoch(min(timestamp)) END, 6) AS duration
        FROM wire GROUP BY src_ip, dst_ip, src_port, dst_port, protocol""",
    "src_packet_list": f"""WITH {O.PACKET_LIST_CTE} SELECT round(timestamp, 6) AS timestamp, src_ip, dst_ip,
        protocol, bytes, src_port, dst_port, packets, round(duration, 6) AS duration FROM converted""",
    "extract_ports": f"""WITH {O.PACKET_LIST_CTE.replace(O.INFO_EXPR, _INFO)}
        SELECT "Info", src_port, dst_port FROM converted""",
    "order_packet_list": f"""WITH {O.PACKETS_CTE}, n AS (SELECT bytes, row_number() OVER (ORDER BY
        CAST(CAST(bytes AS VARCHAR) || lpad(CAST(src_port AS VARCHAR), 5, '0') || lpad(CAST(dst_port AS VARCHAR), 5, '0')
        AS DOUBLE)) - 1 AS i FROM packets)
        SELECT count(*) AS n, count(DISTINCT i) AS numbers, CAST(min(i) AS DOUBLE) AS first,
        CAST(max(i) AS DOUBLE) AS last, CAST(sum(bytes) FILTER (i < 100) AS BIGINT) AS first_bytes FROM n""",
    "synthesize_timestamp": f"""WITH {O.FLOWS_CTE}, n AS (SELECT bytes, 1704067200 + 60 *
        (row_number() OVER (ORDER BY bytes) - 1) AS t FROM flows)
        SELECT count(*) AS n, count(DISTINCT t) AS times, min(t) AS first, max(t) AS last,
        CAST(sum(bytes) FILTER (t < 1704067200 + 6000) AS BIGINT) AS first_bytes FROM n""",
    "agg_converted_summary": f"""WITH {O.PACKET_LIST_CTE} SELECT count(DISTINCT src_ip) AS unique_sources,
        count(DISTINCT dst_ip) AS unique_destinations, count(DISTINCT protocol) AS unique_protocols,
        CAST(COALESCE(sum(bytes), 0) AS BIGINT) AS total_bytes FROM converted""",
    "agg_lateral": f"""WITH {O.LATERAL_CTE} SELECT src_ip, time_window, unique_dsts, unique_ports, packets, bytes,
        round(avg_duration, 6) AS avg_duration FROM lat_g""",
    "detect_lateral": f"WITH {O.LATERAL_CTE} SELECT {O.LATERAL_OUT} FROM lat_out",
    "sink_lateral": f"WITH {O.LATERAL_CTE} SELECT {O.LATERAL_OUT} FROM lat_out WHERE is_lateral_movement = 1",
    "sink_csv": f"""WITH {O.FLOWS_CTE} SELECT epoch(timestamp)::BIGINT AS timestamp, src_ip, dst_ip, src_port,
        dst_port, protocol, bytes, packets, round(duration, 6) AS duration FROM flows""",
    "sink_converted": f"""WITH {O.PACKET_LIST_CTE} SELECT round(timestamp, 6) AS timestamp, src_ip, dst_ip,
        protocol, bytes, src_port, dst_port, packets, round(duration, 6) AS duration FROM converted""",
    "sink_ics": f"WITH {O.ICS_CTE} SELECT {O.FINDINGS_OUT} FROM findings",
    "sink_train_metadata": f"""WITH {O.FEATURES_CTE} SELECT count(*) AS training_samples,
        '{",".join(TRAINING_FEATURES)}' AS features, 0.05::DOUBLE AS contamination, count(*) AS total_flows,
        count(DISTINCT src_ip) AS unique_sources, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM features""",
    "out_overwrite": f"""WITH {O.FLOWS_CTE} SELECT epoch(timestamp)::BIGINT AS timestamp, src_ip, dst_ip, src_port,
        dst_port, protocol, bytes, packets, round(duration, 6) AS duration FROM flows WHERE dst_port = 502""",
    "default_protocol": f"WITH {O.FLOWS_CTE} SELECT src_ip, dst_port, 'TCP' AS protocol FROM flows",
    "ics_unauthorized": f"""WITH {O.FLAGGED_ICS_CTE} SELECT {O.FINDINGS_OUT} FROM findings
        WHERE type = 'unauthorized_access'""",
    "flt_unauthorized": f"WITH {O.FLAGGED_ICS_CTE} SELECT src_ip, dst_ip, dst_port FROM ics_unauth",
    "topk_lateral": f"""WITH {O.LATERAL_CTE} SELECT {O.LATERAL_OUT} FROM lat_out WHERE is_lateral_movement = 1
        ORDER BY lateral_score DESC, src_ip, time_window LIMIT 5""",
    "flt_outbound": f"""WITH {O.EXFIL_CTE} SELECT epoch(timestamp)::BIGINT AS timestamp, src_ip, dst_ip, src_port,
        dst_port, protocol, bytes, packets, round(duration, 6) AS duration FROM outbound""",
    "agg_exfil": f"""WITH {O.EXFIL_CTE} SELECT src_ip, time_window, bytes_out, packets_out, unique_external_dsts,
        unique_ports, round(total_duration, 6) AS total_duration, is_night, is_weekend, suspicious_protocol_count
        FROM ex_g""",
    "detect_exfil": f"WITH {O.EXFIL_CTE} SELECT {O.EXFIL_OUT} FROM exfil",
    "sink_exfil": f"WITH {O.EXFIL_CTE} SELECT {O.EXFIL_OUT} FROM exfil WHERE is_exfiltration = 1",
    "topk_exfil": f"""WITH {O.EXFIL_CTE} SELECT {O.EXFIL_OUT} FROM exfil WHERE is_exfiltration = 1
        ORDER BY exfil_score DESC, src_ip, time_window LIMIT 5""",
    "exfil_bytes_at_risk": f"""WITH {O.EXFIL_CTE}, risk AS (
        SELECT o.* FROM outbound o JOIN exfil e ON o.src_ip = e.src_ip
        AND {O.bucket(600, 'o.timestamp')} = e.time_window WHERE e.is_exfiltration = 1)
        SELECT count(*) AS flows_at_risk, CAST(COALESCE(sum(bytes), 0) AS BIGINT) AS bytes_at_risk FROM risk""",
    "topk_destinations": f"""WITH {O.EXFIL_CTE}, risk AS (
        SELECT o.* FROM outbound o JOIN exfil e ON o.src_ip = e.src_ip
        AND {O.bucket(600, 'o.timestamp')} = e.time_window WHERE e.is_exfiltration = 1)
        SELECT dst_ip, count(*) AS transfers FROM risk WHERE dst_ip IS NOT NULL GROUP BY dst_ip
        ORDER BY transfers DESC, dst_ip LIMIT 3""",
    "flt_ics": f"WITH {O.FEATURES_CTE} SELECT {O.FEATURE_OUT} FROM features WHERE is_ics_protocol = 1",
    "flt_external_ics": f"""WITH {O.FEATURES_CTE} SELECT {O.FEATURE_OUT} FROM features
        WHERE is_ics_protocol = 1 AND NOT {O.private('dst_ip')}""",
    "flt_night_ics": f"""WITH {O.FEATURES_CTE} SELECT {O.FEATURE_OUT} FROM features
        WHERE is_ics_protocol = 1 AND is_night = 1""",
    "flt_weekend_ics": f"""WITH {O.FEATURES_CTE} SELECT {O.FEATURE_OUT} FROM features
        WHERE is_ics_protocol = 1 AND is_weekend = 1""",
    "ics_unusual_time": f"WITH {O.ICS_CTE} SELECT {O.FINDINGS_OUT} FROM findings WHERE type = 'unusual_time'",
    "ics_weekend": f"WITH {O.ICS_CTE} SELECT {O.FINDINGS_OUT} FROM findings WHERE type = 'weekend_activity'",
    "ics_external": f"WITH {O.ICS_CTE} SELECT {O.FINDINGS_OUT} FROM findings WHERE type = 'external_communication'",
    "agg_ics_diversity": f"WITH {O.ICS_CTE} SELECT src_ip, unique_dsts, unique_ports, total_bytes FROM ics_div",
    "ics_high_diversity": f"WITH {O.ICS_CTE} SELECT src_ip, unique_dsts, unique_ports, total_bytes FROM ics_hd",
    "ics_external_ips": f"WITH {O.ICS_CTE} SELECT dst_ip, epoch(first_seen)::BIGINT AS first_seen FROM ics_ext10",
    "agg_ics_volume": f"""WITH {O.ICS_CTE} SELECT time_window, total_bytes, total_packets, unique_devices
        FROM ics_vol""",
    "ics_traffic_spike": f"""WITH {O.ICS_CTE} SELECT time_window, total_bytes, total_packets, unique_devices
        FROM ics_spk""",
    "agg_ics_port": f"WITH {O.ICS_CTE} SELECT port, unique_sources, total_bytes, total_packets FROM ics_port",
    "ics_unusual_protocol": f"""WITH {O.ICS_CTE} SELECT port, unique_sources, total_bytes, total_packets
        FROM ics_unusual""",
    "agg_quantile": f"""WITH {O.ICS_CTE} SELECT round(quantile_cont(unique_sources, 0.9), 6) AS q90_sources,
        round(quantile_cont(total_bytes, 0.9), 6) AS q90_bytes FROM ics_port""",
    "detect_ics": f"WITH {O.ICS_CTE} SELECT {O.FINDINGS_OUT} FROM findings",
    "flt_critical": f"WITH {O.ICS_CTE} SELECT {O.FINDINGS_OUT} FROM findings WHERE severity = 'critical'",
    "head_findings": f"WITH {O.ICS_CTE} SELECT {O.FINDINGS_OUT} FROM findings ORDER BY rule_no LIMIT 10",
    "agg_severity_counts": f"WITH {O.ICS_CTE} SELECT severity, count(*) AS n FROM findings GROUP BY severity",
    "agg_value_counts": f"""WITH {O.FLOWS_CTE} SELECT protocol, count(*) AS count FROM flows WHERE protocol IS NOT NULL GROUP BY protocol""",
    "join_assets": f"""WITH {O.ICS_CTE}, assets AS (SELECT DISTINCT ip FROM (SELECT {O.ASSET_IP} AS ip
        FROM supplier WHERE s_acctbal >= 0) a WHERE {O.private('ip')}),
        u AS (SELECT f.* FROM features f LEFT JOIN assets a ON f.src_ip = a.ip
              WHERE f.dst_port IN ({O.ICS_PORT_LIST}) AND a.ip IS NULL)
        SELECT 6 AS rule_no, 'unauthorized_access' AS type, 'critical' AS severity, count(*) AS count,
        count(*) || ' non-ICS devices accessing ICS ports' AS description,
        count(DISTINCT src_ip) AS affected_devices,
        NULL::VARCHAR AS external_ips, NULL::DOUBLE AS max_volume_mb,
        array_to_string(list_sort(list(DISTINCT CAST(dst_port AS BIGINT))), ',') AS accessed_ports,
        NULL::VARCHAR AS protocols, 4 AS risk_score
        FROM u WHERE (SELECT n FROM n_ics) > 0 HAVING count(*) > 0""",
    "threat_counts": f"""WITH {O.ALL_CTE} SELECT
        (SELECT count(*) FROM features) AS total_flows,
        (SELECT count(DISTINCT src_ip) FROM features) AS unique_sources,
        (SELECT count(DISTINCT dst_ip) FROM features) AS unique_destinations,
        (SELECT CAST(COALESCE(sum(bytes), 0) AS BIGINT) FROM features) AS total_bytes,
        (SELECT CAST(COALESCE(sum(is_ics_protocol), 0) AS BIGINT) FROM features) AS ics_flows,
        (SELECT CAST(COALESCE(sum(is_lateral_movement), 0) AS BIGINT) FROM lat_out) AS lateral_movement,
        (SELECT CAST(COALESCE(sum(is_high_risk), 0) AS BIGINT) FROM lat_out) AS lateral_high_risk,
        (SELECT CAST(COALESCE(sum(is_exfiltration), 0) AS BIGINT) FROM exfil) AS data_exfiltration,
        (SELECT CAST(COALESCE(sum(is_high_risk), 0) AS BIGINT) FROM exfil) AS exfil_high_risk,
        (SELECT count(*) FROM findings) AS ics_anomalies,
        (SELECT count(*) FROM findings WHERE severity = 'critical') AS critical_findings,
        (SELECT count(*) FROM findings WHERE severity = 'high') AS high_findings,
        (SELECT count(*) FROM findings WHERE severity = 'medium') AS medium_findings""",
    "agg_moments": f"""WITH {O.LATERAL_CTE} SELECT round(avg(lateral_score), 6) AS mean_score,
        round(stddev_samp(lateral_score), 6) AS std_score FROM lat_out""",
}
