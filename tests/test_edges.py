"""Hand-made edge rows (FIXTURES.md section 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowlens.functions.ip import is_private_ip
from flowlens.functions.ports import extract_ports
from flowlens.operators.exfil import detect_exfil
from flowlens.operators.features import (extract_features, fill_missing, preprocess, select_features,
                                         select_numeric)
from flowlens.operators.flows_rollup import agg_flows
from flowlens.operators.forest import risk_band
from flowlens.operators.ics import detect_ics
from flowlens.operators.lateral import detect_lateral
from flowlens.operators.timestamps import normalize_timestamp, sequential_index, synthesize_timestamp
from flowlens.schema import FINDINGS_COLUMNS, EXFIL_COLUMNS, FLOW_SCHEMA

RAW = "timestamp string, src_ip string, dst_ip string, src_port long, dst_port long, " \
      "protocol string, bytes long, packets long, duration double"


def flows(spark, rows, schema=RAW):
    return spark.createDataFrame(rows, schema)


def row(ts="2024-01-01 10:00:00", src="10.0.0.1", dst="10.0.0.2", sport=1234, dport=80,
        proto="TCP", b=100, p=2, d=1.0):
    return (ts, src, dst, sport, dport, proto, b, p, d)


def test_iso_saturday_night(spark):
    f = preprocess(flows(spark, [row(ts="2024-01-06 23:00:00")])).first()
    assert (f.day_of_week, f.is_weekend, f.is_night, f.hour) == (5, 1, 1, 23)


def test_unix_seconds_and_millis_same_instant(spark):
    a = normalize_timestamp(flows(spark, [row(ts="1696789123")])).first().timestamp
    b = normalize_timestamp(flows(spark, [row(ts="1696789123000")])).first().timestamp
    assert a == b == dt.datetime(2023, 10, 8, 18, 18, 43)


def test_numeric_column_units(spark):
    df = spark.createDataFrame([(1696789123000000,)], "timestamp long")
    assert normalize_timestamp(df).first().timestamp == dt.datetime(2023, 10, 8, 18, 18, 43)
    df = spark.createDataFrame([(1696789123000,)], "timestamp long")
    assert normalize_timestamp(df, unit="ms").first().timestamp == dt.datetime(2023, 10, 8, 18, 18, 43)


def test_bad_time_kept_in_features_dropped_from_windows(spark):
    df = flows(spark, [row(ts="n/a"), row(ts="2024-01-01 10:00:00")])
    f = preprocess(df)
    assert f.count() == 2
    assert f.where(F.col("timestamp").isNull()).first().is_night == 0
    assert detect_lateral(f).count() == 1


def test_night_bounds(spark):
    rows = [row(ts=f"2024-01-02 {h:02d}:30:00") for h in (6, 7, 21, 22)]
    got = [r.is_night for r in preprocess(flows(spark, rows)).orderBy("hour").collect()]
    assert got == [1, 0, 0, 1]


@pytest.mark.parametrize("ip,expected", [
    ("10.1.2.3", True), ("172.16.0.1", True), ("172.31.9.9", True), ("192.168.0.1", True),
    ("127.0.0.1", True), ("172.15.0.1", False), ("172.32.0.1", False), ("192.169.0.1", False),
    ("8.8.8.8", False), ("fe80::1", False), ("10.x.1.1", False), ("10.1.1", False), (None, False),
])
def test_private_ip(spark, ip, expected):
    df = spark.createDataFrame([(ip,)], "ip string")
    assert df.select(is_private_ip("ip")).first()[0] is expected


def test_missing_protocol_column(spark):
    df = flows(spark, [row()]).drop("protocol")
    f = extract_features(normalize_timestamp(df)).first()
    assert f.protocol == "TCP" and f.is_tcp == 1


def test_missing_timestamp_column(spark):
    df = flows(spark, [row(), row(src="10.0.0.9")]).drop("timestamp")
    f = extract_features(df).first()
    assert (f.hour, f.day_of_week, f.is_night, f.is_weekend) == (12, 2, 0, 0)
    lat = detect_lateral(extract_features(df))
    assert lat.select("time_window").distinct().count() == 1
    found = detect_ics(extract_features(df.withColumn("dst_port", F.lit(502))))
    assert "traffic_spike" not in [r.type for r in found.collect()]


def test_protocol_case(spark):
    df = flows(spark, [row(proto="tcp", dst="8.8.8.8"), row(proto="http", dst="8.8.8.8")])
    f = preprocess(df)
    assert sorted(r.is_tcp for r in f.collect()) == [0, 1]
    ex = detect_exfil(f).first()
    assert ex.suspicious_protocol_count == 0


def test_port_classes(spark):
    rows = [row(dport=p) for p in (0, 1023, 1024, 10000, 10001)]
    got = preprocess(flows(spark, rows)).orderBy("dst_port").collect()
    assert [r.is_well_known for r in got] == [1, 1, 0, 0, 0]
    assert [r.is_high_port for r in got] == [0, 0, 0, 0, 1]


def test_null_numerics_to_zero(spark):
    df = flows(spark, [("2024-01-01 10:00:00", "10.0.0.1", "10.0.0.2", 1, 80, "TCP", None, 2, 1.0)])
    assert fill_missing(normalize_timestamp(df)).first().bytes == 0


def test_divide_by_zero(spark):
    f = preprocess(flows(spark, [row(p=-1, d=-1.0)])).first()
    assert f.bytes_per_packet == 0.0 and f.packets_per_second == 0.0 and f.bytes_per_second == 0.0


def test_one_group_no_flag(spark):
    lat = detect_lateral(preprocess(flows(spark, [row()]))).first()
    assert lat.is_lateral_movement == 0


def test_no_outbound_empty_with_schema(spark):
    ex = detect_exfil(preprocess(flows(spark, [row()])))
    assert ex.count() == 0 and ex.columns == EXFIL_COLUMNS


def test_no_ics_rows_empty_with_schema(spark):
    f = detect_ics(preprocess(flows(spark, [row(dport=80)])))
    assert f.count() == 0 and f.columns == FINDINGS_COLUMNS


def test_no_ics_column_empty(spark):
    f = detect_ics(flows(spark, [row()]))
    assert f.count() == 0 and f.columns == FINDINGS_COLUMNS


def test_strict_limits_lateral(spark):
    # 11 ports / 51 packets fires the port scan, 10 / 50 does not
    base = [row(src="10.0.0.1", dst="10.0.1.1", dport=1000 + i, p=5) for i in range(10)]
    fires = [row(src="10.0.0.2", dst="10.0.1.1", dport=1000 + i, p=5) for i in range(11)]
    extra = [row(src="10.0.0.1", dst="10.0.1.1", dport=1000, p=0)]
    lat = detect_lateral(preprocess(flows(spark, base + fires + extra)))
    got = {r.src_ip: (r.unique_ports, r.packets, r.is_port_scan) for r in lat.collect()}
    assert got["10.0.0.1"] == (10, 50, 0)
    assert got["10.0.0.2"] == (11, 55, 1)


def test_strict_limits_host_scan(spark):
    five = [row(src="10.0.0.1", dst=f"10.0.1.{i}", p=5) for i in range(5)]
    six = [row(src="10.0.0.2", dst=f"10.0.1.{i}", p=5) for i in range(6)]
    lat = detect_lateral(preprocess(flows(spark, five + six)))
    got = {r.src_ip: r.is_host_scan for r in lat.collect()}
    assert got == {"10.0.0.1": 0, "10.0.0.2": 1}


def test_exactly_10mb_not_large(spark):
    mb = 1024 * 1024
    rows = [row(src="10.0.0.1", dst="8.8.8.8", b=10 * mb), row(src="10.0.0.2", dst="8.8.8.8", b=10 * mb + 1)]
    got = {r.src_ip: r.is_large_transfer for r in detect_exfil(preprocess(flows(spark, rows))).collect()}
    assert got == {"10.0.0.1": 0, "10.0.0.2": 1}


@pytest.mark.parametrize("text,expected", [
    ("56443 → 443 [ACK]", (56443, 443)), ("Port=443", (0, 443)), ("70000 → 80", (0, 80)),
    ("hello", (0, 0)), (None, (0, 0)),
])
def test_extract_ports(spark, text, expected):
    df = spark.createDataFrame([(text,)], "info string")
    r = df.select(extract_ports("info").alias("p")).first().p
    assert (r.src_port, r.dst_port) == expected


def test_flow_rollup_durations(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    pk = spark.createDataFrame([
        (t0, "10.0.0.1", "10.0.0.2", 1, 80, "TCP", 60, 1, 0.0),
        (t0, "10.0.0.3", "10.0.0.2", 1, 80, "TCP", 60, 1, 0.0),
        (t0 + dt.timedelta(seconds=2.5), "10.0.0.3", "10.0.0.2", 1, 80, "TCP", 40, 1, 0.0),
    ], FLOW_SCHEMA)
    got = {r.src_ip: (r.duration, r.bytes, r.packets) for r in agg_flows(pk).collect()}
    assert got == {"10.0.0.1": (1.0, 60, 1), "10.0.0.3": (2.5, 100, 2)}


def test_risk_bands(spark):
    df = spark.createDataFrame([(-0.51,), (-0.5,), (-0.3,)], "anomaly_score double")
    assert [r[0] for r in df.select(risk_band()).collect()] == ["high", "medium", "low"]


def test_feature_lists(spark):
    f = preprocess(flows(spark, [row()]))
    assert len(select_numeric(f)) == 18
    assert select_features(f)[0] == "bytes" and len(select_features(f)) == 14


def test_sequential_index_and_synthetic_time(spark):
    df = spark.range(0, 1000, numPartitions=7)
    idx = sequential_index(df, "i").collect()
    assert sorted(r.i for r in idx) == list(range(1000))
    assert all(r.i == r.id for r in idx)
    syn = synthesize_timestamp(spark.range(0, 3, numPartitions=2).withColumn("timestamp", F.lit(None)))
    got = sorted(r.timestamp for r in syn.collect())
    assert got[0] == dt.datetime(2024, 1, 1) and got[2] == dt.datetime(2024, 1, 1, 0, 2)


def test_approx_distinct_opt_in(spark):
    from conftest import SF_SMALL
    from flowlens.sources.fixtures import flows_from_lineitem
    f = flows_from_lineitem(spark, SF_SMALL)
    exact = {(r.src_ip, r.time_window): r.unique_dsts for r in detect_lateral(f).collect()}
    approx = {(r.src_ip, r.time_window): r.unique_dsts for r in detect_lateral(f, exact=False).collect()}
    assert exact.keys() == approx.keys()
    assert sum(abs(exact[k] - approx[k]) for k in exact) <= 0.02 * sum(exact.values())


def test_literal_unauthorized_rule_fires_with_supplied_flag(spark):
    """D5: the literal rule needs a caller-supplied is_ics_protocol = 0 on an ICS port."""
    from flowlens.operators.ics import flt_unauthorized
    rows = [row(src="10.0.0.1", dport=502), row(src="10.0.0.2", dport=502), row(src="10.0.0.3", dport=102)]
    f = preprocess(flows(spark, rows)).withColumn(
        "is_ics_protocol", F.when(F.col("src_ip") == "10.0.0.2", F.lit(0)).otherwise(F.col("is_ics_protocol")))
    assert f.where(flt_unauthorized()).count() == 1
    found = {r.type: r for r in detect_ics(f).collect()}
    u = found["unauthorized_access"]
    assert (u["count"], u.affected_devices, u.accessed_ports, u.risk_score) == (1, 1, [502], 4)


def test_cluster_conf_sizes():
    from flowlens.session import cluster_conf
    c = cluster_conf(100 * 1024 ** 4, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 52428
    assert int(cluster_conf(10 ** 6, 8)["spark.sql.shuffle.partitions"]) == 16


def test_packet_list_aliases_and_defaults(spark):
    from flowlens.sources.packet_list import convert_packet_list
    lower = spark.createDataFrame([("1.5", "10.0.0.1", "10.0.0.2", "UDP", "60", "5353 → 53")],
                                  "time string, src string, dst string, protocol string, length string, info string")
    r = convert_packet_list(lower).first()
    assert (r.timestamp, r.src_ip, r.dst_ip, r.protocol, r.bytes, r.src_port, r.dst_port) == \
        ("1.5", "10.0.0.1", "10.0.0.2", "UDP", 60, 5353, 53)   # time copied as is (parsed by preprocess)
    bare = spark.createDataFrame([("2", "10.0.0.1", "10.0.0.2")], "Time string, Source string, Destination string")
    r = convert_packet_list(bare).first()
    assert (r.protocol, r.bytes, r.src_port, r.dst_port, r.packets, r.duration) == ("TCP", 1000, 0, 0, 1, 0.1)


def test_summary_json_keys(spark):
    from flowlens.operators.summary import attack_summary, recommendations
    from flowlens.schema import EXFIL_COLUMNS
    f = preprocess(flows(spark, [row(), row(src="10.0.0.9", dport=502)]))
    scored = f.withColumn("anomaly_score", F.lit(-0.6)).withColumn("is_anomaly", F.lit(1))
    s = attack_summary(scored, detect_lateral(f), detect_exfil(f), detect_ics(f)).first()
    assert (s.total_flows, s.total_anomalies, s.anomaly_rate, s.rate_band, s.small_input) == (2, 2, 100.0, "high", True)
    assert s.risk_levels.high == 2 and s.threats.lateral_movement == 0
    recs = [r.text for r in recommendations(attack_summary(scored, detect_lateral(f), detect_exfil(f),
                                                           detect_ics(f))).collect()]
    assert recs[-1].startswith("4. Review 2 high-risk")
    assert len(EXFIL_COLUMNS) == 21
