"""End-to-end jobs, sources and sinks."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.operators.lateral import detect_lateral
from flowlens.plans.pipelines import detect_pipeline, packet_pipeline, train_pipeline
from flowlens.sources.fixtures import flows_from_lineitem, packet_list_from_lineitem, packets_from_lineitem
from flowlens.sources.flows import detect_format, read_flows
from flowlens.sources.packet_list import convert_packet_list
from flowlens.sources.capture_fixtures import packets_to_captures


@pytest.fixture(scope="module")
def csv_flows(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("flows"))
    path = os.path.join(d, "flows.csv")
    (flows_from_lineitem(spark, SF_SMALL)
     .withColumn("timestamp", F.unix_seconds("timestamp").cast("string"))
     .coalesce(2).write.option("header", True).csv(path))
    return path


def test_dispatch():
    assert detect_format("x/flows.csv") == "csv"
    assert detect_format("x/flows.parquet") == "parquet"
    assert detect_format("x/cap.pcapng") == "pcap"
    with pytest.raises(ValueError):
        detect_format("x/flows.xlsx")


def test_csv_json_parquet_sources_agree(spark, csv_flows, tmp_out):
    a = read_flows(spark, csv_flows)
    js = os.path.join(tmp_out, "flows.json")
    a.write.json(js)
    b = read_flows(spark, js)
    pq = os.path.join(tmp_out, "flows.parquet")
    a.write.parquet(pq)
    c = read_flows(spark, pq)
    key = lambda df: sorted(tuple(r) for r in df.select(*a.columns).collect())
    assert key(a) == key(b) == key(c)
    assert a.count() == 6000


def test_json_array_document(spark, tmp_out):
    p = os.path.join(tmp_out, "arr.json")
    with open(p, "w") as fh:
        json.dump([{"timestamp": "1704103200", "src_ip": "10.0.0.1", "dst_ip": "8.8.8.8", "src_port": 1,
                    "dst_port": 443, "protocol": "TCP", "bytes": 10, "packets": 1, "duration": 1.0}] * 3, fh)
    assert read_flows(spark, p).count() == 3


def test_train_then_detect_twice(spark, csv_flows, tmp_out):
    from flowlens.operators.common import created_tables
    before = set(created_tables())
    model = os.path.join(tmp_out, "model", "anomaly_model")
    res = train_pipeline(spark, csv_flows, model)
    assert len(res["features"]) == 14
    meta = spark.read.json(res["metadata"]).first()
    assert meta.training_samples == 6000 and meta.data_statistics.total_flows == 6000
    out = os.path.join(tmp_out, "out")
    for _ in range(2):   # second run overwrites
        r = detect_pipeline(spark, csv_flows, model, out)
    lat = spark.read.option("header", True).csv(r["lateral"])
    assert lat.count() == 12
    summary = spark.read.json(r["summary"]).first()
    assert summary.total_flows == 6000 and summary.threats.lateral_movement == 12
    assert 250 <= summary.total_anomalies <= 350
    ics = spark.read.option("header", True).csv(r["ics"])
    assert ics.count() == 6
    recs = spark.read.option("header", True).csv(r["recommendations"]).count()
    assert recs >= 9
    assert len(glob.glob(os.path.join(r["anomalies"], "*.csv"))) >= 1
    top = spark.read.option("header", True).option("inferSchema", True).csv(r["top_anomalies"]).collect()
    assert len(top) == 10 and top[0].anomaly_score <= top[-1].anomaly_score
    assert spark.read.option("header", True).csv(r["top_lateral"]).count() == 5
    assert spark.read.option("header", True).csv(r["critical_findings"]).count() == 1
    # the run's intermediate tables are gone, the outputs stay
    assert not [p for p in created_tables() if p not in before]
    assert os.path.isdir(r["lateral"])


def test_packet_pipeline(spark, tmp_out):
    caps = os.path.join(tmp_out, "caps")
    pk = packets_from_lineitem(spark, SF_SMALL).repartition(3)
    for i, row in enumerate(packets_to_captures(pk).collect()):
        with open(os.path.join(caps if os.path.isdir(caps) else (os.makedirs(caps) or caps), f"c{i}.pcap"),
                  "wb") as fh:
            fh.write(row.content)
    r = packet_pipeline(spark, caps, os.path.join(tmp_out, "m2"), os.path.join(tmp_out, "out2"))
    assert r["anomalies"].endswith("general_anomalies")
    summary = spark.read.json(r["summary"]).first()
    assert summary.total_flows > 4000
    assert os.path.isdir(os.path.join(tmp_out, "m2", "nodes"))


def test_packet_list_missing_columns(spark):
    pl = packet_list_from_lineitem(spark, SF_SMALL)
    with pytest.raises(ValueError):
        convert_packet_list(pl.drop("Source"))
    no_time = convert_packet_list(pl.drop("Time").limit(50))
    ts = sorted(r.timestamp for r in no_time.collect())
    assert ts == [float(i) for i in range(50)]
    base = convert_packet_list(pl.limit(5), base_time=100).agg(F.min("timestamp")).first()[0]
    assert base >= 100


def test_invariance_under_partitions(spark):
    """Same results under a row shuffle and 1 / 4 / 200 partitions."""
    from flowlens.operators.exfil import detect_exfil
    from flowlens.operators.features import extract_features
    from flowlens.operators.ics import detect_ics

    def run(df):
        feats = extract_features(df)
        return [sorted(tuple(r) for r in d.collect())
                for d in (detect_lateral(df), detect_exfil(df), detect_ics(feats))]

    f = flows_from_lineitem(spark, SF_SMALL)
    ref = run(f)
    try:
        for n in (1, 4, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert run(f.repartition(n).orderBy(F.rand(7))) == ref
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_cli_train_detect_convert(spark, csv_flows, tmp_out):
    from flowlens.__main__ import main
    model = os.path.join(tmp_out, "cli", "model")
    main(["train", "--data", csv_flows, "--output", model, "--contamination", "0.1"])
    res = main(["detect", "--data", csv_flows, "--model", model, "--output", os.path.join(tmp_out, "cli", "run"),
                "--detailed"])
    assert 500 <= res["score_counts"]["total_anomalies"] <= 700
    pl = os.path.join(tmp_out, "pl.csv")
    packet_list_from_lineitem(spark, SF_SMALL).coalesce(1).write.option("header", True).csv(pl)
    conv = main(["convert", "--input", pl, "--output", os.path.join(tmp_out, "conv")])
    assert conv["summary"]["unique_sources"] == 10


def test_csv_columns_by_name(spark, tmp_out):
    p = os.path.join(tmp_out, "reordered.csv")
    with open(p, "w") as fh:
        fh.write("dst_ip,label,bytes,src_ip,timestamp,protocol,dst_port,packets,duration,src_port\n")
        fh.write("8.8.8.8,x,12.0,10.0.0.1,1704103200,TCP,443,3,1.5,5555\n")
        fh.write("8.8.4.4,y,bad,10.0.0.2,1704103260,UDP,53,1,0.5,5556\n")
    df = read_flows(spark, p)
    rows = {r.src_ip: r for r in df.collect()}
    a = rows["10.0.0.1"]
    assert (a.dst_ip, a.bytes, a.dst_port, a.packets, a.duration, a.src_port, a.label) == \
        ("8.8.8.8", 12, 443, 3, 1.5, 5555, "x")
    assert rows["10.0.0.2"].bytes is None
    from flowlens.operators.features import preprocess
    f = preprocess(df)
    assert f.where("src_ip = '10.0.0.2'").first().bytes == 0
