"""Rejected rows, staged results, exact times in CSV, protocols as a table."""

import json
import os

import pytest
from pyspark.sql import functions as F

from flowlens.operators.common import Scratch
from flowlens.operators.summary import protocol_counts, top_protocols
from flowlens.operators.timestamps import synthesize_timestamp
from flowlens.plans import sinks
from flowlens.plans.pipelines import detect_pipeline, train_pipeline
from flowlens.plans.staged import recover, swap_in
from flowlens.sources.rejects import load_checked

HEADER = "timestamp,src_ip,dst_ip,src_port,dst_port,protocol,bytes,packets,duration,site\n"


def flows_csv(path, good=300):
    lines = [f"{1704103200 + i},10.0.0.{i % 20},10.0.1.{i % 40},{1024 + i},{(502, 80)[i % 2]},TCP,{100 + i * 7 % 900},"
             f"{1 + i % 9},{i % 5}.5,x\n" for i in range(good)]
    lines.insert(5, "1704103200,10.0.0.1,10.0.0.2\n")                              # too short
    lines.insert(9, "1704103200,10.0.0.1,10.0.0.2,1,2,TCP,3,4,5,x,y,z\n")          # too long
    lines.insert(20, "1704103201,10.0.0.1,10.0.0.2,1,http,TCP,many,4,,x\n")        # text for numbers
    with open(path, "w") as fh:
        fh.writelines([HEADER, *lines])


def test_broken_rows_are_told_apart_and_counted(spark, tmp_out):
    path = os.path.join(tmp_out, "a.csv")
    flows_csv(path)
    with Scratch(spark):
        flows, rejects, counts = load_checked(spark, path)
        assert counts == {"rows_read": 303, "rows_rejected": 2, "unread_src_port": 0, "unread_dst_port": 1,
                          "unread_bytes": 1, "unread_packets": 0, "unread_duration": 0}
        assert flows.count() == 301 and "site" in flows.columns
        assert sorted(r.record for r in rejects.collect()) == [
            "1704103200,10.0.0.1,10.0.0.2", "1704103200,10.0.0.1,10.0.0.2,1,2,TCP,3,4,5,x,y,z"]
        assert flows.schema["bytes"].dataType.simpleString() == "bigint"
    lines = os.path.join(tmp_out, "a.json")
    with open(lines, "w") as fh:
        fh.write('{"src_ip": "10.0.0.1", "bytes": "x"}\n{"bytes": 3, "more": [1]}\nno json\n')
    with Scratch(spark):
        flows, rejects, counts = load_checked(spark, lines)
        assert (counts["rows_read"], counts["rows_rejected"], counts["unread_bytes"]) == (3, 1, 1)
        assert [r.record for r in rejects.collect()] == ["no json"]
        assert sorted((r.bytes, r.more) for r in flows.collect() if r.bytes) == [(3, "[1]")]


def test_counts_reach_the_metadata_the_summary_and_a_table(spark, tmp_out):
    path, model = os.path.join(tmp_out, "a.csv"), os.path.join(tmp_out, "m", "model")
    flows_csv(path)
    t = train_pipeline(spark, path, model)
    meta = json.loads(spark.read.text(t["metadata"]).first()[0])
    assert meta["training_samples"] == 301 and meta["input"]["rows_rejected"] == 2
    r = detect_pipeline(spark, path, model, os.path.join(tmp_out, "out"))
    summary = json.loads(spark.read.text(r["summary"]).first()[0])
    assert summary["total_flows"] == 301 and summary["input"] == meta["input"]
    assert summary["input"]["unread_bytes"] == 1
    assert spark.read.json(r["rejects"]).count() == spark.read.json(t["rejects"]).count() == 2
    assert spark.read.option("header", True).csv(r["protocols"]).collect()[0].asDict() == {
        "protocol": "TCP", "count": "301"}


def test_times_keep_their_microseconds_in_csv(spark, tmp_out):
    df = spark.createDataFrame([("2024-01-01 00:00:00.123456",), ("1969-12-31 23:59:59.999999",), (None,)], "t string") \
        .select(F.col("t").cast("timestamp").alias("t"), F.lit(1).alias("n"))
    path = sinks.write_table(df, os.path.join(tmp_out, "t"), "csv")
    assert sorted(map(repr, sinks.read_table(spark, path, "csv", df.schema).collect())) == sorted(map(repr, df.collect()))
    text = {r[0] for r in spark.read.option("header", True).csv(path).collect()}
    assert text == {"2024-01-01 00:00:00.123456", "1969-12-31 23:59:59.999999", None}


def test_a_failed_write_leaves_the_old_result(spark, tmp_out):
    path = os.path.join(tmp_out, "table")
    sinks.write_table(spark.range(5), path, "parquet")

    def fail(i):
        raise ValueError("lost")
    bad = spark.range(100).select(F.udf(fail, "long")("id").alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_table(bad, path, "parquet")
    assert spark.read.parquet(path).count() == 5 and os.listdir(tmp_out) == ["table"]
    # the write may read the table that it replaces
    sinks.write_table(spark.read.parquet(path).where("id < 3"), path, "parquet")
    assert spark.read.parquet(path).count() == 3


def test_a_swap_killed_between_its_steps_is_put_right(spark, tmp_out):
    path = os.path.join(tmp_out, "table")
    sinks.write_table(spark.range(5), path, "parquet")
    aside = os.path.join(tmp_out, ".table.old")
    os.rename(path, aside)                                 # killed after the first rename
    df = sinks.read_table(spark, path, "parquet", None)
    assert df.count() == 5 and not os.path.exists(aside)
    spark.range(2).write.parquet(aside)                    # killed before the old result's deletion
    assert not recover(spark, path) and not os.path.exists(aside) and spark.read.parquet(path).count() == 5
    with pytest.raises(RuntimeError):
        swap_in(spark, path, lambda folder: (_ for _ in ()).throw(RuntimeError("killed while writing")))
    assert spark.read.parquet(path).count() == 5


def test_protocols_of_any_number_are_a_table(spark):
    df = spark.range(1000).select(F.concat(F.lit("p"), F.col("id") % 50).alias("protocol"))
    df = df.unionByName(spark.range(30).select(F.lit("TCP").alias("protocol")))
    assert protocol_counts(df).count() == 51
    first = top_protocols(df).first()["protocols"]
    assert len(first) == 10 and tuple(first[0]) == ("TCP", 30) and [p.protocol for p in first[1:3]] == ["p0", "p1"]


def test_minutes_past_an_int(spark, monkeypatch):
    from flowlens.operators import timestamps
    monkeypatch.setattr(timestamps, "sequential_index", lambda df, name, order: df.withColumn(name, F.lit(3 * 10**9)))
    got = synthesize_timestamp(spark.range(1)).select(F.unix_seconds("timestamp")).first()[0]
    assert got == 1704067200 + 60 * 3 * 10**9
