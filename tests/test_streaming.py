"""Micro-batch detection over a file stream."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.operators.features import extract_features, select_features
from flowlens.operators.forest import iforest_train
from flowlens.sources.fixtures import flows_from_lineitem
from flowlens.streaming import detect_stream, read_flow_stream


def test_stream_batches_match_batch_detection(spark, tmp_out):
    flows = flows_from_lineitem(spark, SF_SMALL)
    land = os.path.join(tmp_out, "landing")
    # two files = two micro-batches (maxFilesPerTrigger=1)
    flows.where(F.col("src_port") % 2 == 0).coalesce(1).write.parquet(os.path.join(land, "a"))
    flows.where(F.col("src_port") % 2 == 1).coalesce(1).write.parquet(os.path.join(land, "b"))
    for d in ("a", "b"):
        for f in os.listdir(os.path.join(land, d)):
            if f.endswith(".parquet"):
                os.rename(os.path.join(land, d, f), os.path.join(land, f"{d}-{f}"))
    feats = extract_features(flows)
    model = iforest_train(feats, select_features(feats))
    stream = read_flow_stream(spark, land, "parquet", schema=flows.schema, max_files_per_trigger=1)
    out = os.path.join(tmp_out, "stream-out")
    q = detect_stream(stream, model, out, available_now=True, query_name="t_stream")
    q.awaitTermination(300)
    batches = sorted(d for d in os.listdir(out) if d.startswith("batch="))
    assert len(batches) == 2
    total = 0
    for b in batches:
        s = spark.read.json(os.path.join(out, b, "attack_summary")).first()
        total += s.total_flows
    assert total == 6000


def test_csv_stream_reads_declared_schema(spark, tmp_out):
    land = os.path.join(tmp_out, "csv-landing")
    os.makedirs(land)
    with open(os.path.join(land, "a.csv"), "w") as fh:
        fh.write("timestamp,src_ip,dst_ip,src_port,dst_port,protocol,bytes,packets,duration\n")
        fh.write("1704103200,10.0.0.1,8.8.8.8,1234,443,TCP,100,2,1.0\n")
    stream = read_flow_stream(spark, land, "csv")
    assert stream.isStreaming and stream.schema["bytes"].dataType.simpleString() == "bigint"
    q = (stream.writeStream.format("memory").queryName("csv_stream_t")
         .option("checkpointLocation", os.path.join(tmp_out, "csv-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    rows = spark.sql("SELECT * FROM csv_stream_t").collect()
    assert len(rows) == 1 and rows[0].bytes == 100 and rows[0].timestamp == "1704103200"
