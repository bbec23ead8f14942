"""Run isolation, numbering, input formats and hot keys."""

import json
import math
import os
import threading

import pytest
from pyspark.sql import functions as F

from flowlens.operators.common import Scratch, created_tables, materialize
from flowlens.operators.features import join_fanout
from flowlens.operators.flows_rollup import agg_flows
from flowlens.operators.forest import iforest_train, scale_fit
from flowlens.operators.lateral import detect_lateral
from flowlens.operators.summary import agg_value_counts
from flowlens.operators.timestamps import synthesize_timestamp
from flowlens.plans.concurrent import run_concurrently
from flowlens.session import checkpoint_dir
from flowlens.sources.fixtures import flows_from_lineitem
from flowlens.sources.flows import read_flows
from flowlens.sources.packet_list import convert_packet_list, read_packet_list
from conftest import SF_SMALL


def exists(spark, path):
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp)


def test_two_runs_at_once_delete_only_their_own_tables(spark):
    inside, done, paths = threading.Event(), threading.Event(), {}

    def a():
        with Scratch(spark):
            paths["a"] = materialize(spark.range(3), "a").inputFiles()[0].rsplit("/", 1)[0]
            inside.wait(60)
        done.set()

    def b():
        with Scratch(spark):
            df = materialize(spark.range(5), "b")
            paths["b"] = df.inputFiles()[0].rsplit("/", 1)[0]
            inside.set()
            done.wait(60)
            return df.count()

    assert run_concurrently(a, b)[1] == 5
    assert not exists(spark, paths["a"]) and not exists(spark, paths["b"])


def test_scratch_covers_jobs_on_other_threads(spark):
    before = len(created_tables())
    with Scratch(spark):
        run_concurrently(*[lambda i=i: materialize(spark.range(i), "t") for i in range(3)])
        assert len(created_tables()) == before + 3
    assert len(created_tables()) == before


def test_checkpoint_folder_is_required_off_the_local_machine():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_packet_list_is_numbered_by_value_after_a_write(spark, tmp_out):
    n = 200_000
    src = os.path.join(tmp_out, "list")
    spark.range(n).select(
        ((F.col("id") * 77_777) % n).alias("No"), F.lit("10.0.0.1").alias("Source"), F.lit("10.0.0.2").alias("Destination"),
        ((F.col("id") * 77_777) % n).alias("Length")).repartition(5).write.option("header", True).csv(src)
    out = os.path.join(tmp_out, "out")
    convert_packet_list(read_packet_list(spark, src), order_by="No").write.parquet(out)
    got = spark.read.parquet(out).agg(F.count("*"), F.countDistinct("timestamp"), F.min("timestamp"), F.max("timestamp"),
                                      F.count_if(F.col("timestamp") != F.col("bytes"))).first()
    assert tuple(got) == (n, n, 0.0, n - 1.0, 0)


def test_synthesized_times_follow_the_order(spark):
    df = spark.createDataFrame([("10",), ("9",), ("100",)], "k string").repartition(3)
    got = synthesize_timestamp(df, "t", order_by="k").orderBy("t").select("k", F.minute("t")).collect()
    assert [tuple(r) for r in got] == [("9", 0), ("10", 1), ("100", 2)]


def test_json_array_from_a_folder_a_uri_and_a_compressed_file(spark, tmp_out):
    import gzip
    rec = {"timestamp": "1704103200", "src_ip": "10.0.0.1", "dst_ip": "8.8.8.8", "src_port": 1, "dst_port": 443,
           "protocol": "TCP", "bytes": 10, "packets": 1, "duration": 1.0}
    folder = os.path.join(tmp_out, "flows.json")
    os.makedirs(folder)
    with open(os.path.join(folder, "a.json"), "w") as fh:
        fh.write("\n " + json.dumps([rec] * 3, indent=2))
    packed = os.path.join(tmp_out, "packed.json.gz")
    with gzip.open(packed, "wt") as fh:
        fh.write(json.dumps([rec] * 2, indent=1))
    lines = os.path.join(tmp_out, "lines.json")
    with open(lines, "w") as fh:
        fh.write("\n".join(json.dumps(rec) for _ in range(4)))
    for path, n in ((folder, 3), (f"file://{folder}", 3), (f"file://{folder}/a.json", 3), (lines, 4)):
        assert [r.src_ip for r in read_flows(spark, path).collect()] == ["10.0.0.1"] * n
    assert read_flows(spark, packed, fmt="json").count() == 2


def test_inputs_are_not_spread_by_their_size(spark):
    df = flows_from_lineitem(spark, SF_SMALL)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_hot_source_is_split_in_the_fanout_join(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(200_000, numPartitions=8).select(
            F.when(F.col("id") % 5 > 0, F.lit("10.0.0.1")).otherwise(F.concat(F.lit("10.1.0."), F.col("id") % 97)).alias("src_ip"),
            F.concat(F.lit("d"), F.col("id") % 1000).alias("dst_ip"), F.sha2(F.col("id").cast("string"), 256).alias("extra"))
        out = join_fanout(rows)
        assert out.where("src_ip = '10.0.0.1'").select("unique_destinations").distinct().collect()[0][0] == 800
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan or "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_approximate_counts_reach_the_plan(spark):
    df = flows_from_lineitem(spark, SF_SMALL)
    plan = detect_lateral(df, materialize_groups=False, exact=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "approx_count_distinct" in plan
    assert "approx" not in detect_lateral(df, materialize_groups=False)._jdf.queryExecution().optimizedPlan().toString()


def test_null_keys_and_nan(spark):
    cols = "timestamp timestamp, src_ip string, dst_ip string, src_port long, dst_port long, protocol string, bytes long, packets long"
    df = spark.createDataFrame([(None, None, "a", 1, 2, "TCP", 5, 1), (None, "b", "a", 1, 2, "TCP", 5, 1),
                                (None, "b", "a", 1, 2, None, 5, 1)], cols)
    assert agg_flows(df).count() == 1
    assert [tuple(r) for r in agg_value_counts(df).collect()] == [("TCP", 2)]
    x = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    n, means, stds = scale_fit(x, ["x"])
    assert (n, means) == (4, [1.0]) and not math.isnan(stds[0])


def test_exact_threshold_is_the_quantile(spark):
    df = flows_from_lineitem(spark, SF_SMALL).select("bytes", "packets")
    a = iforest_train(df, n_trees=10, exact_threshold=True).threshold
    b = iforest_train(df, n_trees=10).threshold
    assert abs(a - b) < 0.01
