"""Exact quantiles, top values, distinct sketches and the time-sorted store."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.operators import heavy, quantiles
from flowlens.operators import distinct_sketches as sketches
from flowlens.operators.forest import iforest_threshold
from flowlens.operators.heavy import top_values
from flowlens.operators.quantiles import exact_quantile
from flowlens.plans import time_store
from flowlens.sources.fixtures import flows_from_lineitem


def doubles(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(3)


RNG = random.Random(1)
CASES = {
    "spread": [RNG.uniform(-5, 5) for _ in range(3000)],
    "magnitudes": [s * 10.0 ** RNG.uniform(-300, 300) for _ in range(1500) for s in (1, -1)],
    "one value": [0.25] * 2000,
    "a third equal": [0.5] * 1000 + [i / 1000 for i in range(2000)],
    "two values": [0.0] * 999 + [1.0] * 1001,
    "nulls and ends": [None] * 50 + [float("inf"), float("-inf"), -0.0, 0.0] + [float(i % 7) for i in range(900)],
    "few": [3.0, 1.0],
}


@pytest.mark.parametrize("name", CASES)
def test_quantiles_equal_percentile(spark, name, monkeypatch):
    seen = []
    inside = quantiles._inside
    monkeypatch.setattr(quantiles, "_inside", lambda df, a, b: seen.append((a, b)) or inside(df, a, b))
    df = doubles(spark, CASES[name]).cache()
    for q in (0.0, 0.05, 0.5, 1 / 3, 0.999, 1.0):
        want = df.agg(F.percentile("v", q)).first()[0]
        got = exact_quantile(df, "v", q, slice_rows=40, accuracy=200)
        assert got == want or (math.isnan(got) and math.isnan(want)), (q, got, want)
    assert name not in ("spread", "magnitudes") or len(seen) > 12          # brackets were narrowed
    df.unpersist()


def test_no_values_and_the_threshold(spark):
    assert exact_quantile(doubles(spark, []), "v", 0.5) is None
    assert exact_quantile(doubles(spark, [None]), "v", 0.5) is None
    df = doubles(spark, CASES["spread"]).withColumnRenamed("v", "anomaly_score")
    assert iforest_threshold(df, 0.05, exact=True) == df.agg(F.percentile("anomaly_score", 0.05)).first()[0]


@pytest.mark.parametrize("first, buckets", [(1, 16), (2, 64), (256, 65_536)])
def test_top_values_equal_the_group_by(spark, first, buckets):
    rng = random.Random(first)
    values = [f"v{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)] + [None] * 100
    df = spark.createDataFrame([(v, 1) for v in values], "dst string, count int")
    want = [tuple(r) for r in df.where("dst is not null").groupBy("dst").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "dst").limit(5).collect()]
    assert [tuple(r) for r in top_values(df, "dst", 5, "n", buckets, first).collect()] == want


def test_flat_values_ties_and_fewer_than_k(spark):
    flat = spark.range(500).selectExpr("concat('x', lpad(id, 3, '0')) as d")
    assert [tuple(r) for r in top_values(flat, "d", 3, buckets=8, first=1).collect()] == [("x000", 1), ("x001", 1), ("x002", 1)]
    assert [r.d for r in top_values(flat.limit(2), "d", 3).collect()] == ["x000", "x001"]
    assert top_values(flat.limit(0), "d", 3).collect() == []


def test_only_full_buckets_are_counted_one_by_one(spark, monkeypatch):
    """3 heavy values among 20,000: what is grouped by value is a small part."""
    df = spark.range(60_000).selectExpr("case when id % 3 = 0 then concat('h', id % 9) else concat('r', id % 20000) end as d")
    counted = []
    join = type(df).join

    def watched(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "_bucket":
            counted.append(out.select("d").distinct().count())
        return out
    monkeypatch.setattr(type(df), "join", watched)
    got = top_values(df, "d", 3, first=8)
    assert [r["count"] for r in got.collect()] == [6667, 6667, 6666]
    assert len(counted) == 1 and counted[0] < 60          # of 13,336 values


def test_sketches_of_three_days_merge_within_the_bound(spark, tmp_out):
    rows = spark.range(120_000).selectExpr(
        "timestamp_seconds(1703980800 + id * 2) as timestamp", "concat('10.0.0.', id % 3) as src_ip",
        "concat('d', hash(id) % 9000) as dst_ip", "cast(pmod(hash(id, 1), 50000) as bigint) as dst_port",
        "id as bytes", "1L as packets").cache()
    path = os.path.join(tmp_out, "sketches")
    days = [rows.where(F.dayofmonth("timestamp") == d) for d in (31, 1, 2)]
    for d in (days[0], days[1].limit(100), days[1], days[2]):      # a day stored twice is replaced
        sketches.store_sketches(d, path)
    got = {r.src_ip: r for r in sketches.merged_counts(spark, path, hours=72).collect()}
    want = rows.groupBy("src_ip").agg(F.countDistinct("dst_ip").alias("d"), F.countDistinct("dst_port").alias("p"),
                                      F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()
    bound = 4 * sketches.standard_error()
    for w in want:
        g = got[w.src_ip]
        assert (g.flows, g.bytes, g.packets) == (w.n, w.b, w.n)
        assert abs(g.unique_dsts - w.d) <= bound * w.d and abs(g.unique_ports - w.p) <= bound * w.p
    one = sketches.merged_counts(spark, path, 24, start=1703980800 + 86400, end=1703980800 + 2 * 86400)
    assert one.select("time_window").distinct().count() == 1 and one.agg(F.sum("flows")).first()[0] == days[1].count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hour_s" in plan
    rows.unpersist()


def test_the_order_is_kept_across_files_and_ranges_read_few(spark, tmp_out):
    flows = flows_from_lineitem(spark, SF_SMALL).unionByName(
        spark.range(2500).selectExpr("timestamp_seconds(1704300000) as timestamp", "concat('h', id) as src_ip",
                                     "'x' as dst_ip", "1L as src_port", "2L as dst_port", "'TCP' as protocol",
                                     "id as bytes", "1L as packets", "0.5D as duration"))       # one instant: a third
    flows = flows.unionByName(flows.limit(3).withColumn("timestamp", F.lit(None).cast("timestamp"))).cache()
    path = time_store.write_sorted(flows, os.path.join(tmp_out, "sorted"), partitions=12)
    files = time_store.manifest(spark, path).collect()
    assert len(files) > 8 and sum(f.rows for f in files) == flows.count() == 8503
    assert max(f.rows for f in files) < 2000                        # the hot instant is spread
    timed = [f for f in files if f["first"] is not None]
    assert all(a["last"] <= b["first"] for a, b in zip(timed, timed[1:]))
    rows = time_store.numbered(spark, path).collect()
    assert sorted(r.position for r in rows) == list(range(8503))
    key = [tuple((v is None, v) for v in r[:-1]) for r in sorted(rows, key=lambda r: r.position)]
    assert key == sorted(key)
    low, high = 1704067200 + 86400, 1704067200 + 90000
    part = time_store.read_sorted(spark, path, low, high)
    want = flows.where(f"unix_seconds(timestamp) >= {low} and unix_seconds(timestamp) < {high}")
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, want.collect())) and part.count() > 20
    assert len(part.inputFiles()) <= 2 < len(time_store.read_sorted(spark, path).inputFiles())
    assert time_store.read_sorted(spark, path, 4_000_000_000).collect() == []
    time_store.write_sorted(flows.limit(10), path)                   # replaced with its manifest
    assert time_store.read_sorted(spark, path).count() == 10
    flows.unpersist()


def test_module_constants():
    assert heavy.FIRST < heavy.BUCKETS and np.isclose(sketches.standard_error(), 0.008125)
