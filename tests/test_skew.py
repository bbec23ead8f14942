"""One source holding a third of all rows: results equal a brute force."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.operators.features import extract_features
from flowlens.operators.ics import agg_ics_diversity
from flowlens.operators.lateral import agg_lateral
from flowlens.sources.fixtures import flows_from_lineitem


def hot_flows(spark):
    f = flows_from_lineitem(spark, SF_SMALL)
    # a third of the rows (by a hash of the row) come from one scanner
    hot = (F.pmod(F.xxhash64(*f.columns), F.lit(3)) == 0)
    return f.withColumn("src_ip", F.when(hot, F.lit("10.9.9.9")).otherwise(F.col("src_ip")))


def test_lateral_groups_under_hot_source(spark):
    f = hot_flows(spark)
    pdf = f.toPandas()
    assert (pdf.src_ip == "10.9.9.9").mean() > 0.3
    pdf["time_window"] = pdf.timestamp.dt.floor("5min")
    want = (pdf.groupby(["src_ip", "time_window"])
               .agg(unique_dsts=("dst_ip", "nunique"), unique_ports=("dst_port", "nunique"),
                    packets=("packets", "sum"), bytes=("bytes", "sum"))
               .reset_index())
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = agg_lateral(f).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    m = want.merge(got, on=["src_ip", "time_window"], suffixes=("", "_s"))
    assert len(m) == len(want) == len(got)
    for c in ("unique_dsts", "unique_ports", "packets", "bytes"):
        assert (m[c] == m[c + "_s"]).all(), c


def test_ics_sources_under_hot_source(spark):
    f = extract_features(hot_flows(spark))
    pdf = f.where("is_ics_protocol = 1").toPandas()
    want = pdf.groupby("src_ip").agg(unique_dsts=("dst_ip", "nunique"), total_bytes=("bytes", "sum"))
    got = agg_ics_diversity(f).toPandas().set_index("src_ip")
    assert sorted(got.index) == sorted(want.index)
    assert (got.loc[want.index, "unique_dsts"] == want.unique_dsts).all()
    assert (got.loc[want.index, "total_bytes"] == want.total_bytes).all()
    assert want.loc["10.9.9.9", "unique_dsts"] == want.unique_dsts.max()
