"""Groups written in portions equal those written at once; of the flows one stored copy stays."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.operators import common
from flowlens.operators.common import created_tables, materialize_parts, portions
from flowlens.operators.exfil import detect_exfil
from flowlens.operators.features import extract_features
from flowlens.operators.ics import detect_ics
from flowlens.operators.lateral import detect_lateral
from flowlens.plans import model_queries, store_queries
from flowlens.sources.fixtures import flows_from_lineitem


def rows(df) -> list:
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("detect", [detect_lateral, detect_exfil, detect_ics])
@pytest.mark.parametrize("timed", [True, False])
def test_portions_give_the_groups_of_one_pass(spark, monkeypatch, detect, timed):
    flows = flows_from_lineitem(spark, SF_SMALL)
    hot = F.pmod(F.xxhash64(*flows.columns), F.lit(3)) == 0
    flows = flows.withColumn("src_ip", F.when(hot, F.lit("10.9.9.9")).when(F.col("src_port") % 50 > 0, F.col("src_ip")))
    f = extract_features(flows if timed else flows.drop("timestamp"))
    whole = rows(detect(f))
    monkeypatch.setattr(common, "PORTION_ROWS", 250)
    assert len(portions(f, "src_ip")) == common.MAX_PORTIONS
    assert rows(detect(f)) == whole and whole


def test_no_rows_give_one_empty_portion(spark):
    none = spark.range(0)
    parts = portions(none, "id")
    assert len(parts) == 1 and materialize_parts(parts, "none").count() == 0


def test_trained_summary_keeps_one_narrow_copy_of_the_flows(spark):
    model_queries._MODELS.pop(SF_SMALL, None)
    before = len(created_tables())
    store_queries.q_trained_attack_summary(spark, SF_SMALL).collect()
    left = {os.path.basename(p).rsplit("-", 1)[0]: p for p in created_tables()[before:]}
    assert not [n for n in left if n.startswith(("flowlens-features", "flowlens-ics", "flowlens-lateral", "flowlens-exfil"))]
    flows = flows_from_lineitem(spark, SF_SMALL)
    stored = spark.read.parquet(left["flowlens-train-scored"])
    assert stored.columns == [*flows.columns, "unique_destinations", "anomaly_score"]
    features = extract_features(flows)
    assert rows(model_queries._trained_on(spark, SF_SMALL).select(features.columns)) == rows(features)
    assert model_queries._scored(spark, SF_SMALL).columns == [*features.columns, "anomaly_score", "is_anomaly"]
