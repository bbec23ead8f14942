
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.operators.features import extract_features, select_features
from flowlens.operators.forest import (c_factor, iforest_score, iforest_train, model_load, model_save,
                                       path_lengths, sample_for_trees, scale_fit,
                                       train_or_load)
from flowlens.sources.fixtures import flows_from_lineitem


@pytest.fixture(scope="module")
def feats(spark):
    f = extract_features(flows_from_lineitem(spark, SF_SMALL))
    return f.select(*select_features(f), "src_ip", "dst_ip", "timestamp").cache()


@pytest.fixture(scope="module")
def model(feats):
    return iforest_train(feats, select_features(feats))


def test_c_factor():
    assert c_factor([0, 1, 2])[0] == 0 and c_factor([1])[0] == 0 and c_factor([2])[0] == 1.0
    assert abs(c_factor([256])[0] - 10.2449) < 1e-3


def test_flagged_share_near_contamination(model, feats):
    s = iforest_score(model, feats)
    share = s.agg(F.avg("is_anomaly")).first()[0]
    assert abs(share - 0.05) <= 0.005


def test_scores_in_range(model, feats):
    s = iforest_score(model, feats).agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert -1.0 <= s[0] and s[1] < 0.0


def test_tree_shape(model):
    nd = model.nodes
    assert nd["tree_id"].nunique() == 100
    assert nd["depth"].max() <= 8
    roots = nd[nd["node_id"] == 0]
    assert (roots["size"] == 256).all()


def test_planted_outlier_ranks_worst(spark, model, feats):
    cols = select_features(feats)
    # far outside the training range in every feature at once
    odd = feats.limit(1).select(*[(F.col(c) * 1000 + 1e7).alias(c) for c in cols],
                                "src_ip", "dst_ip", "timestamp")
    allrows = feats.unionByName(odd.withColumn("src_ip", F.lit("planted")))
    s = iforest_score(model, allrows)
    worst = s.orderBy("anomaly_score").limit(int(0.01 * feats.count())).select("src_ip").collect()
    assert "planted" in [r.src_ip for r in worst]


def test_scaled_bytes_lower_mean_score(spark, model, feats):
    s = iforest_score(model, feats.withColumn("bytes", F.col("bytes") * 500)
                      .withColumn("bytes_per_packet", F.col("bytes_per_packet") * 500)
                      .withColumn("bytes_per_second", F.col("bytes_per_second") * 500))
    base = iforest_score(model, feats)
    assert s.agg(F.avg("anomaly_score")).first()[0] < base.agg(F.avg("anomaly_score")).first()[0]


def test_save_load_identical_scores(spark, model, feats, tmp_out):
    model_save(model, spark, tmp_out + "/m")
    m2 = model_load(spark, tmp_out + "/m")
    a = [r.anomaly_score for r in iforest_score(model, feats).orderBy("src_ip", "dst_ip", "timestamp",
                                                                      "anomaly_score").collect()]
    b = [r.anomaly_score for r in iforest_score(m2, feats).orderBy("src_ip", "dst_ip", "timestamp",
                                                                   "anomaly_score").collect()]
    assert a == b and m2.threshold == model.threshold
    assert train_or_load(spark, tmp_out + "/m", feats).threshold == model.threshold


def test_untrained_errors(feats):
    with pytest.raises(ValueError):
        iforest_score(None, feats)


def test_sampling_independent_of_partitioning(spark, feats):
    cols = select_features(feats)
    n, means, stds = scale_fit(feats, cols)
    a = sample_for_trees(feats, cols, means, stds, n, 256, 100, 42)
    b = sample_for_trees(feats.repartition(13), cols, means, stds, n, 256, 100, 42)
    key = ["tree_id", "_key", "_m"]
    ra = sorted(tuple(r) for r in a.select(*key).collect())
    rb = sorted(tuple(r) for r in b.select(*key).collect())
    assert ra == rb
    per_tree = a.groupBy("tree_id").agg(F.sum("_m").alias("c")).agg(F.min("c"), F.max("c")).first()
    assert per_tree[0] >= 256 and per_tree[1] < 600


def test_hot_duplicate_is_bounded_and_sampled(spark):
    """A vector holding half of all rows: every tree group stays small and
    the vector is in (nearly) every tree with about psi/2 copies."""
    from pyspark.sql import functions as F
    n = 200_000
    df = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit(5.0)).otherwise(F.col("id").cast("double")).alias("a"),
        F.when(F.col("id") % 2 == 0, F.lit(1.0)).otherwise((F.col("id") % 97).cast("double")).alias("b"))
    n_, means, stds = scale_fit(df, ["a", "b"])
    pairs = sample_for_trees(df, ["a", "b"], means, stds, n_, 256, 100, 42)
    per_tree = pairs.groupBy("tree_id").count().agg(F.max("count")).first()[0]
    assert per_tree < 600
    hot = pairs.where(F.col("_m") == n // 2).select("tree_id").distinct().count()
    assert hot >= 99
    model = iforest_train(df, ["a", "b"])
    hot_score = iforest_score(model, df.where(F.col("a") == 5.0).limit(1)).first().anomaly_score
    assert hot_score > model.threshold


def test_model_identical_under_partitioning(spark, feats, model):
    cols = select_features(feats)
    m2 = iforest_train(feats.repartition(5), cols)
    assert np.allclose(m2.nodes.sort_values(["tree_id", "node_id"])["threshold"].to_numpy(),
                       model.nodes.sort_values(["tree_id", "node_id"])["threshold"].to_numpy())


def test_path_lengths_small_trees():
    import pandas as pd
    from flowlens.operators.forest import ForestModel
    # tree 0: single leaf of 4 rows at depth 0; tree 1: split on feature 1 at 0.5
    nodes = pd.DataFrame([(0, 0, -1, 0.0, -1, -1, 0, 4),
                          (1, 0, 1, 0.5, 1, 2, 0, 4), (1, 1, -1, 0.0, -1, -1, 1, 1),
                          (1, 2, -1, 0.0, -1, -1, 1, 3)],
                         columns=["tree_id", "node_id", "feature", "threshold", "left", "right", "depth", "size"])
    m = ForestModel(["a", "b"], [0, 0], [1, 1], 4, 2, 1, 0.1, 0.0, 4, nodes)
    x = np.array([[0.0, 0.0], [0.0, 1.0]])
    got = path_lengths(x, m.arrays())
    c4, c3 = c_factor([4])[0], c_factor([3])[0]
    assert np.allclose(got, [(c4 + 1.0) / 2, (c4 + 1.0 + c3) / 2])
