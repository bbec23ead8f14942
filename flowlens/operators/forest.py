"""Isolation forest (Liu, Ting & Zhou, ICDM 2008) trained and applied on Spark.

Training
  1. One aggregate gives the row count and the per-feature mean and
     population standard deviation (the scaler).
  2. Each tree keeps every row with probability ``p = min(1, 1.5 psi / n)``,
     independently. This runs on distinct feature vectors with their
     multiplicity ``m`` (one ``groupBy``; a vector repeated in a third of the
     rows is one row after partial aggregation): the copies a tree takes
     from a vector are Binomial(m, p). One hash per vector decides whether
     it reaches any tree, so the ``T``-way expansion touches only the ~1.5 psi
     T drawn pairs. Keys are ``xxhash64`` of the raw values, so the sample
     does not depend on the partitioning. Expected draws per tree 1.5 psi
     (sd ~ 20 for psi = 256): falling short of psi is a > 6 sigma event.
  3. ``groupBy(tree_id).applyInPandas`` draws the copy counts, keeps the psi
     copies of lowest random rank and grows the tree; each group holds about
     1.5 psi distinct vectors whatever the duplication, so it is bounded.
  4. The node table (at most ``T * (2 psi - 1)`` rows) is collected once and
     broadcast; the score threshold is the ``contamination`` quantile of the
     training scores (approximate quantile sketch: mergeable, bounded memory).

Scoring is an iterator pandas UDF: Arrow batches, all trees traversed level
by level with NumPy gathers.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.common import Scratch, materialize
from flowlens.operators.quantiles import exact_quantile
from flowlens.schema import (DEFAULT_CONTAMINATION, DEFAULT_MAX_SAMPLES, DEFAULT_SEED,
                             DEFAULT_TREES, RISK_HIGH_BELOW, RISK_MEDIUM_BELOW)

EULER_GAMMA = 0.5772156649015329
OVERSAMPLE = 1.5
QUANTILE_ACCURACY = 100_000          # rank error of the threshold: 1 / accuracy of the rows
MAX_BROADCAST_DRAWS = 2_000_000      # (vector, tree) pairs, 24 bytes each
MAX_FOREST_BYTES = 512 << 20         # arrays broadcast for scoring
_U53 = float(1 << 53)

NODE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),     # -1 for a leaf
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
])


def c_factor(n):
    """Average path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER_GAMMA) - 2.0 * (nb - 1.0) / nb
    return out


@dataclass
class ForestModel:
    features: list
    means: list
    stds: list
    psi: int
    n_trees: int
    seed: int
    contamination: float
    threshold: float | None = None
    n_train: int = 0
    nodes: pd.DataFrame = field(default_factory=pd.DataFrame)
    # the training input and, stored, its scores (``iforest_train(keep_scores=True)``); not saved
    kept: tuple | None = field(default=None, repr=False, compare=False)

    # -- complete-tree arrays for scoring ------------------------------------
    def arrays(self):
        """Each tree as a complete binary tree of depth D: internal node ``c``
        has children ``2c+1`` / ``2c+2``; a leaf reached early is padded with
        never-taken splits (threshold +inf) down to depth D, its value copied
        to every padded leaf. Scoring is then D branch-free steps per tree."""
        nd = self.nodes
        depth = int(nd["depth"].max()) if len(nd) else 0
        n_int, n_leaf = 2 ** depth - 1, 2 ** depth
        feat = np.zeros((self.n_trees, max(n_int, 1)), dtype=np.int64)
        thr = np.full((self.n_trees, max(n_int, 1)), np.inf)
        leaf = np.zeros((self.n_trees, n_leaf))
        cols = {c: nd[c].to_numpy() for c in ("tree_id", "node_id", "feature", "threshold",
                                              "left", "right", "depth", "size")}
        value = cols["depth"] + c_factor(cols["size"])
        by_tree: dict = {}
        for i in range(len(nd)):
            by_tree.setdefault(int(cols["tree_id"][i]), {})[int(cols["node_id"][i])] = i
        for t, rows in by_tree.items():
            stack = [(0, 0)]                       # (node id, complete index)
            while stack:
                node, c = stack.pop()
                i = rows[node]
                if cols["feature"][i] < 0:
                    lo, span = c, 1
                    while lo < n_int:
                        lo, span = 2 * lo + 1, span * 2
                    leaf[t, lo - n_int: lo - n_int + span] = value[i]
                else:
                    feat[t, c] = cols["feature"][i]
                    thr[t, c] = cols["threshold"][i]
                    stack.append((int(cols["left"][i]), 2 * c + 1))
                    stack.append((int(cols["right"][i]), 2 * c + 2))
        return {"feature": feat, "threshold": thr, "leaf_value": leaf, "depth": depth,
                "norm": float(c_factor([self.psi])[0]) or 1.0}

    def params(self) -> dict:
        return {k: getattr(self, k) for k in
                ("features", "means", "stds", "psi", "n_trees", "seed", "contamination", "threshold",
                 "n_train")}


# --- scaler -------------------------------------------------------------------

def _value(f: str):
    """A feature as a number; NULL and NaN are 0."""
    x = F.col(f).cast("double")
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def _filled(features):
    return [_value(f).alias(f) for f in features]


def scale_fit(df: DataFrame, features: list) -> tuple[int, list, list]:
    """Row count, per-feature mean and population std (0 -> 1): one aggregate."""
    x = df.select(*_filled(features))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(features):
        aggs += [F.avg(f).alias(f"m{i}"), F.stddev_pop(f).alias(f"s{i}")]
    row = x.agg(*aggs).first()
    means = [float(row[f"m{i}"] or 0.0) for i in range(len(features))]
    stds = []
    for i in range(len(features)):
        s = row[f"s{i}"]
        stds.append(1.0 if (s is None or s == 0 or math.isnan(s)) else float(s))
    return int(row["_n"]), means, stds


def scale_apply(df: DataFrame, features: list, means: list, stds: list) -> DataFrame:
    """Scaled copies of the feature columns (``_z0 .. _zk``), JVM-side."""
    return df.withColumns({
        f"_z{i}": (_value(f) - F.lit(m)) / F.lit(s)
        for i, (f, m, s) in enumerate(zip(features, means, stds))
    })


# --- sampling -------------------------------------------------------------------

def _unit(h):
    """Map a 64-bit hash column to [0, 1)."""
    return F.pmod(h, F.lit(1 << 53)).cast("double") / F.lit(_U53)


def sample_for_trees(df: DataFrame, features: list, means: list, stds: list, n: int, psi: int,
                     n_trees: int, seed: int) -> DataFrame:
    """(vector, tree) pairs that draw at least one copy: ``tree_id, _key, _m, _z*``.

    Sampling is per row, Bernoulli(p) for each tree, but done on distinct
    feature vectors. Only their 64-bit keys are counted and shuffled (16 bytes
    a vector, partial aggregation absorbs a hot duplicate); the drawn keys,
    about 1.5 psi T whatever the input, are then looked up in the rows before
    any shuffle of feature values (broadcast up to ``MAX_BROADCAST_DRAWS``
    pairs, an ordinary join beyond). The copies a tree draws from a vector of
    multiplicity ``m`` are Binomial(m, p). A vector takes
    part in some tree with probability ``1 - (1-p)^(m T)`` (one hash); the
    first such tree follows the truncated geometric law, later trees their
    own hashes. Copy counts and their ranks are drawn in :func:`_grower`.
    Everything is keyed by the raw values, so the result does not depend on
    the partitioning.
    """
    raw = df.select(*_filled(features)).withColumn("_key", F.xxhash64(*[F.col(f) for f in features]))
    vec = raw.groupBy("_key").agg(F.count(F.lit(1)).alias("_m"))
    p = min(1.0, OVERSAMPLE * psi / n)
    log_miss = F.col("_m").cast("double") * F.lit(math.log1p(-p) if p < 1.0 else float("-inf"))
    hit_any = -F.expm1(log_miss * F.lit(float(n_trees)))          # 1 - z^T, z = (1-p)^m
    hit_one = -F.expm1(log_miss)                                   # 1 - z
    u_any = _unit(F.xxhash64("_key", F.lit(seed), F.lit(-1)))
    u_first = _unit(F.xxhash64("_key", F.lit(seed), F.lit(-2)))
    first = F.coalesce(F.least(F.floor(F.log1p(-u_first * hit_any) / log_miss),
                               F.lit(n_trees - 1)), F.lit(0)).cast("int")
    cand = vec.where(u_any < hit_any).withColumn("_first", first).withColumn("_hit", hit_one)
    tree_u = lambda t: _unit(F.xxhash64("_key", t, F.lit(seed)))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                      lambda t: (t == F.col("_first"))
                      | ((t > F.col("_first")) & (tree_u(t) < F.col("_hit"))))
    drawn = materialize(cand.withColumn("tree_id", F.explode(chosen)).select("_key", "_m", "tree_id"), "train-draws")
    keys = drawn.select("_key").distinct()
    if drawn.count() <= MAX_BROADCAST_DRAWS:
        keys = F.broadcast(keys)
    # one row per drawn vector (a repeated one is reduced before the shuffle), then its trees
    vectors = raw.join(keys, "_key", "left_semi").dropDuplicates(["_key"])
    z = scale_apply(vectors.join(drawn, "_key"), features, means, stds)
    return z.select("tree_id", "_key", "_m", *[f"_z{i}" for i in range(len(features))])


# --- tree growth (runs inside applyInPandas) -------------------------------

def _grow_tree(x: np.ndarray, rng: np.random.Generator, height_limit: int):
    """Array-form isolation tree: rows of (node, feature, threshold, left,
    right, depth, size)."""
    nodes = []

    def build(idx, depth):
        node_id = len(nodes)
        nodes.append(None)
        size = len(idx)
        if depth >= height_limit or size <= 1:
            nodes[node_id] = (node_id, -1, 0.0, -1, -1, depth, size)
            return node_id
        sub = x[idx]
        lo = sub.min(axis=0)
        hi = sub.max(axis=0)
        varying = np.flatnonzero(hi > lo)
        if len(varying) == 0:
            nodes[node_id] = (node_id, -1, 0.0, -1, -1, depth, size)
            return node_id
        f = int(varying[rng.integers(len(varying))])
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] <= thr
        left = build(idx[go_left], depth + 1)
        right = build(idx[~go_left], depth + 1)
        nodes[node_id] = (node_id, f, thr, left, right, depth, size)
        return node_id

    build(np.arange(len(x)), 0)
    return nodes


def draw_copies(m: np.ndarray, p: float, rng: np.random.Generator) -> np.ndarray:
    """Copies drawn from vectors of multiplicity ``m`` given at least one:
    the first success index J (truncated geometric), then Binomial on the
    remaining trials."""
    m = m.astype(np.int64)
    if p >= 1.0:
        return m
    u = rng.random(len(m))
    hit = -np.expm1(m * math.log1p(-p))
    j = np.floor(np.log1p(-u * hit) / math.log1p(-p)).astype(np.int64)
    j = np.clip(j, 0, m - 1)
    return 1 + rng.binomial(m - 1 - j, p)


def _grower(k: int, psi: int, n: int, seed: int):
    height_limit = int(math.ceil(math.log2(max(psi, 2))))
    p = min(1.0, OVERSAMPLE * psi / n)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree_id"].iloc[0])
        pdf = pdf.sort_values("_key", kind="mergesort")
        rng = np.random.default_rng([seed, tree_id])
        copies = draw_copies(pdf["_m"].to_numpy(), p, rng)
        rows = np.repeat(np.arange(len(pdf)), copies)
        rank = rng.random(len(rows))
        keep = rows[np.argsort(rank, kind="stable")[:psi]]
        x = pdf[[f"_z{i}" for i in range(k)]].to_numpy(dtype=float)[np.sort(keep)]
        nodes = _grow_tree(x, rng, height_limit)
        out = pd.DataFrame(nodes, columns=["node_id", "feature", "threshold", "left", "right", "depth", "size"])
        out.insert(0, "tree_id", tree_id)
        return out.astype({"tree_id": "int32", "node_id": "int32", "feature": "int32", "left": "int32",
                           "right": "int32", "depth": "int32", "size": "int32", "threshold": "float64"})
    return grow


# --- scoring ---------------------------------------------------------------------

def path_lengths(x: np.ndarray, arr: dict) -> np.ndarray:
    """Mean path length of each row of ``x`` (rows x features) over all trees."""
    m = x.shape[0]
    flat = np.ascontiguousarray(x.T).ravel()       # feature-major: value of f at f*m + row
    rows = np.arange(m)
    feat, thr, leaf, depth = arr["feature"], arr["threshold"], arr["leaf_value"], arr["depth"]
    n_int = 2 ** depth - 1
    acc = np.zeros(m)
    for t in range(leaf.shape[0]):
        ft, tt = feat[t], thr[t]
        node = np.zeros(m, dtype=np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (flat[ft[node] * m + rows] > tt[node])
        acc += leaf[t][node - n_int]
    return acc / leaf.shape[0]


def _score_udf(bc):
    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        arr = bc.value
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            h = path_lengths(x, arr)
            yield pd.Series(-np.power(2.0, -h / arr["norm"]))
    return score


def _raw_scores(model: ForestModel, df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    k = len(model.features)
    arrays = model.arrays()
    size = sum(a.nbytes for a in arrays.values() if isinstance(a, np.ndarray))
    if size > MAX_FOREST_BYTES:
        raise ValueError(f"the forest's arrays take {size} bytes, the limit is {MAX_FOREST_BYTES}: fewer or shallower trees")
    bc = spark.sparkContext.broadcast(arrays)
    z = scale_apply(df, model.features, model.means, model.stds)
    udf = _score_udf(bc)
    zs = F.struct(*[F.col(f"_z{i}") for i in range(k)])
    return z.withColumn("anomaly_score", udf(zs)).drop(*[f"_z{i}" for i in range(k)])


def iforest_threshold(scored: DataFrame, contamination: float, exact: bool = False) -> float:
    """The ``contamination`` quantile of the scores; see :func:`iforest_train`.
    ``exact`` stores the scores and narrows a bracket around the quantile
    (:mod:`flowlens.operators.quantiles`)."""
    if exact:
        with Scratch(scored.sparkSession):
            stored = materialize(scored.select("anomaly_score"), "train-scores")
            return float(exact_quantile(stored, "anomaly_score", float(contamination)))
    q = F.percentile_approx("anomaly_score", float(contamination), QUANTILE_ACCURACY)
    return float(scored.agg(q).first()[0])


# --- public API -------------------------------------------------------------------

def iforest_train(df: DataFrame, features: list | None = None, n_trees: int = DEFAULT_TREES,
                  contamination: float = DEFAULT_CONTAMINATION, seed: int = DEFAULT_SEED,
                  max_samples: int = DEFAULT_MAX_SAMPLES, materialize_input: bool = True,
                  exact_threshold: bool = False, keep_scores: bool | Callable = False) -> ForestModel:
    """Fit scaler and forest; ``features=None`` selects numeric columns.

    The threshold is a mergeable quantile sketch of the training scores with a
    rank error of 1 / ``QUANTILE_ACCURACY`` of the rows; ``exact_threshold``
    takes the exact quantile instead (a few more passes over the stored scores).
    The threshold needs the score of every training row: with ``keep_scores`` that
    pass stores the scored input, and :func:`iforest_score` of the same frame reads
    it instead of running the forest a second time (a function stores the scored
    frame it is given its own way, and returns the frame that reads it)."""
    from flowlens.operators.features import select_numeric
    features = list(features) if features is not None else select_numeric(df)
    if not features:
        raise ValueError("No numeric feature columns to train on")
    # Three passes read the training matrix (scaler, sampling, threshold):
    # write it once instead of re-deriving the features (fan-out join) thrice.
    rows, df = df, df.select(*_filled(features))
    if materialize_input and not df.isStreaming:
        df = materialize(df, "train-matrix")
    n, means, stds = scale_fit(df, features)
    if n == 0:
        raise ValueError("Cannot train on an empty input")
    psi = min(max_samples, n)
    k = len(features)
    sample = sample_for_trees(df, features, means, stds, n, psi, n_trees, seed)
    node_pdf = (sample.groupBy("tree_id").applyInPandas(_grower(k, psi, n, seed), NODE_SCHEMA)
                .toPandas())
    model = ForestModel(features, means, stds, psi, n_trees, seed, contamination, None, n, node_pdf)
    if keep_scores:
        keep = keep_scores if callable(keep_scores) else lambda table: materialize(table, "train-scored")
        scored = keep(_raw_scores(model, rows))
        model.kept = (rows, scored)
    else:
        scored = _raw_scores(model, df)
    model.threshold = iforest_threshold(scored, contamination, exact_threshold)
    return model


def kept_input(model: ForestModel, spark: SparkSession) -> DataFrame | None:
    """The frame whose scores the model keeps, while they can be read in this session."""
    if not model.kept or model.kept[0].sparkSession is not spark:
        return None
    tables = [t.stored_path for t in model.kept if hasattr(t, "stored_path")]
    return model.kept[0] if all(_exists(spark, p) for p in tables) else None


def iforest_score(model: ForestModel, df: DataFrame) -> DataFrame:
    """Adds ``anomaly_score`` in [-1, 0) (lower = more anomalous) and
    ``is_anomaly`` (score below the training threshold)."""
    if model is None or model.threshold is None:
        raise ValueError("Model not trained")
    kept = kept_input(model, df.sparkSession)
    out = model.kept[1] if kept is not None and kept is df else _raw_scores(model, df)
    return out.withColumn("is_anomaly", (F.col("anomaly_score") < F.lit(model.threshold)).cast("int"))


def risk_band(score: str = "anomaly_score"):
    """high (< -0.5), medium ([-0.5, -0.3)), low (>= -0.3)."""
    s = F.col(score)
    return (F.when(s < RISK_HIGH_BELOW, F.lit("high"))
            .when(s < RISK_MEDIUM_BELOW, F.lit("medium"))
            .when(s.isNotNull(), F.lit("low")))


def score_summary(scored: DataFrame) -> DataFrame:
    """Anomaly count and percentage (1 row)."""
    return scored.agg(F.count(F.lit(1)).alias("total_flows"),
                      F.coalesce(F.sum("is_anomaly"), F.lit(0)).cast("long").alias("total_anomalies")) \
        .withColumn("anomaly_rate", F.coalesce(F.try_divide(F.col("total_anomalies") * 100.0,
                                                            F.col("total_flows")), F.lit(0.0)))


def model_save(model: ForestModel, spark: SparkSession, path: str) -> None:
    """Node table as Parquet, parameters as one JSON row; a model at ``path`` is
    replaced as a whole (:mod:`flowlens.plans.staged`)."""
    from flowlens.plans.staged import swap_in

    def write(folder: str) -> None:
        spark.createDataFrame(model.nodes, NODE_SCHEMA).coalesce(1).write.parquet(f"{folder}/nodes")
        spark.createDataFrame([(json.dumps(model.params()),)], "params string") \
            .coalesce(1).write.text(f"{folder}/params")
    swap_in(spark, path, write)


def model_load(spark: SparkSession, path: str) -> ForestModel:
    from flowlens.plans.staged import recover
    recover(spark, path)
    params = json.loads(spark.read.text(f"{path}/params").first()[0])
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").toPandas()
    return ForestModel(nodes=nodes, **params)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    return bool(hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp))


def train_or_load(spark: SparkSession, path: str, df: DataFrame, **train_kw) -> ForestModel:
    """Use the saved model at ``path`` if there is one, else train on ``df``
    with automatic features and save it. A model that exists but cannot be
    read raises instead of being silently replaced."""
    from flowlens.plans.staged import recover
    recover(spark, path)
    if _exists(spark, f"{path}/params"):
        return model_load(spark, path)
    model = iforest_train(df, **train_kw)
    model_save(model, spark, path)
    return model
