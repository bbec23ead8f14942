"""NN-descent: recall and scores against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm.nn_descent import _codes, graph_search, nearest, neighbour_graph


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows
          if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for q, v in zip(ids, u):
        if q % every == 0:
            s = u @ v
            out[int(q)] = [(int(ids[j]), float(s[j])) for j in
                           sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-round(s[j], 12), ids[j]))[:k]]
    return out


def found(out):
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


SCHEMA = "vec_id long, embedding array<float>, node string"


def test_recall_on_clustered_and_on_random_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 24))
    x = np.vstack([centres[rng.integers(0, 20, 1500)] + 0.3 * rng.standard_normal((1500, 24)),
                   rng.standard_normal((500, 24))]).astype(np.float32)
    rows = [(i, x[i].tolist(), "n") for i in range(len(x))]
    got = found(nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    want = brute([r[:2] for r in rows], 5, 20)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.97 * 5 * len(want)
    for q in got:
        truth = dict(brute([r[:2] for r in rows], len(rows), 10**9).get(q, [])) if q == 0 else {}
        for i, s in got[q]:
            v, w = x[q].astype(float), x[i].astype(float)
            assert s == pytest.approx(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), abs=1e-12)
            assert not truth or truth[i] == pytest.approx(s, abs=1e-12)


def test_equal_vectors_ties_and_rows_that_take_no_part(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(100, 140)] + [(i, [0.0, 1.0, 0.1 * i]) for i in range(8)]
    rows += [(50, None), (51, [0.0, 0.0, 0.0]), (52, [float("nan"), 1.0, 0.0]), (53, [float("inf"), 0.0, 0.0]), (54, []),
             (55, [1.0, None, 0.0]), (None, [1.0, 1.0, 1.0]), (100, [1.0, 0.0, 0.0])]
    got = found(nearest(spark.createDataFrame([(*r, "n") for r in rows], SCHEMA), F.col("vec_id") % 10 == 0))
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105] and [i for i, _ in got[130]] == [100, 101, 102, 103, 104]
    assert sorted(got) == [0, 100, 110, 120, 130]
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]


def test_few_candidates_and_empty_tables(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], "n")], SCHEMA)
    assert nearest(one, F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], "n"), (1, [2.0], "n")], SCHEMA)   # the shorter one is filled up with zeros
    assert found(nearest(two, F.col("vec_id") % 50 == 0)) == {0: [(1, pytest.approx(1 / np.sqrt(5)))]}
    assert nearest(one.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_queries_that_are_not_in_the_index_enter_by_the_sample(spark):
    x = np.random.default_rng(2).standard_normal((600, 8))
    vectors = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(_codes(x))], "node long, code binary")
    queries = spark.createDataFrame([(1000 + i, -1 - i, bytearray(c)) for i, c in enumerate(_codes(x[:10] + 0.01))],
                                    "query_id long, node long, code binary")
    graph = neighbour_graph(vectors)
    best = graph_search(graph, vectors, queries).groupBy("query_id").agg(F.max_by("node", "sim").alias("node")).collect()
    assert {(r["query_id"], r["node"]) for r in best} == {(1000 + i, i) for i in range(10)}


def test_recall_in_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    one = rng.standard_normal(64)
    jitter = rng.standard_normal((1500, 64))
    x = np.vstack([one / np.linalg.norm(one) + 0.003 * jitter / np.linalg.norm(jitter, axis=1, keepdims=True),
                   rng.standard_normal((300, 64))]).astype(np.float32)
    rows = [(i, x[i].tolist(), "n") for i in range(len(x))]
    got = found(nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 15 == 0))
    want = brute([r[:2] for r in rows], 5, 15)
    near = [q for q in want if q < 1500]
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in near)
    assert hits >= 0.95 * 5 * len(near)
