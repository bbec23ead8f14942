"""Approximate nearest neighbours by NN-descent and greedy graph search.

The index is a graph of every distinct vector's ``K`` nearest ones. It starts
from blocks of vectors on the same side of random hyperplanes and is refined
by NN-descent: the neighbours and reverse neighbours of a vector are compared
with each other (the neighbours of a neighbour), and better ones are kept,
until few rows change. Each round is a join of the edges with the vectors and
two groupings. A vector that many others point to has its neighbourhood cut
into parts, so no group is unbounded and nobody is left out.

Queries walk the graph, in both directions of its edges, greedily: from a
query's own node, or the nearest of a bounded sample of entry nodes, the best
``WIDTH`` unexpanded nodes' neighbours are joined in and the best ``EF`` are
kept, until nothing better turns up. The adjacency table holds the
neighbours' vectors and is bucketed by node, so each hop shuffles the
queries' few open nodes only. The nodes found are then measured exactly, in
double precision. Rows with a neighbourhood's vectors are read and handed to
Python in small batches, as 4096 or 10,000 of them would be 70 to 170 MB a task.

Equal vectors are one node; of each the ``k + 1`` smallest vec_ids stay, which
is exact, as ties go to the smaller vec_id. Graph rounds and the search rank by
cosines in double precision of float32 components, so that the members of a
large group of near copies are told apart. Vectors that are NULL, zero or hold NULL or
non-finite components, and rows without a vec_id, take no part; shorter
vectors count as filled up with zeros.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.common import drop_stored, drop_tables, materialize, settled, track_table
from flowlens.session import checkpoint_dir, small_batches

K = 28                # neighbours per node
EF = 256              # nodes kept per query
WIDTH = 32            # nodes expanded per query and hop
BLOCK = 128           # vectors per block of the start graph
STARTS = 2            # start graphs
ROUNDS = 6            # NN-descent rounds at most
MIN_CHANGE = 0.02     # a round that changes a smaller share of the edges is the last
PART = 64             # members of a neighbourhood compared together
OFFERS = 5            # candidates a member takes from one neighbourhood
HOPS = 24             # expansions per query at most
ENTRIES = 512         # entry nodes for queries that are not in the index


# --- vectors in Arrow batches ------------------------------------------------

def _codes(x: np.ndarray) -> list[bytes]:
    """Rows as float32 components, scaled by a power of two: float32 values stay what they are."""
    x = x.astype(np.float64)
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))    # against overflow of the squares
    return [row.tobytes() for row in np.ldexp(x, -exponent).astype("<f4")]


def _vectors(column) -> np.ndarray:
    """The unit vectors of a column of codes, in double precision: near copies differ
    by less in cosine than single precision tells apart."""
    raw = column.to_pylist()
    if not raw:
        return np.zeros((0, 1))
    x = np.frombuffer(b"".join(raw), "<f4").reshape(len(raw), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(dim: int):
    def run(batches):
        for batch in batches:
            lists = batch.column(1).to_pylist()
            if not lists:
                continue
            x = np.zeros((len(lists), dim))
            for i, v in enumerate(lists):
                x[i, :len(v)] = v
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_codes(x), pa.binary())],
                                             names=["node", "code"])
    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>, node): rows that take part; node is the vector's 64-bit hash."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return e.where("vec_id is not null and embedding is not null").where(F.size("embedding") > 0) \
        .where(F.coalesce(finite, F.lit(False))).where(F.exists("embedding", lambda x: x != 0.0)) \
        .withColumn("node", F.xxhash64("embedding"))


# --- the graph ---------------------------------------------------------------

def _compare(members, k: int):
    """Pairwise similarities inside each row's list; candidates better than a
    member's worst neighbour, at most the ``k`` best per member and list."""
    def run(batches):
        for batch in batches:
            col = batch.column(members)
            flat, offsets = col.flatten(), col.offsets.to_numpy()
            offsets = offsets - offsets[0]
            node = flat.field("node").to_numpy(zero_copy_only=False)
            worst = flat.field("worst").to_numpy(zero_copy_only=False)
            new = flat.field("new").to_numpy(zero_copy_only=False)
            unit = _vectors(flat.field("code"))
            src, dst, sim = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                if b - a < 2:
                    continue
                s = unit[a:b] @ unit[a:b].T
                np.fill_diagonal(s, -2)
                s[~(new[a:b, None] | new[None, a:b])] = -2
                s[s <= worst[a:b, None]] = -2
                if b - a > k + 1:
                    cut = np.partition(s, b - a - k, axis=1)[:, b - a - k]
                    s[s < cut[:, None]] = -2
                i, j = np.nonzero(s > -2)
                src.append(node[a:b][i])
                dst.append(node[a:b][j])
                sim.append(s[i, j])
            if src:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(src)), pa.array(np.concatenate(dst)), pa.array(np.concatenate(sim))],
                    names=["src", "dst", "sim"])
    return run


_EDGES = "src long, dst long, sim double"


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest rows per src of (src, dst, sim, new), each dst once."""
    best = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("new").alias("new")) \
        .withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)


def _start(vectors: DataFrame, n: int, dim: int, k: int, seed: int) -> DataFrame:
    """Each node's nearest ones in its block: same side of log2(n / BLOCK)
    hyperplanes; larger blocks are cut into parts by hash."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / BLOCK)))))
    planes = np.random.default_rng(seed).standard_normal((dim, bits)).astype(np.float32)

    def sides(batches):
        for batch in batches:
            x = _vectors(batch.column(1))
            side = ((x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64) if bits and len(x) \
                else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(side)],
                                             names=["node", "code", "block"])

    coded = materialize(vectors.mapInArrow(sides, "node long, code binary, block long"), "nn-blocks")
    sizes = coded.groupBy("block").agg(F.count("*").alias("n"))
    parts = coded.join(materialize(sizes, "nn-block-sizes"), "block") \
        .withColumn("part", F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(F.col("n") / (2 * BLOCK))))
    return parts.groupBy("block", "part").agg(F.collect_list(F.struct(
        "node", "code", F.lit(-1.5).alias("worst"), F.lit(True).alias("new"))).alias("members")) \
        .select("members").mapInArrow(_compare(0, k), _EDGES)


def neighbour_graph(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """``vectors(node, code)`` -> ``(src, dst, sim)``: approximately the k nearest
    nodes of each node."""
    first = vectors.select("code").first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], _EDGES)
    n, dim = vectors.count(), len(first["code"]) // 4
    spark = vectors.sparkSession

    def begin() -> DataFrame:
        starts = [_start(vectors, n, dim, k, seed) for seed in range(STARTS)]
        return _best(reduce(DataFrame.unionByName, starts).withColumn("new", F.lit(True)), k)

    def refined() -> DataFrame:
        worst = graph.groupBy("src").agg(F.min("sim").alias("worst"), F.count("*").alias("have")) \
            .select(F.col("src").alias("node"),
                    F.when(F.col("have") >= k, F.col("worst")).otherwise(F.lit(-1.5)).alias("worst"))
        known = materialize(vectors.join(worst, "node"), "nn-known")
        both = graph.select(F.col("src").alias("centre"), F.col("dst").alias("node"), "new") \
            .unionByName(graph.select(F.col("dst").alias("centre"), F.col("src").alias("node"), "new")) \
            .groupBy("centre", "node").agg(F.max("new").alias("new"))
        both = materialize(both, "nn-both")
        sizes = materialize(both.groupBy("centre").agg(F.count("*").alias("n"), F.max("new").alias("any"))
                            .where("any and n > 1").select("centre", "n"), "nn-sizes")
        spread = both.join(sizes, "centre").withColumn(
            "part", F.pmod(F.xxhash64("centre", "node"), F.ceil(F.col("n") / PART)))
        lists = spread.select("centre", "part", "node", "new").join(known, "node") \
            .groupBy("centre", "part").agg(F.collect_list(F.struct("node", "code", "worst", "new")).alias("members"))
        found = lists.select("members").mapInArrow(_compare(0, OFFERS), _EDGES).withColumn("new", F.lit(True))
        old = graph.select("src", "dst", "sim", F.lit(False).alias("new"))
        return _best(old.unionByName(found), k)

    graph = settled(spark, "nn-graph", begin)
    for _ in range(rounds):
        before, graph = graph, settled(spark, "nn-graph", refined)
        drop_stored(before)
        changed = graph.agg(F.avg(F.col("new").cast("int"))).first()[0] or 0.0
        if changed < MIN_CHANGE:
            break
    return graph.select("src", "dst", "sim")


# --- search ------------------------------------------------------------------

def _score_pairs(batches):
    """(query_id, node, query's code, node's code) -> (query_id, node, sim)."""
    for batch in batches:
        a, b = _vectors(batch.column(2)), _vectors(batch.column(3))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.einsum("ij,ij->i", a, b) if len(a) else a[:, 0])],
            names=["query_id", "node", "sim"])


def _expand(batches):
    """(query_id, code, worst, near: list of (node, code)) -> neighbours better than the worst kept."""
    for batch in batches:
        near = batch.column(3)
        flat, offsets = near.flatten(), near.offsets.to_numpy()
        offsets = offsets - offsets[0]
        nodes, codes = flat.field("node").to_numpy(zero_copy_only=False), flat.field("code")
        q, worst = _vectors(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
        ids, out = batch.column(0).to_numpy(zero_copy_only=False), ([], [], [])
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            sim = _vectors(codes.slice(a, b - a)) @ q[i]
            keep = np.flatnonzero(sim > worst[i])
            for column, values in zip(out, (np.full(len(keep), ids[i]), nodes[a:b][keep], sim[keep])):
                column.append(values)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out],
                                             names=["query_id", "node", "sim"])


def adjacency(graph: DataFrame, vectors: DataFrame) -> tuple[str, str]:
    """Name and folder of the table ``(at, near)``: the neighbours of each node along edges of either
    direction, with their codes, in parts of about ``PART``; a table bucketed by
    ``at`` under the shared checkpoint folder."""
    spark = graph.sparkSession
    edges = graph.select(F.col("src").alias("at"), F.col("dst").alias("node")) \
        .unionByName(graph.select(F.col("dst").alias("at"), F.col("src").alias("node"))).distinct()
    edges = materialize(edges, "nn-edges")
    sizes = materialize(edges.groupBy("at").agg(F.count("*").alias("n")), "nn-degrees")
    lists = edges.join(sizes, "at").withColumn("part", F.pmod(F.xxhash64("at", "node"), F.ceil(F.col("n") / PART))) \
        .join(vectors, "node").groupBy("at", "part") \
        .agg(F.collect_list(F.struct("node", "code")).alias("near")).select("at", "near")
    name = f"nn_adjacency_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = os.path.join(checkpoint_dir(spark), name)
    lists.repartition(buckets, "at").write.bucketBy(buckets, "at").sortBy("at") \
        .option("path", path).format("parquet").saveAsTable(name)
    track_table(path)
    return name, path


def graph_search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, ef: int = EF, width: int = WIDTH,
                 hops: int = HOPS) -> DataFrame:
    """``queries(query_id, node, code)`` -> ``(query_id, node, sim)``: the ``ef``
    nearest nodes found by greedy search. ``node`` is the query's own node in
    the graph, where it has one."""
    spark = graph.sparkSession
    table, path = adjacency(graph, vectors)
    near = spark.table(table)
    pairs = "query_id long, node long, sim double"
    q = queries.select("query_id", "code")

    own = queries.join(vectors.select("node"), "node", "left_semi").select("query_id", "node")
    strangers = queries.join(vectors.select("node"), "node", "left_anti").select("query_id", "code")
    entries = [tuple(r) for r in vectors.orderBy(F.xxhash64("node", F.lit(1))).limit(ENTRIES).collect()]
    shared = spark.sparkContext.broadcast(entries)        # ENTRIES vectors

    def enter(batches):
        ids = np.array([e[0] for e in shared.value], np.int64)
        x = _vectors(pa.array([bytes(e[1]) for e in shared.value], pa.binary()))
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            top = np.argsort(-(_vectors(batch.column(1)) @ x.T), axis=1)[:, :width]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), top.shape[1])), pa.array(ids[top].ravel())],
                names=["query_id", "node"])

    start = own.unionByName(strangers.mapInArrow(enter, "query_id long, node long"))
    start = start.join(vectors, "node").join(q.withColumnRenamed("code", "q"), "query_id") \
        .select("query_id", "node", "q", "code").mapInArrow(_score_pairs, pairs)
    beam_of = Window.partitionBy("query_id").orderBy(F.desc("sim"), "node")
    open_of = Window.partitionBy("query_id", "done").orderBy(F.desc("sim"), "node")
    of_query = Window.partitionBy("query_id")

    def ranked(beam: DataFrame) -> DataFrame:
        """The ef best, which of them are expanded next, and the worst kept similarity once ef are there."""
        return settled(spark, "nn-beam", lambda: (
            beam.withColumn("r", F.row_number().over(beam_of)).where(F.col("r") <= ef)
            .withColumn("turn", ~F.col("done") & (F.row_number().over(open_of) <= width))
            .withColumn("worst", F.when(F.count("*").over(of_query) >= ef, F.min("sim").over(of_query))
                        .otherwise(F.lit(-2.0))).drop("r")))

    beam = ranked(start.withColumn("done", F.lit(False)))
    for _ in range(hops):
        front = beam.where("turn").select("query_id", F.col("node").alias("at"), "worst").join(q, "query_id")
        if front.isEmpty():
            break
        found = front.join(near, "at").select("query_id", "code", "worst", "near").mapInArrow(_expand, pairs)
        kept = beam.select("query_id", "node", "sim", (F.col("done") | F.col("turn")).alias("done"))
        before, beam = beam, ranked(kept.unionByName(found.withColumn("done", F.lit(False)))
                                    .groupBy("query_id", "node").agg(F.max("sim").alias("sim"), F.max("done").alias("done")))
        drop_stored(before)
    spark.sql(f"drop table {table}")
    drop_tables(spark, [path])
    return beam.select("query_id", "node", "sim")


def _measured(batches):
    """Exact cosine in double precision of the lists in columns 3 and 4."""
    for batch in batches:
        a, b = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        score = []
        for x, y in zip(a, b):
            x, y = np.array(x), np.array(y)
            m = min(len(x), len(y))
            norms = np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y))
            if not (1e-150 < norms < 1e150):          # squares out of range: scale first
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                norms = np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y))
            score.append(float(np.dot(x[:m], y[:m]) / norms))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score, pa.float64())],
                                         names=["query_id", "vec_id", "node", "score"])


def nearest(embeddings: DataFrame, is_query, k: int = 5, graph_k: int = K, ef: int = EF,
            rounds: int = ROUNDS) -> DataFrame:
    """For every usable row that ``is_query`` (a Column over vec_id) selects, the
    ``k`` nearest other rows by cosine: query_id, rank (from 1), vec_id, score;
    ties go to the smaller vec_id, with fewer candidates there are fewer rows.

    Rows that repeat a vec_id with the same vector are one candidate and one
    query; with different vectors each is a candidate, and a query is never
    its own answer. Cases without part are named above; other columns are
    ignored; an empty table gives no rows."""
    spark = embeddings.sparkSession
    with small_batches(spark):
        return settled(spark, "nn-found", lambda: _nearest(embeddings, is_query, k, graph_k, ef, rounds))


def _nearest(embeddings: DataFrame, is_query, k: int, graph_k: int, ef: int, rounds: int) -> DataFrame:
    rows = materialize(usable(embeddings).distinct(), "nn-rows")
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    # the k + 1 smallest ids of each distinct vector
    smallest = Window.partitionBy("node").orderBy("vec_id")
    members = materialize(rows.select("node", "vec_id").withColumn("r", F.row_number().over(smallest))
                          .where(F.col("r") <= k + 1).drop("r"), "nn-members")
    shapes = materialize(rows.join(members, ["node", "vec_id"]).groupBy("node")
                         .agg(F.min_by("embedding", "vec_id").alias("embedding")), "nn-shapes")
    vectors = materialize(shapes.select("node", "embedding").mapInArrow(_packed(dim), "node long, code binary"),
                          "nn-vectors")
    graph = neighbour_graph(vectors, graph_k, rounds)
    asked = materialize(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "node"), "nn-queries")
    # equal query vectors are searched once
    searched = asked.select("node").distinct().join(vectors, "node").select(F.col("node").alias("query_id"), "node", "code")
    beam = graph_search(graph, vectors, materialize(searched, "nn-searched"), ef)
    pairs = beam.select(F.col("query_id").alias("q_node"), "node")
    exact = pairs.join(shapes.withColumnRenamed("node", "q_node").withColumnRenamed("embedding", "x"), "q_node") \
        .join(shapes.withColumnRenamed("embedding", "y"), "node") \
        .select(F.col("q_node").alias("query_id"), F.lit(0).cast("long").alias("vec_id"), "node", "x", "y") \
        .mapInArrow(_measured, "query_id long, vec_id long, node long, score double")
    exact = materialize(exact.select(F.col("query_id").alias("q_node"), "node", "score"), "nn-exact")
    nearest_of = Window.partitionBy("q_node").orderBy(F.desc("score"), "vec_id")
    # the k + 1 nearest ids per query vector hold the k nearest of each of its queries
    answers = exact.join(members, "node").withColumn("r", F.row_number().over(nearest_of)).where(F.col("r") <= k + 1)
    answers = materialize(answers.select("q_node", "vec_id", "score"), "nn-answers")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return asked.withColumnRenamed("node", "q_node").join(answers, "q_node").where("vec_id <> query_id") \
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")) \
        .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
