"""Quality classifier: supervised subword embeddings (fastText's model).

A text's features are its words, word pairs (a word said twice in a row is one
feature, whatever the word) and character n-grams (bytes of a word between its
boundaries), hashed into ``buckets`` learned vectors. The
vectors are averaged over the whole text, a softmax over two classes follows,
and both are trained by stochastic gradient descent in numpy. Case and
punctuation are kept: words are runs of bytes other than x20, x09-x0D.

Training takes at most ``SAMPLE`` labelled texts (chosen by a hash of their
doc_id, so the choice is the same for any partitioning); a bounded task fits
the model. As the softmax of an average is linear in the features, scoring
needs one weight per bucket: the model is ``buckets`` floats, 1 MB by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import vectext as vt
from flowlens.operators.common import materialize

SAMPLE = 6000            # labelled texts the model is fitted on, at most
BUCKETS = 1 << 18
DIM = 8
STEPS = 36_000          # texts seen in training, over as many passes as that takes
RATE = 0.5
BYTE_NGRAMS = (3, 4)
THRESHOLD = 0.3
_SAME_WORD = np.uint64(0x2545F4914F6CDD1D)
FOLDS = 5                # crc32(doc_id) mod 5 = 0 is held out


def _hashed(texts: list):
    """Per kind of feature: 64-bit hashes and the index of each one's text."""
    buf, at = vt.pack(texts, lower_ascii=False)
    space = vt.ASCII_SPACE[buf]
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    starts, _ = vt.word_spans(buf, vt.ASCII_SPACE)
    h = vt.word_hashes(buf, starts, vt.ASCII_SPACE)
    yield h, owner[starts]
    if len(h) > 1:
        pair = np.flatnonzero(owner[starts[1:]] == owner[starts[:-1]])
        yield np.where(h[pair] == h[pair + 1], _SAME_WORD, vt.rolling(h, 2)[pair]), owner[starts[pair]]
    # n-grams of " word ": a boundary may be the first or last byte, not an inner one
    values = vt._byte_values(np.zeros(256, bool))
    values = np.concatenate([values[0x20:0x21], values[np.where(space, np.uint8(0x20), buf)]])
    boundary = np.concatenate([[True], space])
    for n in BYTE_NGRAMS:
        m = len(values) - n + 1
        if m < 1:
            continue
        acc, inside = np.full(m, n, np.uint64), np.ones(m, bool)
        for j in range(n):
            acc *= np.uint64(vt._BASE)
            acc += values[j:m + j]
            if 0 < j < n - 1:
                inside &= ~boundary[j:m + j]
        i = np.flatnonzero(inside)
        yield vt.mix64(acc[i]), owner[i]


def features(texts: list, buckets: int = BUCKETS):
    """Bucket of every feature of all texts in order, and ``first``: text i has
    the features ``first[i]:first[i + 1]``."""
    hashes, text_of = (np.concatenate(x) for x in zip(*_hashed(texts)))
    order = np.argsort(text_of, kind="stable")
    ids = (hashes & np.uint64(buckets - 1)).astype(np.int64)
    return ids[order], np.searchsorted(text_of[order], np.arange(len(texts) + 1))


def _mean_weights(texts: list, weights: np.ndarray) -> np.ndarray:
    """Mean weight over each text's features; 0 for a text without any."""
    n, mask = len(texts), np.uint64(len(weights) - 1)
    total, count = np.zeros(n), np.zeros(n)
    for hashes, text_of in _hashed(texts):
        total += np.bincount(text_of, weights[(hashes & mask).astype(np.int64)], n)
        count += np.bincount(text_of, minlength=n)
    return np.divide(total, count, out=np.zeros(n), where=count > 0)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, dim: int = DIM,
        total_steps: int = STEPS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """SGD over (feature buckets, their shares of the text, label) -> one weight
    per bucket and a bias: softmax([z0, z1])[1] = sigmoid(mean weight + bias)."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    passes = -(-total_steps // len(rows))
    steps, t = passes * len(rows), 0
    for _ in range(passes):
        for j in rng.permutation(len(rows)):
            ids, share, label = rows[j]
            lr = rate * (1 - t / steps)
            t += 1
            x = share @ emb[ids]
            z = out @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            grad = p @ out
            out -= lr * np.outer(p, x)
            bias -= lr * p
            # fastText adds a text's whole gradient to each of its vectors
            emb[ids] -= (lr * np.minimum(1.0, share * len(ids)))[:, None].astype(np.float32) * grad
    return (emb @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id's text is a multiple of ``folds``; False for NULL."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS,
          dim: int = DIM, total_steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Fit on ``labels(doc_id, quality)`` joined with ``docs(doc_id, text)``,
    without the held-out fold. Of several labels of a document the smallest
    counts; labels other than 0 and 1 and NULL ids are ignored. Without both
    classes the model is the constant of the share of 1s (0.5 without labels)."""
    chosen = materialize(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "classifier-labels")
    # one text per chosen id, whatever the rows with it: that of the least hash
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .join(chosen, "doc_id").groupBy("doc_id").agg(
            F.min_by("text", F.xxhash64("text")).alias("text"), F.first("quality").alias("quality"))

    def bags(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in vt.slices([len(t or "") for t in texts]):
                ids, first = features(texts[a:b], buckets)
                bag = [np.unique(ids[i:j], return_counts=True) for i, j in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a),
                     pa.array([x.astype("<i4").tobytes() for x, _ in bag]),
                     pa.array([(n / max(1, n.sum())).astype("<f4").tobytes() for _, n in bag])],
                    names=["doc_id", "quality", "ids", "shares"])

    def fit_task(batches):
        rows = sorted((d, i, s, q) for batch in batches for d, q, i, s in zip(*(c.to_pylist() for c in batch.columns)))
        data = [(np.frombuffer(i, "<i4"), np.frombuffer(s, "<f4"), q) for _, i, s, q in rows if i]
        if len({q for *_, q in data}) == 2:
            weights, bias = fit(data, buckets, dim, total_steps, rate)
        else:
            ones, n = sum(r[3] for r in rows), len(rows)
            weights, bias = np.zeros(buckets, np.float32), float(np.log((ones + 1) / (n - ones + 1)))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], names=["weights", "bias"])

    bagged = materialize(texts.mapInArrow(bags, "doc_id long, quality int, ids binary, shares binary"),
                         "classifier-bags")
    model = bagged.repartition(1).mapInArrow(fit_task, "weights binary, bias double").collect()  # one row of 4 * buckets bytes
    if not model:
        return np.zeros(buckets, np.float32), 0.0
    return np.frombuffer(bytes(model[0]["weights"]), np.float32), model[0]["bias"]


def score_column(spark, model: tuple[np.ndarray, float], text: Column) -> Column:
    """Probability of class 1 for a text column (NULL and empty: the bias alone)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        for texts in batches:
            values = texts.tolist()
            z = np.concatenate([_mean_weights(values[a:b], weights)
                                for a, b in vt.slices([len(t or "") for t in values])] or [np.zeros(0)])
            yield pd.Series(1 / (1 + np.exp(-(z + bias))))

    return score(text.cast("string"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted
    (1 if score >= threshold). Only the text is scored. NULL and empty texts
    get the model's bias; repeated rows come out as often; other columns are
    ignored; empty input gives no rows."""
    model = train(docs, labels)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        score_column(docs.sparkSession, model, F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
