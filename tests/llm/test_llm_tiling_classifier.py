"""String tiling against a direct definition; the classifier's model and scores."""

import random
import re
import zlib

import numpy as np

from flowlens.llm import vectext as vt
from flowlens.llm.string_tiling import contaminated_pairs, normalised, tiles
from flowlens.llm.subword_classifier import features, fit, held_out, quality_scores, score_column, train
from pyspark.sql import functions as F


def brute_tiles(item, doc, least):
    """Greedy string tiling as it is defined: mark the longest common unmarked run again and again."""
    least, ui, ud, out = min(least, len(item)), set(), set(), []
    while least:
        best = 0
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while (i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]
                       and i + n not in ui and j + n not in ud):
                    n += 1
                if n > best:
                    best, at = n, (i, j)
        if best < least:
            return out
        out.append((*at, best))
        ui |= set(range(at[0], at[0] + best))
        ud |= set(range(at[1], at[1] + best))
    return out


def test_tiles_equal_the_definition():
    rng = random.Random(1)
    for _ in range(400):
        item = [rng.randrange(1, 6) for _ in range(rng.randrange(0, 14))]
        doc = [rng.randrange(1, 6) for _ in range(rng.randrange(0, 24))]
        if rng.random() < 0.5 and item:
            cut = rng.randrange(len(item))
            doc += item[cut:] + [9] + item[:cut]
        got = tiles(vt.mix64(np.array(item, np.uint64)), vt.mix64(np.array(doc, np.uint64)), 3)
        assert got == brute_tiles(item, doc, 3), (item, doc)


def brute_pairs(docs, items, least, coverage):
    split = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", normalised([t])[0])
    out = []
    for d, t in docs:
        for i, u in items:
            w = split(u)
            found = brute_tiles(w, split(t), least)
            n = sum(x[2] for x in found)
            if w and n >= coverage * len(w):
                out.append((str(d), i, len(found), n, n / len(w)))
    return sorted(out)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    vocab = ["w%d" % i for i in range(60)] + ["Été", "x-y"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(6, 40))) for i in range(25)] + [(30, "Tiny item"), (31, None), (32, "!!"), (33, "solo")]
    docs = [(d, text(30)) for d in range(20)]
    for d in range(20, 45):
        w = rng.choice(items[:25])[1].split()
        cut = rng.randrange(1, len(w))
        docs.append((d, text(5) + " " + ", ".join(w[cut:]).upper() + " " + text(3) + "\n" + " ".join(w[:cut])))
    docs += [(50, None), (51, ""), (52, "a tiny ITEM here"), (53, "solo"), (53, "solo"), (None, items[0][1]), (54, "so lo tiny")]
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, item_id int, coverage string")
    b = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, doc_id int")
    want = brute_pairs(docs, items, 5, 0.5)
    assert len(want) > 25
    got = contaminated_pairs(d, b).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == want
    assert contaminated_pairs(d.limit(0), b).count() == contaminated_pairs(d, b.limit(0)).count() == 0


def test_a_phrase_of_all_items_and_a_third_of_the_documents_makes_no_pairs(spark, monkeypatch):
    import flowlens.llm.string_tiling as st
    sizes, keep = {}, st.materialize

    def watched(df, name):
        out = keep(df, name)
        sizes[name] = out.count()
        return out
    monkeypatch.setattr(st, "materialize", watched)
    phrase = "which of the following is the best answer to this question"
    items = [(i, phrase + " " + " ".join(f"i{i}w{j}" for j in range(30))) for i in range(40)]
    docs = [(d, phrase + " " + " ".join(f"d{d}w{j}" for j in range(30))) for d in range(300)]
    docs += [(1000 + i, "x " + items[i][1]) for i in range(5)] + [(2000 + d, f"other words {d}") for d in range(600)]
    docs += [(5000, "long " * 30_000 + items[7][1])]
    got = contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"),
                             spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["tiled_words"]) for r in got) == \
        [(1000 + i, i, 41) for i in range(5)] + [(5000, 7, 41)]
    assert sizes["tiling-pairs"] == 6 and sizes["tiling-seeds"] > 300


def test_reordered_halves_are_caught(spark):
    w = [f"t{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(w[20:] + ["and"] + w[:20])), (2, " ".join(w[::-1])), (3, " ".join(w[:19]))],
                                 "doc_id long, text string")
    b = spark.createDataFrame([(9, " ".join(w))], "item_id long, text string")
    assert [tuple(r) for r in contaminated_pairs(docs, b).collect()] == [(1, 9, 2, 40, 1.0)]


def test_features_are_words_pairs_and_byte_ngrams():
    texts = ["ab abc", None, "é", "  x  y\n", ""]
    ids, first = features(texts, 1 << 20)
    # n-grams of " ab " and " abc ": 3 bytes 2 + 3, 4 bytes 1 + 2; words 2; pairs 1
    assert np.diff(first).tolist() == [2 + 1 + 5 + 3, 0, 1 + 2 + 1, 2 + 1 + 2, 0] and len(ids) == first[-1]
    again, _ = features(["ab abc"], 1 << 20)
    assert sorted(again.tolist()) == sorted(ids[:first[1]].tolist())
    assert not set(features(["AB ABC"], 1 << 20)[0].tolist()) & set(again.tolist())


def test_score_is_the_softmax_of_the_averaged_vectors(spark):
    rng = random.Random(3)
    good, bad = [f"g{i}" for i in range(80)], [f"B{i}!!" for i in range(80)]
    def text(label):
        return " ".join(rng.choice(good if rng.random() < (0.8 if label else 0.3) else bad) for _ in range(40))
    rows = [(i, text(i % 2), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "label", 0.5) for i, t, _ in rows], "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0), (10**6, 1, 0)],
                                   "doc_id long, quality int, text int")
    out = {r["doc_id"]: r for r in quality_scores(docs, labels).collect()}
    assert len(out) == 400
    tested = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in out.items() if r["held_out"]} == set(tested)
    hits = [(out[i]["score"] >= 0.5) == (i % 2 == 1) for i in tested]
    assert sum(hits) / len(hits) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    # the label of a held-out row is not read
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in quality_scores(docs, flipped).collect()} == {i: r["score"] for i, r in out.items()}


def test_gradient_step_lowers_the_loss_and_folding_is_exact():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        ids = rng.integers(0, 50, 20) + 50 * (i % 2)
        u, n = np.unique(ids, return_counts=True)
        rows.append((u.astype(np.int32), (n / n.sum()).astype(np.float32), i % 2))
    weights, bias = fit(rows, buckets=128, total_steps=800)
    p = np.array([1 / (1 + np.exp(-(s @ weights[i] + bias))) for i, s, _ in rows])
    assert ((p > 0.5) == np.array([q for *_, q in rows])).all()


def test_classifier_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None), (None, ""), (3, "x" * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality_scores(docs, none).collect()] == [0.5] * 5
    ones = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, 1)], "doc_id long, quality int")
    scores = {r["score"] for r in quality_scores(docs, ones).collect()}
    assert len(scores) == 1 and 0.5 <= scores.pop() < 1
    assert quality_scores(docs.limit(0), ones).count() == 0
    weights, bias = train(docs, none)
    assert docs.where(score_column(spark, (weights, bias), F.col("text")) >= 0.3).count() == 5
