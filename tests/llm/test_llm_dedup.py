"""Near-dedup, substring dedup and components against brute force."""

import random
import re

import numpy as np
import pytest

from flowlens.llm import vectext as vt
from flowlens.llm.components import connected_components
from flowlens.llm.minmax_dedup import near_duplicates
from flowlens.llm.paragraph_dedup import repeated_paragraphs, repeated_passages
from flowlens.llm.repeated_runs import anchors, repeated_runs, sliding, without_words

DOCS = "doc_id long, text string, n long, set_id string, bands int, label string"


def lower_ascii(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))


def shingles(ws, k):
    return {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def brute_components(sets, percent=80):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def family(rng, vocab, n_words, n_copies, edits):
    base = [rng.choice(vocab) for _ in range(n_words)]
    out = [" ".join(base)]
    for _ in range(n_copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["Été", "der,", "THE"]
    texts = []
    for _ in range(14):
        texts += family(rng, vocab, rng.randrange(8, 90), rng.randrange(0, 9), 6)
    texts += family(rng, vocab, 60, 60, 9)          # links of a family lie on both sides of the limit
    texts += [texts[0], texts[0].upper(), "  " + texts[1] + "\n", None, "", " \t\n", "one", "one", "One", "two words"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    texts = corpus()
    rows = [(i * 3 + 1, t, 7, "x", 1, "y") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(rows, DOCS), shingle_words=k).collect()}
    sets = [shingles(words(t), k) for t in texts]
    for i, c in enumerate(brute_components(sets)):
        r = got[i * 3 + 1]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), c * 3 + 1, i == c), texts[i]


def test_near_duplicates_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, "a b c", 1), (5, "a b c", 2), (None, "a b c", 3), (None, "x y z", 4), (7, None, 5), (8, "A B C", 6),
            (9, long, 7), (10, long + " tail", 8)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int"), 2).collect()
    assert sorted(str(tuple(r)) for r in out) == sorted(map(str, [
        (5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 2, None, True), (7, 0, 7, True),
        (8, 2, 5, False), (9, 29_999, 9, True), (10, 30_000, 9, False)]))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty, 2).count() == 0


def test_a_row_repeated_in_a_third_of_the_table(spark, monkeypatch):
    import flowlens.llm.simjoin as simjoin
    sizes, keep = [], simjoin.materialize

    def watched(df, name):
        out = keep(df, name)
        if name == "minmax-sets":
            sizes.append((out.count(), out.select("set_id").distinct().count()))
        return out
    monkeypatch.setattr(simjoin, "materialize", watched)
    base = [f"w{i}" for i in range(80)]
    rows = [(1, " ".join(base))] * 300 + [(i, " ".join(base[:i] + ["x"] + base[i + 1:])) for i in range(2, 12)]
    rows += [(100 + i, f"other text number {i}") for i in range(50)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert out.where("component_id = 1").count() == 310 and out.where("kept").count() == 350
    assert sizes[0][0] == sizes[0][1] >= 11


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100: 100}, **{200 + i: 100 for i in range(50)}}


def test_word_and_shingle_hashes_follow_the_words():
    texts = ["a b  c\n", "A\tB c", None, "", "ab c", "c b a", "é É", "x" * 300 + " y"]
    h, first = vt.hashed_words(texts)
    split = [words(t) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in split]
    seen = dict(zip((w for ws in split for w in ws), h.tolist()))
    assert [seen[w] for ws in split for w in ws] == h.tolist() and len(set(seen.values())) == len(seen)
    sets = vt.shingle_sets(h, first, 2)
    assert [len(s) for s in sets] == [len(shingles(w, 2)) for w in split]
    assert vt.set_id(sets[0]) == vt.set_id(sets[1]) != vt.set_id(sets[5])


def brute_paragraphs(rows, min_words, k=5):
    paras = []
    for d, t in rows:
        at = 0
        for j, line in enumerate((t or "").split("\n")):
            w = words(line)
            paras.append((d, j, at, w))
            at += len(w)
    paras = sorted((p for p in paras if len(p[3]) >= min_words), key=lambda p: (p[0], p[1]))
    comp = brute_components([shingles(w, k) for *_, w in paras])
    return sorted((d, j, at, len(w), *paras[c][:2], i == c) for i, ((d, j, at, w), c) in enumerate(zip(paras, comp))
                  if comp.count(c) > 1)


def brute_runs(rows, window):
    """Per row the places of the words in windows that an earlier (doc_id, text) holds."""
    seen, out = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(t)
        out[d, t] = set()
        for i in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[i:i + window]), (d, t, i)) != (d, t, i):
                out[d, t].update(range(i, i + window))
    return out


def cut_words(text, places):
    """The text without these words and the space behind each (before, at the end)."""
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    ends = [a for a, _ in spans[1:]] + [len(text)]
    out = (text[:spans[0][0]] if spans else text) + "".join(
        text[a:e] for i, ((a, _), e) in enumerate(zip(spans, ends)) if i not in places)
    return out.rstrip(" \t\n\x0b\x0c\r") if spans and len(spans) - 1 in places else out


def test_repeated_paragraphs_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = ["v%d" % i for i in range(500)]
    shared = sum((family(rng, vocab, rng.randrange(18, 60), 5, 3) for _ in range(6)), [])
    rows = []
    for d in range(60):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        lines += rng.sample(shared, rng.randrange(3))
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, shared[0] + "\n" + shared[0].upper()), (103, " \n\n" + shared[1] + "\n")]
    got = repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), min_words=15).collect()
    assert sorted(map(tuple, got)) == brute_paragraphs(rows, 15)


def test_runs_equal_brute_force_over_lines_and_inside_them(spark):
    rng = random.Random(8)
    vocab = ["v%d" % i for i in range(3000)] + ["É", "the"]
    shared = [[rng.choice(vocab) for _ in range(rng.randrange(8, 40))] for _ in range(7)] + [["the"] * 30]
    rows = []
    for d in range(90):
        w = [rng.choice(vocab) for _ in range(rng.randrange(40))]
        for p in rng.sample(shared, rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((d if rng.random() < 0.9 else None, "".join(x.title() + rng.choice([" ", "\n", "  ", "\t"]) for x in w)))
    rows += [(200, rows[3][1]), (200, rows[3][1]), (3, rows[3][1]), (201, None), (202, ""), (203, " ".join(shared[0][:9]))]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, tid int, at string")
    tids = {r["text"]: r["tid"] for r in frame.selectExpr("text", "xxhash64(text) as tid").collect()}
    found = repeated_runs(frame, window=10, shingle=4).collect()
    got = {}
    for r in found:
        got.setdefault((r["doc_id"], r["tid"]), []).append((r["start_word"], r["n_words"]))
    want = brute_runs(sorted(rows, key=lambda r: tids.get(r[1], 0)), 10)
    for (d, t), places in want.items():
        runs = set(got.pop((d, tids[t]), []))
        assert {i for a, n in runs for i in range(a, a + n)} == places, (d, t)
        assert all(not (b <= a <= b + m) for a, n in runs for b, m in runs if (a, n) != (b, m))
    assert not got
    docs = frame.withColumn("k", frame["doc_id"] * 0 + 1)
    assert repeated_runs(docs.limit(0), 10, 4).collect() == []


def test_a_passage_in_a_third_of_the_rows_and_a_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, f"own{i} w{i} {passage.replace(' ', chr(10)) if i % 2 else passage} end{i}") for i in range(1, 301)]
    rows += [(1000 + i, " ".join(f"q{i}x{j}" for j in range(60))) for i in range(600)]
    rows.append((5000, " ".join(f"l{j}" for j in range(150_000)) + " " + passage))
    got = repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), window=50)
    got = sorted(map(tuple, got.drop("tid").collect()))
    assert got == [(i, 2, 55, 1) for i in range(2, 301)] + [(5000, 150_000, 55, 1)]


def test_anchors_are_the_least_shingles_of_all_windows():
    rng = np.random.default_rng(3)
    for n in (0, 9, 10, 11, 40, 200):
        h = rng.integers(0, 5 if n == 200 else 2**63, n).astype(np.uint64)
        at, keys = anchors(h, 10, 4)
        s = vt.rolling(h, 4)
        want = {j for i in range(len(h) - 9) for j in range(i, i + 7) if s[j] == s[i:i + 7].min()}
        assert set(at.tolist()) == want and (keys == s[at]).all()
    for width in (1, 2, 3, 7, 8, 31):
        v = rng.integers(0, 99, 50).astype(np.uint64)
        assert sliding(v, width, True).tolist() == [v[i:i + width].min() for i in range(51 - width)]


def test_both_kinds_of_passages_and_cutting_them(spark):
    p = " ".join(f"p{i}" for i in range(60))
    near = p.replace("p30 ", "other ")
    rows = [(1, f"head\n{p}\ntail", "en"), (2, f"{near}\n\nother", "en"), (3, "short\nshort", None), (4, None, "fr"),
            (None, f"x {p} y\nz", "de"), (5, p, "es"), (6, f" {p}\n", "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, unit string")
    got = repeated_passages(docs)
    assert sorted((str(r["doc_id"]), r["unit"], r["start_word"], r["n_words"], r["first_doc_id"], r["kept"])
                  for r in got.collect()) == sorted([
        ("1", "line", 1, 60, 1, True), ("2", "line", 0, 60, 1, False), ("5", "line", 0, 60, 1, False),
        ("6", "line", 0, 60, 1, False), ("None", "line", 0, 62, 1, False), ("None", "run", 1, 60, 1, False),
        ("5", "run", 0, 60, 1, False), ("6", "run", 0, 60, 1, False)])
    keyed = docs.selectExpr("*", "coalesce(doc_id, -1) as k")
    cuts = got.where("not kept").selectExpr("coalesce(doc_id, -1) as k", "start_word", "n_words")
    out = without_words(keyed, cuts, "k").drop("k")
    assert out.columns == docs.columns
    assert {r[0]: r[1] for r in out.collect()} == {
        1: f"head\n{p}\ntail", 2: "other", 3: "short\nshort", 4: None, None: "z", 5: "", 6: ""}
    assert repeated_passages(docs.limit(0)).count() == 0
