"""The corpus pipeline stage by stage against brute force on each stage's own input."""

from collections import Counter

import corpus_pipeline
from flowlens.llm.subword_classifier import quality_scores
from test_llm_dedup import brute_components, brute_paragraphs, brute_runs, cut_words, shingles, words
from test_llm_packing import plan_packing
from test_llm_tiling_classifier import brute_pairs

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_equal_brute_force(spark, tmp_out):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, states = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, states[-1], SF).write.parquet(f"{tmp_out}/{i}")
        states.append(spark.read.parquet(f"{tmp_out}/{i}"))
    assert [s.columns for s in states[1:5]] == [columns] * 4
    rows = [{r["doc_id"]: r for r in s.collect()} for s in states[:5]]

    scores = {r["doc_id"]: r["score"] for r in
              quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(rows[1]) == {d for d, s in scores.items() if s >= 0.3} and len(rows[1]) < len(rows[0])

    ids = sorted(rows[1])
    comp = brute_components([shingles(words(rows[1][d]["text"]), 5) for d in ids])
    assert set(rows[2]) == {d for i, d in enumerate(ids) if comp[i] == i} and len(rows[2]) < len(rows[1])

    texts = [(d, r["text"]) for d, r in rows[2].items()]
    places = {d: set(p) for (d, _), p in brute_runs(texts, 50).items()}
    for d, j, at, n, *_, kept in brute_paragraphs(texts, 50):
        places[d] |= set() if kept else set(range(at, at + n))
    assert set(rows[3]) == set(rows[2])
    for d, r in rows[2].items():
        text = cut_words(r["text"], places[d])
        assert rows[3][d]["text"] == text and rows[3][d]["n_chars"] == len(text)
    assert any(places.values())

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    seeds = {i: shingles(words(t), 5) for i, t in items}
    held = {d for d, r in rows[3].items()
            for i, t in items if seeds[i] & shingles(words(r["text"]), 5) and brute_pairs([(d, r["text"])], [(i, t)], 5, 0.5)}
    assert set(rows[4]) == set(rows[3]) - held

    packed = states[5].collect()
    assert {r["doc_id"] for r in packed} == set(rows[4])
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048
    assert len(fill) == plan_packing(Counter(r["length"] for r in packed))[1]["bins"]


def test_run_on_documents_with_odd_rows(spark, tmp_out):
    docs = spark.createDataFrame(
        [(1, "a good text of some words", "en", "s", 25), (None, None, None, None, None), (2, "", "en", "s", 0),
         (1, "a good text of some words", "en", "s", 25), (3, "x" * 50_000, "en", "s", 50_000)],
        "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_out}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_out}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_out}/benchmark.parquet")
    out = corpus_pipeline.run(spark, tmp_out).collect()
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter({1: 1, None: 1, 2: 1, 3: 1})
    docs.limit(0).write.parquet(f"{tmp_out}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_out}/{t}.parquet").write.parquet(f"{tmp_out}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_out}/none").count() == 0


def test_texts_without_or_with_a_shared_doc_id_are_decided_apart(spark, tmp_out):
    def text(name, n=60):
        return " ".join(f"{name}{i}" for i in range(n))
    near = text("a").rsplit(" ", 1)[0] + " x"
    rows = [(1, text("a")), (2, near), (2, text("b")), (None, near + " y"), (None, text("c")), (None, text("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, tmp_out)
    assert Counter(map(tuple, out.collect())) == Counter([(1, text("a")), (2, text("b")), (None, text("c")), (None, text("d"))])

    lines = [(1, text("a")), (3, "head\n" + text("a")), (3, "other\n" + text("e")), (None, text("a")), (None, text("f"))]
    out = corpus_pipeline.drop_repeated_paragraphs(spark, spark.createDataFrame(lines, docs.schema), tmp_out)
    assert Counter(map(tuple, out.collect())) == Counter(
        [(1, text("a")), (3, "head"), (3, "other\n" + text("e")), (None, ""), (None, text("f"))])

    spark.createDataFrame([(7, text("c"))], "item_id long, text string").write.parquet(f"{tmp_out}/benchmark.parquet")
    out = corpus_pipeline.decontaminate(spark, docs, tmp_out)
    assert Counter(map(tuple, out.collect())) == Counter(r for r in rows if r[1] != text("c"))
