"""Steps whose memory, shuffles and order keys are bounded: packing's pieces, the texts
that the dedup operators look up again, the numbers of texts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.llm import bestfit_packing as packing


def test_pieces_hold_a_portion_of_a_batch_at_a_time():
    rng = random.Random(5)
    some = [" ".join(rng.choice(("the", "word", "again,", "Été")) for _ in range(20_000)) for _ in range(4)]
    texts = pa.array(some * 100)                                      # 400 texts of about 100 kB in one batch
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), texts], names=["doc_id", "text"])
    run = packing._piece_maker(packing.TOKENIZER, 2048, 0, False)
    tracemalloc.start()
    try:
        out = [b.to_pylist() for b in run(iter([batch.slice(0, 4)]))]
        base = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        lengths = [(r["doc_id"], r["length"]) for b in run(iter([batch])) for r in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1] - base
    finally:
        tracemalloc.stop()
    assert peak < 25e6, f"{peak / 1e6:.0f} MB"                        # the texts alone are over 30 MB
    first = [(r["doc_id"], r["length"]) for b in out for r in b]
    assert lengths[:len(first)] == first and lengths[-1][0] == 399
    assert sum(n for _, n in lengths) == 100 * sum(n for _, n in first)


def test_few_texts_pass_to_the_join_that_looks_them_up(spark):
    from flowlens.llm.simjoin import likely, named_rows
    rows = [(None if i % 50 == 0 else i // 2, f"text {i}") for i in range(4000)] + [(7, "twice")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tid", F.xxhash64("text"))
    wanted = docs.where("doc_id is null or doc_id % 100 = 7").distinct() \
        .select(F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid")).localCheckpoint()
    expected = sorted((r for r in rows if r[0] is None or r[0] % 100 == 7), key=str)
    assert sorted(((r.doc_id, r.text) for r in named_rows(docs, wanted, "t").collect()), key=str) == expected
    keyed = docs.withColumn("key", F.xxhash64("tid", "doc_id"))
    passed = likely(keyed, "key", wanted.select(F.xxhash64("_tid", "_doc").alias("key")), "t")
    assert passed.columns == keyed.columns and len(expected) <= passed.count() < len(expected) + 10


def test_the_lookups_of_sets_and_windows_take_the_filtered_texts(spark, monkeypatch):
    from flowlens.llm import minmax_dedup, paragraph_dedup, repeated_runs
    seen, real = [], minmax_dedup.named_rows

    def counted(docs, wanted, name):
        seen.append(name)
        return real(docs, wanted, name)
    for module in (minmax_dedup, paragraph_dedup, repeated_runs):
        monkeypatch.setattr(module, "named_rows", counted)
    long = " ".join("w%d" % i for i in range(120))
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (None, long + " more"), (3, "other words"), (4, None)],
                                 "doc_id long, text string")
    near = {(r.doc_id, r.component_id) for r in minmax_dedup.near_duplicates(docs, 2).collect()}
    assert near == {(1, 1), (2, 1), (None, 1), (3, 3), (4, 4)}
    found = {(r.unit, r.doc_id, r.start_word, r.n_words, r.first_doc_id, r.kept)
             for r in paragraph_dedup.repeated_passages(docs).collect()}
    assert found == {("line", 1, 0, 120, 1, True), ("line", 2, 0, 121, 1, False), ("line", None, 0, 121, 1, False),
                     ("run", 2, 0, 120, 1, False), ("run", None, 0, 121, 2, False)}
    assert {"minmax-texts", "paragraph-texts", "runs-whole"} <= set(seen)


def test_texts_are_numbered_in_order_without_gaps(spark):
    from flowlens.llm.repeated_runs import numbered
    rows = [(i * 7919 % 1009 - 500, None if i % 9 == 0 else i * 31 % 97) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "tid long, rep long").repartition(5)).orderBy("no").collect()
    assert [r.no for r in got] == list(range(1000))
    assert [(r.tid, r.rep) for r in got] == sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))


def test_signatures_of_many_sets_at_once():
    from flowlens.llm.minmax_dedup import minmax_signatures, permutations
    from flowlens.llm.paragraph_dedup import minima
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 5, 3000, 2)]
    mult, add = permutations(12)
    for s, low, both in zip(sets, minima(sets, mult, add), minmax_signatures(sets, mult, add)):
        v = (s >> np.uint64(32)).astype(np.uint32)[:, None] * mult[None, :] + add
        assert (low == v.min(axis=0)).all() and (both[0::2] == low).all() and (both[1::2] == v.max(axis=0)).all()


def test_sets_of_many_sequences_at_once():
    from flowlens.llm import vectext as vt
    rng = np.random.default_rng(6)
    n = np.array([7, 1, 40, 3, 200, 5, 2])
    h = rng.integers(0, 4, n.sum()).astype(np.uint64)                       # most shingles repeat
    begin = np.cumsum(n) - n
    values, first = vt.distinct_shingles(h, begin, n, 3)
    want = vt.shingle_sets(h, np.append(begin, len(h)), 3)
    assert [np.sort(values[a:b]).tolist() for a, b in zip(first, first[1:])] == [s.tolist() for s in want]
    assert vt.set_ids(values, first).tolist() == [vt.set_id(s) for s in want]
    values, first = vt.distinct_shingles(h, begin[:0], n[:0], 3)
    assert len(values) == 0 and vt.set_ids(values, first).tolist() == []
    for k in (1, 2, 20, 50, 258):                                           # by the polynomial's definition
        slow = [sum(int(x) * 0xD6E8FEB86659FD93 ** (k - 1 - j) for j, x in enumerate(h[i:i + k].tolist())) % 2**64
                for i in range(len(h) - k + 1)]
        assert (vt.rolling(h, k) == vt.mix64(np.array(slow, np.uint64))).all()


def test_only_windows_whose_own_anchor_repeats_are_hashed():
    from flowlens.llm import vectext as vt
    from flowlens.llm.repeated_runs import PLACE_BITS, _window_maker, anchors
    text = " ".join(f"w{i}" for i in range(400))
    h, _ = vt.hashed_words([text])
    at, _ = anchors(h, 50, 20)
    s, wanted = vt.rolling(h, 20), at[3:5].tolist()
    batch = pa.RecordBatch.from_pydict({"no": [3], "text": [text], "wanted": [wanted]})
    got = [r for b in _window_maker(50, 20)(iter([batch])) for r in b.to_pylist()]
    own = [i for i in range(351) if i + int(s[i:i + 31].argmin()) in wanted]
    assert [r["spot"] for r in got] == [(3 << PLACE_BITS) + i for i in own]
    assert [r["key"] for r in got] == vt.rolling(h, 50).view(np.int64)[own].tolist()


def test_runs_are_joined_across_batches():
    from flowlens.llm.repeated_runs import PLACE_BITS, _islands
    rng, rows, want = random.Random(9), [], []
    for no in range(1, 30):
        for i in sorted(rng.sample(range(400), rng.randrange(30))):
            if rows and rows[-1][0] == no and i <= rows[-1][1] + 10:
                want[-1]["n_words"] = i + 10 - want[-1]["start_word"]
            else:
                want.append({"no": no, "start_word": i, "n_words": 10, "first_no": len(rows) % 7})
            rows.append((no, i, len(rows) % 7))
    for size in (1, 2, 37, 5000):
        spots = pa.RecordBatch.from_pydict({"spot": [(n << PLACE_BITS) + i for n, i, _ in rows],
                                            "first": [(f << PLACE_BITS) + 5 for *_, f in rows]})
        parts = [spots.slice(0, 0)] + [spots.slice(a, size) for a in range(0, len(rows), size)]
        assert [r for b in _islands(10)(iter(parts)) for r in b.to_pylist()] == want
    assert [r for b in _islands(10)(iter([])) for r in b.to_pylist()] == []


def test_neighbourhoods_and_stages_run_in_small_batches(spark, monkeypatch):
    """Batches that cross to Python are bounded in bytes in op4 and in each of the pipeline's stages."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    import corpus_pipeline
    from flowlens.llm import nn_descent
    from flowlens.session import BATCH_CONF

    def largest() -> int:
        def sizes(batches):
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes for b in batches], pa.int64())], names=["n"])
        wide = spark.range(0, 1500, 1, 1).select(F.repeat(F.lit("x"), 16384).alias("s"))
        return wide.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]

    before, seen = {k: spark.conf.get(k) for k in BATCH_CONF}, []
    e = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    monkeypatch.setattr(nn_descent, "_nearest", lambda *a: seen.append(largest()) or e)
    nn_descent.nearest(e, F.col("vec_id") == 1)
    assert {k: spark.conf.get(k) for k in BATCH_CONF} == before
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "pack_documents", lambda d: d)
    try:
        corpus_pipeline.pack(spark, docs, "")
        seen.append(largest())
        assert all(hasattr(f, "__wrapped__") for _, f in corpus_pipeline.STAGES)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert largest() > 20e6 and all(n < 6e6 for n in seen) and len(seen) == 2
