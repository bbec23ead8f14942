"""Packing: dominance against optimal packings, token ids against the tokenizer."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from flowlens.llm.bestfit_packing import (END_ID, TOKENIZER, WordIds, pack_documents, place_pieces, plan_packing,
                                          token_pieces)


def bins_of(segments):
    bins = defaultdict(list)
    for s, lo, hi, first, q, at in segments:
        for i in range(hi - lo):
            bins[first + i // q].append((at + i % q * s, s))
    return bins


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for level in {b for b in bins if b + items[i] <= capacity}:
            k = bins.index(level)
            bins[k] += items[i]
            place(i + 1, bins)
            bins[k] -= items[i]
        place(i + 1, bins + [items[i]])
    place(0, [])
    return best[0]


def test_plan_is_a_packing_and_dominance_keeps_the_optimum():
    rng = random.Random(1)
    worse = 0
    for _ in range(400):
        items = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 11))]
        segments, figures = plan_packing(Counter(items), 20)
        bins = bins_of(segments)
        assert Counter(s for b in bins.values() for _, s in b) == Counter(items)
        assert set(bins) == set(range(figures["bins"]))
        for b in bins.values():
            at = 0
            for offset, s in sorted(b):
                assert offset == at
                at += s
            assert at <= 20
        fixed = Counter(s for k, b in bins.items() if k < figures["fixed_bins"] for _, s in b)
        best = optimum(items, 20)
        assert figures["fixed_bins"] + optimum(list((Counter(items) - fixed).elements()), 20) == best
        worse += figures["bins"] > best
    assert worse <= 4


def test_large_instance_is_close_to_the_lower_bound():
    lengths = np.clip(np.random.default_rng(1).lognormal(6.2, 1, 100_000), 1, 2048).astype(int)
    _, f = plan_packing(Counter(lengths.tolist()))
    assert f["lower_bound"] <= f["bins"] <= 1.001 * f["lower_bound"] and f["fixed_bins"] > f["bins"] // 2


TEXTS = ["Hello, world!! it's the 2nd test x", "T̈e ́ café ÉTÉ STRASSE straße ǅ", "", None,
         "<|endoftext|> a<|startoftext|>b", "a\x1cb\x1fc \x85d", "don't DON'T we'll x'S", "日本語 テスト 123,45.6",
         "tab\tnew\nline  spaces ", "İstanbul ﬁ K", "a.b,c;d!!e", "word... (paren) [b] {c} --"]


def test_word_ids_equal_the_tokenizer():
    path = public_tokenizers.path(TOKENIZER)
    tokenizer, ids_of = Tokenizer.from_file(path), WordIds(path)
    rng = random.Random(2)
    chars = "abYZ '.,!-0 9éÉß́̈\t\n\x1c　<|>日"
    for text in [t or "" for t in TEXTS] + ["".join(rng.choice(chars) for _ in range(40)) for _ in range(500)]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids_of(text), "<u4").tolist() == want, repr(text)


def test_pieces_and_places(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, "the of and " * 300), (50, "same id"), (50, "same id"),
                                                    (None, "no id"), (60, "x " * 63), (61, "y " * 64)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, length string, rank int")
    out = pack_documents(docs, capacity=64).collect()
    want = Counter()
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [END_ID]
        for p, at in enumerate(range(0, len(ids), 64)):
            part = ids[at:at + 64]
            want[(d, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in out) == want
    fill = defaultdict(list)
    for r in out:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in fill.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert pack_documents(docs.limit(0)).count() == 0
    ids = token_pieces(docs, capacity=64, with_ids=True).where("doc_id = 60").collect()
    assert [len(r["ids"]) for r in ids] == [r["length"] for r in ids]


def test_plan_joined_as_a_table_gives_the_same_fill(spark):
    rng = random.Random(4)
    rows = [(i, 0, 0, rng.randrange(1, 65), i) for i in range(500)] + [(1000 + i, 0, 0, 17, i) for i in range(300)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    a, _ = place_pieces(pieces, 64)
    b, _ = place_pieces(pieces, 64, max_broadcast=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_pre_tokens_in_use_outlive_a_full_memory(monkeypatch):
    """Narrow, wide and odd texts have the tokenizer's ids, and a word that keeps coming is tokenized once."""
    from flowlens.llm import bestfit_packing
    monkeypatch.setattr(bestfit_packing, "_CACHE_WORDS", 50)
    ids_of = WordIds(public_tokenizers.path(TOKENIZER))
    made, model = [], ids_of.tokenizer.model
    monkeypatch.setattr(ids_of, "tokenize", lambda s: made.append(s) or model.tokenize(s), raising=False)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    text = " ".join(f"{w} Often," for w in words)
    assert ids_of(text) == ids_of.plain(text)
    assert made.count("often") == 1 and len(ids_of) + len(ids_of.old) <= 100
    rng = random.Random(4)
    letters = [*map(chr, range(256)), *"'''sstmdreve.,  \n" * 6, "—", "漢", "é", "<|endoftext|>", " "]
    for _ in range(1500):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert ids_of(s) == ids_of.plain(s)
