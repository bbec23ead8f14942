"""Source divergence: against a plain-Python version over every term."""

import random
import re
from collections import Counter

import pytest

from flowlens.llm.source_divergence import divergence_audit

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value string"


def brute_force(docs, min_docs=10, top=10):
    groups, found, langs = {}, {}, {}
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t)
                 for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups.setdefault((lang, source), Counter()).update(terms)
        langs.setdefault(lang, Counter()).update(terms)
        found.setdefault(lang, Counter()).update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in found.items()}

    def shares(lang, counts):
        total = sum(counts[t] for t in kept[lang])
        return [1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept[lang])) for t in kept[lang]]

    out = []
    for (lang, source), counts in groups.items():
        p = shares(lang, counts)
        pairs = [(o, sum((a - b) ** 2 // (a + b) for a, b in zip(p, shares(lang, c))))
                 for (other_lang, o), c in groups.items() if other_lang == lang and o != source]
        pairs.sort(key=lambda x: (-x[1], x[0].encode()))
        out += [(lang, source, "pair", o, v, i) for i, (o, v) in enumerate(pairs, 1)]
        q = shares(lang, langs[lang])
        terms = [(t, (a - b) ** 2 // (a + b)) for t, a, b in zip(kept[lang], p, q) if counts[t] and a > b]
        terms.sort(key=lambda x: (-x[1], x[0].encode()))
        out += [(lang, source, "term", t, v, i) for i, (t, v) in enumerate(terms[:top], 1)]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA)


def made_up(rng, rows, sources):
    words = ["The", "the", "cat", "Éclair", "éclair", "naïve", "ß", "日本", "\U0001f600", "a-b", "c3po", "don't"] \
        + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    docs = []
    for i in range(rows):
        source = "hot" if rng.random() < 0.34 else f"s{rng.randrange(sources)}"
        lang = rng.choice(["en", "en", "fr", None, ""])
        text = " ".join(rng.choice(words[: rng.randrange(1, len(words))]) for _ in range(rng.randrange(0, 40)))
        docs.append((i, text, lang, source))
    return docs + docs[:50]         # repeated rows count each time


@pytest.mark.parametrize("blocks, tiles", [(4096, 64), (3, 2)])
def test_every_pair_and_term(spark, blocks, tiles):
    docs = made_up(random.Random(3), 500, 7)
    got = divergence_audit(frame(spark, docs), min_docs=10, block_terms=blocks, tile_sources=tiles)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_force(docs)


def test_nulls_empty_and_long_texts_ties_and_groups_without_terms(spark):
    long_text = "word " * 200_000 + "Z" * 100_000
    docs = [(i, "same words tie", "en", "a") for i in range(10)] + [
        (20, None, "en", "empty"), (21, "", "en", None), (22, " 123 \x00\x7f", "en", "digits"),
        (23, long_text, "en", "long"), (24, "lonely", "xx", "one"), (25, "lonely", "xx", "two"),
        (None, "words", None, None)]
    got = sorted(map(tuple, divergence_audit(frame(spark, docs)).collect()))
    assert got == brute_force(docs)
    assert ("xx", "one", "pair", "two", 0, 1) in got
    assert [r[3] for r in got if r[1:3] == ("a", "term")] == []      # no share above its language's
    assert {r[3] for r in got if r[:3] == ("en", "a", "pair")} == {"", "empty", "digits", "long"}


def test_many_terms_of_one_cell_are_ranked_by_their_bytes(spark):
    tied = " ".join("t" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(300))
    docs = [(i, tied, "en", "a") for i in range(10)] + [(50 + i, "other", "en", "b") for i in range(12)]
    got = sorted(map(tuple, divergence_audit(frame(spark, docs)).collect()))
    assert got == brute_force(docs)
    assert len([r for r in got if r[1:3] == ("a", "term")]) == 10


def test_small_slices_and_holdings_change_nothing():
    from types import SimpleNamespace
    import pyarrow as pa
    from flowlens.llm import source_divergence as d
    texts = ["Aa bB aa É1é " * 40, "", "zz" * 50, "one"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts]), pa.array([b"en"] * 12),
                                        pa.array([b"s%d" % (i % 2) for i in range(12)])], names=["t", "l", "s"])

    def total():
        n = Counter()
        for out in d._count([batch]):
            for r in out.to_pylist():
                n[r["lang"], r["source"], r["term"], "n"] += r["n"]
                n[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return n
    want, was = total(), SimpleNamespace(held=d.HELD_TERMS, piece=d.TEXT_SLICE)
    try:
        d.HELD_TERMS, d.TEXT_SLICE = 2, 5
        assert total() == want
    finally:
        d.HELD_TERMS, d.TEXT_SLICE = was.held, was.piece
    assert want["en", "s0", "aa", "n"] == 240 and want["en", "s0", "aa", "docs"] == 3


def test_empty_table(spark):
    assert divergence_audit(frame(spark, [])).collect() == []
