"""Byte-level BPE: the perfect hash, and ids as the tiktoken library's."""

import base64
import hashlib
import os
import random
import tempfile

import public_tokenizers as P
import pytest
import tiktoken

from flowlens.llm import byte_bpe
from flowlens.llm.byte_bpe import RANKS, UNKNOWN, PerfectHash, Vocabulary, decode, digests, encode


@pytest.fixture(scope="module")
def ranks():
    with open(P.path(RANKS), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def theirs(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 17, 1000])
def test_perfect_hash_is_minimal_and_finds_only_its_keys(n):
    keys = [b"", *(b"k%d" % i for i in range(n))][:n]
    table = PerfectHash(keys)
    assert sorted(table.order) == list(range(n)) == sorted(table.slot(k) for k in keys)
    assert [keys[table.order[table.slot(k)]] for k in keys] == keys
    assert all(table.slot(b"other%d" % i) == -1 for i in range(2000))


def test_every_token_is_found_in_one_slot(ranks):
    v = Vocabulary(ranks)
    assert sorted(v.table.order) == list(range(len(ranks)))
    assert all(v.encode_piece(t) == [r] for t, r in ranks.items())


def test_merging_takes_the_least_pair_leftmost_first(ranks, theirs):
    v = Vocabulary(ranks)
    rng = random.Random(5)
    for _ in range(1500):
        piece = bytes(rng.choice(b"aabcst\xc3\xa9\xff ") for _ in range(rng.randrange(1, 40)))
        got = v.merge(piece)
        assert b"".join(v.bytes_of[i] for i in got) == piece
        assert got == theirs._core_bpe.encode_single_piece(piece) or v.rank(piece) >= 0


TEXTS = ["Hello world", "don't  stop\n\n now 123456 --!!", "", None, " ", "\x00\x1c\x85 x", "ß日本語\U0001f600é" * 9,
         "x" * 5000, "\n" * 3000 + "end", "word " * 60_000, "<|endoftext|>", "ab" * 200_000]


def test_ids_and_bytes_as_the_library(spark, theirs):
    rng = random.Random(2)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0xD800), 32, 10]))
                             for _ in range(rng.randrange(80))) for _ in range(300)]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(0, texts[0], None, None), (None, "no id", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string").repartition(5)
    got = sorted(map(tuple, digests(decode(encode(docs))).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        ids = theirs.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_output_batches_and_a_full_memo_change_nothing(spark, theirs, monkeypatch):
    v = byte_bpe._Memo(Vocabulary(theirs._mergeable_ranks))
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 3)
    pieces = ["a", "bc", "defq", "zzzz", "a", "qqqqqq"]
    assert [v[p] for p in pieces] == [theirs.encode_ordinary(p) for p in pieces] and len(v) <= 3


def test_decoding_unknown_and_null_ids(spark):
    rows = [(1, [0, 99_999, None]), (2, None), (3, [])]
    got = dict(decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).select("doc_id", "decoded").collect())
    assert got == {1: b"!" + UNKNOWN + UNKNOWN, 2: b"", 3: b""}


def test_own_ranks_and_pattern(spark):
    path = os.path.join(tempfile.mkdtemp(), "own.tiktoken")
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc"]
    with open(path, "wb") as f:
        f.write(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    docs = spark.createDataFrame([(1, "abcx bc")], "doc_id long, text string")
    assert encode(docs, path, r"(\w)+|\s").first()["ids"] == [257, 120, 32, 258]


def test_empty_table(spark):
    assert digests(decode(encode(spark.createDataFrame([], "doc_id long, text string")))).collect() == []


def test_a_merge_puts_its_new_pair_in_the_place_of_the_old_one(ranks, theirs, monkeypatch):
    v, calls = Vocabulary(ranks), []
    for name in ("heappop", "heappush"):
        monkeypatch.setattr(byte_bpe.heapq, name, lambda *a, f=getattr(byte_bpe.heapq, name): calls.append(1) or f(*a))
    rng, merges = random.Random(5), 0
    for _ in range(300):
        piece = bytes(rng.choice(b"abcdefghiou") for _ in range(rng.randrange(2, 14)))
        ids = v.merge(piece)
        assert ids == theirs._encode_single_piece(piece)
        merges += len(piece) - len(ids)
    assert len(calls) < 1.85 * merges        # 2.07 before
    memo = byte_bpe._PackedMemo(v)
    assert memo[" été"] == b"".join(i.to_bytes(4, "little") for i in theirs.encode_ordinary(" été"))
