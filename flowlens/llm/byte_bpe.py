"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern and each is encoded
by itself. Tier one: a minimal perfect hash over the vocabulary (one 64-bit
hash, one displacement per bucket, as many slots as tokens) resolves a
pre-token that is a token itself. Tier two, for the others: a linked list of
bytes and a heap of adjacent pairs by (rank, place); the least pair is merged
until none is left, in O(n log n) for a pre-token of n bytes. Merged bytes are
looked up in the same hash.

The hash is built once on the driver and broadcast: its size is the
vocabulary's (50,256 tokens, about 2 MB), whatever the corpus. Documents are
encoded where they lie; nothing is shuffled. A task remembers up to
``MEMO_PIECES`` pre-tokens and ``MEMO_PAIRS`` pairs of tokens that it has looked
up, and starts anew when they are full.

Defined results: NULL text is the empty text, which has no ids; very long texts
and pre-tokens are encoded whole; repeated rows and ids give one row each; an
empty table gives no rows; other columns are ignored, whatever their names.
Decoding gives the bytes of the ids; NULL ids decode as no ids, an id that is
NULL or outside the vocabulary as U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from operator import getitem

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = "byte_bpe_multi_50k.tiktoken"
BUCKET_KEYS = 4                  # tokens per bucket of the perfect hash, on average
MEMO_PIECES = 400_000
MEMO_PAIRS = 400_000
BATCH_IDS = 1 << 20              # ids in an output batch, unless one text has more
UNKNOWN = "\ufffd".encode()

_MASK = (1 << 32) - 1


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: ``self.keys[slot(key)] == key``,
    the slots being 0 .. n - 1 without a gap."""

    def __init__(self, keys: list[bytes], seed: int = 0):
        self.seed = seed
        while not self._place(keys):
            self.seed += 1

    def _place(self, keys: list[bytes]) -> bool:
        n = len(keys)
        self.size = max(1, n)
        self.buckets = max(1, n // BUCKET_KEYS)
        self.displace = [0] * self.buckets
        self.keys: list = [None] * self.size
        self.order: list = [0] * n               # slot -> place of its key in the list given
        members: list[list] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k, self.seed)
            members[(h >> 32) % self.buckets].append(((h & _MASK) % n, i))
        free = np.ones(2 * n, bool)              # the slots twice, so that a displacement wraps round
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            at = [a for a, _ in members[b]]
            if not at:
                break
            if len(set(at)) < len(at):
                return False
            fits = free[at[0]:at[0] + n].copy()
            for a in at[1:]:
                fits &= free[a:a + n]
            d = int(fits.argmax())
            if not fits[d]:
                return False
            self.displace[b] = d
            for a, i in members[b]:
                s = (a + d) % n
                free[s] = free[s + n] = False
                self.keys[s], self.order[s] = keys[i], i
        return True

    def slot(self, key: bytes) -> int:
        """The slot of ``key``, or -1 if it is none of the keys."""
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        s = ((h & _MASK) + self.displace[(h >> 32) % self.buckets]) % self.size
        return s if self.keys[s] == key else -1


class Vocabulary:
    """Tokens by rank, found through a perfect hash."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens, ids = list(ranks), list(ranks.values())
        self.table = PerfectHash(tokens)
        self.slot_ids = [ids[i] for i in self.table.order]
        self.bytes_of = dict(zip(ids, tokens))
        self.byte_ids = [ranks.get(bytes([b]), -1) for b in range(256)]
        # ranks of all pairs of bytes, the pairs that every merge begins with
        self.pair_ids = [[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        self.id_of_byte, self.pairs_of_byte = self.byte_ids.__getitem__, self.pair_ids.__getitem__
        self.joined: dict[int, int] = {}       # (id, id) -> what the hash gave for their bytes, or -1

    def rank(self, token: bytes) -> int:
        slot = self.table.slot(token)
        return self.slot_ids[slot] if slot >= 0 else -1

    def look_up(self, key: int, token: bytes) -> int:
        if len(self.joined) >= MEMO_PAIRS:
            self.joined.clear()
        found = self.joined[key] = self.rank(token)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the token it is, or its merged bytes."""
        whole = self.rank(piece)
        return [whole] if whole >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Repeatedly merge the adjacent pair of least rank, the leftmost of equal ones.

        A part is known by the byte it starts at; the heap holds (rank, start of
        the left part) as one number. An entry whose parts have changed since is
        passed over: its rank is no longer that of the pair."""
        n = len(piece)
        joined = self.joined
        ids = list(map(self.id_of_byte, piece))                # of the part that starts here
        if -1 in ids:
            raise ValueError(f"byte {piece[ids.index(-1)]} is not in the vocabulary")
        pair = list(map(getitem, map(self.pairs_of_byte, piece), piece[1:]))    # rank of the part and the next together
        pair.append(-1)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        heap = [r << shift | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        push, pop, replace = heapq.heappush, heapq.heappop, heapq.heapreplace
        end = list(range(1, n + 1))                            # of the part that starts here
        before = list(range(-1, n - 1))                        # start of the part before
        while heap:
            top = heap[0]                                      # goes when a new entry takes its place, or at the end
            i, r = top & mask, top >> shift
            if pair[i] != r:
                pop(heap)
                continue
            j = end[i]
            k = end[i] = end[j]
            ids[i], pair[j] = r, -1
            if k < n:
                before[k] = i
                key = r << 32 | ids[k]
                new = joined.get(key)
                if new is None:
                    new = self.look_up(key, piece[i:end[k]])
                pair[i] = new
                if new >= 0:
                    replace(heap, new << shift | i)
                    top = -1
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                key = ids[left] << 32 | r
                new = joined.get(key)
                if new is None:
                    new = self.look_up(key, piece[left:k])
                pair[left] = new
                if new >= 0:
                    if top >= 0:
                        replace(heap, new << shift | left)
                        top = -1
                    else:
                        push(heap, new << shift | left)
            if top >= 0:
                pop(heap)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = end[i]
        return out


class _Memo(dict):
    """Pre-token -> its ids, for the pre-tokens resolved so far."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def resolve(self, piece: str) -> list[int]:
        return self.vocabulary.encode_piece(piece.encode("utf-8", "surrogatepass"))

    def __missing__(self, piece: str):
        if len(self) >= MEMO_PIECES:
            self.clear()
        ids = self.resolve(piece)
        if len(piece) <= 1024:                 # bounds the memory; longer ones hardly repeat
            self[piece] = ids
        return ids


class _PackedMemo(_Memo):
    """The same with the ids as native 32-bit integers in bytes, which are joined without a Python step per id."""

    def resolve(self, piece: str) -> bytes:
        return array("i", super().resolve(piece)).tobytes()


def ranks_file(name: str) -> str:
    """A path as it is; a bare file name from the public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def vocabulary(spark: SparkSession, ranks: str = RANKS):
    """The broadcast vocabulary of a rank file (lines of base64 token and rank)."""
    with open(ranks_file(ranks), "rb") as f:
        pairs = dict(line.split() for line in f if line.strip())
    return spark.sparkContext.broadcast(Vocabulary({base64.b64decode(t): int(r) for t, r in pairs.items()}))


def _batch(doc_ids, held: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(held, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, ids array<int>)``, each match of
    ``pattern`` (the public tokenizers' by default) encoded by itself."""
    if pattern is None:
        import public_tokenizers
        pattern = public_tokenizers.PATTERN
    shared = vocabulary(docs.sparkSession, ranks)

    def run(batches):
        import regex
        matcher = regex.compile(pattern)
        pieces_of = (lambda t: [m[0] for m in matcher.finditer(t)]) if matcher.groups else matcher.findall
        memo = _PackedMemo(shared.value)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            held, size, at = [], 0, 0
            for i, text in enumerate(texts):
                held.append(np.frombuffer(b"".join(map(memo.__getitem__, pieces_of(text.as_py() or ""))), np.intc))
                size += len(held[-1])
                if size >= BATCH_IDS:
                    yield _batch(doc_ids.slice(at, len(held)), held)
                    held, size, at = [], 0, i + 1
            yield _batch(doc_ids.slice(at), held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")) \
        .mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``encoded`` with the bytes of its ``ids`` as column ``decoded`` (replaced if there)."""
    shared = vocabulary(encoded.sparkSession, ranks)

    @F.pandas_udf("binary")
    def bytes_of(ids: pd.Series) -> pd.Series:
        known = shared.value.bytes_of

        def joined(row: list) -> bytes:
            try:
                return b"".join(map(known.__getitem__, row))
            except KeyError:
                return b"".join([known.get(i, UNKNOWN) for i in row])
        return pd.Series([joined(row.tolist() if row is not None else []) for row in ids], dtype=object)

    return encoded.withColumn("decoded", bytes_of("ids"))


def digests(decoded: DataFrame) -> DataFrame:
    """Per row of ``decode(encode(docs))`` the number of ids and the SHA-256 of the
    decimal ids joined by commas and of the decoded bytes."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
