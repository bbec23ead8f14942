"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token pieces of at most ``capacity`` tokens; pieces are
packed into as few sequences as possible. Packing depends on the lengths
only, so the driver works on the histogram of lengths (at most ``capacity``
rows, whatever the corpus): it fixes the small sets of lengths that dominate
every alternative (they are part of some optimal packing), which shrinks the
instance, and best-fits the remainder in decreasing order, many equal bins at
a time. The plan is a list of segments, "items of length s with rank lo..hi
go to bins b, b+1, ... at this offset"; ranks are given to the pieces on the
executors, and each piece looks its place up.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import vectext as vt
from flowlens.operators.common import materialize

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
BLOCKS = 256                 # rank blocks per length, so no length is ranked in one task
MAX_BROADCAST_SEGMENTS = 1_000_000
_CACHE_WORDS = 150_000


# --- tokens -----------------------------------------------------------------

def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's character for every byte: printable ones stand for
    themselves, the others for U+0100 onwards, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in own else next(others)) for b in range(256)}


# The tokenizer's pre-token pattern, and what it is for lower-case text of U+0000 to U+00FF.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "a-zªµºß-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_NARROW_SPLIT = re.compile(
    f"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}\x09-\x0d\x20\x85\xa0]+")


class WordIds(dict):
    """Token ids (little-endian uint32 bytes) of whole texts, pre-token by pre-token;
    the dict holds the pre-tokens seen lately. When it is full it becomes ``old``,
    from which those still in use come back, and a new one is begun.

    Texts of U+0000 to U+00FF stay as they are under NFC and in that range in
    lower case: they are lowered, cut by the tokenizer's own pattern, and each
    distinct pre-token goes to the BPE model once, after the byte mapping. For
    tokenizers that drop white space and never merge across it, other texts'
    ids are their white-space separated chunks' ids in order; chunks go through
    the tokenizer whole. So do texts with x1C-x1F, which Python counts as white
    space and the tokenizer doesn't, or with the tokenizer's own added tokens.
    """

    _odd_space = re.compile("[\x1c-\x1f]")
    _wide = re.compile("[^\x00-\xff]")

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.bytes_of = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.letters = str.maketrans(_byte_letters())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        steps = json.loads(self.tokenizer.to_str())
        self.splits = _SPLIT in json.dumps(steps["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")

    def plain(self, s: str) -> bytes:
        ids = self.tokenizer.encode(s, add_special_tokens=False).ids
        return b"".join([self.bytes_of[i] for i in ids])

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.pop(piece, None)
        if ids is None:
            mapped = piece if piece.isascii() and piece.isprintable() \
                else piece.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([self.bytes_of[t.id] for t in self.tokenize(mapped)])
        if len(self) >= _CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def chunk(self, s: str) -> bytes:
        ids = self.chunks.get(s)
        if ids is None:
            if len(self.chunks) >= _CACHE_WORDS // 2:
                self.chunks.clear()
            ids = self.chunks[s] = self.narrow(s) if self.splits and not self._wide.search(s) else self.plain(s)
        return ids

    def narrow(self, s: str) -> bytes:
        return b"".join(map(self.__getitem__, _NARROW_SPLIT.findall(s.lower())))

    def __call__(self, text: str) -> bytes:
        if self._odd_space.search(text) or any(a in text for a in self.added):
            return self.plain(text)
        if self.splits and (text.isascii() or not self._wide.search(text)):
            return self.narrow(text)
        return b"".join(map(self.chunk, text.split()))


def tokenizer_file(name: str) -> str:
    """A path as it is; a bare file name from the public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY,
                 end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece: doc_id, piece, start, length,
    ids_crc32 and, with ``with_ids``, the ids (array<int>). A document's ids are
    its text's, then ``end_id``; only longer ones are cut."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")) \
        .mapInArrow(_piece_maker(tokenizer, capacity, end_id, with_ids), schema)


def _piece_maker(tokenizer: str, capacity: int, end_id: int, with_ids: bool):
    end = struct.pack("<I", end_id)

    def run(batches):
        ids_of = WordIds(tokenizer_file(tokenizer))
        for batch in (p for b in batches for p in vt.portions(b, 1)):
            cols = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = ids_of(text or "") + end
                for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at:at + 4 * capacity]
                    for c, v in zip(cols, (doc_id, p, at // 4, len(part) // 4, zlib.crc32(part), part)[:5 + with_ids]):
                        c.append(v)
            out = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                   *(pa.array(c, pa.int64()) for c in cols[2:5])]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<i4") for x in cols[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                out, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(out)])
    return run


# --- the plan over the histogram of lengths ---------------------------------

class _Lengths:
    """Counts by length with sorted lookup of the lengths still present."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def remove(self, s: int, k: int) -> None:
        self.n[s] -= k
        if not self.n[s]:
            del self.n[s]
            self.sizes.pop(bisect.bisect_left(self.sizes, s))

    def largest(self, limit: int, without: Counter) -> int | None:
        """The largest length <= limit with an item that is not in ``without``."""
        i = bisect.bisect_right(self.sizes, limit) - 1
        while i >= 0 and self.n[self.sizes[i]] <= without[self.sizes[i]]:
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def smallest(self, k: int, without: Counter) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.n[s] - without[s])
            if len(out) == k:
                break
        return out


def dominating_set(left: _Lengths, w: int, capacity: int) -> list[int] | None:
    """A set holding one item of length ``w`` that dominates every feasible
    set with it (Martello and Toth), or None where that can't be shown.

    With room r = capacity - w: nothing fits -> {w}; an item that fills r
    exactly -> {w, r}; at most one more item fits -> {w, largest}; at most two
    fit -> {w, largest} if the largest is no less than any pair, else
    {w, largest, next} if next is no less than the smaller item of any pair.
    """
    own = Counter({w: 1})
    room = capacity - w
    i = left.largest(room, own)
    if i is None:
        return [w]
    if i == room:
        return [w, i]
    small = left.smallest(3, own)
    if len(small) < 2 or small[0] + small[1] > room:
        return [w, i]
    if len(small) == 3 and sum(small) <= room:
        return None
    best = weak = 0     # largest sum, and largest smaller item, of a pair that fits
    for d in left.sizes:
        if 2 * d > room:
            break
        if left.n[d] <= own[d]:
            continue
        c = left.largest(room - d, own + Counter({d: 1}))
        if c is not None and c >= d:
            best, weak = max(best, c + d), d
    if i >= best:
        return [w, i]
    b = left.largest(room - i, own + Counter({i: 1}))
    return [w, i, b] if b is not None and b >= weak else None


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], dict]:
    """Segments ``(length, lo, hi, first_bin, per_bin, offset)`` and figures
    (bins, bins fixed by dominance, lower bound). Work and size depend on the
    number of distinct lengths, not on the number of items."""
    left, used, segments, bins = _Lengths(counts), defaultdict(int), [], 0

    def place(s: int, n: int, first: int, per_bin: int, offset: int) -> None:
        segments.append((s, used[s], used[s] + n, first, per_bin, offset))
        used[s] += n

    fixed = True
    while fixed:
        fixed = False
        for w in reversed(list(left.sizes)):
            while w in left.n and (chosen := dominating_set(left, w, capacity)):
                need = Counter(chosen)
                k = min(left.n[s] // m for s, m in need.items())
                offset = 0
                for s, m in need.items():
                    place(s, k * m, bins, m, offset)
                    left.remove(s, k)
                    for _ in range(m - 1):
                        left.remove(s, k)
                    offset += s * m
                bins += k
                fixed = True
    fixed_bins = bins

    room: dict[int, list[tuple[int, int]]] = {}   # residual -> ranges of bins (first, count)
    residuals: list[int] = []

    def open_range(r: int, first: int, n: int) -> None:
        if n and r:
            if r not in room:
                room[r] = []
                bisect.insort(residuals, r)
            room[r].append((first, n))

    for s in reversed(left.sizes):
        n = left.n[s]
        while n:
            i = bisect.bisect_left(residuals, s)
            if i < len(residuals):
                r = residuals[i]
                first, m = room[r].pop()
                if not room[r]:
                    del room[r]
                    residuals.pop(i)
            else:
                r, first, m = capacity, bins, -(-n // (capacity // s))
                bins += m
            q = r // s
            full, rest = divmod(min(n, m * q), q)
            if full:
                place(s, full * q, first, q, capacity - r)
                open_range(r - q * s, first, full)
            if rest:
                place(s, rest, first + full, rest, capacity - r)
                open_range(r - rest * s, first + full, 1)
            open_range(r, first + full + bool(rest), m - full - bool(rest))
            n -= full * q + rest
    tokens = sum(s * c for s, c in counts.items())
    return segments, {"bins": bins, "fixed_bins": fixed_bins, "lower_bound": -(-tokens // capacity)}


# --- placing the pieces -----------------------------------------------------

def _ranked(pieces: DataFrame) -> DataFrame:
    """Each piece's rank among those of its length: counts by (length, block)
    give a block's first rank, a window inside the block the rest. A length
    that holds a third of all pieces is spread over ``BLOCKS`` groups."""
    p = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BLOCKS)))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = p.groupBy("length", "block").agg(F.count("*").alias("n")) \
        .select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece")
    return p.withColumn("r", F.row_number().over(inside) - 1).join(bases, ["length", "block"]) \
        .withColumn("rank", F.col("base") + F.col("r")).drop("block", "r", "base")


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY,
                 max_broadcast: int = MAX_BROADCAST_SEGMENTS) -> tuple[DataFrame, dict]:
    """``pieces(doc_id, piece, start, length, ids_crc32)`` with sequence_id and
    offset, and the plan's figures. The plan is broadcast up to
    ``max_broadcast`` segments (48 bytes each) and joined as a table beyond."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in                      # <= capacity rows
              pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    segments, figures = plan_packing(counts, capacity)
    ranked = _ranked(pieces)
    if len(segments) > max_broadcast:
        plan = materialize(spark.createDataFrame(
            segments, "length long, lo long, hi long, first long, per_bin long, at long"), "packing-plan")
        placed = ranked.join(plan, "length").where("rank >= lo and rank < hi") \
            .withColumn("i", F.col("rank") - F.col("lo")) \
            .withColumn("sequence_id", F.expr("first + i div per_bin")) \
            .withColumn("offset", F.expr("at + (i % per_bin) * length"))
        return placed.select(*pieces.columns, "sequence_id", "offset"), figures

    table = np.array(sorted(segments), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)
    columns = list(pieces.columns)

    def run(batches):
        plan = shared.value
        starts = (plan[:, 0] << np.int64(44)) + plan[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            seg = plan[np.searchsorted(starts, (length << np.int64(44)) + rank, side="right") - 1]
            i, per_bin = rank - seg[:, 1], seg[:, 4]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array(seg[:, 3] + i // per_bin), pa.array(seg[:, 5] + (i % per_bin) * length)],
                names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*columns, "rank").mapInArrow(run, f"{schema}, sequence_id long, offset long"), figures


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY,
                   end_id: int = END_ID) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    NULL and empty texts are one piece with the end id alone. Rows with equal
    doc_ids, repeated rows and NULL doc_ids are documents of their own. Other
    columns are ignored; an empty table gives no rows. Ties between pieces of
    one length go by doc_id and piece inside their block.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id), "packing-pieces")
    return place_pieces(pieces, capacity)[0]
