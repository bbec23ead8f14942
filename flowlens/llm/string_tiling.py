"""Benchmark decontamination by greedy string tiling.

Seeds are the hashes of ``min_match`` consecutive words. Documents and benchmark
items are joined on shared seeds. Of an item's seeds the most common ones are left
out as long as they cover fewer of its words than the threshold: tiles that reach
it then hold one of the others, and only these meet in the join, so that a common
phrase makes no pairs. Documents send the seeds that a
filter of ``FILTER_BITS`` bits (a fixed size) of the items' seeds lets through.
The texts of the pairs found are joined and each pair is tiled in a task. Where all
shared seeds together can reach the threshold, the longest common run of unmarked words is marked again and again
(found by Karp-Rabin windows, whose length is bisected) until no run of
``min_match`` words is left. The tiles' words over the item's words are the
coverage; as tiles may lie in any order, reordered passages are caught.

Words are runs of ASCII letters and digits and of non-ASCII characters of the
lower-cased text. An item with fewer than ``min_match`` words is matched by
its whole word sequence; items without words match nothing.

Equal texts on either side are one until the end. Seeds and words are 64-bit
hashes, a wrong decision needs a collision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import vectext as vt
from flowlens.llm.minmax_dedup import list_array
from flowlens.operators.common import materialize, settled

MIN_MATCH = 5
COVERAGE = 0.5
FILTER_BITS = 1 << 23        # a power of two


def normalised(texts: list) -> list[str]:
    return [(t or "").lower() for t in texts]


def _windows(h: np.ndarray, marked: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and Karp-Rabin hash of every unmarked window of n words."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.concatenate([[0], np.cumsum(marked)])
    at = np.flatnonzero(sums[n:] == sums[:-n])
    # prefix sums of h[i] * p**i; a window's sum is brought to power 0 by the inverse of p**start
    pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * vt._powers(vt._BASE, len(h)), dtype=np.uint64)])
    return at, (pre[at + n] - pre[at]) * vt._powers(vt._INVERSE, len(h))[at]


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word-hash sequences: (item start, doc start,
    words), longest first; of equally long matches, the earliest in the item,
    then in the document."""
    min_match = min(min_match, len(item))
    used_i, used_d = np.zeros(len(item), np.int64), np.zeros(len(doc), np.int64)
    found: list[tuple[int, int, int]] = []

    def matches(n: int):
        ai, hi = _windows(item, used_i, n)
        ad, hd = _windows(doc, used_d, n)
        keep = np.isin(hd, hi)
        return ai, hi, ad[keep], hd[keep]

    longest = min(len(item), len(doc))
    while min_match and longest >= min_match:
        lo, hi = min_match - 1, longest          # a common run of lo words exists, of hi + 1 words doesn't
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if len(matches(mid)[2]):
                lo = mid
            else:
                hi = mid - 1
        if lo < min_match:
            break
        ai, hi_, ad, hd = matches(lo)
        where: dict[int, list[int]] = {}
        for p, x in zip(ad.tolist(), hd.tolist()):
            where.setdefault(x, []).append(p)
        for p, x in zip(ai.tolist(), hi_.tolist()):
            if x not in where or used_i[p:p + lo].any():
                continue
            for q in where[x]:
                if not used_d[q:q + lo].any():
                    used_i[p:p + lo] = 1
                    used_d[q:q + lo] = 1
                    found.append((p, q, lo))
                    break
        longest = lo
    return found


def seeds_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words; k is part of it."""
    return vt.mix64(vt.rolling(h, k) + np.uint64(k)) if len(h) >= k > 0 else np.zeros(0, np.uint64)


def _hashed(texts: list):
    h, first = vt.hashed_words(normalised(texts), vt.NON_ALNUM, lower_ascii=False)
    return [h[a:b] for a, b in zip(first[:-1], first[1:])]


def _item_maker(min_match: int):
    """(tid, text) -> (tid, k, words, seeds): the words and, at every place, the seed of k words."""
    def run(batches):
        for part in (p for b in batches for p in vt.portions(b, 1)):
            words = _hashed(part.column(1).to_pylist())
            ks = [min(min_match, len(w)) for w in words]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ks, pa.int64()), list_array(words),
                 list_array([seeds_of(w, k) for w, k in zip(words, ks)])], names=["tid", "k", "words", "seeds"])
    return run


def _seed_sender(ks: list[int], passed):
    """(dtid, text) -> the document's distinct seeds that the filter lets through."""
    def run(batches):
        bits = np.unpackbits(np.frombuffer(passed.value, np.uint8), bitorder="little").astype(bool)
        for part in (p for b in batches for p in vt.portions(b, 1)):
            keys, ids = [], []
            for w, d in zip(_hashed(part.column(1).to_pylist()), part.column(0).to_pylist()):
                s = np.concatenate([seeds_of(w, k) for k in ks])
                s = np.unique(s[bits[(s % np.uint64(len(bits))).astype(np.int64)]])
                keys.append(s)
                ids.append(np.full(len(s), d, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys).view(np.int64))], names=["dtid", "seed"])
    return run


def _rarest(coverage: float):
    """(tid, k, n, places: list of (df, seed, at)) of the seeds that documents have
    -> (seed, tid): all but the most common ones that cover too few words."""
    def run(batches):
        for batch in batches:
            seeds, tids = [], []
            for tid, k, n, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
                places = sorted((p["df"], p["seed"], p["at"]) for p in places)
                covered, left = np.zeros(n, bool), len(places)
                while left:
                    covered[places[left - 1][2]:places[left - 1][2] + k] = True
                    if covered.sum() >= coverage * n:
                        break
                    left -= 1
                kept = {s for _, s, _ in places[:left]}
                seeds += kept
                tids += [tid] * len(kept)
            yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array(tids, pa.int64())],
                                             names=["seed", "tid"])
    return run


def _tiler(min_match: int, coverage: float):
    """(dtid, tid, text, words) -> the tiles' figures, where they reach the coverage."""
    def run(batches):
        for part in (p for b in batches for p in vt.portions(b, 2)):
            dtids, tids = part.column(0).to_pylist(), part.column(1).to_pylist()
            out = []
            for dtid, tid, doc, words in zip(dtids, tids, _hashed(part.column(2).to_pylist()), part.column(3)):
                item = words.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                k = min(min_match, len(item))
                at_doc, at_item = seeds_of(doc, k), seeds_of(item, k)
                near, bound = np.zeros(len(doc) + 1, np.int64), np.zeros(len(item) + 1, np.int64)
                for covered, places in ((near, np.flatnonzero(np.isin(at_doc, at_item))),
                                        (bound, np.flatnonzero(np.isin(at_item, at_doc)))):
                    np.add.at(covered, places, 1)
                    np.add.at(covered, places + k, -1)
                near, bound = np.cumsum(near)[:-1] > 0, np.cumsum(bound)[:-1] > 0
                if bound.sum() < coverage * len(item):
                    continue
                # every tile lies inside shared seeds: the document's other words can go,
                # with a word of no item where they were
                keep = near | np.concatenate([[False], near[:-1]])
                found = tiles(item, np.where(near, doc, np.uint64(0))[keep], min_match)
                n = sum(x for *_, x in found)
                if n >= coverage * len(item):
                    out.append((dtid, tid, len(found), n, n / len(item)))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.float64())],
                    names=["dtid", "tid", "n_tiles", "tiled_words", "coverage"])
    return run


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH,
                       coverage: float = COVERAGE) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> one row per document
    and item whose tiles cover at least ``coverage`` of the item's words:
    doc_id, item_id, n_tiles, tiled_words, coverage.

    NULL or word-less texts on either side match nothing. Repeated rows of
    either side give repeated pairs; NULL ids stay NULL. Other columns are
    ignored. Empty tables give no rows.
    """
    return settled(docs.sparkSession, "tiling", lambda: _contaminated_pairs(docs, benchmark, min_match, coverage))


def _contaminated_pairs(docs: DataFrame, benchmark: DataFrame, min_match: int, coverage: float) -> DataFrame:
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .where("text is not null").withColumn("dtid", F.xxhash64("text"))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .where("text is not null").withColumn("tid", F.xxhash64("text"))
    texts = rows.select("tid", "text").dropDuplicates(["tid"])
    items = materialize(texts.mapInArrow(_item_maker(min_match), "tid long, k long, words array<long>, seeds array<long>")
                        .where("k > 0"), "tiling-items")
    placed = items.select("tid", "k", F.size("words").cast("long").alias("n"), F.posexplode("seeds").alias("at", "seed"))
    # the filter: one bit per item seed, gathered as bitmaps of 4 KB
    bit = F.col("seed").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1            # Spark's bitmaps count from 1
    maps = placed.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()       # FILTER_BITS / 8 bytes
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps:
        low = (r["bucket"] - 1) * 4096
        bits[low:low + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    ks = sorted(r["k"] for r in items.select("k").distinct().collect())                          # at most min_match
    empty = "doc_id long, item_id long, n_tiles long, tiled_words long, coverage double"
    if not ks:
        return spark.createDataFrame([], empty)
    passed = spark.sparkContext.broadcast(bits.tobytes())
    sent = d.select("dtid", "text").mapInArrow(_seed_sender(ks, passed), "dtid long, seed long").distinct()
    sent = materialize(sent, "tiling-seeds")
    known = materialize(sent.groupBy("seed").agg(F.count("*").alias("df")), "tiling-frequencies")
    meeting = placed.join(known, "seed").groupBy("tid", "k", "n") \
        .agg(F.collect_list(F.struct("df", "seed", "at")).alias("places")) \
        .mapInArrow(_rarest(coverage), "seed long, tid long")                                    # lists of one item
    pairs = materialize(sent.join(materialize(meeting, "tiling-meeting"), "seed").select("dtid", "tid").distinct(),
                        "tiling-pairs")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    reps = d.select("doc_id", "dtid").join(pairs.select("dtid").distinct(), "dtid").groupBy("dtid") \
        .agg(F.min(order)["doc_id"].alias("rep"))
    reps = materialize(reps.withColumnRenamed("dtid", "_dtid"), "tiling-documents")
    # one row of each text: that of its smallest doc_id (repeated rows give equal figures)
    once = d.join(reps, (F.col("dtid") == F.col("_dtid")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("dtid", "text")
    tiled = once.join(pairs, "dtid").join(items.select("tid", "words"), "tid").select("dtid", "tid", "text", "words") \
        .mapInArrow(_tiler(min_match, coverage), "dtid long, tid long, n_tiles long, tiled_words long, coverage double")
    found = materialize(tiled.distinct(), "tiling-found")
    return d.select("doc_id", "dtid").join(found, "dtid").join(rows.select("item_id", "tid"), "tid") \
        .select("doc_id", "item_id", "n_tiles", "tiled_words", "coverage")
