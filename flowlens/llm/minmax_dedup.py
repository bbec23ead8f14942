"""MinHash near-dedup by min-max hashing.

Every permutation gives two signature values, the minimum and the maximum of
the permuted set, so half as many permutations are evaluated as plain MinHash
needs for a signature of the same length (Ji et al., "Min-Max Hash for
Jaccard Similarity"). Signatures are cut into bands; sets that agree in a
band are candidates, and every link is confirmed on the full sets.

Words are the runs of bytes other than x20 and x09-x0D after lower-casing
A-Z. A text's set holds its distinct shingles of ``shingle_words`` words; a
text with fewer words has its whole word sequence as one shingle, a text
without words (or NULL) has the empty set and is linked with nothing.

Shingles are 64-bit hashes, so a wrong decision needs a collision of 64-bit
values. A link of similarity s at or above the threshold is missed by all
bands with probability (1 - s**rows)**bands, 1.3e-7 at 0.8 for the defaults.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import vectext as vt
from flowlens.llm.simjoin import named_rows, similarity_components
from flowlens.operators.common import materialize, settled

BANDS = 40
ROWS = 5
SIMILARITY_PERCENT = 80
SHINGLE_WORDS = 5      # the pipeline's stage; the registered query uses the contract's 2


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``n`` fixed permutations of 32-bit values."""
    seq = vt.mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values = (seq >> np.uint64(32)).astype(np.uint32)
    return values[:n] | np.uint32(1), values[n:]


def minmax_signatures(sets: list[np.ndarray], mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """min and max of each non-empty set under each permutation: [min0, max0, min1, max1, ...]."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), 2 * len(mult)), np.uint32)
    for j in range(len(mult)):
        v = x * mult[j] + add[j]
        out[:, 2 * j], out[:, 2 * j + 1] = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, values) -> (texts, bands) 64-bit keys; the band's number is part of its key."""
    v = signatures[:, :bands * rows].astype(np.uint64).reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), v.shape[:2])
    for r in range(rows):
        key = vt.mix64(key * np.uint64(0xD6E8FEB86659FD93) + v[:, :, r])
    return key.view(np.int64)


def list_array(rows: list[np.ndarray]) -> pa.ListArray:
    """Arrow list<int64> of the given 64-bit arrays."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _sketcher(shingle_words: int, bands: int, rows: int):
    mult, add = permutations(-(-bands * rows // 2))

    def run(batches):
        for part in (p for batch in batches for p in vt.portions(batch, 1)):
            sets = vt.shingle_sets(*vt.hashed_words(part.column(1).to_pylist()), shingle_words)
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(minmax_signatures(full, mult, add), bands, rows) if full else ())
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([vt.set_id(s) if len(s) else None for s in sets], pa.int64()),
                 list_array([next(keys) if len(s) else none for s in sets])],
                names=["doc_id", "tid", "n", "set_id", "bands"])
    return run


def _set_maker(shingle_words: int):
    def run(batches):
        for part in (p for batch in batches for p in vt.portions(batch, 1)):
            sets = vt.shingle_sets(*vt.hashed_words(part.column(1).to_pylist()), shingle_words)
            same = [(s, w) for s, w in zip(sets, part.column(0).to_pylist()) if len(s) and vt.set_id(s) == w]
            if same:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for _, w in same], pa.int64()), pa.array([len(s) for s, _ in same], pa.int64()),
                     list_array([s for s, _ in same])], names=["set_id", "n", "items"])
    return run


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS,
                    percent: int = SIMILARITY_PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles,
    component_id (the smallest doc_id reachable over links, itself included)
    and kept (doc_id = component_id).

    Rows with equal sets are one node, whatever their number; repeated rows
    come out as often as they came in, with one decision. NULL and word-less
    texts: n_shingles 0, their own component. A NULL doc_id is nobody's
    smallest id; its row's component_id is that of its component (or NULL) and
    kept is true only without a component. Columns other than doc_id and text
    are ignored. Empty input gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("tid", F.xxhash64("text"))
    return settled(docs.sparkSession, "minmax", lambda: _near_duplicates(docs, shingle_words, percent, bands, rows))


def _near_duplicates(docs: DataFrame, shingle_words: int, percent: int, bands: int, rows: int) -> DataFrame:
    sketches = materialize(
        docs.mapInArrow(_sketcher(shingle_words, bands, rows),
                        "doc_id long, tid long, n long, set_id long, bands array<long>"), "minmax-sketches")
    # where a set is found again: the row of its smallest doc_id (NULL last)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tid")
    nodes = materialize(
        sketches.where("set_id is not null").groupBy("set_id")
        .agg(F.min(place).alias("place"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .select("set_id", "place.doc_id", "place.tid", "n", "bands"), "minmax-nodes")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = nodes.select("set_id", F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid")).join(ids, "set_id")
        wanted = materialize(wanted, "minmax-wanted")
        found = named_rows(docs, wanted, "minmax-texts").select("set_id", "text")
        # a repeated row gives its set once
        if not sketches.groupBy("doc_id", "tid").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
            found = found.dropDuplicates(["set_id"])
        return found \
            .mapInArrow(_set_maker(shingle_words), "set_id long, n long, items array<long>")

    labels = similarity_components(nodes.select("set_id", "bands"), sets_of, percent, "minmax", frames=1)
    comp = nodes.select("set_id", "doc_id").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left") \
        .withColumn("label", F.coalesce("label", "set_id"))
    comp = materialize(comp, "minmax-labels")
    # stored, so that Spark may split a large component's rows in the join
    smallest = materialize(comp.groupBy("label").agg(F.min("doc_id").alias("component_id")), "minmax-smallest")
    decided = materialize(comp.join(smallest, "label").select("set_id", "component_id"), "minmax-components")
    return sketches.select("doc_id", "n", "set_id").join(decided, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
