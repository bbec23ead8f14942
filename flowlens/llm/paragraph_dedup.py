"""Substring dedup by paragraph MinHash banding.

Two kinds of paragraphs cover all words of a text: its lines of at least
``min_words`` words, compared by Jaccard (:func:`repeated_paragraphs`, below), and
every window of ``min_words`` words of its running text, compared for equality
(:mod:`repeated_runs`), which finds passages across short lines and inside longer
ones. :func:`repeated_passages` gives both, as ranges of words.

Equal paragraphs (equal sets of five-word shingles) are one node; distinct
ones are banded with few rows per band, tuned for recall (a pair at the
threshold is missed with probability (1 - 0.8**rows)**bands, 6e-7 with the
defaults), colliding ones are joined and verified by exact Jaccard on the
full sets, and removals go by connected components: of each component the
first paragraph (smallest doc_id, then position) stays.

Words are as in :mod:`minmax_dedup`. Lines end at x0A.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import vectext as vt
from flowlens.llm.minmax_dedup import band_keys, list_array, permutations
from flowlens.llm.repeated_runs import repeated_runs
from flowlens.llm.simjoin import named_rows, similarity_components
from flowlens.operators.common import materialize, settled

MIN_WORDS = 50
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
BANDS = 20
ROWS = 3


def _minima(values: np.ndarray, first: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, len(mult)), np.uint32)
    for j in range(len(mult)):
        out[:, j] = np.minimum.reduceat(x * mult[j] + add[j], first[:-1])
    return out


def minima(sets: list[np.ndarray], mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Plain MinHash signatures of non-empty sets of 64-bit hashes."""
    return _minima(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]), mult, add)


def paragraphs(texts: list, min_words: int):
    """Text, line of the text, first word in the text and number of words of each
    line with ``min_words`` words; the place of its first word in the hashes of
    all words, and these."""
    buf, at = vt.pack(texts)
    starts, _ = vt.word_spans(buf, vt.ASCII_SPACE)
    h = vt.word_hashes(buf, starts, vt.ASCII_SPACE)
    lines = np.sort(np.concatenate([at[:-1], np.flatnonzero(buf == 0x0A) + 1]))
    word = np.append(np.searchsorted(starts, lines), len(starts))
    k = np.flatnonzero(np.diff(word) >= max(min_words, 1))
    text = np.searchsorted(at, lines[k], "right") - 1
    first_line = np.searchsorted(lines, at[text])
    return text, k - first_line, word[k] - word[first_line], word[k + 1] - word[k], word[k], h


def _line_sets(texts: list, min_words: int, shingle_words: int):
    """Text, line, first word and number of words of each paragraph; their sets, one after the other."""
    *found, n_words, begin, h = paragraphs(texts, min_words)
    return (*found, n_words), *vt.distinct_shingles(h, begin, n_words, shingle_words)


def _sketcher(min_words: int, shingle_words: int, bands: int, rows: int):
    mult, add = permutations(bands * rows)

    def run(batches):
        for part in (p for batch in batches for p in vt.portions(batch, 1)):
            (text, line, start, n_words), values, first = _line_sets(part.column(1).to_pylist(), min_words, shingle_words)
            if not len(text):
                continue
            keys = band_keys(_minima(values, first, mult, add), bands, rows)
            of = pa.array(text)
            offsets = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(of), part.column(2).take(of), pa.array(line), pa.array(start), pa.array(n_words),
                 pa.array(np.diff(first)), pa.array(vt.set_ids(values, first)),
                 pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))],
                names=["doc_id", "tid", "paragraph", "start_word", "n_words", "n", "set_id", "bands"])
    return run


def _set_maker(min_words: int, shingle_words: int):
    """Texts with the set ids wanted of them -> the sets of those paragraphs."""
    def run(batches):
        for part in (p for batch in batches for p in vt.portions(batch, 0)):
            wanted = [set(w) for w in part.column(1).to_pylist()]
            (text, *_), values, first = _line_sets(part.column(0).to_pylist(), min_words, shingle_words)
            rows = {}
            for j, (i, w) in enumerate(zip(text.tolist(), vt.set_ids(values, first).tolist())):
                if w in wanted[i]:
                    rows[w] = values[first[j]:first[j + 1]]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(rows), pa.int64()), pa.array([len(s) for s in rows.values()], pa.int64()),
                     list_array(list(rows.values()))], names=["set_id", "n", "items"])
    return run


def repeated_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, shingle_words: int = SHINGLE_WORDS,
                        percent: int = SIMILARITY_PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per paragraph that has a near-equal one
    anywhere: doc_id, paragraph (line number from 0), start_word (its first in
    the text, from 0), n_words, first_doc_id and first_paragraph (its
    component's first), kept (it is that one).

    Paragraphs of one document count as well. NULL and empty texts and shorter
    lines give no rows. A NULL doc_id comes after all others in the order.
    Repeated rows give repeated rows with one decision. Other columns are
    ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("tid", F.xxhash64("text"))
    return settled(docs.sparkSession, "paragraphs",
                   lambda: _repeated_paragraphs(docs, min_words, shingle_words, percent, bands, rows))


def _repeated_paragraphs(docs: DataFrame, min_words: int, shingle_words: int, percent: int, bands: int,
                         rows: int) -> DataFrame:
    sketches = materialize(
        docs.mapInArrow(_sketcher(min_words, shingle_words, bands, rows),
                        "doc_id long, tid long, paragraph long, start_word long, n_words long, n long, set_id long, "
                        "bands array<long>"),
        "paragraph-sketches")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "paragraph")
    nodes = materialize(
        sketches.groupBy("set_id").agg(F.min(place).alias("place"), F.min_by("tid", place).alias("tid"),
                                       F.count("*").alias("copies"),
                                       F.first("n").alias("n"), F.first("bands").alias("bands")),
        "paragraph-nodes")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = nodes.join(ids, "set_id").select(F.col("place.doc_id").alias("_doc"), F.col("tid").alias("_tid"), "set_id") \
            .groupBy("_doc", "_tid").agg(F.collect_set("set_id").alias("wanted"))   # at most a text's own paragraphs
        wanted = materialize(wanted, "paragraph-wanted")
        found = named_rows(docs, wanted, "paragraph-texts").select("text", "wanted", "_doc", "_tid")
        # a repeated row gives its sets once
        if not sketches.groupBy("doc_id", "tid", "paragraph").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
            found = found.dropDuplicates(["_doc", "_tid"])
        return found.select("text", "wanted") \
            .mapInArrow(_set_maker(min_words, shingle_words), "set_id long, n long, items array<long>")

    labels = similarity_components(nodes.select("set_id", "bands"), sets_of, percent, "paragraph")
    comp = materialize(
        nodes.select("set_id", "place", "copies").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
        .withColumn("label", F.coalesce("label", "set_id")), "paragraph-labels")
    # stored, so that Spark may split a large component's rows in the join
    groups = materialize(comp.groupBy("label").agg(F.min("place").alias("first"), F.sum("copies").alias("copies"))
                         .where("copies > 1"), "paragraph-groups")
    decided = materialize(comp.select("set_id", "label").join(groups, "label").select("set_id", "first"),
                          "paragraph-components")
    out = sketches.select("doc_id", "paragraph", "start_word", "n_words", "set_id").join(decided, "set_id")
    return out.select(
        "doc_id", "paragraph", "start_word", "n_words", F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.paragraph").alias("first_paragraph"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("paragraph") == F.col("first.paragraph")))
        .alias("kept"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All words of ``docs(doc_id, text)`` in paragraphs of ``min_words`` words that
    repeat: ``unit`` ('line': near-equal lines; 'run': runs of repeated windows),
    doc_id, start_word, n_words, first_doc_id (where the line's component, or the
    run's first window, comes first) and kept (a line that is its component's
    first). What is not kept is a repetition of earlier words. Edge rows as in
    :func:`repeated_paragraphs` and :func:`repeated_runs.repeated_runs`."""
    lines = repeated_paragraphs(docs, min_words)
    runs = settled(docs.sparkSession, "runs", lambda: repeated_runs(docs, min_words))
    columns = ["doc_id", "start_word", "n_words", "first_doc_id"]
    return lines.select(F.lit("line").alias("unit"), *columns, "kept") \
        .unionByName(runs.select(F.lit("run").alias("unit"), *columns, F.lit(False).alias("kept")))
