"""Repeated runs of words, wherever they lie in the running text.

Every window of ``window`` consecutive words of a text is a paragraph of its
own here; a window that occurs earlier in the corpus is repeated, and runs are
the unions of a text's repeated windows, so a passage of that many words is
found whole, across lines and inside longer ones.

Windows are not enumerated to find candidates. Each is represented by the
MinHash of its ``SHINGLE``-word shingles (one permutation: the least shingle
hash); neighbouring windows mostly share it, so a text has one *anchor* in about
15 words. Equal windows have equal minima at the same place in them, so only
the windows whose own anchor occurs twice can be repeated; those are hashed whole
and grouped, and a text's repeated ones pass in order by a task that joins them to runs. Texts are numbered in their order, so a window's spot is one long
(number and place), which groups are aggregated by in place. All groups are pre-aggregated; rows with equal texts are one text
until the end. Hashes have 64 bits, a wrong decision needs a collision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import vectext as vt
from flowlens.llm.minmax_dedup import list_array
from flowlens.llm.simjoin import likely, named_rows
from flowlens.operators.common import materialize

SHINGLE = 20
PLACE_BITS = 32      # of a spot: a text's bytes fit 31 bits, so its words do


def sliding(v: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` consecutive values, by doubling."""
    op, have = (np.minimum if least else np.maximum), 1
    while 2 * have <= width:
        v = op(v[:-have], v[have:])
        have *= 2
    return op(v[:len(v) - (width - have)], v[width - have:]) if have < width else v


def anchors(h: np.ndarray, window: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the shingles that are the least of some window of the text's words."""
    width = window - shingle + 1                 # shingles of a window
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s = vt.rolling(h, shingle)
    least = sliding(s, width, True)
    edge = np.zeros(width - 1, np.uint64)
    chosen = sliding(np.concatenate([edge, least, edge]), width, False) == s
    at = np.flatnonzero(chosen)
    return at, s[at]


def _each_text(texts: list):
    h, first = vt.hashed_words(texts)
    for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        yield i, h[lo:hi]


def _anchor_maker(window: int, shingle: int):
    def run(batches):
        for batch in (p for b in batches for p in vt.portions(b, 1)):
            found = [(len(h), *anchors(h, window, shingle)) for _, h in _each_text(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([n for n, *_ in found], pa.int64()),
                 list_array([k for *_, k in found]), list_array([at for _, at, _ in found])],
                names=["doc_id", "tid", "n_words", "keys", "at"])
    return run


def _window_maker(window: int, shingle: int):
    """Numbered texts with the places of their repeated anchors -> the windows that
    these are the least shingles of: hash, and spot (the text's number, then the place)."""
    width = window - shingle + 1

    def run(batches):
        for batch in (p for b in batches for p in vt.portions(b, 1)):
            numbers, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, h in _each_text(batch.column(1).to_pylist()):
                if len(h) < window:
                    continue
                s = vt.rolling(h, shingle)
                repeated = np.zeros(len(s), bool)
                repeated[np.array(wanted[i], np.int64)] = True
                among = np.where(repeated, s, np.uint64(0xFFFFFFFFFFFFFFFF))
                places = np.flatnonzero(sliding(among, width, True) == sliding(s, width, True))
                rolled = vt.rolling(h, window)
                for a in range(0, len(places), 1 << 16):
                    part = places[a:a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rolled[part].view(np.int64)), pa.array((numbers[i] << PLACE_BITS) + part)],
                        names=["key", "spot"])
    return run


def _islands(window: int):
    """(spot, first spot) of repeated windows in the order of spots -> the runs they
    make up. Texts' spots lie further apart than a text is long."""
    def run(batches):
        start = end = first = np.zeros(0, np.int64)           # of the run that may go on
        for batch in batches:
            spot, of = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(spot):
                continue
            before = np.concatenate([end if len(end) else spot[:1] - window - 1, spot])
            fresh = np.flatnonzero(np.diff(before) > window)
            start, first = np.concatenate([start, spot[fresh]]), np.concatenate([first, of[fresh]])
            ends = before[fresh] if len(end) else before[fresh[1:]]
            yield _runs(start[:-1], ends, first[:-1])
            start, end, first = start[-1:], spot[-1:], first[-1:]
        yield _runs(start, end, first)

    def _runs(start, end, first):
        return pa.RecordBatch.from_arrays(
            [pa.array(start >> PLACE_BITS), pa.array(start & ((1 << PLACE_BITS) - 1)), pa.array(end - start + window),
             pa.array(first >> PLACE_BITS)], names=["no", "start_word", "n_words", "first_no"])
    return run


def numbered(texts: DataFrame) -> DataFrame:
    """``texts(tid, rep, ...)`` with ``no``: their order by rep (NULL last) and tid, from 0."""
    rows = materialize(texts.orderBy(F.col("rep").isNull(), "rep", "tid")
                       .withColumn("_m", F.monotonically_increasing_id()), "runs-order")
    part, low = F.shiftright("_m", 33).alias("_part"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)     # a row per partition
    bases = rows.groupBy(part).agg(F.count("*").alias("n")) \
        .select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return rows.select("*", part, low.alias("_low")).join(F.broadcast(bases), "_part") \
        .withColumn("no", F.col("_base") + F.col("_low")).select(*texts.columns, "no")


def repeated_runs(docs: DataFrame, window: int = 50, shingle: int = SHINGLE) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per run of words that occurs earlier:
    doc_id, tid (the text's hash), start_word and n_words (words as in
    :mod:`minmax_dedup`, from 0), first_doc_id (where the run's first window
    comes first). Earlier is by doc_id (NULL last), text hash and place.

    A row whose text a smaller doc_id has too is one run from its first word to
    its last; rows repeated with one doc_id are each decided like one. Texts of
    fewer words, NULL or empty ones give no rows; other columns are ignored; an
    empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .where("text is not null").withColumn("tid", F.xxhash64("text"))
    rows = materialize(docs.select("doc_id", "text", "tid").mapInArrow(
        _anchor_maker(window, shingle),
        "doc_id long, tid long, n_words long, keys array<long>, at array<long>"), "runs-anchors")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    texts = rows.groupBy("tid").agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count("*").alias("times")) \
        .select("tid", F.col("lo.doc_id").alias("rep"), (F.col("lo") != F.col("hi")).alias("copied"), "times")
    texts = materialize(numbered(texts), "runs-texts")
    found = rows.select("tid", F.explode(F.arrays_zip("keys", "at")).alias("a")).select("tid", "a.*") \
        .withColumnRenamed("keys", "key")
    place = F.xxhash64("tid", "at")
    twice = found.groupBy("key").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("key")
    twice = materialize(twice, "runs-keys")
    wanted = likely(found, "key", twice, "runs-keys").join(twice, "key") \
        .groupBy("tid").agg(F.collect_set("at").alias("wanted"))                                 # of one text
    wanted = materialize(wanted.join(texts, "tid").select(F.col("tid").alias("_tid"), F.col("rep").alias("_doc"),
                                                          "no", "wanted"), "runs-wanted")
    # one row of each text: that of its smallest doc_id
    whole = named_rows(docs, wanted, "runs-whole").select("no", "text", "wanted")
    # a repeated row gives its windows once
    if not rows.groupBy("doc_id", "tid").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        whole = whole.dropDuplicates(["no"])
    windows = materialize(whole.mapInArrow(_window_maker(window, shingle), "key long, spot long"), "runs-windows")
    firsts = windows.groupBy("key").agg(F.min("spot").alias("first"), F.max("spot").alias("hi")).where("first <> hi") \
        .select("key", "first")
    firsts = materialize(firsts, "runs-firsts")
    cut = windows.join(firsts, "key").where("spot <> first").select("spot", "first")
    runs = cut.repartition(F.shiftright("spot", PLACE_BITS)).sortWithinPartitions("spot") \
        .mapInArrow(_islands(window), "no long, start_word long, n_words long, first_no long")
    runs = materialize(runs, "runs-found") \
        .join(texts.select("no", "tid", F.col("rep").alias("doc_id")), "no") \
        .join(texts.select(F.col("no").alias("first_no"), F.col("rep").alias("first_doc_id")), "first_no")
    copied = materialize(texts.where("times > 1"), "runs-copied")
    copies = rows.select("doc_id", "tid", "n_words").join(copied, "tid")
    own = F.col("doc_id").eqNullSafe(F.col("rep"))
    later = copies.where(~own & (F.col("n_words") >= window)).select(
        "doc_id", "tid", F.lit(0).cast("long").alias("start_word"), "n_words", F.col("rep").alias("first_doc_id"))
    # rows repeated with the doc_id that comes first share its runs
    again = materialize(copies.where(own).groupBy("tid").agg(F.count("*").cast("int").alias("rows")).where("rows > 1"),
                        "runs-again")
    runs = runs.join(again, "tid", "left").select(
        "doc_id", "tid", "start_word", "n_words", "first_doc_id",
        F.explode(F.array_repeat(F.lit(0), F.coalesce("rows", F.lit(1)))).alias("_i")).drop("_i")
    return runs.unionByName(later)


def _cut(text: str, cuts: list) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    starts, _ = vt.word_spans(vt.pack([text], lower_ascii=False)[0], vt.ASCII_SPACE)
    n, starts = len(starts), np.append(starts, len(raw))
    gone = np.zeros(n + 1, np.int64)
    for c in cuts:
        gone[min(c["start_word"], n)] += 1
        gone[min(c["start_word"] + c["n_words"], n)] -= 1
    gone = np.cumsum(gone)[:n] > 0
    left = raw[:starts[0]] + b"".join([raw[starts[i]:starts[i + 1]] for i in np.flatnonzero(~gone)])
    if n and gone[-1]:
        left = left.rstrip(b" \t\n\x0b\x0c\r")
    return left.decode("utf-8", "surrogatepass")


def _cutter(text: int):
    def run(batches):
        for batch in (p for b in batches for p in vt.portions(b, text)):
            rows = batch.select(batch.schema.names[:-1])
            ranges = batch.column(batch.num_columns - 1)
            if ranges.null_count < len(ranges):
                new = [t.as_py() if not r.is_valid or not t.is_valid else _cut(t.as_py(), r.as_py())
                       for t, r in zip(batch.column(text), ranges)]
                rows = rows.set_column(text, rows.schema.field(text), pa.array(new, rows.schema.field(text).type))
            yield rows
    return run


def without_words(docs: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """``docs`` with the words of ``cuts(key, start_word, n_words)`` taken out of
    ``text``, each with the space behind it, the last word with that before it.
    ``key`` is a column of both that tells texts apart. All columns and rows stay."""
    ranges = cuts.groupBy(F.col(key).alias("_cut")) \
        .agg(F.collect_set(F.struct("start_word", "n_words")).alias("_ranges"))           # at most a text's own words
    ranges = materialize(ranges, "cut-ranges")
    joined = docs.join(ranges, F.col(key) == F.col("_cut"), "left").select(*docs.columns, "_ranges")
    return joined.mapInArrow(_cutter(docs.columns.index("text")), docs.schema)
