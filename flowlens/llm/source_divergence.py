"""Source divergence audit by count cells.

How far the term distribution of a source stands from every other source of
its language (part ``pair``) and which terms set it apart from its language
(part ``term``). Shares are whole numbers, ``p = 1 + floor(SCALE * (count + 2)
/ (N + 2 * V))``, and ``f = floor((p - q)^2 / (p + q))``, so results are exact
whatever the order of the sums.

f depends on a term's counts alone. For part ``term``, the terms of a group
are grouped into cells (group count, language count); f is evaluated once per
cell, cells of equal value are merged, values are ranked by the number of terms
before them, and only the terms of cells that can reach a rank are looked up
and ordered by their UTF-8 bytes. For part ``pair``, the terms of a language
are dealt into blocks and its sources into tiles; a task evaluates one block
for one pair of tiles, once per distinct column of counts, and terms that
neither tile holds are one cell with their number as multiplicity.

Counts are pre-aggregated before every shuffle, inside the tasks that read the
texts at first (at most ``HELD_TERMS`` and one text's terms at a time), so a hot source, language or
term is one row per map task and term. A block holds about ``BLOCK_TERMS``
terms of at most two tiles of about ``TILE_SOURCES`` sources.

Defined results: NULL text, lang and source count as ''; every row is a
document (repeated rows count each time); a text without terms still makes its
group; a language without kept terms gives pairs of value 0 and no terms; ties
go to the smaller item in UTF-8 order; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.common import materialize, settled

# Fixed values of the measure. Bytes from x80 are those of characters beyond ASCII.
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10

HELD_TERMS = 500_000
TEXT_SLICE = 1 << 22
BLOCK_TERMS = 4096
TILE_SOURCES = 64


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * terms))``, exact for any long."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    whole = F.call_function("div", scaled, (total + 2 * terms).cast("decimal(20,0)"))
    return (F.lit(1) + whole).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))`` of two shares (at most SCALE + 1, so it fits a long)."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pieces(text: bytes):
    """Slices of a long text, cut where no term goes on."""
    start = 0
    while start < len(text):
        cut = _BETWEEN.search(text, start + TEXT_SLICE)
        end = cut.start() if cut else len(text)
        yield start, end
        start = end


def _count(batches):
    """Counts of (lang, source, term) over a task's documents, handed on whenever
    ``HELD_TERMS`` of them are held. A text's bytes are lower-cased as ASCII."""
    n: dict = {}
    docs: dict = {}
    size = 0

    def held():
        cols = [[], [], [], [], []]
        for (lang, source), terms in n.items():
            found = docs[lang, source]
            for c, v in zip(cols, ([lang] * len(terms), [source] * len(terms), list(terms), list(terms.values()),
                                   [found[t] for t in terms])):
                c += v
        n.clear(), docs.clear()
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.binary()).cast(pa.string()) for c in cols[:3]), *(pa.array(c, pa.int64()) for c in cols[3:])],
            names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for text, lang, source in zip(*(batch.column(i) for i in range(3))):
            key = lang.as_py(), source.as_py()
            text = text.as_py().lower()
            terms, seen = n.setdefault(key, Counter()), set()
            size -= len(terms)
            for start, end in _pieces(text):
                words = _TERM.findall(text, start, end)
                terms.update(words)
                seen.update(words)
            # a group without terms is a row of the NULL term
            docs.setdefault(key, Counter()).update(seen or (None,))
            if not seen:
                terms[None] += 0
            size += len(terms)
            if size >= HELD_TERMS:
                yield held()
                size = 0
    yield held()


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of a term in a group and
    the number of its documents; a group's texts without terms are a row of
    NULL term. One pass over the texts, counted inside the tasks first."""
    def raw(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c)
    return docs.select(raw("text"), raw("lang"), raw("source")) \
        .mapInArrow(_count, "lang string, source string, term string, n long, docs long") \
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class _Counts:
    """The stored tables that both parts read."""

    def __init__(self, docs: DataFrame, min_docs: int):
        counts = materialize(term_counts(docs), "divergence-counts")
        kept = counts.where("term is not null").groupBy("lang", "term") \
            .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        kept = materialize(kept.select("lang", "term", "lang_n"), "divergence-terms")
        langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
        kept_counts = counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
        self.counts = materialize(kept_counts, "divergence-kept")
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.select("lang", "source").distinct() \
            .join(totals, ["lang", "source"], "left").join(langs, "lang", "left") \
            .na.fill(0, ["total", "lang_total", "terms"])
        # one row per (lang, source), with the group's and its language's totals
        self.groups = materialize(groups, "divergence-groups")


def _ranked_terms(t: _Counts, top: int) -> DataFrame:
    """Part ``term``: each group's terms of larger share than in its language."""
    group = ["lang", "source"]
    cells = t.counts.groupBy(*group, "n", "lang_n").agg(F.count("*").alias("m")) \
        .join(t.groups, group) \
        .withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))) \
        .withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))) \
        .where("p > q") \
        .select(*group, "n", "lang_n", "m", divergence(F.col("p"), F.col("q")).alias("value"))
    cells = materialize(cells, "divergence-cells")
    by_value = Window.partitionBy(*group).orderBy(F.desc("value"))
    # any value has a term, so no value beyond the first `top` reaches a rank
    merged = cells.groupBy(*group, "value").agg(F.sum("m").alias("m")) \
        .withColumn("_i", F.row_number().over(by_value)).where(F.col("_i") <= top) \
        .withColumn("before", F.sum("m").over(by_value.rowsBetween(Window.unboundedPreceding, -1)))
    reached = merged.where(F.coalesce("before", F.lit(0)) < top).select(*group, "value")
    chosen = materialize(cells.join(reached, [*group, "value"]).select(*group, "n", "lang_n", "value"),
                         "divergence-chosen")
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "term")
    return t.counts.join(chosen, [*group, "n", "lang_n"]) \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
        .select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _tile_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sum of f over one block's terms for every pair of sources of two tiles.

    ``rows``: marks (NULL term) give each source's tile, its share of a term it
    lacks (``p``) and the block's number of terms (``block_terms``); the others
    give the share of a term it has.
    """
    _, left_tile, right_tile, _ = key
    marks = rows[rows["term"].isna()].sort_values("source")
    names, tiles = marks["source"].to_numpy(object), marks["tile"].to_numpy()
    absent = marks["p"].to_numpy(np.int64)
    has = rows[rows["term"].notna()]
    column, terms = pd.factorize(has["term"])
    shares = np.tile(absent[:, None], (1, len(terms) + 1))     # the last column: terms no source here has
    at = pd.Index(names).get_indexer(has["source"])
    shares[at, column] = has["p"].to_numpy(np.int64)
    shares, times = np.unique(shares, axis=1, return_inverse=True)
    weights = np.zeros(shares.shape[1], np.int64)
    ones = np.ones(len(terms) + 1, np.int64)
    ones[-1] = int(marks["block_terms"].iloc[0]) - len(terms)
    np.add.at(weights, times.ravel(), ones)
    left, right = np.flatnonzero(tiles == left_tile), np.flatnonzero(tiles == right_tile)
    out = []
    for i in left:
        p, q = shares[i], shares[right]
        sums = ((p - q) ** 2 // (p + q)) @ weights
        for j, v in zip(right, sums.tolist()):
            if left_tile != right_tile:
                out.append((names[j], names[i], v))
            if i != j:
                out.append((names[i], names[j], v))
    frame = pd.DataFrame(out, columns=["source", "item", "value"])
    frame.insert(0, "lang", key[0])
    return frame.astype({"value": "int64"})


def _ranked_pairs(t: _Counts, block_terms: int, tile_sources: int) -> DataFrame:
    """Part ``pair``: every ordered pair of a language's sources."""
    group = ["lang", "source"]
    sizes = t.groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("terms").alias("terms")) \
        .select("lang", F.ceil(F.col("sources") / tile_sources).alias("tiles"),
                F.greatest(F.ceil(F.col("terms") / block_terms), F.lit(1)).alias("blocks"))
    sizes = materialize(sizes, "divergence-sizes")
    tiled = t.groups.join(sizes, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles"))) \
        .withColumn("absent", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
                    .otherwise(F.lit(1).cast("long")))
    tiled = materialize(tiled, "divergence-tiles")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    kept = t.counts.select("lang", "term").distinct().join(sizes, "lang") \
        .groupBy("lang", block).agg(F.count("*").alias("block_terms"))
    pair_of_tiles = F.explode(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1),
        lambda o: F.struct(F.least("tile", o).alias("a"), F.greatest("tile", o).alias("b"))))
    marks = tiled.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
        .join(kept, ["lang", "block"], "left").na.fill(0, ["block_terms"]) \
        .select(*group, F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"),
                "block", "block_terms", "tile", pair_of_tiles.alias("t"))
    rows = t.counts.join(tiled, group) \
        .select(*group, "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
                block, F.lit(0).cast("long").alias("block_terms"), "tile", pair_of_tiles.alias("t"))
    sums = marks.unionByName(rows) \
        .select(*group, "term", "p", "block", "block_terms", "tile", "t.a", "t.b") \
        .groupBy("lang", "a", "b", "block") \
        .applyInPandas(_tile_sums, "lang string, source string, item string, value long")
    pairs = sums.groupBy(*group, "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    return pairs.select(*group, F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS,
                     tile_sources: int = TILE_SOURCES) -> DataFrame:
    """``docs(text, lang, source)`` -> ``(lang, source, part, item, value, rank)``:
    all pairs of sources of a language, and each group's ``top`` terms."""
    def found() -> DataFrame:
        t = _Counts(docs, min_docs)
        return _ranked_pairs(t, block_terms, tile_sources).unionByName(_ranked_terms(t, top))
    return settled(docs.sparkSession, "divergence", found)


# Every kept term with every group and source of its language, no cells.
ORACLE_SQL = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
w as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
l as (select lang, term, count(*) as c from w group by 1, 2 having count(distinct id) >= 10),
lt as (select lang, cast(sum(c) as hugeint) as n, cast(count(*) as hugeint) as v from l group by 1),
g as (select distinct lang, source from d),
own as (select lang, source, term, count(*) as c from w group by 1, 2, 3),
gc as (
  select g.lang, g.source, l.term, cast(coalesce(own.c, 0) as hugeint) as c, cast(l.c as hugeint) as lc
  from g join l on l.lang = g.lang
  left join own on own.lang = g.lang and own.source = g.source and own.term = l.term),
gt as (select lang, source, sum(c) as n from gc group by 1, 2),
p as (
  select gc.lang, gc.source, gc.term, gc.c,
    cast(1 + (1000000000 * (gc.c + 2)) // (cast(gt.n as hugeint) + 2 * lt.v) as bigint) as p,
    cast(1 + (1000000000 * (gc.lc + 2)) // (lt.n + 2 * lt.v) as bigint) as q
  from gc join gt on gt.lang = gc.lang and gt.source = gc.source join lt on lt.lang = gc.lang),
pairs as (
  select a.lang, a.source, b.source as item,
    cast(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as bigint) as s
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
terms as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value,
    row_number() over (partition by lang, source order by ((p - q) * (p - q)) // (p + q) desc, term) as rank
  from p where c > 0 and p > q)
select lang, source, part, item, value, cast(rank as integer) as rank from terms where rank <= 10
union all
select a.lang, a.source, 'pair', b.source, coalesce(s, 0),
  cast(row_number() over (partition by a.lang, a.source order by coalesce(s, 0) desc, b.source) as integer)
from g a join g b on a.lang = b.lang and a.source <> b.source
left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
"""
