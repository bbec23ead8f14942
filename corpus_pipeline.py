"""Corpus preparation: five training-data operators chained over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents``. Rows are decided
by a key of doc_id and text, so texts that share a doc_id, or have none, are
decided apart; rows with the same doc_id and text share one fate, and one of
them stays after the near-dedup stage.

In every stage: other columns, whatever their names, go through as they are; an
empty table gives an empty one; very long texts are read whole.
"""

from __future__ import annotations

import functools
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.bestfit_packing import pack_documents
from flowlens.llm.minmax_dedup import near_duplicates
from flowlens.llm.paragraph_dedup import repeated_paragraphs
from flowlens.llm.repeated_runs import repeated_runs, without_words
from flowlens.llm.string_tiling import contaminated_pairs
from flowlens.llm.subword_classifier import THRESHOLD, score_column, train
from flowlens.operators.common import Scratch, drop_tables, materialize, release_shuffles, settled, track_table
from flowlens.session import BATCH_CONF, checkpoint_dir


KEY = "_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key that the rows of a stage are decided, joined and cut by."""
    return docs.withColumn(KEY, F.xxhash64("doc_id", F.xxhash64("text")))


def _as_ids(keyed: DataFrame) -> DataFrame:
    """``(doc_id, text)`` for the operators, the key being the doc_id."""
    return keyed.select(F.col(KEY).alias("doc_id"), "text")


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    return keyed.join(keys.select(F.col("doc_id").alias(KEY)).distinct(), KEY, "left_anti")


def _firsts(found: DataFrame, keyed: DataFrame, group: list[str], place: list[str]) -> DataFrame:
    """``found`` (doc_id is a key) but for the first of each group: the one with the smallest
    doc_id in ``keyed``, NULL coming last, then the smallest key and ``place``."""
    ids = keyed.select(F.col(KEY).alias("doc_id"), F.col("doc_id").alias("_id")).distinct()
    order = F.struct(F.col("_id").isNull().alias("last"), "_id", "doc_id", *place)
    placed = materialize(found.distinct().join(ids, "doc_id").withColumn("_place", order), "corpus-places")
    first = materialize(placed.groupBy(*group).agg(F.min("_place").alias("_first")), "corpus-firsts")
    return placed.join(first, group).where("not (_place <=> _first)").drop("_id", "_place", "_first")


def _once(keyed: DataFrame) -> DataFrame:
    """One of the rows of each key; only the repeated rows are shuffled."""
    again = settled(keyed.sparkSession, "corpus-again",
                    lambda: keyed.groupBy(KEY).agg(F.count("*").alias("n")).where("n > 1").select(KEY))
    return keyed.join(again, KEY, "left_anti").unionByName(keyed.join(again, KEY, "left_semi").dropDuplicates([KEY]))


def _bounded(stage):
    """``stage`` with batches bounded in bytes. The settings stay, as the caller writes the frame that it returns."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for k, v in BATCH_CONF.items():
            spark.conf.set(k, v)
        return stage(spark, docs, sf_dir)
    return run


@_bounded
def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below its threshold go. NULL
    texts are scored as empty ones."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(score_column(spark, model, F.col("text")) >= THRESHOLD)


@_bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays (five-word shingles,
    0.8): the one with the smallest doc_id, NULL last. Of rows with the same
    doc_id and text one stays. NULL texts and those without words are in no
    component."""
    keyed = _keyed(docs)

    def gone() -> DataFrame:
        found = near_duplicates(_as_ids(keyed)).select("doc_id", "component_id")
        return _firsts(found, keyed, ["component_id"], []).select("doc_id")
    return _once(_without(keyed, settled(spark, "corpus-copies", gone))).select(*docs.columns)


@_bounded
def drop_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines of 50 words the first one stays, and of every window of
    50 words that repeats the first one; the words of the others are cut from
    their texts (n_chars follows). First is by doc_id, NULL last. All rows stay;
    NULL and shorter texts as they are."""
    keyed = _keyed(docs)

    def cuts() -> DataFrame:
        group = ["first_doc_id", "first_paragraph"]
        lines = repeated_paragraphs(_as_ids(keyed)).select("doc_id", "paragraph", "start_word", "n_words", *group)
        runs = repeated_runs(docs).select(F.xxhash64("doc_id", "tid").alias(KEY), "start_word", "n_words")
        return _firsts(lines, keyed, group, ["paragraph"]) \
            .select(F.col("doc_id").alias(KEY), "start_word", "n_words").unionByName(runs)
    found = settled(spark, "corpus-cuts", cuts)
    out = without_words(keyed, found, KEY).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else out


@_bounded
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words in tiles go. NULL and
    empty texts hold none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs)
    return _without(keyed, contaminated_pairs(_as_ids(keyed), benchmark)).select(*docs.columns)


@_bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of 2048 tokens.
    A NULL or empty text is one piece of the end token."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", keep_good_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_paragraphs),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

ORACLE_SQL = None      # trained scores, tiling and packing are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; each result is written as Parquet and read
    again as the next one's documents. A stage's intermediate tables, and its
    input once its result is written, are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex[:12]}")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        with Scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        track_table(path)
        docs = spark.read.parquet(path)
        if before:
            drop_tables(spark, [before])
        release_shuffles(spark)
        before = path
    return docs
