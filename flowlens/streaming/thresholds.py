"""Score thresholds over all closed windows of a stream (mean + 2 sigma, maxima).

A group's score weighs a few whole numbers of the group (distinct hosts and
ports, bytes, flags). For lateral movement two of the weights are divided by
maxima over all groups, so a new maximum changes every earlier score. The state
therefore holds what no maximum changes, the exact integer moments of
:mod:`flowlens.operators.score_moments`. Mean and deviation of the scores under
the maxima so far follow from them, and after the last window they are those of
a batch run over all groups, whatever the triggers were.

The state is a few dozen numbers per detector (``transformWithState``); each
task of a trigger reduces its groups to one such row first.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.operators import exfil, lateral
from flowlens.operators.score_moments import Weights, mean_and_std, merged
from flowlens.streaming.state import state_on_disk

_MOMENTS = "kind string, moments string"
THRESHOLDS = "kind string, groups long, max_first long, max_second long, mean double, std double"


SCORES = {"lateral": lateral, "exfil": exfil}        # modules: SCORE, SCALARS, scored()


def moments_of(rows: np.ndarray) -> dict:
    """Exact moments of whole-number rows (NumPy integers as Python ones: products may pass 64 bits)."""
    x = rows.astype(object)
    if not len(x):
        return {"n": 0, "sums": [], "products": [], "maxima": []}
    return {"n": len(x), "sums": [int(v) for v in x.sum(axis=0)],
            "products": [[int(v) for v in r] for r in x.T.dot(x)], "maxima": [int(v) for v in x.max(axis=0)]}


def _reduced(kind: str, width: int):
    def run(batches):
        total = moments_of(np.zeros((0, width), object))
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            rows = [r for r in zip(*cols) if None not in r]
            if rows:
                total = merged(total, moments_of(np.array(rows, dtype=object)))
        if total["n"]:
            yield pa.RecordBatch.from_pydict({"kind": [kind], "moments": [json.dumps(total)]})
    return run


class _Moments(StatefulProcessor):
    """Merges a trigger's moments into the state; emits the thresholds so far."""

    def __init__(self, score: Weights):
        self.score = score

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", "moments string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = json.loads(self.state.get()[0]) if self.state.exists() else None
        for frame in rows:
            for text in frame["moments"]:
                total = merged(total, json.loads(text))
        self.state.update((json.dumps(total),))
        mean, std = mean_and_std(self.score, total)
        first, second = (total["maxima"] + [None, None])[:2]
        yield pd.DataFrame({"kind": [key[0]], "groups": [total["n"]], "max_first": [first], "max_second": [second],
                            "mean": [mean], "std": [std]}).astype({"mean": "float64", "std": "float64"})

    def close(self) -> None:
        pass


def start_thresholds(spark: SparkSession, kind: str, out_dir: str, available_now: bool = False,
                     checkpoint: str | None = None):
    """Follow the closed groups that :func:`flowlens.streaming.windows.start_groups`
    writes to ``out_dir/groups`` and append the thresholds after each trigger to
    ``out_dir/thresholds``. Returns the ``StreamingQuery``; a restart with the
    same checkpoint (``out_dir/_thresholds_checkpoint`` by default) goes on."""
    numbers = SCORES[kind].SCORE.numbers
    path = os.path.join(out_dir, "groups")
    groups = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    rows = SCORES[kind].with_flags(groups).select(*(F.col(c).cast("long") for c in numbers))
    out = rows.mapInArrow(_reduced(kind, len(numbers)), _MOMENTS).groupBy("kind") \
        .transformWithStateInPandas(_Moments(SCORES[kind].SCORE), THRESHOLDS, "Append", "None")
    writer = out.writeStream.format("parquet").outputMode("append") \
        .option("path", os.path.join(out_dir, "thresholds")) \
        .option("checkpointLocation", checkpoint or os.path.join(out_dir, "_thresholds_checkpoint"))
    writer = writer.trigger(availableNow=True) if available_now else writer
    with state_on_disk(spark, partitions=1, unload=available_now):   # one key
        return writer.start()


def latest_thresholds(spark: SparkSession, out_dir: str):
    """The thresholds over all groups so far, as a row, or None."""
    return spark.read.schema(THRESHOLDS).parquet(os.path.join(out_dir, "thresholds")) \
        .orderBy(F.desc("groups")).first()


def flagged_groups(spark: SparkSession, kind: str, out_dir: str) -> DataFrame:
    """All closed groups, scored and flagged with the latest thresholds: what the
    batch detector gives for the same flows."""
    score, t = SCORES[kind], latest_thresholds(spark, out_dir)
    values = [None] * 4 if t is None else [t["max_first"], t["max_second"], t["mean"], t["std"]]
    groups = spark.read.parquet(os.path.join(out_dir, "groups")).drop("flows")
    return score.scored(groups, *values)
