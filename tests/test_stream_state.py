"""The streams keep their state on disk, the thresholds' single key in one partition."""

import json
import os

from conftest import SF_SMALL
from flowlens.sources.fixtures import flows_from_lineitem
from flowlens.streaming import start_groups, start_thresholds
from flowlens.streaming.state import PARTITIONS, PROVIDER, ROCKSDB


def started_with(checkpoint: str) -> dict:
    with open(os.path.join(checkpoint, "offsets", "0")) as fh:
        return json.loads(fh.read().splitlines()[1])["conf"]


def test_state_is_on_disk(spark, tmp_out):
    flows, landing, out = flows_from_lineitem(spark, SF_SMALL), os.path.join(tmp_out, "in"), os.path.join(tmp_out, "out")
    before = spark.conf.get(PROVIDER, None), spark.conf.get(PARTITIONS)
    flows.write.parquet(landing)
    start_groups(spark.readStream.schema(flows.schema).parquet(landing), "lateral", out, available_now=True).awaitTermination()
    start_thresholds(spark, "lateral", out, available_now=True).awaitTermination()
    groups, thresholds = (started_with(os.path.join(out, c)) for c in ("_groups_checkpoint", "_thresholds_checkpoint"))
    assert groups[PROVIDER] == ROCKSDB and groups[PARTITIONS] == before[1]
    assert thresholds[PROVIDER] == ROCKSDB and thresholds[PARTITIONS] == "1"
    assert (spark.conf.get(PROVIDER, None), spark.conf.get(PARTITIONS)) == before
