"""What a stream keeps on disk: one state row per flow at most, groups once, nothing consumed."""

import os

from conftest import SF_SMALL
from flowlens.plans import store_queries
from flowlens.sources.fixtures import flows_from_lineitem
from flowlens.streaming import start_groups
from flowlens.streaming.windows import _put


def test_state_holds_one_row_per_flow(spark, tmp_out):
    flows, landing = flows_from_lineitem(spark, SF_SMALL), os.path.join(tmp_out, "in")
    flows.write.parquet(landing)
    q = start_groups(spark.readStream.schema(flows.schema).parquet(landing), "lateral", os.path.join(tmp_out, "out"),
                     delay="30 days", available_now=True)
    assert q.awaitTermination(300)
    states = q.recentProgress[0].stateOperators
    pairs = flows.selectExpr("window(timestamp, '300 seconds') as w", "src_ip", "dst_ip", "dst_port").distinct().count()
    assert [s.numRowsUpdated for s in states] == [pairs]


def test_a_repeated_trigger_adds_its_groups_once(spark, tmp_out):
    target = os.path.join(tmp_out, "groups")
    read = lambda: sorted(r.id for r in spark.read.parquet(target).collect())
    _put(spark.range(10).repartition(3), 0, tmp_out)
    _put(spark.range(10).repartition(2), 0, tmp_out)        # the trigger was not committed and comes again
    _put(spark.range(10, 12), 1, tmp_out)
    assert read() == list(range(12))
    # stopped after the folder was complete, before all its files were moved
    moved = sorted(f for f in os.listdir(target) if f.startswith("part-"))[0]
    os.rename(os.path.join(target, moved), os.path.join(tmp_out, "_group_batches", "0", moved))
    _put(spark.range(10), 0, tmp_out)
    assert read() == list(range(12))
    # stopped while the folder was written
    spark.range(50).write.parquet(os.path.join(tmp_out, "_group_batches", ".2"))
    _put(spark.range(12, 14), 2, tmp_out)
    assert read() == list(range(14))


def test_the_query_keeps_its_groups_only(spark, monkeypatch):
    one = store_queries.q_stream_exfil(spark, SF_SMALL)
    monkeypatch.setattr(store_queries, "TRIGGER_BYTES", 1)      # as many triggers as may be
    many = store_queries.q_stream_exfil(spark, SF_SMALL)
    out = os.path.dirname(os.path.dirname(many.inputFiles()[0].removeprefix("file:").replace("///", "/")))
    assert not os.path.exists(os.path.join(out, "_groups_checkpoint"))
    assert not os.path.exists(os.path.join(os.path.dirname(out), "landing"))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
