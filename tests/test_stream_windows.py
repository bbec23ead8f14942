"""Closed windows and thresholds of a stream against the batch detectors."""

import os
import random
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.operators.exfil import agg_exfil, detect_exfil
from flowlens.operators.lateral import agg_lateral, detect_lateral
from flowlens.sources.fixtures import flows_from_lineitem
from flowlens.streaming import (flagged_groups, late_flows, latest_thresholds, progress_rows, start_groups,
                                start_thresholds)
from flowlens.operators.score_moments import gathered, mean_and_std, merged, observed
from flowlens.streaming.thresholds import SCORES, moments_of

LATERAL, EXFIL = SCORES["lateral"].SCORE, SCORES["exfil"].SCORE
AGG = {"lateral": agg_lateral, "exfil": agg_exfil}
DETECT = {"lateral": detect_lateral, "exfil": detect_exfil}


def land(df, folder):
    """One file, later than those before it: one trigger."""
    df.coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)      # the file source orders files by modification time


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("kind", ["lateral", "exfil"])
def test_many_triggers_restarts_and_late_rows_give_the_batch_result(spark, tmp_out, few_partitions, kind):
    day = flows_from_lineitem(spark, SF_SMALL).where("timestamp < '2024-01-03'").cache()
    second = F.unix_seconds("timestamp") - 1704067200          # since 2024-01-01
    third = F.floor(second / 57600)                            # 16 hours a file
    folder, out = os.path.join(tmp_out, "landing"), os.path.join(tmp_out, kind)
    read = 0

    def run():
        q = start_groups(stream(spark, day.schema, folder), kind, out, available_now=True)
        assert q.awaitTermination(300)
        t = start_thresholds(spark, kind, out, available_now=True)
        assert t.awaitTermination(300)
        return sum(p[2] for p in progress_rows(q)), sum(p[3] for p in progress_rows(q))

    # out of order within the delay: the halves of each file's last 10 minutes swap files
    near = F.pmod(F.hash("src_port", "dst_ip"), F.lit(2))
    edge = second % 57600 >= 57600 - 600
    part = F.when(edge & (near == 0), F.least(third + 1, F.lit(2))).otherwise(third)
    parts = [day.where(part == i) for i in range(3)]
    land(parts[0], folder)
    land(parts[1], folder)
    n, dropped = run()                                   # the first run ends here
    read += n
    assert dropped == 0 and late_flows(spark, read, out) > 0      # its last windows are still open
    first = latest_thresholds(spark, out)["groups"]
    land(parts[2], folder)
    late = day.where("timestamp < '2024-01-01 06:00:00'").withColumn("dst_ip", F.lit("203.0.113.99"))
    land(late, folder)                                   # all of it is behind the watermark
    outbound = "10.0.0.1", "203.0.113.1"
    end = day.limit(1).withColumns({"timestamp": F.lit("2031-01-01").cast("timestamp"), "src_ip": F.lit(outbound[0]),
                                    "dst_ip": F.lit(outbound[1])})
    land(end, folder)                                    # closes every window
    n, dropped = run()                                   # a new query on the same checkpoint
    read += n

    want_groups = AGG[kind](day)
    got = spark.read.parquet(os.path.join(out, "groups"))
    assert rows(got.select(*want_groups.columns)) == rows(want_groups)
    assert got.count() == got.select("src_ip", "time_window").distinct().count()
    late_rows = late.count() if kind == "lateral" else late.where("src_ip like '10.%'").count()
    assert dropped > 0 and late_flows(spark, read, out) == late_rows + 1      # and the one of 2031, still open

    assert latest_thresholds(spark, out)["groups"] == want_groups.count() > first
    want = DETECT[kind](day)
    flagged = flagged_groups(spark, kind, out)
    assert flagged.columns == want.columns
    places = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in want.dtypes]
    assert rows(flagged.select(*places)) == rows(want.select(*places))
    assert any(r[want.columns.index({"lateral": "is_lateral_movement", "exfil": "is_exfiltration"}[kind])]
               for r in rows(want))
    day.unpersist()


def test_moments_merge_in_any_order_and_are_exact():
    rng = random.Random(4)
    x = [[rng.randrange(1, 50), rng.randrange(1, 1000), rng.randrange(2), rng.randrange(2)] for _ in range(60)]
    whole = moments_of(np.array(x, dtype=object))
    cuts = sorted(rng.randrange(60) for _ in range(5))
    parts = [moments_of(np.array(x[a:b], dtype=object).reshape(-1, 4)) for a, b in zip([0, *cuts], [*cuts, 60])]
    rng.shuffle(parts)
    total = None
    for p in parts:
        total = merged(total, p)
    assert total == whole
    tops = [max(r[i] for r in x) for i in range(2)]
    scores = [Fraction(4 * r[0], tops[0]) + Fraction(3 * r[1], tops[1]) + 2 * r[2] + 2 * r[3] for r in x]
    mean = sum(scores) / 60
    var = sum((s - mean) ** 2 for s in scores) / 59
    assert mean_and_std(LATERAL, whole) == pytest.approx((float(mean), float(var) ** 0.5), rel=1e-15)


def test_moments_past_64_bits_one_group_and_no_spread():
    big = moments_of(np.array([[10**17, 1, 1, 0, 1, 1, 0], [10**17 + 1, 1, 1, 0, 1, 1, 0]], dtype=object))
    assert big["products"][0][0] == 10**34 + (10**17 + 1) ** 2
    assert mean_and_std(EXFIL, big)[1] == pytest.approx(3 / 2**20 / 2**0.5)
    assert mean_and_std(EXFIL, moments_of(np.array([[2**20, 1, 0, 0, 0, 0, 0]], dtype=object))) == (5.0, None)
    assert mean_and_std(LATERAL, moments_of(np.array([[0, 0, 0, 0]], dtype=object))) == (None, None)
    assert all(len(s.SCORE.numbers) == len(s.SCORE.weights) for s in SCORES.values())


def test_observed_moments_are_those_of_the_rows(spark):
    rng = random.Random(9)
    x = [[rng.randrange(10**15), *(rng.randrange(9) for _ in range(6))] for _ in range(200)]
    rows = spark.createDataFrame([*map(tuple, x), (None, 1, 1, 1, 1, 1, 1)], ", ".join(f"{c} long" for c in EXFIL.numbers))
    watched, obs = observed(rows.repartition(7), EXFIL)
    watched.write.format("noop").mode("overwrite").save()
    assert gathered(obs, EXFIL) == moments_of(np.array(x, dtype=object))
    watched, obs = observed(rows.limit(0), EXFIL)
    watched.write.format("noop").mode("overwrite").save()
    assert mean_and_std(EXFIL, gathered(obs, EXFIL)) == (None, None)
