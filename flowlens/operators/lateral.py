"""Lateral movement: per (source, 5-minute window) fan-out and scan scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.arith import flag
from flowlens.operators.common import (above_sigma, add_time_window, distinct_count, group_portions, materialize_parts,
                                      moments, weighted_sum, with_scalars)
from flowlens.operators.score_moments import Gathered, mean_and_std, weights
from flowlens.schema import LATERAL_COLUMNS, LATERAL_WINDOW_S

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's). Limits are strict (more than).
PORT_SCAN_MIN_PORTS = 10
PORT_SCAN_MIN_PACKETS = 50
HOST_SCAN_MIN_HOSTS = 5
HOST_SCAN_MIN_PACKETS = 20
# lateral_score = sum of column x weight, in this order
SCORE_WEIGHTS = [("dst_diversity_score", 4.0), ("port_scan_score", 3.0),
                 ("is_port_scan", 2.0), ("is_host_scan", 2.0)]
SIGMA = 2.0
# dst_diversity_score and port_scan_score are these numbers over their maxima
SCORE = weights([("unique_dsts", 4.0), ("unique_ports", 3.0), *SCORE_WEIGHTS[2:]], divided=2)
# ---------------------------------------------------------------------------



def agg_lateral(df: DataFrame, width_s: int = LATERAL_WINDOW_S, exact: bool = True) -> DataFrame:
    """Per (src_ip, window): distinct destinations and ports, packet and byte
    sums, mean duration. NULL keys are dropped, as a group-by would."""
    w = add_time_window(df.select("timestamp", "src_ip", "dst_ip", "dst_port",
                                  "packets", "bytes", "duration")
                        if "timestamp" in df.columns else
                        df.select("src_ip", "dst_ip", "dst_port", "packets", "bytes", "duration"),
                        width_s)
    return (w.where(F.col("src_ip").isNotNull() & F.col("time_window").isNotNull())
             .groupBy("src_ip", "time_window")
             .agg(distinct_count("dst_ip", exact).alias("unique_dsts"),
                  distinct_count("dst_port", exact).alias("unique_ports"),
                  F.sum("packets").cast("long").alias("packets"),
                  F.sum("bytes").cast("long").alias("bytes"),
                  F.avg("duration").alias("avg_duration")))


def with_flags(groups: DataFrame) -> DataFrame:
    """Groups with the scan flags."""
    return groups.withColumns({
        "is_port_scan": flag((F.col("unique_ports") > PORT_SCAN_MIN_PORTS)
                             & (F.col("packets") > PORT_SCAN_MIN_PACKETS)),
        "is_host_scan": flag((F.col("unique_dsts") > HOST_SCAN_MIN_HOSTS)
                             & (F.col("packets") > HOST_SCAN_MIN_PACKETS)),
    })


def _with_score(groups: DataFrame) -> DataFrame:
    """``groups`` with ``_max_ud`` and ``_max_up`` -> the scores."""
    return with_flags(groups).withColumns({
        "dst_diversity_score": F.try_divide(F.col("unique_dsts"), F.col("_max_ud")),
        "port_scan_score": F.try_divide(F.col("unique_ports"), F.col("_max_up")),
        "traffic_intensity": F.try_divide(F.col("bytes"), F.col("avg_duration") + 1),
    }).withColumn("lateral_score", weighted_sum(SCORE_WEIGHTS)).drop("_max_ud", "_max_up")


def _flagged(g: DataFrame) -> DataFrame:
    is_lat = above_sigma("lateral_score", SIGMA)
    return g.withColumns({
        "is_lateral_movement": is_lat.cast("int"),
        "is_high_risk": (is_lat & ((F.col("is_port_scan") == 1) | (F.col("is_host_scan") == 1))).cast("int"),
    }).select(*LATERAL_COLUMNS)


def scored(groups: DataFrame, max_dsts, max_ports, mean, std) -> DataFrame:
    """Scores and flags under given maxima, mean and deviation (None: none yet)."""
    one = groups.sparkSession.createDataFrame([(max_dsts, max_ports, mean, std)],
                                              "_max_ud long, _max_up long, _mean double, _std double")
    return _flagged(_with_score(groups.crossJoin(F.broadcast(one))))


def score_lateral(groups: DataFrame) -> DataFrame:
    """Scores and flags over the output of :func:`agg_lateral` (all groups)."""
    g = _with_score(with_scalars(groups, F.max("unique_dsts").alias("_max_ud"), F.max("unique_ports").alias("_max_up")))
    return _flagged(with_scalars(g, *moments("lateral_score")))


def detect_lateral(df: DataFrame, materialize_groups: bool = True, exact: bool = True) -> DataFrame:
    """All (source, window) groups with scores; flag ``is_lateral_movement``.

    With ``materialize_groups`` the groups are written once (an eager job for
    each portion of them), so a flow is aggregated once; maxima, mean and
    deviation are observed by these jobs, and the frame returned is one scan of
    the groups. Pass False for a fully lazy plan, which reads the input for each
    of them.
    """
    if not materialize_groups or df.isStreaming:
        return score_lateral(agg_lateral(df, exact=exact))
    found = Gathered(SCORE)
    parts = group_portions(df, LATERAL_WINDOW_S)
    stored = materialize_parts(found.watched(with_flags(agg_lateral(p, exact=exact)) for p in parts), "lateral-groups")
    m = found.moments
    maxima = m["maxima"][:2] if m["n"] else (None, None)
    return scored(stored, *maxima, *mean_and_std(SCORE, m))
