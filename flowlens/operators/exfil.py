"""Data exfiltration: outbound volume per (source, 10-minute window)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.arith import BYTES_PER_MB, flag, rate
from flowlens.functions.ip import is_private_ip
from flowlens.functions.timefns import dt_hour, dt_weekday
from flowlens.operators.common import (above_sigma, add_time_window, distinct_count, group_portions, materialize_parts,
                                      moments, weighted_sum, with_scalars)
from flowlens.operators.features import has_timestamp, night_flag, weekend_flag
from flowlens.operators.score_moments import Gathered, mean_and_std, weights
from flowlens.schema import EXFIL_COLUMNS, EXFIL_WINDOW_S, SUSPICIOUS_PROTOCOLS

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's). Limits are strict (more than).
LARGE_TRANSFER_MB = 10
MULTI_DESTINATIONS = 3
HIGH_BANDWIDTH_BPS = 1_000_000
# exfil_score = sum of column x weight, in this order
SCORE_WEIGHTS = [("mb_transferred", 3.0), ("unique_external_dsts", 2.0), ("is_large_transfer", 4.0),
                 ("is_multiple_destinations", 3.0), ("is_high_bandwidth", 2.0), ("is_unusual_time", 2.0),
                 ("is_suspicious_protocol", 1.5)]
SIGMA = 2.0
SCORE = weights(SCORE_WEIGHTS, units={"mb_transferred": ("bytes_out", BYTES_PER_MB)})
# ---------------------------------------------------------------------------


def flt_outbound() -> Column:
    """Internal source and non-internal destination."""
    return is_private_ip("src_ip") & ~is_private_ip("dst_ip")


def flt_suspicious_protocol() -> Column:
    """Protocol name in the suspicious list (exact, case-sensitive)."""
    return F.coalesce(F.col("protocol").isin(SUSPICIOUS_PROTOCOLS), F.lit(False))


def agg_exfil(df: DataFrame, width_s: int = EXFIL_WINDOW_S, exact: bool = True) -> DataFrame:
    """One fused group-by on outbound flows: volume, fan-out, duration,
    night / weekend presence and suspicious-protocol count per
    (src_ip, window). Replaces three group-bys and two merges."""
    t = has_timestamp(df)
    cols = (["timestamp"] if t else []) + ["src_ip", "dst_ip", "dst_port", "protocol",
                                           "bytes", "packets", "duration"]
    if "protocol" not in df.columns:
        df = df.withColumn("protocol", F.lit("TCP"))
    out = add_time_window(df.select(*cols).where(flt_outbound()), width_s)
    timing = ([F.max(night_flag(dt_hour("timestamp"))).alias("is_night"),
               F.max(weekend_flag(dt_weekday("timestamp"))).alias("is_weekend")] if t else
              [F.lit(0).alias("is_night"), F.lit(0).alias("is_weekend")])
    return (out.where(F.col("src_ip").isNotNull() & F.col("time_window").isNotNull())
               .groupBy("src_ip", "time_window")
               .agg(F.sum("bytes").cast("long").alias("bytes_out"),
                    F.sum("packets").cast("long").alias("packets_out"),
                    distinct_count("dst_ip", exact).alias("unique_external_dsts"),
                    distinct_count("dst_port", exact).alias("unique_ports"),
                    F.sum("duration").alias("total_duration"),
                    *timing,
                    F.count_if(flt_suspicious_protocol()).cast("long").alias("suspicious_protocol_count")))


def with_flags(groups: DataFrame) -> DataFrame:
    """Groups with volume, rates and flags."""
    g = groups.withColumns({
        "mb_transferred": F.col("bytes_out") / F.lit(float(BYTES_PER_MB)),
        "transfer_rate": rate("bytes_out", "total_duration"),
        "packet_rate": rate("packets_out", "total_duration"),
    })
    return g.withColumns({
        "is_large_transfer": flag(F.col("mb_transferred") > LARGE_TRANSFER_MB),
        "is_multiple_destinations": flag(F.col("unique_external_dsts") > MULTI_DESTINATIONS),
        "is_high_bandwidth": flag(F.col("transfer_rate") > HIGH_BANDWIDTH_BPS),
        "is_unusual_time": flag((F.col("is_night") == 1) | (F.col("is_weekend") == 1)),
        "is_suspicious_protocol": flag(F.col("suspicious_protocol_count") > 0),
    })


def _with_score(groups: DataFrame) -> DataFrame:
    return with_flags(groups).withColumn("exfil_score", weighted_sum(SCORE_WEIGHTS))


def _flagged(g: DataFrame) -> DataFrame:
    is_ex = above_sigma("exfil_score", SIGMA)
    return g.withColumns({
        "is_exfiltration": is_ex.cast("int"),
        "is_high_risk": (is_ex & ((F.col("is_large_transfer") == 1)
                                  | (F.col("is_unusual_time") == 1))).cast("int"),
    }).select(*EXFIL_COLUMNS)


def scored(groups: DataFrame, max_first, max_second, mean, std) -> DataFrame:
    """Scores and flags under given mean and deviation (None: none yet); the
    maxima, which other detectors need, don't matter here."""
    one = groups.sparkSession.createDataFrame([(mean, std)], "_mean double, _std double")
    return _flagged(_with_score(groups.crossJoin(F.broadcast(one))))


def score_exfil(groups: DataFrame) -> DataFrame:
    """Scores and flags over the output of :func:`agg_exfil` (all groups)."""
    return _flagged(with_scalars(_with_score(groups), *moments("exfil_score")))


def detect_exfil(df: DataFrame, materialize_groups: bool = True, exact: bool = True) -> DataFrame:
    """All outbound (source, window) groups with scores; flag ``is_exfiltration``.
    No outbound traffic gives an empty frame with the same schema.
    ``materialize_groups``: as in :func:`flowlens.operators.lateral.detect_lateral`."""
    if not materialize_groups or df.isStreaming:
        return score_exfil(agg_exfil(df, exact=exact))
    found = Gathered(SCORE)
    parts = group_portions(df.where(flt_outbound()), EXFIL_WINDOW_S)
    stored = materialize_parts(found.watched(with_flags(agg_exfil(p, exact=exact)) for p in parts), "exfil-groups")
    return scored(stored, None, None, *mean_and_std(SCORE, found.moments))
