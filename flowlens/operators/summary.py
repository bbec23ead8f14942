"""Threat summary (one nested row) and recommendations.

Every number is an aggregate over a distributed input; the pieces are
one-row frames joined without a key, so nothing large reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.common import add_time_window
from flowlens.operators.exfil import flt_outbound
from flowlens.operators.heavy import top_values
from flowlens.schema import EXFIL_WINDOW_S, RISK_HIGH_BELOW, RISK_MEDIUM_BELOW

LOW_RATE_PCT = 5
HIGH_RATE_PCT = 20
SMALL_INPUT_FLOWS = 100
TOP_DESTINATIONS = 3
TOP_PROTOCOLS = 10

# ---------------------------------------------------------------------------
# Recommendation lines of the reference report, in order, with
# the threat count that selects them ("none" = no other line selected).
RECOMMENDATIONS = [
    (1, "lateral_movement", "1. URGENT: Điều tra các IP thực hiện lateral movement"),
    (2, "lateral_movement", "   → Xem lại trong Wireshark, check firewall logs"),
    (3, "lateral_movement", "   → Kiểm tra compromised accounts"),
    (4, "data_exfiltration", "2. HIGH PRIORITY: Phát hiện data exfiltration"),
    (5, "data_exfiltration", "   → Block ngay các external IPs đáng ngờ"),
    (6, "data_exfiltration", "   → Review data access logs"),
    (7, "ics_anomalies", "3. CRITICAL: ICS/SCADA anomalies"),
    (8, "ics_anomalies", "   → Verify device configurations"),
    (9, "ics_anomalies", "   → Check unauthorized protocol usage"),
    (10, "high_risk", "4. Review %d high-risk anomalies được model đánh dấu"),
    (11, "none", "✅ Không phát hiện mối đe dọa nghiêm trọng."),
    (12, "none", "   → Tiếp tục monitoring thường xuyên"),
    (13, "none", "   → Cập nhật baseline model định kỳ"),
]
# ---------------------------------------------------------------------------


def agg_value_counts(df: DataFrame, col: str = "protocol") -> DataFrame:
    """Rows per non-NULL value, most frequent first."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), F.col(col).asc_nulls_last()))


def exfil_flows_at_risk(flows: DataFrame, exfil: DataFrame) -> DataFrame:
    """Outbound flows that belong to a flagged (source, 10-minute) group.

    The flagged side is a small share of groups but still grows with the
    input, so it is an ordinary equi-join (AQE broadcasts it when small).
    """
    flagged = exfil.where(F.col("is_exfiltration") == 1).select("src_ip", "time_window")
    out = add_time_window(flows.where(flt_outbound()), EXFIL_WINDOW_S)
    return out.join(flagged, ["src_ip", "time_window"], "left_semi")


def topk_destinations(flows: DataFrame, exfil: DataFrame, k: int = TOP_DESTINATIONS) -> DataFrame:
    """Most frequent external destinations among flows at risk (ties by address):
    exact, and only the destinations of full hash buckets are counted one by one
    (:mod:`flowlens.operators.heavy`)."""
    return top_values(exfil_flows_at_risk(flows, exfil), "dst_ip", k, "transfers")


def bytes_at_risk(flows: DataFrame, exfil: DataFrame) -> DataFrame:
    """Number and bytes of the flows at risk (1 row)."""
    return exfil_flows_at_risk(flows, exfil).agg(
        F.count(F.lit(1)).alias("flows_at_risk"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes_at_risk"))


def protocol_counts(flows: DataFrame) -> DataFrame:
    """Flows per protocol, a table: captures have a fixed vocabulary of them,
    text inputs any."""
    return agg_value_counts(flows, "protocol")


def top_protocols(flows: DataFrame, k: int = TOP_PROTOCOLS) -> DataFrame:
    """The ``k`` most frequent protocols as one row: array of (protocol, count),
    most frequent first, ties by name; all are in :func:`protocol_counts`."""
    first = protocol_counts(flows).orderBy(F.desc("count"), "protocol").limit(k)
    each = F.struct((-F.col("count")).alias("order"), F.col("protocol"), F.col("count"))
    return first.agg(F.transform(
        F.array_sort(F.collect_list(each)),
        lambda x: F.struct(x["protocol"].alias("protocol"), x["count"].alias("count"))).alias("protocols"))


def _one_row(*frames: DataFrame) -> DataFrame:
    """Aggregates of one row each, side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))
    return out


def _flag_sum(df: DataFrame, col: str, alias: str):
    if col in df.columns:
        return F.coalesce(F.sum(col), F.lit(0)).cast("long").alias(alias)
    return F.lit(0).cast("long").alias(alias)


def threat_counts(flows: DataFrame, lateral: DataFrame, exfil: DataFrame, findings: DataFrame,
                  more: list | tuple = ()) -> DataFrame:
    """Traffic totals and threat counts (one row, no model columns); ``more``
    aggregates of the flows are taken in the same pass."""
    traffic = flows.agg(
        *more,
        F.count(F.lit(1)).alias("total_flows"),
        F.countDistinct("src_ip").alias("unique_sources"),
        F.countDistinct("dst_ip").alias("unique_destinations"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"),
        _flag_sum(flows, "is_ics_protocol", "ics_flows"))
    lat = lateral.agg(_flag_sum(lateral, "is_lateral_movement", "lateral_movement"),
                      _flag_sum(lateral, "is_high_risk", "lateral_high_risk"))
    exf = exfil.agg(_flag_sum(exfil, "is_exfiltration", "data_exfiltration"),
                    _flag_sum(exfil, "is_high_risk", "exfil_high_risk"))
    sev = F.col("severity")
    fnd = findings.agg(F.count(F.lit(1)).alias("ics_anomalies"),
                       F.count_if(sev == "critical").cast("long").alias("critical_findings"),
                       F.count_if(sev == "high").cast("long").alias("high_findings"),
                       F.count_if(sev == "medium").cast("long").alias("medium_findings"))
    return _one_row(traffic, lat, exf, fnd)


def score_counts() -> list:
    """Model counts of a scored table: flagged flows and the three score bands."""
    s = F.col("anomaly_score")
    return [F.coalesce(F.sum("is_anomaly"), F.lit(0)).cast("long").alias("total_anomalies"),
            F.count_if(s < RISK_HIGH_BELOW).cast("long").alias("risk_high"),
            F.count_if((s >= RISK_HIGH_BELOW) & (s < RISK_MEDIUM_BELOW)).cast("long").alias("risk_medium"),
            F.count_if(s >= RISK_MEDIUM_BELOW).cast("long").alias("risk_low")]


def attack_summary(scored: DataFrame, lateral: DataFrame, exfil: DataFrame,
                   findings: DataFrame, model_counts: dict | None = None) -> DataFrame:
    """The JSON summary as one nested row: totals, anomaly rate and its band,
    threat counts, risk bands of the score, severity counts, bytes at risk,
    flows of the ten most frequent protocols.

    ``scored`` may be the unscored feature table when ``model_counts`` (the
    values of :func:`score_counts`, e.g. observed while the anomalies were
    written) is given; then the forest is not run again."""
    if model_counts is None:
        model = score_counts()
    else:
        names = ["total_anomalies", "risk_high", "risk_medium", "risk_low"]
        model = [F.lit(int(model_counts.get(k) or 0)).cast("long").alias(k) for k in names]
    base = _one_row(threat_counts(scored, lateral, exfil, findings, model), bytes_at_risk(scored, exfil),
                    top_protocols(scored))
    rate = F.coalesce(F.try_divide(F.col("total_anomalies") * 100.0, F.col("total_flows")), F.lit(0.0))
    return base.select(
        F.current_timestamp().alias("timestamp"),
        "total_flows", "total_anomalies", rate.alias("anomaly_rate"),
        F.when(rate < LOW_RATE_PCT, F.lit("low")).when(rate > HIGH_RATE_PCT, F.lit("high"))
         .otherwise(F.lit("normal")).alias("rate_band"),
        (F.col("total_flows") < SMALL_INPUT_FLOWS).alias("small_input"),
        F.struct("lateral_movement", "data_exfiltration", "ics_anomalies").alias("threats"),
        F.struct(F.col("risk_high").alias("high"), F.col("risk_medium").alias("medium"),
                 F.col("risk_low").alias("low")).alias("risk_levels"),
        F.struct(F.col("critical_findings").alias("critical"), F.col("high_findings").alias("high"),
                 F.col("medium_findings").alias("medium")).alias("ics_severity"),
        "unique_sources", "unique_destinations", "total_bytes", "ics_flows",
        "lateral_high_risk", "exfil_high_risk", "bytes_at_risk", "protocols")


def recommendations(summary: DataFrame) -> DataFrame:
    """Recommendation lines selected by the summary's counts, in order."""
    spark = summary.sparkSession
    rules = spark.createDataFrame(RECOMMENDATIONS, "line_no int, trigger string, text string")
    counts = summary.select(
        F.col("threats.lateral_movement").alias("lateral_movement"),
        F.col("threats.data_exfiltration").alias("data_exfiltration"),
        F.col("threats.ics_anomalies").alias("ics_anomalies"),
        F.col("risk_levels.high").alias("high_risk"))
    any_line = ((F.col("lateral_movement") > 0) | (F.col("data_exfiltration") > 0)
                | (F.col("ics_anomalies") > 0) | (F.col("high_risk") > 0))
    trig = F.col("trigger")
    keep = (((trig == "lateral_movement") & (F.col("lateral_movement") > 0))
            | ((trig == "data_exfiltration") & (F.col("data_exfiltration") > 0))
            | ((trig == "ics_anomalies") & (F.col("ics_anomalies") > 0))
            | ((trig == "high_risk") & (F.col("high_risk") > 0))
            | ((trig == "none") & ~any_line))
    text = F.when(trig == "high_risk", F.expr("format_string(text, high_risk)")).otherwise(F.col("text"))
    return (rules.crossJoin(F.broadcast(counts)).where(keep)
                 .select("line_no", "trigger", text.alias("text")).orderBy("line_no"))
