"""Top-k reports. Each is an ``orderBy(...).limit(k)``, planned as
``TakeOrderedAndProject``: every task keeps its own k best rows, the driver
merges ``k x tasks`` rows. Explicit tie-break columns make them deterministic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP_ANOMALIES = 10
TOP_SOURCES = 5
TOP_FINDINGS = 10
# Columns of the two top-source reports.
LATERAL_REPORT = ["src_ip", "unique_dsts", "unique_ports", "lateral_score", "is_port_scan", "is_host_scan"]
EXFIL_REPORT = ["src_ip", "mb_transferred", "unique_external_dsts", "exfil_score", "is_large_transfer",
                "is_unusual_time"]
ANOMALY_COLUMNS = ["timestamp", "src_ip", "dst_ip", "dst_port", "bytes", "anomaly_score"]


def topk_anomalies(scored: DataFrame, k: int = TOP_ANOMALIES) -> DataFrame:
    """The k lowest anomaly scores among flagged flows."""
    return (scored.where(F.col("is_anomaly") == 1)
                  .orderBy(F.col("anomaly_score").asc(), F.col("timestamp").asc_nulls_last(),
                           "src_ip", "dst_ip", "dst_port", "bytes")
                  .limit(k).select(*ANOMALY_COLUMNS))


def topk_lateral(lateral: DataFrame, k: int = TOP_SOURCES) -> DataFrame:
    """The k highest lateral scores among flagged groups."""
    return (lateral.where(F.col("is_lateral_movement") == 1)
                   .orderBy(F.col("lateral_score").desc(), "src_ip", "time_window").limit(k))


def report_lateral(lateral: DataFrame, k: int = TOP_SOURCES) -> DataFrame:
    """The report's columns of :func:`topk_lateral`."""
    return topk_lateral(lateral, k).select(*LATERAL_REPORT)


def report_exfil(exfil: DataFrame, k: int = TOP_SOURCES) -> DataFrame:
    """The report's columns of :func:`topk_exfil`."""
    return topk_exfil(exfil, k).select(*EXFIL_REPORT)


def topk_exfil(exfil: DataFrame, k: int = TOP_SOURCES) -> DataFrame:
    """The k highest exfiltration scores among flagged groups."""
    return (exfil.where(F.col("is_exfiltration") == 1)
                 .orderBy(F.col("exfil_score").desc(), "src_ip", "time_window").limit(k))


def head_findings(findings: DataFrame, k: int = TOP_FINDINGS) -> DataFrame:
    """The first k findings in rule order."""
    return findings.orderBy("rule_no").limit(k)
