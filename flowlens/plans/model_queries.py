"""Registered queries of the isolation forest and of the reports on scored flows.

A trained forest's random draws cannot equal an SQL engine's, so
``iforest_train`` and ``iforest_score`` have no oracle SQL (pytest checks
their statistical properties); a literal forest and all report operators do.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.common import drop_stored, materialize, release_shuffles
from flowlens.operators.features import default_protocol, extract_features, join_fanout, row_features, select_features
from flowlens.operators.forest import (EULER_GAMMA, NODE_SCHEMA, ForestModel, iforest_score, iforest_train,
                                       kept_input, risk_band, score_summary)
from flowlens.operators.summary import RECOMMENDATIONS, attack_summary, recommendations
from flowlens.operators.topk import topk_anomalies
from flowlens.plans import oracle_sql as O
from flowlens.plans import sinks
from flowlens.plans.catalog import hashable, out_path
from flowlens.sources.fixtures import flows_from_lineitem

_MODELS: dict[str, ForestModel] = {}


def _features(spark: SparkSession, sf: str, stored_fanout: bool = False) -> DataFrame:
    return extract_features(flows_from_lineitem(spark, sf), stored_fanout)


def _scored_model(spark: SparkSession, sf: str) -> ForestModel:
    """Trained on stored flows, with their scores kept. Of the features the
    fan-out alone is stored, the others follow from a flow's own columns; the
    flows stored with their scores take the place of those without."""
    flows = materialize(join_fanout(default_protocol(flows_from_lineitem(spark, sf)), stored=True), "features")

    def with_features(stored: DataFrame) -> DataFrame:
        out = row_features(stored)
        last = [c for c in ("unique_destinations", "anomaly_score") if c in stored.columns]
        return out.select(*(c for c in out.columns if c not in last), *last)

    def keep(scored: DataFrame) -> DataFrame:
        release_shuffles(spark)
        stored = materialize(scored.select(*flows.columns, "anomaly_score"), "train-scored")
        out = with_features(stored)
        out.stored_path = stored.stored_path
        return out

    f = with_features(flows)
    model = iforest_train(f, select_features(f), materialize_input=False, keep_scores=keep)
    scored = model.kept[1]
    model.kept = (scored.drop("anomaly_score"), scored)
    drop_stored(flows)
    return model


def _model(spark: SparkSession, sf: str, keep_scores: bool = False) -> ForestModel:
    """Train once per input directory and process (training is deterministic).
    ``keep_scores``: with the scores kept for :func:`_scored`."""
    if sf not in _MODELS:
        if keep_scores:
            _MODELS[sf] = _scored_model(spark, sf)
        else:
            f = _features(spark, sf, stored_fanout=True)
            _MODELS[sf] = iforest_train(f, select_features(f))
    return _MODELS[sf]


def _trained_on(spark: SparkSession, sf: str) -> DataFrame:
    """The features the model keeps the scores of, or else the features anew."""
    kept = kept_input(_model(spark, sf, keep_scores=True), spark)
    return _features(spark, sf, stored_fanout=True) if kept is None else kept


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    f = _trained_on(spark, sf)
    return iforest_score(_model(spark, sf), f)


def q_iforest_train(spark, sf):
    _MODELS.pop(sf, None)   # always a fresh fit
    return spark.createDataFrame(_model(spark, sf).nodes, NODE_SCHEMA)


def q_iforest_score(spark, sf):
    return hashable(_scored(spark, sf))


# The report operators take any scored table. Their rows score the flows by an
# expression of their columns, so their results can be stated in SQL.
SCORE_SQL = "CAST(-((src_port * 13 + bytes) % 997) AS DOUBLE) / 997"
ANOMALY_SQL = "CASE WHEN score_of < -0.95 THEN 1 ELSE 0 END"


def _reported(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).withColumn("anomaly_score", F.expr(SCORE_SQL)) \
        .withColumn("is_anomaly", F.expr(ANOMALY_SQL.replace("score_of", "anomaly_score")))


def q_flt_anomaly(spark, sf):
    """The written anomalies: the sink holds the filter."""
    return hashable(spark.read.parquet(sinks.sink_anomalies(_reported(spark, sf), out_path(spark, "anomalies"), "parquet")))


def q_topk_anomalies(spark, sf):
    return hashable(topk_anomalies(_reported(spark, sf), 10))


def q_risk_band(spark, sf):
    s = _reported(spark, sf)
    return s.groupBy(risk_band().alias("risk_band")).agg(F.count(F.lit(1)).alias("flows"))


def q_score_summary(spark, sf):
    return hashable(score_summary(_reported(spark, sf)))


def _summary(spark, sf):
    from flowlens.plans.concurrent import run_detectors
    s = _reported(spark, sf)
    # lateral and exfil are scans of their stored groups; the findings are aggregates of several tables
    lateral, exfil, findings = run_detectors(_features(spark, sf))
    return attack_summary(s, lateral, exfil, materialize(findings, "findings"))


def flat_summary(summary: DataFrame) -> DataFrame:
    """The summary's nested columns as plain ones."""
    flat = summary.drop("timestamp")
    nested = {"threats": "threat", "risk_levels": "risk", "ics_severity": "severity"}
    cols = []
    for f in flat.schema.fields:
        if f.name in nested:
            cols += [F.col(f"{f.name}.{x.name}").alias(f"{nested[f.name]}_{x.name}") for x in f.dataType.fields]
        elif f.name == "protocols":
            cols.append(F.transform("protocols", lambda p: F.concat(p["protocol"], F.lit("="), p["count"])).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return hashable(flat.select(*cols))


def q_attack_summary(spark, sf):
    return flat_summary(_summary(spark, sf))


def q_recommendations(spark, sf):
    return recommendations(_summary(spark, sf))


def _literal_forest() -> ForestModel:
    """Two trees over (bytes, dst_port), for a score that SQL can state."""
    rows = [(0, 0, 0, 0.25, 1, 2, 0, 8), (0, 1, -1, 0.0, -1, -1, 1, 6), (0, 2, 1, -0.5, 3, 4, 1, 2),
            (0, 3, -1, 0.0, -1, -1, 2, 1), (0, 4, -1, 0.0, -1, -1, 2, 1),
            (1, 0, 1, 0.125, 1, 2, 0, 8), (1, 1, -1, 0.0, -1, -1, 1, 5), (1, 2, -1, 0.0, -1, -1, 1, 3)]
    nodes = pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])
    return ForestModel(["bytes", "dst_port"], [30000.0, 5000.0], [20000.0, 10000.0], 8, 2, 0, 0.05, -0.6, 8, nodes)


def q_iforest_score_literal(spark, sf):
    return hashable(iforest_score(_literal_forest(), flows_from_lineitem(spark, sf))
                    .select("src_ip", "dst_port", "bytes", "anomaly_score", "is_anomaly"))


def _literal_forest_sql() -> str:
    c = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER_GAMMA) - 2 * (n - 1) / n
    return f"""WITH {O.FLOWS_CTE}, z AS (SELECT *, (bytes - 30000.0::DOUBLE) / 20000 AS z0,
        (dst_port - 5000.0::DOUBLE) / 10000 AS z1 FROM flows),
      h AS (SELECT *, ((CASE WHEN z0 <= 0.25 THEN {1 + c(6)}::DOUBLE ELSE 2.0::DOUBLE END)
        + (CASE WHEN z1 <= 0.125 THEN {1 + c(5)}::DOUBLE ELSE {1 + c(3)}::DOUBLE END)) / 2 AS depth FROM z),
      s AS (SELECT *, -pow(2.0::DOUBLE, -depth / {c(8)}::DOUBLE) AS score FROM h)
      SELECT src_ip, dst_port, bytes, round(score, 6) AS anomaly_score,
        CASE WHEN score < -0.6 THEN 1 ELSE 0 END AS is_anomaly FROM s"""


_SCORED = f"""scored AS (SELECT *, {ANOMALY_SQL.replace("score_of", "anomaly_score")} AS is_anomaly
  FROM (SELECT *, {SCORE_SQL} AS anomaly_score FROM features) f)"""
_COUNTS = f"""{O.ALL_CTE}, {_SCORED},
n AS (SELECT count(*) AS total_flows, CAST(sum(is_anomaly) AS BIGINT) AS total_anomalies,
  count(DISTINCT src_ip) AS unique_sources, count(DISTINCT dst_ip) AS unique_destinations,
  CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(is_ics_protocol) AS BIGINT) AS ics_flows,
  count(*) FILTER (anomaly_score < -0.5) AS risk_high,
  count(*) FILTER (anomaly_score >= -0.5 AND anomaly_score < -0.3) AS risk_medium,
  count(*) FILTER (anomaly_score >= -0.3) AS risk_low FROM scored),
c AS (SELECT *, total_anomalies * 100.0::DOUBLE / total_flows AS rate,
  (SELECT CAST(COALESCE(sum(is_lateral_movement), 0) AS BIGINT) FROM lat_out) AS lateral_movement,
  (SELECT CAST(COALESCE(sum(is_high_risk), 0) AS BIGINT) FROM lat_out) AS lateral_high_risk,
  (SELECT CAST(COALESCE(sum(is_exfiltration), 0) AS BIGINT) FROM exfil) AS data_exfiltration,
  (SELECT CAST(COALESCE(sum(is_high_risk), 0) AS BIGINT) FROM exfil) AS exfil_high_risk,
  (SELECT count(*) FROM findings) AS ics_anomalies,
  (SELECT count(*) FROM findings WHERE severity = 'critical') AS critical_findings,
  (SELECT count(*) FROM findings WHERE severity = 'high') AS high_findings,
  (SELECT count(*) FROM findings WHERE severity = 'medium') AS medium_findings,
  (SELECT CAST(COALESCE(sum(o.bytes), 0) AS BIGINT) FROM outbound o JOIN exfil e ON e.is_exfiltration = 1
     AND e.src_ip = o.src_ip AND e.time_window = {O.bucket(600).replace("timestamp", "o.timestamp")}) AS bytes_at_risk,
  (SELECT string_agg(protocol || '=' || k, ',' ORDER BY k DESC, protocol) FROM
     (SELECT protocol, count(*) AS k FROM features WHERE protocol IS NOT NULL GROUP BY protocol)) AS protocols
  FROM n)"""
_FEATURE_COLUMNS = O.FEATURE_OUT + ", round(anomaly_score, 6) AS anomaly_score, is_anomaly"
_TRIGGERS = {"lateral_movement": "lateral_movement", "data_exfiltration": "data_exfiltration",
             "ics_anomalies": "ics_anomalies", "high_risk": "risk_high"}


def _recommendations_sql() -> str:
    rows = []
    for no, trigger, text in RECOMMENDATIONS:
        keep = f"{_TRIGGERS[trigger]} > 0" if trigger in _TRIGGERS else \
            " AND ".join(f"{c} = 0" for c in _TRIGGERS.values())
        shown = "replace('" + text + "', '%d', CAST(risk_high AS VARCHAR))" if "%d" in text else f"'{text}'"
        rows.append(f"SELECT {no} AS line_no, '{trigger}' AS trigger, {shown} AS text FROM c WHERE {keep}")
    return f"WITH {_COUNTS} " + " UNION ALL ".join(rows)


MODEL_ORACLE = {
    "flt_anomaly": f"WITH {O.FEATURES_CTE}, {_SCORED} SELECT {_FEATURE_COLUMNS} FROM scored WHERE is_anomaly = 1",
    "topk_anomalies": f"""WITH {O.FEATURES_CTE}, {_SCORED} SELECT epoch(timestamp)::BIGINT AS timestamp, src_ip, dst_ip,
        dst_port, bytes, round(anomaly_score, 6) AS anomaly_score FROM scored WHERE is_anomaly = 1
        ORDER BY scored.anomaly_score, scored.timestamp NULLS LAST, src_ip, dst_ip, dst_port, bytes LIMIT 10""",
    "risk_band": f"""WITH {O.FEATURES_CTE}, {_SCORED} SELECT CASE WHEN anomaly_score < -0.5 THEN 'high'
        WHEN anomaly_score < -0.3 THEN 'medium' ELSE 'low' END AS risk_band, count(*) AS flows FROM scored GROUP BY 1""",
    "score_summary": f"""WITH {O.FEATURES_CTE}, {_SCORED} SELECT count(*) AS total_flows,
        CAST(sum(is_anomaly) AS BIGINT) AS total_anomalies,
        round(sum(is_anomaly) * 100.0::DOUBLE / count(*), 6) AS anomaly_rate FROM scored""",
    "attack_summary": f"""WITH {_COUNTS} SELECT total_flows, total_anomalies, round(rate, 6) AS anomaly_rate,
        CASE WHEN rate < 5 THEN 'low' WHEN rate > 20 THEN 'high' ELSE 'normal' END AS rate_band,
        total_flows < 100 AS small_input, lateral_movement AS threat_lateral_movement,
        data_exfiltration AS threat_data_exfiltration, ics_anomalies AS threat_ics_anomalies, risk_high, risk_medium,
        risk_low, critical_findings AS severity_critical, high_findings AS severity_high,
        medium_findings AS severity_medium, unique_sources, unique_destinations, total_bytes, ics_flows,
        lateral_high_risk, exfil_high_risk, bytes_at_risk, protocols FROM c""",
    "recommendations": _recommendations_sql(),
    "iforest_score_literal": _literal_forest_sql(),
}


MODEL_QUERIES = {
    "iforest_train": q_iforest_train,
    "iforest_score": q_iforest_score,
    "iforest_score_literal": q_iforest_score_literal,
    "flt_anomaly": q_flt_anomaly,
    "topk_anomalies": q_topk_anomalies,
    "risk_band": q_risk_band,
    "score_summary": q_score_summary,
    "attack_summary": q_attack_summary,
    "recommendations": q_recommendations,
}
