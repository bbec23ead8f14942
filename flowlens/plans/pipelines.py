"""End-to-end jobs: train, detect, and capture analysis.

Scoring runs once, inside the job that writes the flagged flows; the counts
the summary needs from the scores are observed by that job. Detector
outputs are small and written once to the shared checkpoint folder
(``spark.checkpoint.dir``) before the sinks and the summary read them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession

from flowlens.operators.common import Scratch
from flowlens.operators.common import materialize as _materialize
from flowlens.operators.exfil import detect_exfil
from flowlens.operators.features import preprocess, select_features
from flowlens.operators.forest import (iforest_score, iforest_train, model_load, model_save,
                                       train_or_load)
from flowlens.operators.ics import detect_ics_with_devices, flt_critical
from flowlens.operators.lateral import detect_lateral
from flowlens.operators.stats import stats
from flowlens.operators.summary import attack_summary, protocol_counts, recommendations, score_counts, topk_destinations
from flowlens.operators.topk import head_findings, report_exfil, report_lateral, topk_anomalies
from flowlens.plans import sinks
from flowlens.plans.concurrent import run_concurrently
from flowlens.schema import DEFAULT_CONTAMINATION
from flowlens.sources.packets import read_capture_flows
from flowlens.sources.rejects import load_checked


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back."""
    return _materialize(df, name)


def train_pipeline(spark: SparkSession, data_path: str, model_path: str,
                   contamination: float = DEFAULT_CONTAMINATION, fmt: str | None = None,
                   features: list | None = None, unit: str = "auto") -> dict:
    """Load, preprocess, statistics, train on the fixed feature list, save
    model and ``training_metadata`` next to it. ``unit`` names the epoch unit
    of numeric timestamps (``auto`` looks for the column's maximum first)."""
    with Scratch(spark):
        flows, rejects, report = load_checked(spark, data_path, fmt)
        data = preprocess(flows, unit=unit)
        feats = features or select_features(data)
        model = iforest_train(data, feats, contamination=contamination)
        model_save(model, spark, model_path)
        st = stats(data)
        beside = os.path.dirname(model_path.rstrip("/")) or "."
        meta_path = os.path.join(beside, "training_metadata")
        sinks.sink_train_metadata(spark, meta_path, model.n_train, feats, contamination, st, report)
        out = {"model": model_path, "metadata": meta_path, "features": feats}
        if rejects is not None:
            out["rejects"] = sinks.sink_rejects(rejects, os.path.join(beside, "rejected_rows"))
    return out


def analyze(spark: SparkSession, features: DataFrame, model, out_dir: str, detailed: bool = True,
            assets: DataFrame | None = None, fmt: str = "csv", keep_intermediate: bool = False,
            anomalies_name: str = "anomalies_detected", report: dict | None = None) -> dict:
    """Score and detect (see :func:`_analyze`); intermediate tables written
    under the checkpoint folder are deleted afterwards unless
    ``keep_intermediate``."""
    with Scratch(spark, keep_intermediate):
        return _analyze(spark, features, model, out_dir, detailed, assets, fmt, anomalies_name, report)


def _analyze(spark: SparkSession, features: DataFrame, model, out_dir: str, detailed: bool,
             assets: DataFrame | None, fmt: str, anomalies_name: str, report: dict | None) -> dict:
    """Score, write anomalies; with ``detailed`` run the three detectors and
    write their tables, the summary JSON and the recommendations.

    The forest runs once, in the job that writes the flagged rows; the
    score-band counts of all rows are gathered by the same job
    (``DataFrame.observe``), so the full scored table is never stored. The
    detectors do not need scores and read the input with their own column
    pruning; their (small) outputs are written once and shared by the sinks
    and the summary. ``report``: the counts of rejected rows and unread
    values for the summary's ``input``.
    """
    obs = Observation("flowlens-score-counts")
    scored = iforest_score(model, features).observe(obs, *score_counts())
    anomalies_path = os.path.join(out_dir, anomalies_name)

    def write_anomalies():
        return sinks.sink_anomalies(scored, anomalies_path, fmt)

    def ics_tables():
        findings, devices = detect_ics_with_devices(features, assets)
        return materialize(spark, findings, "findings"), devices

    if detailed:
        # scoring write and the three detectors are independent jobs
        written, lateral, exfil, (findings, devices) = run_concurrently(
            write_anomalies,
            lambda: materialize(spark, detect_lateral(features), "lateral"),
            lambda: materialize(spark, detect_exfil(features), "exfil"),
            ics_tables)
    else:
        written = write_anomalies()
    out = {"anomalies": written}
    counts = obs.get
    out["score_counts"] = counts
    # the top 10 come from the written flagged rows (a few percent), not a re-score
    flagged = sinks.read_table(spark, anomalies_path, fmt, scored.schema)
    out["top_anomalies"] = sinks.write_table(topk_anomalies(flagged), os.path.join(out_dir, "top_anomalies"), fmt)
    if detailed:
        tables = {
            "lateral": lambda: sinks.sink_lateral(lateral, os.path.join(out_dir, "lateral_movement"), fmt),
            "exfil": lambda: sinks.sink_exfil(exfil, os.path.join(out_dir, "data_exfiltration"), fmt),
            "ics": lambda: sinks.sink_ics(findings, os.path.join(out_dir, "ics_anomalies"), fmt),
            "top_lateral": lambda: sinks.write_table(report_lateral(lateral),
                                                     os.path.join(out_dir, "top_lateral"), fmt),
            "top_exfil": lambda: sinks.write_table(report_exfil(exfil), os.path.join(out_dir, "top_exfil"), fmt),
            "protocols": lambda: sinks.write_table(protocol_counts(features), os.path.join(out_dir, "protocols"), fmt),
            "top_destinations": lambda: sinks.write_table(topk_destinations(features, exfil),
                                                          os.path.join(out_dir, "top_destinations"), fmt),
            "first_findings": lambda: sinks.write_table(head_findings(findings),
                                                        os.path.join(out_dir, "first_findings"), fmt),
            "high_diversity_devices": lambda: sinks.write_table(
                devices, os.path.join(out_dir, "high_diversity_devices"), fmt),
            "critical_findings": lambda: sinks.write_table(flt_critical(findings),
                                                           os.path.join(out_dir, "critical_findings"), fmt),
        }
        out.update(zip(tables, run_concurrently(*tables.values())))
        summary = attack_summary(features, lateral, exfil, findings, counts)
        if report:
            summary = summary.withColumn("input", sinks.load_counts(report))
        summary = materialize(spark, summary, "summary")
        out["summary"] = sinks.sink_json_summary(summary, os.path.join(out_dir, "attack_summary"))
        out["recommendations"] = sinks.write_table(recommendations(summary),
                                                   os.path.join(out_dir, "recommendations"), fmt)
    return out


def detect_pipeline(spark: SparkSession, data_path: str, model_path: str, out_dir: str,
                    detailed: bool = True, fmt: str | None = None,
                    assets: DataFrame | None = None, unit: str = "auto") -> dict:
    """Load, preprocess, score with the saved model, detectors, sinks, summary."""
    with Scratch(spark):
        flows, rejects, report = load_checked(spark, data_path, fmt)
        model = model_load(spark, model_path)
        out = analyze(spark, preprocess(flows, unit=unit), model, out_dir, detailed, assets, report=report)
        if rejects is not None:
            out["rejects"] = sinks.sink_rejects(rejects, os.path.join(out_dir, "rejected_rows"))
        return out


def packet_pipeline(spark: SparkSession, capture_dir: str, model_path: str, out_dir: str,
                    detailed: bool = True) -> dict:
    """Captures to flows, then as :func:`detect_pipeline`; trains (automatic
    features) and saves a model first when none exists at ``model_path``."""
    with Scratch(spark):
        flows = materialize(spark, read_capture_flows(spark, capture_dir), "capture-flows")
        features = preprocess(flows)
        model = train_or_load(spark, model_path, features)
        return analyze(spark, features, model, out_dir, detailed, anomalies_name="general_anomalies")


def convert_pipeline(spark: SparkSession, input_path: str, output_path: str) -> dict:
    """Packet-list CSV export to the flow schema, written as CSV, with the
    converter's summary (distinct sources / destinations / protocols, bytes)."""
    from flowlens.sources.packet_list import convert_packet_list, converted_summary, read_packet_list
    with Scratch(spark):
        converted = convert_packet_list(read_packet_list(spark, input_path))
        sinks.sink_converted(converted, output_path)
    written = spark.read.option("header", True).option("inferSchema", True).csv(output_path)
    return {"output": output_path, "summary": converted_summary(written).first().asDict()}
