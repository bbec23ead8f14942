"""Industrial-protocol findings: seven rules, one FINDINGS table.

Plan shape: the ICS-port rows (the ``dst_port IN (...)`` filter reaches the
scan) are pre-aggregated once per (source, destination, port, ICS flag,
30-minute window) -- :func:`ics_base`, written once -- and every rule is a
small aggregate of that table: a per-source table for the counting rules and
the diversity rule, a per-window table for spikes, a per-port table for
usage, a per-destination top-k for the external addresses. Whole-input
scalars are one-row aggregates joined by broadcast. Every list put in a
findings row is bounded (at most the seven ICS ports, or the first ten
addresses); the unbounded list of high-diversity sources is its own table,
:func:`ics_high_diversity_devices`, which the detect pipeline writes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.arith import BYTES_PER_MB
from flowlens.functions.ip import is_private_ip
from flowlens.functions.protocol import is_ics_port
from flowlens.operators.common import (SCORE_PLACES, add_time_window, materialize, materialize_parts, portions,
                                      quantiles, with_scalars)
from flowlens.operators.features import has_timestamp, split_key
from flowlens.plans.concurrent import run_concurrently
from flowlens.schema import (FINDINGS_COLUMNS, FINDINGS_SCHEMA, ICS_VOLUME_WINDOW_S,
                             SEVERITY_SCORES)

# ---------------------------------------------------------------------------
# Rule names, severities and description texts of the findings
# (must equal the reference's), in rule order.
RULES = [
    (1, "unusual_time", "medium", "%d ICS connections during night hours"),
    (2, "weekend_activity", "medium", "%d ICS connections during weekend"),
    (3, "high_diversity", "high", "%d ICS devices with unusually high connection diversity"),
    (4, "external_communication", "critical", "%d ICS connections to external IPs"),
    (5, "traffic_spike", "high", "%d time windows with unusual ICS traffic volume"),
    (6, "unauthorized_access", "critical", "%d non-ICS devices accessing ICS ports"),
    (7, "unusual_protocol_usage", "medium", "%d ICS protocols showing unusual usage patterns"),
]
DIVERSITY_SIGMA = 2.0
SPIKE_SIGMA = 3.0
USAGE_QUANTILE = 0.9
EXTERNAL_IPS_SHOWN = 10
# ---------------------------------------------------------------------------
_RULE = {r[1]: r for r in RULES}


def empty_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDINGS_SCHEMA)


def risk_score(severity: Column) -> Column:
    expr = None
    for name, score in SEVERITY_SCORES.items():
        expr = F.when(severity == name, F.lit(score)) if expr is None else expr.when(severity == name, F.lit(score))
    return expr.cast("int")


def _finding(rule: str, count: Column, **fields: Column) -> Column:
    """One FINDINGS row as a struct over a one-row aggregate."""
    no, typ, severity, text = _RULE[rule]
    cols = {
        "rule_no": F.lit(no),
        "type": F.lit(typ),
        "severity": F.lit(severity),
        "count": count.cast("long"),
        "description": F.format_string(text, count.cast("long")),
        "risk_score": risk_score(F.lit(severity)),
    }
    cols.update(fields)
    return F.struct(*[(cols[f.name] if f.name in cols else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in FINDINGS_SCHEMA.fields])


def _rows(one_row: DataFrame, *found: Column) -> DataFrame:
    """The findings of a one-row aggregate whose count is positive."""
    return one_row.select(F.inline(F.filter(F.array(*found), lambda f: f["count"] > 0)))


# --- predicates --------------------------------------------------------------

def flt_ics() -> Column:
    return F.col("is_ics_protocol") == 1


def flt_external_ics() -> Column:
    return flt_ics() & ~is_private_ip("dst_ip")


def flt_night_ics() -> Column:
    return flt_ics() & (F.col("is_night") == 1)


def flt_weekend_ics() -> Column:
    return flt_ics() & (F.col("is_weekend") == 1)


def flt_unauthorized() -> Column:
    """Literal rule: ICS port reached by a flow not flagged as ICS. With
    ``is_ics_protocol`` derived from the port this cannot fire; it does when
    a caller supplies the flag. See ``assets=`` for the inventory form."""
    return (F.col("is_ics_protocol") == 0) & is_ics_port("dst_port")


def flt_critical(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity") == "critical")


# --- aggregates ----------------------------------------------------------------

def _candidates(df: DataFrame) -> DataFrame:
    """Rows any rule looks at: ICS flows, or flows to an ICS port."""
    return df.where(flt_ics() | is_ics_port("dst_port"))


def ics_base(df: DataFrame, width_s: int = ICS_VOLUME_WINDOW_S) -> DataFrame:
    """Compact pre-aggregate of the ICS candidate rows, one row per
    (src_ip, dst_ip, dst_port, ICS flag, 30-minute window): flow, night and
    weekend counts, byte and packet sums, first time seen.

    Every rule is an aggregate of this table (distinct counts over it equal
    those over the flows), so the flows are scanned once. Repeated polling
    between the same endpoints collapses here, and partial aggregation
    absorbs a hot source before the shuffle.
    """
    c = add_time_window(_candidates(df), width_s)
    t = has_timestamp(df)
    night = (F.count_if(F.col("is_night") == 1) if "is_night" in df.columns else F.lit(0).cast("long"))
    weekend = (F.count_if(F.col("is_weekend") == 1) if "is_weekend" in df.columns else F.lit(0).cast("long"))
    return (c.groupBy("src_ip", "dst_ip", F.col("dst_port").cast("long").alias("dst_port"),
                      F.col("is_ics_protocol").cast("int").alias("_ics"), "time_window")
             .agg(F.count(F.lit(1)).alias("_n"),
                  night.alias("_n_night"),
                  weekend.alias("_n_weekend"),
                  F.sum("bytes").cast("long").alias("_bytes"),
                  F.sum("packets").cast("long").alias("_packets"),
                  (F.min("timestamp") if t else F.lit(None).cast("timestamp")).alias("_first")))


def _is_ics() -> Column:
    return F.col("_ics") == 1


def _per_source(base: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """One row per source: rule counts, distinct ICS destinations / ports,
    ICS bytes, unauthorized ports."""
    if assets is not None:
        known = assets.select(F.col("ip").alias("src_ip")).distinct() \
            .withColumn("_split", split_key("src_ip")).withColumn("_asset", F.lit(True))
        base = base.withColumn("_split", split_key("src_ip")).join(known, ["src_ip", "_split"], "left")
        unauth = is_ics_port("dst_port") & F.col("_asset").isNull()
    else:
        unauth = (F.col("_ics") == 0) & is_ics_port("dst_port")
    ics = _is_ics()
    n = F.col("_n")

    def total(cond, col=n):
        return F.coalesce(F.sum(F.when(cond, col)), F.lit(0)).cast("long")

    return base.groupBy("src_ip").agg(
        total(ics).alias("n_ics"),
        total(ics, F.col("_n_night")).alias("n_night"),
        total(ics, F.col("_n_weekend")).alias("n_weekend"),
        total(ics & ~is_private_ip("dst_ip")).alias("n_external"),
        total(unauth).alias("n_unauth"),
        F.array_sort(F.collect_set(F.when(unauth, F.col("dst_port")))).alias("unauth_ports"),
        F.countDistinct(F.when(ics, F.col("dst_ip"))).alias("unique_dsts"),
        F.countDistinct(F.when(ics, F.col("dst_port"))).alias("unique_ports"),
        F.sum(F.when(ics, F.col("_bytes"))).cast("long").alias("total_bytes"),
    )


def ics_per_source(df: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    return _per_source(ics_base(df), assets)


def _diversity(per_src: DataFrame) -> DataFrame:
    return (per_src.where((F.col("n_ics") > 0) & F.col("src_ip").isNotNull())
            .select("src_ip", "unique_dsts", "unique_ports", "total_bytes"))


def agg_ics_diversity(df: DataFrame) -> DataFrame:
    """Per ICS source: distinct destinations, distinct ports, total bytes."""
    return _diversity(ics_per_source(df))


def _high_diversity(per_src: DataFrame) -> DataFrame:
    d = with_scalars(_diversity(per_src), F.avg("unique_dsts").alias("_m"),
                     F.stddev_samp("unique_dsts").alias("_s"))
    thr = F.round(F.col("_m") + DIVERSITY_SIGMA * F.col("_s"), SCORE_PLACES)
    return d.where(F.coalesce(F.col("unique_dsts") > thr, F.lit(False))).drop("_m", "_s")


def ics_high_diversity_devices(df: DataFrame) -> DataFrame:
    """ICS sources whose distinct destinations exceed mean + 2 sigma (full list)."""
    return _high_diversity(ics_per_source(df))


def _source_totals(per_src: DataFrame) -> DataFrame:
    """Collapse the per-source table to the rule counts (one row)."""
    known = F.col("src_ip").isNotNull()
    return per_src.agg(
        F.sum("n_ics").alias("n_ics"),
        F.sum("n_night").alias("n_night"),
        F.count_if((F.col("n_night") > 0) & known).alias("d_night"),
        F.sum("n_weekend").alias("n_weekend"),
        F.count_if((F.col("n_weekend") > 0) & known).alias("d_weekend"),
        F.sum("n_external").alias("n_external"),
        F.count_if((F.col("n_external") > 0) & known).alias("d_external"),
        F.sum("n_unauth").alias("n_unauth"),
        F.count_if((F.col("n_unauth") > 0) & known).alias("d_unauth"),
        # each source's list is a sorted subset of the seven ICS ports, so the
        # set of distinct lists is bounded (at most 2^7) whatever the sources
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("unauth_ports")))).alias("unauth_ports"),
    )


def _external_first_seen(base: DataFrame, k: int) -> DataFrame:
    return (base.where(_is_ics() & ~is_private_ip("dst_ip"))
                .groupBy("dst_ip").agg(F.min("_first").alias("first_seen"))
                .orderBy(F.col("first_seen").asc_nulls_last(), F.col("dst_ip").asc_nulls_last())
                .limit(k))


def external_ips_first_seen(df: DataFrame, k: int = EXTERNAL_IPS_SHOWN) -> DataFrame:
    """First ``k`` distinct external destinations of ICS flows by first
    appearance in time (ties by address); a bounded top-k."""
    return _external_first_seen(ics_base(df), k)


def _volume(base: DataFrame) -> DataFrame:
    return (base.where(_is_ics() & F.col("time_window").isNotNull())
                .groupBy("time_window")
                .agg(F.sum("_bytes").cast("long").alias("total_bytes"),
                     F.sum("_packets").cast("long").alias("total_packets"),
                     F.countDistinct("src_ip").alias("unique_devices")))


def agg_ics_volume(df: DataFrame, width_s: int = ICS_VOLUME_WINDOW_S) -> DataFrame:
    """Per 30-minute window on ICS flows: bytes, packets, distinct sources."""
    return _volume(ics_base(df, width_s))


def _spikes(volume: DataFrame) -> DataFrame:
    v = with_scalars(volume, F.avg("total_bytes").alias("_m"), F.stddev_samp("total_bytes").alias("_s"))
    thr = F.round(F.col("_m") + SPIKE_SIGMA * F.col("_s"), SCORE_PLACES)
    return v.where(F.coalesce(F.col("total_bytes") > thr, F.lit(False))).drop("_m", "_s")


def ics_volume_spikes(df: DataFrame) -> DataFrame:
    """Windows whose ICS bytes exceed mean + 3 sigma."""
    return _spikes(_volume(ics_base(df)))


def _ports(base: DataFrame) -> DataFrame:
    return (base.where(_is_ics()).groupBy(F.col("dst_port").alias("port"))
                .agg(F.countDistinct("src_ip").alias("unique_sources"),
                     F.sum("_bytes").cast("long").alias("total_bytes"),
                     F.sum("_packets").cast("long").alias("total_packets")))


def agg_ics_port(df: DataFrame) -> DataFrame:
    """Per ICS destination port: distinct sources, bytes, packets. At most seven
    rows when the ICS flag is derived from the port."""
    return _ports(ics_base(df))


def port_quantiles(ports: DataFrame) -> DataFrame:
    """The 0.9 quantiles (linear interpolation) of sources and bytes over ports (one row)."""
    return ports.agg(*quantiles(USAGE_QUANTILE, q90_sources="unique_sources", q90_bytes="total_bytes"))


def _unusual_ports(ports: DataFrame) -> DataFrame:
    p = ports.crossJoin(F.broadcast(port_quantiles(ports)))
    cond = (F.col("unique_sources") > F.col("q90_sources")) | (F.col("total_bytes") > F.col("q90_bytes"))
    return p.where(F.coalesce(cond, F.lit(False))).drop("q90_sources", "q90_bytes")


def ics_unusual_ports(df: DataFrame) -> DataFrame:
    """Ports whose distinct sources or bytes exceed the 0.9 quantile
    (linear interpolation) over ports, exactly."""
    return _unusual_ports(_ports(ics_base(df)))


# --- the seven rules -------------------------------------------------------

def ics_rules(df: DataFrame, assets: DataFrame | None = None,
              materialize_base: bool = True) -> tuple[list[DataFrame], DataFrame]:
    """Frames of findings, together the seven rules, and the high-diversity devices. Unless ``materialize_base``
    is False, :func:`ics_base` and the per-source table are written once: the
    counting rules come from one totals row of the latter, the diversity rule
    from the same table, the others from small aggregates of the base."""
    eager = materialize_base and not df.isStreaming

    def stored(table: DataFrame, name: str) -> DataFrame:
        return materialize(table, name) if eager else table

    def in_portions(rows: DataFrame, keys: list, build, name: str) -> DataFrame:
        return materialize_parts((build(p) for p in portions(rows, *keys)), name) if eager else build(rows)

    base = in_portions(_candidates(df), ["src_ip", "dst_ip"], ics_base, "ics-base")
    # three tables of the base, written as concurrent jobs
    timed = has_timestamp(df)
    per_src, ports, *volume = run_concurrently(
        lambda: in_portions(base, ["src_ip"], lambda part: _per_source(part, assets), "ics-sources"), lambda: stored(_ports(base), "ics-ports"),
        *([lambda: stored(_volume(base).select("time_window", "total_bytes"), "ics-volume")] if timed else []))
    ips = (_external_first_seen(base, EXTERNAL_IPS_SHOWN)
           .agg(F.transform(F.array_sort(F.collect_list(F.struct(
               F.coalesce(F.unix_micros("first_seen"), F.lit(2**62)).alias("t"), F.col("dst_ip").alias("ip")))),
               lambda s: s["ip"]).alias("ips")))
    totals = _source_totals(per_src).where(F.col("n_ics") > 0).crossJoin(F.broadcast(ips))
    counted = [
        _finding("external_communication", F.col("n_external"), affected_devices=F.col("d_external"),
                 external_ips=F.col("ips")),
        _finding("unauthorized_access", F.col("n_unauth"), affected_devices=F.col("d_unauth"),
                 accessed_ports=F.col("unauth_ports"))]
    if "is_night" in df.columns:
        counted.append(_finding("unusual_time", F.col("n_night"), affected_devices=F.col("d_night")))
    if "is_weekend" in df.columns:
        counted.append(_finding("weekend_activity", F.col("n_weekend"), affected_devices=F.col("d_weekend")))
    out = [_rows(totals, *counted)]
    devices = _high_diversity(per_src).agg(F.count(F.lit(1)).alias("n"))
    out.append(_rows(devices, _finding("high_diversity", F.col("n"), affected_devices=F.col("n"))))
    if timed:
        spikes = _spikes(volume[0]).agg(F.count(F.lit(1)).alias("n"), F.max("total_bytes").alias("mx"))
        out.append(_rows(spikes, _finding("traffic_spike", F.col("n"),
                                          max_volume_mb=F.col("mx") / F.lit(float(BYTES_PER_MB)))))
    unusual = _unusual_ports(ports).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("port")).alias("ports"))
    out.append(_rows(unusual, _finding("unusual_protocol_usage", F.col("n"), protocols=F.col("ports"))))
    return out, _high_diversity(per_src)


def union_findings(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def detect_ics_with_devices(df: DataFrame, assets: DataFrame | None = None,
                            materialize_base: bool = True) -> tuple[DataFrame, DataFrame]:
    """:func:`detect_ics` and :func:`ics_high_diversity_devices`, of one base."""
    if "is_ics_protocol" not in df.columns:
        return empty_findings(df.sparkSession), ics_high_diversity_devices(df)
    frames, devices = ics_rules(df, assets, materialize_base)
    return union_findings(frames).select(*FINDINGS_COLUMNS), devices


def detect_ics(df: DataFrame, assets: DataFrame | None = None,
               materialize_base: bool = True) -> DataFrame:
    """FINDINGS rows (rule order in ``rule_no``; the affected devices of
    ``high_diversity`` are listed by :func:`ics_high_diversity_devices`). No ``is_ics_protocol``
    column or no ICS rows gives an empty frame with the FINDINGS schema."""
    if "is_ics_protocol" not in df.columns:
        return empty_findings(df.sparkSession)
    return detect_ics_with_devices(df, assets, materialize_base)[0]


def agg_severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
