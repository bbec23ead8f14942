"""Declared schemas and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reference's for identical results.
# ---------------------------------------------------------------------------
# Industrial-protocol destination ports and their names.
ICS_PORTS = {
    102: "S7",
    502: "Modbus",
    2404: "IEC 61850",
    20000: "DNP3",
    44818: "EtherNet/IP",
    47808: "BACnet",
    4840: "OPC UA",
}
# Protocol names counted as suspicious for exfiltration (exact, case-sensitive).
SUSPICIOUS_PROTOCOLS = ["FTP", "HTTP", "HTTPS", "SFTP", "SCP"]
# Finding severity -> risk score.
SEVERITY_SCORES = {"low": 1, "medium": 2, "high": 3, "critical": 4}
# Fixed 14-feature list used for training when no list is given.
TRAINING_FEATURES = [
    "bytes", "packets", "duration",
    "bytes_per_packet", "packets_per_second", "bytes_per_second",
    "is_ics_protocol", "is_high_port", "is_tcp", "is_udp",
    "unique_destinations", "hour", "is_night", "is_weekend",
]
# Columns never used as model features by the automatic selection.
FEATURE_EXCLUDE = ["src_ip", "dst_ip", "timestamp", "label", "anomaly"]
# Window widths (seconds) of the three detectors.
LATERAL_WINDOW_S = 300
EXFIL_WINDOW_S = 600
ICS_VOLUME_WINDOW_S = 1800
# Forest defaults.
DEFAULT_TREES = 100
DEFAULT_SEED = 42
DEFAULT_CONTAMINATION = 0.05
DEFAULT_MAX_SAMPLES = 256
# Score bands of the summary.
RISK_HIGH_BELOW = -0.5
RISK_MEDIUM_BELOW = -0.3
# Substitute values of time features when the input has no timestamp column.
NO_TIME_HOUR = 12
NO_TIME_DAY_OF_WEEK = 2
# ---------------------------------------------------------------------------

FLOW_COLUMNS = ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port",
                "protocol", "bytes", "packets", "duration"]

FLOW_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.LongType()),
    T.StructField("dst_port", T.LongType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("packets", T.LongType()),
    T.StructField("duration", T.DoubleType()),
])

# Raw text form (CSV / JSON): the timestamp is parsed by norm_timestamp.
FLOW_RAW_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.StringType())] + list(FLOW_SCHEMA.fields[1:]))

PACKET_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.LongType()),
    T.StructField("dst_port", T.LongType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("packets", T.LongType()),
    T.StructField("duration", T.DoubleType()),
])

LATERAL_COLUMNS = [
    "src_ip", "time_window", "unique_dsts", "unique_ports", "packets", "bytes",
    "avg_duration", "dst_diversity_score", "port_scan_score", "traffic_intensity",
    "is_port_scan", "is_host_scan", "lateral_score", "is_lateral_movement", "is_high_risk",
]

EXFIL_COLUMNS = [
    "src_ip", "time_window", "bytes_out", "packets_out", "unique_external_dsts",
    "unique_ports", "total_duration", "mb_transferred", "transfer_rate", "packet_rate",
    "is_large_transfer", "is_multiple_destinations", "is_high_bandwidth", "is_night",
    "is_weekend", "is_unusual_time", "suspicious_protocol_count", "is_suspicious_protocol",
    "exfil_score", "is_exfiltration", "is_high_risk",
]

FINDINGS_SCHEMA = T.StructType([
    T.StructField("rule_no", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("description", T.StringType()),
    T.StructField("affected_devices", T.LongType()),
    T.StructField("external_ips", T.ArrayType(T.StringType())),
    T.StructField("max_volume_mb", T.DoubleType()),
    T.StructField("accessed_ports", T.ArrayType(T.LongType())),
    T.StructField("protocols", T.ArrayType(T.LongType())),
    T.StructField("risk_score", T.IntegerType()),
])
FINDINGS_COLUMNS = [f.name for f in FINDINGS_SCHEMA.fields]
