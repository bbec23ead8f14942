"""DuckDB SQL texts equal in meaning to the registered Spark queries.

Shared conventions with the Spark side (``flowlens.plans.catalog``): doubles
rounded to 6 places, windows and times as epoch seconds (BIGINT), integer
widths fixed by casts, lists as comma-joined text.
"""

from __future__ import annotations

from flowlens.sources.fixtures import FLOWS_SQL, PACKETS_SQL

ICS_PORT_LIST = "102, 502, 2404, 20000, 44818, 47808, 4840"
SUSP_LIST = "'FTP', 'HTTP', 'HTTPS', 'SFTP', 'SCP'"


def private(ip: str) -> str:
    p1 = f"TRY_CAST(string_split({ip}, '.')[1] AS INTEGER)"
    p2 = f"TRY_CAST(string_split({ip}, '.')[2] AS INTEGER)"
    return (f"COALESCE(len(string_split({ip}, '.')) = 4 AND {p1} IS NOT NULL AND {p2} IS NOT NULL AND "
            f"({p1} = 10 OR ({p1} = 172 AND {p2} BETWEEN 16 AND 31) OR ({p1} = 192 AND {p2} = 168) "
            f"OR {p1} = 127), false)")


def bucket(width: int, ts: str = "timestamp") -> str:
    return f"CAST(floor(epoch({ts}) / {width}) * {width} AS BIGINT)"


def r6(x: str) -> str:
    return f"round({x}, 6)"


ICS_NAME = ("CASE dst_port WHEN 102 THEN 'S7' WHEN 502 THEN 'Modbus' WHEN 2404 THEN 'IEC 61850' "
            "WHEN 20000 THEN 'DNP3' WHEN 44818 THEN 'EtherNet/IP' WHEN 47808 THEN 'BACnet' "
            "WHEN 4840 THEN 'OPC UA' ELSE 'Unknown' END")

FLOWS_CTE = f"flows AS ({FLOWS_SQL})"

FEATURES_CTE = f"""{FLOWS_CTE},
fanout AS (SELECT src_ip, count(DISTINCT dst_ip) AS unique_destinations FROM flows
           WHERE src_ip IS NOT NULL GROUP BY src_ip),
features AS (
  SELECT f.timestamp, f.src_ip, f.dst_ip, f.src_port, f.dst_port, f.protocol, f.bytes, f.packets, f.duration,
    CASE WHEN dst_port IN ({ICS_PORT_LIST}) THEN 1 ELSE 0 END AS is_ics_protocol,
    {ICS_NAME} AS ics_protocol,
    COALESCE(bytes / (packets + 1), 0.0) AS bytes_per_packet,
    COALESCE(packets / (duration + 1), 0.0) AS packets_per_second,
    COALESCE(bytes / (duration + 1), 0.0) AS bytes_per_second,
    CAST(hour(timestamp) AS INTEGER) AS hour,
    CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week,
    CASE WHEN hour(timestamp) >= 22 OR hour(timestamp) <= 6 THEN 1 ELSE 0 END AS is_night,
    CASE WHEN isodow(timestamp) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN dst_port > 10000 THEN 1 ELSE 0 END AS is_high_port,
    CASE WHEN dst_port < 1024 THEN 1 ELSE 0 END AS is_well_known,
    CASE WHEN upper(protocol) = 'TCP' THEN 1 ELSE 0 END AS is_tcp,
    CASE WHEN upper(protocol) = 'UDP' THEN 1 ELSE 0 END AS is_udp,
    u.unique_destinations
  FROM flows f LEFT JOIN fanout u ON f.src_ip = u.src_ip)"""

FEATURE_OUT = f"""epoch(timestamp)::BIGINT AS timestamp, src_ip, dst_ip, src_port, dst_port, protocol, bytes, packets,
  {r6('duration')} AS duration, is_ics_protocol, ics_protocol, {r6('bytes_per_packet')} AS bytes_per_packet,
  {r6('packets_per_second')} AS packets_per_second, {r6('bytes_per_second')} AS bytes_per_second,
  hour, day_of_week, is_night, is_weekend, is_high_port, is_well_known, is_tcp, is_udp, unique_destinations"""

LATERAL_BODY = f"""lat_g AS (
  SELECT src_ip, {bucket(300)} AS time_window,
    count(DISTINCT dst_ip) AS unique_dsts, count(DISTINCT dst_port) AS unique_ports,
    CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, avg(duration) AS avg_duration
  FROM flows WHERE src_ip IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1, 2),
lat_s AS (
  SELECT g.*, g.unique_dsts / mx.mud AS dst_diversity_score, g.unique_ports / mx.mup AS port_scan_score,
    g.bytes / (g.avg_duration + 1) AS traffic_intensity,
    CASE WHEN g.unique_ports > 10 AND g.packets > 50 THEN 1 ELSE 0 END AS is_port_scan,
    CASE WHEN g.unique_dsts > 5 AND g.packets > 20 THEN 1 ELSE 0 END AS is_host_scan
  FROM lat_g g CROSS JOIN (SELECT max(unique_dsts) AS mud, max(unique_ports) AS mup FROM lat_g) mx),
lat_c AS (
  SELECT *, dst_diversity_score * 4.0::DOUBLE + port_scan_score * 3.0::DOUBLE
            + is_port_scan * 2.0::DOUBLE + is_host_scan * 2.0::DOUBLE AS lateral_score FROM lat_s),
lat AS (
  SELECT c.*, CASE WHEN round(c.lateral_score, 9) > round(m.mu + 2.0::DOUBLE * m.sd, 9) THEN 1 ELSE 0 END
    AS is_lateral_movement
  FROM lat_c c CROSS JOIN (SELECT avg(lateral_score) AS mu, stddev_samp(lateral_score) AS sd FROM lat_c) m),
lat_out AS (
  SELECT *, CASE WHEN is_lateral_movement = 1 AND (is_port_scan = 1 OR is_host_scan = 1) THEN 1 ELSE 0 END
    AS is_high_risk FROM lat)"""
LATERAL_CTE = f"{FLOWS_CTE},\n{LATERAL_BODY}"

LATERAL_OUT = f"""src_ip, time_window, unique_dsts, unique_ports, packets, bytes, {r6('avg_duration')} AS avg_duration,
  {r6('dst_diversity_score')} AS dst_diversity_score, {r6('port_scan_score')} AS port_scan_score,
  {r6('traffic_intensity')} AS traffic_intensity, is_port_scan, is_host_scan, {r6('lateral_score')} AS lateral_score,
  is_lateral_movement, is_high_risk"""

EXFIL_BODY = f"""outbound AS (SELECT * FROM flows WHERE {private('src_ip')} AND NOT {private('dst_ip')}),
ex_g AS (
  SELECT src_ip, {bucket(600)} AS time_window,
    CAST(sum(bytes) AS BIGINT) AS bytes_out, CAST(sum(packets) AS BIGINT) AS packets_out,
    count(DISTINCT dst_ip) AS unique_external_dsts, count(DISTINCT dst_port) AS unique_ports,
    sum(duration) AS total_duration,
    max(CASE WHEN hour(timestamp) >= 22 OR hour(timestamp) <= 6 THEN 1 ELSE 0 END) AS is_night,
    max(CASE WHEN isodow(timestamp) - 1 >= 5 THEN 1 ELSE 0 END) AS is_weekend,
    CAST(count(*) FILTER (WHERE protocol IN ({SUSP_LIST})) AS BIGINT) AS suspicious_protocol_count
  FROM outbound WHERE src_ip IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1, 2),
ex_s AS (
  SELECT *, bytes_out / 1048576.0::DOUBLE AS mb_transferred,
    bytes_out / (total_duration + 1) AS transfer_rate, packets_out / (total_duration + 1) AS packet_rate
  FROM ex_g),
ex_f AS (
  SELECT *, CASE WHEN mb_transferred > 10 THEN 1 ELSE 0 END AS is_large_transfer,
    CASE WHEN unique_external_dsts > 3 THEN 1 ELSE 0 END AS is_multiple_destinations,
    CASE WHEN transfer_rate > 1000000 THEN 1 ELSE 0 END AS is_high_bandwidth,
    CASE WHEN is_night = 1 OR is_weekend = 1 THEN 1 ELSE 0 END AS is_unusual_time,
    CASE WHEN suspicious_protocol_count > 0 THEN 1 ELSE 0 END AS is_suspicious_protocol
  FROM ex_s),
ex_c AS (
  SELECT *, mb_transferred * 3.0::DOUBLE + unique_external_dsts * 2.0::DOUBLE + is_large_transfer * 4.0::DOUBLE
    + is_multiple_destinations * 3.0::DOUBLE + is_high_bandwidth * 2.0::DOUBLE + is_unusual_time * 2.0::DOUBLE
    + is_suspicious_protocol * 1.5::DOUBLE AS exfil_score FROM ex_f),
ex_x AS (
  SELECT c.*, CASE WHEN round(c.exfil_score, 9) > round(m.mu + 2.0::DOUBLE * m.sd, 9) THEN 1 ELSE 0 END
    AS is_exfiltration
  FROM ex_c c CROSS JOIN (SELECT avg(exfil_score) AS mu, stddev_samp(exfil_score) AS sd FROM ex_c) m),
exfil AS (
  SELECT *, CASE WHEN is_exfiltration = 1 AND (is_large_transfer = 1 OR is_unusual_time = 1) THEN 1 ELSE 0 END
    AS is_high_risk FROM ex_x)"""
EXFIL_CTE = f"{FLOWS_CTE},\n{EXFIL_BODY}"

EXFIL_OUT = f"""src_ip, time_window, bytes_out, packets_out, unique_external_dsts, unique_ports,
  {r6('total_duration')} AS total_duration, {r6('mb_transferred')} AS mb_transferred,
  {r6('transfer_rate')} AS transfer_rate, {r6('packet_rate')} AS packet_rate, is_large_transfer,
  is_multiple_destinations, is_high_bandwidth, is_night, is_weekend, is_unusual_time, suspicious_protocol_count,
  is_suspicious_protocol, {r6('exfil_score')} AS exfil_score, is_exfiltration, is_high_risk"""

ICS_BODY = f"""ics AS (SELECT * FROM features WHERE is_ics_protocol = 1),
ics_div AS (
  SELECT src_ip, count(DISTINCT dst_ip) AS unique_dsts, count(DISTINCT dst_port) AS unique_ports,
    CAST(sum(bytes) AS BIGINT) AS total_bytes
  FROM ics WHERE src_ip IS NOT NULL GROUP BY src_ip),
ics_hd AS (
  SELECT d.* FROM ics_div d CROSS JOIN (SELECT avg(unique_dsts) AS mu, stddev_samp(unique_dsts) AS sd FROM ics_div) m
  WHERE d.unique_dsts > round(m.mu + 2.0::DOUBLE * m.sd, 9)),
ics_ext AS (SELECT * FROM ics WHERE NOT {private('dst_ip')}),
ics_ext10 AS (
  SELECT dst_ip, min(timestamp) AS first_seen FROM ics_ext GROUP BY dst_ip
  ORDER BY first_seen ASC NULLS LAST, dst_ip ASC NULLS LAST LIMIT 10),
ics_vol AS (
  SELECT {bucket(1800)} AS time_window, CAST(sum(bytes) AS BIGINT) AS total_bytes,
    CAST(sum(packets) AS BIGINT) AS total_packets, count(DISTINCT src_ip) AS unique_devices
  FROM ics WHERE timestamp IS NOT NULL GROUP BY 1),
ics_spk AS (
  SELECT v.* FROM ics_vol v CROSS JOIN (SELECT avg(total_bytes) AS mu, stddev_samp(total_bytes) AS sd FROM ics_vol) m
  WHERE v.total_bytes > round(m.mu + 3.0::DOUBLE * m.sd, 9)),
ics_unauth AS (SELECT * FROM features WHERE is_ics_protocol = 0 AND dst_port IN ({ICS_PORT_LIST})),
ics_port AS (
  SELECT CAST(dst_port AS BIGINT) AS port, count(DISTINCT src_ip) AS unique_sources,
    CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(packets) AS BIGINT) AS total_packets
  FROM ics GROUP BY 1),
ics_unusual AS (
  SELECT p.* FROM ics_port p CROSS JOIN (SELECT quantile_cont(unique_sources, 0.9) AS qs,
    quantile_cont(total_bytes, 0.9) AS qb FROM ics_port) q
  WHERE p.unique_sources > q.qs OR p.total_bytes > q.qb),
n_ics AS (SELECT count(*) AS n FROM ics),
findings AS (
  SELECT 1 AS rule_no, 'unusual_time' AS type, 'medium' AS severity, count(*) AS count,
    count(*) || ' ICS connections during night hours' AS description,
    count(DISTINCT src_ip) AS affected_devices, NULL::VARCHAR AS external_ips,
    NULL::DOUBLE AS max_volume_mb, NULL::VARCHAR AS accessed_ports, NULL::VARCHAR AS protocols, 2 AS risk_score
  FROM ics WHERE is_night = 1 HAVING count(*) > 0
  UNION ALL
  SELECT 2, 'weekend_activity', 'medium', count(*), count(*) || ' ICS connections during weekend',
    count(DISTINCT src_ip), NULL, NULL, NULL, NULL, 2
  FROM ics WHERE is_weekend = 1 HAVING count(*) > 0
  UNION ALL
  SELECT 3, 'high_diversity', 'high', count(*),
    count(*) || ' ICS devices with unusually high connection diversity', count(DISTINCT src_ip), NULL, NULL, NULL, NULL, 3
  FROM ics_hd HAVING count(*) > 0
  UNION ALL
  SELECT 4, 'external_communication', 'critical', count(*), count(*) || ' ICS connections to external IPs',
    count(DISTINCT src_ip),
    (SELECT array_to_string(list(dst_ip ORDER BY first_seen ASC NULLS LAST, dst_ip), ',') FROM ics_ext10),
    NULL, NULL, NULL, 4
  FROM ics_ext HAVING count(*) > 0
  UNION ALL
  SELECT 5, 'traffic_spike', 'high', count(*), count(*) || ' time windows with unusual ICS traffic volume',
    NULL, NULL, round(max(total_bytes) / 1048576.0::DOUBLE, 6), NULL, NULL, 3
  FROM ics_spk HAVING count(*) > 0
  UNION ALL
  SELECT 6, 'unauthorized_access', 'critical', count(*), count(*) || ' non-ICS devices accessing ICS ports',
    count(DISTINCT src_ip), NULL, NULL,
    array_to_string(list_sort(list(DISTINCT CAST(dst_port AS BIGINT))), ','), NULL, 4
  FROM ics_unauth WHERE (SELECT n FROM n_ics) > 0 HAVING count(*) > 0
  UNION ALL
  SELECT 7, 'unusual_protocol_usage', 'medium', count(*),
    count(*) || ' ICS protocols showing unusual usage patterns', NULL, NULL, NULL, NULL,
    array_to_string(list_sort(list(port)), ','), 2
  FROM ics_unusual HAVING count(*) > 0)"""
ICS_CTE = f"{FEATURES_CTE},\n{ICS_BODY}"
# features whose ICS flag was cleared on some flows to ICS ports
FLAGGED_ICS_CTE = f"""{FEATURES_CTE.replace("features AS (", "derived AS (", 1)},
features AS (SELECT * REPLACE (CASE WHEN src_port % 7 = 0 THEN 0 ELSE is_ics_protocol END AS is_ics_protocol) FROM derived),
{ICS_BODY}"""
ALL_CTE = f"{FEATURES_CTE},\n{LATERAL_BODY},\n{EXFIL_BODY},\n{ICS_BODY}"

ASSET_IP = ("CASE WHEN s_suppkey % 10 = 9 THEN '198.51.100.' || CAST(s_suppkey % 250 AS VARCHAR) "
            "ELSE '10.0.' || CAST(CAST(floor(s_suppkey / 250.0) AS BIGINT) AS VARCHAR) || '.' "
            "|| CAST(s_suppkey % 250 AS VARCHAR) END")

FINDINGS_OUT = """CAST(rule_no AS INTEGER) AS rule_no, type, severity, CAST(count AS BIGINT) AS count, description,
  CAST(affected_devices AS BIGINT) AS affected_devices, external_ips, max_volume_mb,
  accessed_ports, protocols, CAST(risk_score AS INTEGER) AS risk_score"""

PACKETS_CTE = f"packets AS ({PACKETS_SQL})"

INFO_EXPR = "CAST(src_port AS VARCHAR) || ' → ' || CAST(dst_port AS VARCHAR) || ' [ACK] Seq=1'"
PACKET_LIST_CTE = f"""{PACKETS_CTE},
packet_list AS (
  SELECT CAST(epoch(timestamp) AS DOUBLE) AS "Time", src_ip AS "Source", dst_ip AS "Destination",
    protocol AS "Protocol", bytes AS "Length",
    {INFO_EXPR} AS "Info"
  FROM packets),
converted AS (
  SELECT "Time" AS timestamp, "Source" AS src_ip, "Destination" AS dst_ip, "Protocol" AS protocol,
    CAST("Length" AS BIGINT) AS bytes,
    CASE WHEN len(t) >= 2 THEN (CASE WHEN CAST(t[1] AS BIGINT) <= 65535 THEN CAST(t[1] AS BIGINT) ELSE 0 END)
         ELSE 0 END AS src_port,
    CASE WHEN len(t) >= 2 THEN (CASE WHEN CAST(t[2] AS BIGINT) <= 65535 THEN CAST(t[2] AS BIGINT) ELSE 0 END)
         WHEN len(t) = 1 THEN (CASE WHEN CAST(t[1] AS BIGINT) <= 65535 THEN CAST(t[1] AS BIGINT) ELSE 0 END)
         ELSE 0 END AS dst_port,
    CAST(1 AS BIGINT) AS packets, 0.1::DOUBLE AS duration, "Info"
  FROM (SELECT *, COALESCE(regexp_extract_all("Info", '\\b(\\d{{1,5}})\\b', 1), []) AS t FROM packet_list))"""
