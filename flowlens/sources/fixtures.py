"""Deterministic flow-shaped views derived from the driver's TPC-H tables.

The driver's tables hold no network flows, so the test views re-shape
``lineitem`` (FIXTURES.md section 2). Roles by supplier key: ``% 10 = 7``
scanner, ``% 10 = 3`` large outbound transfers, ``% 10 = 9`` external
source, supplier 5 high fan-out. Every column is a plain expression, so the
scan is pruned to the seven ``lineitem`` columns it reads.

``FLOWS_SQL`` is the same definition as one SQL text, run unchanged by Spark
SQL and DuckDB (the oracle inlines it as a CTE).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources.parallelism import spread

EPOCH_2024 = 1704067200  # 2024-01-01 00:00:00 UTC

FLOWS_SQL = """SELECT TIMESTAMP '2024-01-01 00:00:00' + CAST(sec AS BIGINT) * INTERVAL '1' SECOND AS timestamp,
  src_ip, dst_ip, 1024 + (l_orderkey * 7 + l_linenumber) % 64000 AS src_port, dst_port, protocol, bytes, packets, duration
FROM (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_suppkey % 10 = 7 THEN (l_orderkey % 12) * 50400 + (l_orderkey % 200)
       ELSE (l_orderkey * 7919 + l_linenumber * 613) % 604800 END AS sec,
  CASE WHEN l_suppkey % 10 = 9 THEN '198.51.100.' || CAST(l_suppkey % 250 AS VARCHAR(10))
       ELSE '10.0.' || CAST(CAST(floor(l_suppkey / 250.0) AS BIGINT) AS VARCHAR(10)) || '.' || CAST(l_suppkey % 250 AS VARCHAR(10)) END AS src_ip,
  CASE WHEN l_suppkey % 10 <> 7 AND (l_partkey % 10 = 0 OR (l_suppkey % 10 = 3 AND l_partkey % 2 = 0)) THEN '203.0.113.' || CAST(l_partkey % 50 AS VARCHAR(10))
       WHEN l_suppkey = 5 THEN '10.0.1.' || CAST(l_partkey % 240 AS VARCHAR(10))
       ELSE '10.0.1.' || CAST(l_partkey % 40 AS VARCHAR(10)) END AS dst_ip,
  CASE WHEN l_suppkey % 10 = 7 THEN 1 + l_partkey % 1024
       WHEN l_partkey % 12 = 0 THEN 502 WHEN l_partkey % 12 = 1 THEN 102 WHEN l_partkey % 12 = 2 THEN 2404 WHEN l_partkey % 12 = 3 THEN 20000
       WHEN l_partkey % 12 = 4 THEN 44818 WHEN l_partkey % 12 = 5 THEN 4840 WHEN l_partkey % 12 = 6 THEN 47808
       WHEN l_partkey % 12 = 7 THEN 80 WHEN l_partkey % 12 = 8 THEN 443 WHEN l_partkey % 12 = 9 THEN 22 WHEN l_partkey % 12 = 10 THEN 445 ELSE 3389 END AS dst_port,
  CASE WHEN l_linenumber = 7 THEN 'HTTP' WHEN l_returnflag = 'R' THEN 'UDP' ELSE 'TCP' END AS protocol,
  CAST(floor(l_extendedprice) AS BIGINT) * (CASE WHEN l_suppkey % 10 = 3 AND l_orderkey % 50 = 0 THEN 500 ELSE 1 END) AS bytes,
  CAST(floor(l_quantity) AS BIGINT) AS packets,
  CAST(l_linenumber AS DOUBLE) * 0.5 AS duration
FROM lineitem) x"""

# Packets view: one packet per line item, four source ports per order.
PACKETS_SQL = (FLOWS_SQL
               .replace("1024 + (l_orderkey * 7 + l_linenumber) % 64000 AS src_port",
                        "CAST(40000 + l_linenumber % 4 AS BIGINT) AS src_port")
               .replace("CAST(floor(l_quantity) AS BIGINT) AS packets", "CAST(1 AS BIGINT) AS packets")
               .replace("CAST(l_linenumber AS DOUBLE) * 0.5 AS duration", "CAST(0.0 AS DOUBLE) AS duration"))

_LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                  "l_quantity", "l_extendedprice", "l_returnflag"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "lineitem").select(*_LINEITEM_COLS))


def _src_ip(sup: Column) -> Column:
    return (F.when(sup % 10 == 9, F.concat(F.lit("198.51.100."), (sup % 250).cast("string")))
            .otherwise(F.concat(F.lit("10.0."), F.floor(sup / 250.0).cast("long").cast("string"),
                                F.lit("."), (sup % 250).cast("string"))))


def _dst_ip(sup: Column, part: Column) -> Column:
    return (F.when((sup % 10 != 7) & ((part % 10 == 0) | ((sup % 10 == 3) & (part % 2 == 0))),
                   F.concat(F.lit("203.0.113."), (part % 50).cast("string")))
            .when(sup == 5, F.concat(F.lit("10.0.1."), (part % 240).cast("string")))
            .otherwise(F.concat(F.lit("10.0.1."), (part % 40).cast("string"))))


# Destination port by part key modulo 12 (fixture definition).
_PORT_BY_PART_MOD12 = [502, 102, 2404, 20000, 44818, 4840, 47808, 80, 443, 22, 445, 3389]


def _dst_port(sup: Column, part: Column) -> Column:
    m = part % 12
    expr = F.when(sup % 10 == 7, F.lit(1) + part % 1024)
    for i, port in enumerate(_PORT_BY_PART_MOD12[:-1]):
        expr = expr.when(m == i, F.lit(port).cast("long"))
    return expr.otherwise(F.lit(_PORT_BY_PART_MOD12[-1]).cast("long"))


def _sec(sup: Column, ok: Column, ln: Column) -> Column:
    return (F.when(sup % 10 == 7, (ok % 12) * 50400 + ok % 200)
            .otherwise((ok * 7919 + ln * 613) % 604800))


def _flow_columns(li: DataFrame, packets_view: bool) -> DataFrame:
    ok, part, sup, ln = (F.col("l_orderkey"), F.col("l_partkey"),
                         F.col("l_suppkey"), F.col("l_linenumber"))
    if packets_view:
        src_port = F.lit(40000) + (ln % 4).cast("long")
        packets = F.lit(1).cast("long")
        duration = F.lit(0.0)
    else:
        src_port = F.lit(1024) + (ok * 7 + ln) % 64000
        packets = F.floor("l_quantity").cast("long")
        duration = ln.cast("double") * 0.5
    multiplier = F.when((sup % 10 == 3) & (ok % 50 == 0), F.lit(500)).otherwise(F.lit(1))
    return li.select(
        F.timestamp_seconds(F.lit(EPOCH_2024) + _sec(sup, ok, ln)).alias("timestamp"),
        _src_ip(sup).alias("src_ip"),
        _dst_ip(sup, part).alias("dst_ip"),
        src_port.cast("long").alias("src_port"),
        _dst_port(sup, part).cast("long").alias("dst_port"),
        F.when(ln == 7, F.lit("HTTP")).when(F.col("l_returnflag") == "R", F.lit("UDP"))
         .otherwise(F.lit("TCP")).alias("protocol"),
        (F.floor("l_extendedprice").cast("long") * multiplier).alias("bytes"),
        packets.alias("packets"),
        duration.alias("duration"),
    )


def flows_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``flows`` fixture view (FLOW schema) over ``lineitem``."""
    return _flow_columns(_lineitem(spark, sf_dir), packets_view=False)


def packets_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``packets`` fixture view: one packet per line item."""
    return _flow_columns(_lineitem(spark, sf_dir), packets_view=True)


def packet_list_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet-list export (No, Time, Source, Destination, Protocol, Length,
    Info) built from the packets view; ``Time`` is epoch seconds."""
    li = _lineitem(spark, sf_dir)
    pk = _flow_columns(li, packets_view=True)
    return pk.select(
        F.unix_seconds("timestamp").cast("double").alias("Time"),
        F.col("src_ip").alias("Source"),
        F.col("dst_ip").alias("Destination"),
        F.col("protocol").alias("Protocol"),
        F.col("bytes").alias("Length"),
        F.concat(F.col("src_port").cast("string"), F.lit(" → "), F.col("dst_port").cast("string"),
                 F.lit(" [ACK] Seq=1")).alias("Info"),
    )


def assets_from_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-asset inventory (``ip``): the internal address of every supplier
    in good standing (``s_acctbal >= 0``); the others count as unknown."""
    from flowlens.functions.ip import is_private_ip
    sup = F.col("s_suppkey")
    return (read_table(spark, sf_dir, "supplier")
            .where(F.col("s_acctbal") >= 0)
            .select(_src_ip(sup).alias("ip"))
            .where(is_private_ip("ip")))
