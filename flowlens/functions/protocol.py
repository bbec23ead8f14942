"""Protocol naming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.schema import ICS_PORTS


def proto_label(proto_number) -> Column:
    """IP protocol number to a label: TCP, UDP, ICMP, else ``IP_<n>``."""
    p = F.col(proto_number) if isinstance(proto_number, str) else proto_number
    return (F.when(p == 6, F.lit("TCP"))
            .when(p == 17, F.lit("UDP"))
            .when(p == 1, F.lit("ICMP"))
            .otherwise(F.concat(F.lit("IP_"), p.cast("string"))))


def ics_protocol_name(dst_port) -> Column:
    """Industrial protocol served on a destination port, else ``'Unknown'``."""
    p = F.col(dst_port) if isinstance(dst_port, str) else dst_port
    expr = None
    for port, name in ICS_PORTS.items():
        expr = (F.when(p == port, F.lit(name)) if expr is None
                else expr.when(p == port, F.lit(name)))
    return expr.otherwise(F.lit("Unknown"))


def is_ics_port(dst_port) -> Column:
    p = F.col(dst_port) if isinstance(dst_port, str) else dst_port
    return p.isin(list(ICS_PORTS))
