"""Port numbers from free packet-summary text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PORT = 65535
_PORT_TOKEN = r"\b(\d{1,5})\b"


def _valid(p: Column) -> Column:
    return F.when(p <= MAX_PORT, p).otherwise(F.lit(0))


def extract_ports(info) -> Column:
    """Struct ``(src_port, dst_port)`` from text such as ``'56443 → 443 [ACK]'``.

    Numbers of 1-5 digits on word boundaries: two or more give source and
    destination, one gives the destination; numbers above 65535 become 0;
    no number or NULL text gives ``(0, 0)``.
    """
    c = F.col(info) if isinstance(info, str) else info
    tokens = F.coalesce(F.regexp_extract_all(c, F.lit(_PORT_TOKEN), 1),
                        F.array().cast("array<string>"))
    n = F.size(tokens)
    p0 = F.get(tokens, 0).cast("long")
    p1 = F.get(tokens, 1).cast("long")
    src = F.when(n >= 2, _valid(p0)).otherwise(F.lit(0).cast("long"))
    dst = (F.when(n >= 2, _valid(p1))
           .when(n == 1, _valid(p0))
           .otherwise(F.lit(0).cast("long")))
    return F.struct(src.alias("src_port"), dst.alias("dst_port"))
