"""Text inputs loaded once, with what could not be read told apart and counted.

A line of a CSV file with more or fewer fields than its header and a JSON record
that is no object go to a table of rejects, as text. A value that is no number
in a numeric column stays NULL (and becomes 0 by the fill rule), its row stays.
All are counted by ``observe`` in the one job that parses the input and stores
it as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.common import materialize
from flowlens.schema import FLOW_RAW_SCHEMA
from flowlens.sources.flows import detect_format, flow_casts, read_csv_flows, read_flows, read_json_flows

REJECTED = "_rejected"
TEXT_FORMATS = ("csv", "json")


def _unread(df: DataFrame) -> dict:
    """Per numeric flow column the good rows whose text is no number."""
    numeric = [f.name for f in FLOW_RAW_SCHEMA.fields if isinstance(f.dataType, T.NumericType) and f.name in df.columns]
    return {c: F.count_if(F.col(REJECTED).isNull() & (F.trim(c) != "") & F.col(f"_cast.{c}").isNull()) for c in numeric}


def load_checked(spark: SparkSession, path: str, fmt: str | None = None) -> tuple[DataFrame, DataFrame | None, dict]:
    """``(flows, rejects(record), counts)`` of the flows at ``path``. Counts:
    ``rows_read``, ``rows_rejected``, and ``unread_<column>`` per numeric
    column. Other formats than text have neither rejects nor counts. Both frames
    read one stored table: call inside a :class:`Scratch`."""
    fmt = (fmt or detect_format(path)).lower()
    if fmt not in TEXT_FORMATS:
        return read_flows(spark, path, fmt), None, {}
    read = read_csv_flows if fmt == "csv" else read_json_flows
    raw = read(spark, path, rejected=REJECTED, cast=False)
    both = raw.withColumn("_cast", F.struct(*flow_casts(raw.drop(REJECTED))))
    seen = Observation("flowlens-load")
    unread = _unread(both)
    both = both.observe(seen, F.count(F.lit(1)).alias("rows_read"),
                        F.count(REJECTED).alias("rows_rejected"),
                        *[n.alias(f"unread_{c}") for c, n in unread.items()])
    stored = materialize(both.select("_cast.*", REJECTED), "parsed-flows")
    flows = stored.where(F.col(REJECTED).isNull()).drop(REJECTED)
    rejects = stored.where(F.col(REJECTED).isNotNull()).select(F.col(REJECTED).alias("record"))
    return flows, rejects, dict(seen.get)
