"""Flow-table readers: Parquet, CSV and JSON, chosen by extension or name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.schema import FLOW_RAW_SCHEMA
from flowlens.sources.parallelism import spread

_BY_EXTENSION = {
    ".parquet": "parquet",
    ".csv": "csv",
    ".json": "json",
    ".pcap": "pcap",
    ".pcapng": "pcap",
}
_JSON_SPACE = (0x20, 0x09, 0x0A, 0x0D, 0xEF, 0xBB, 0xBF)   # white space and a byte-order mark
SUPPORTED = sorted(set(_BY_EXTENSION.values()))


def detect_format(path: str) -> str:
    """Reader name for ``path`` (a file, or a directory of same-type files)."""
    base = path.rstrip("/")
    for ext, fmt in _BY_EXTENSION.items():
        if base.lower().endswith(ext):
            return fmt
    raise ValueError(f"Unsupported format for {path!r}; use one of {SUPPORTED} "
                     "or pass fmt=")


def flow_casts(df: DataFrame, schema: T.StructType = FLOW_RAW_SCHEMA) -> list:
    """The columns of :func:`cast_flow_columns`."""
    types = {f.name: f.dataType for f in schema.fields}
    cols = []
    for c in df.columns:
        t = types.get(c)
        col = F.col(f"`{c}`")
        if t is None or isinstance(t, T.StringType):
            cols.append(col)
        elif isinstance(t, T.LongType):
            cols.append(F.coalesce(col.try_cast("long"), col.try_cast("double").try_cast("long")).alias(c))
        else:
            cols.append(col.try_cast(t).alias(c))
    return cols


def cast_flow_columns(df: DataFrame, schema: T.StructType = FLOW_RAW_SCHEMA) -> DataFrame:
    """Cast the known flow columns of a text table by name (extra columns pass
    through as text; the timestamp stays text for ``normalize_timestamp``).
    Integers parse exactly, or from decimal text such as ``"12.0"``;
    unparseable values become NULL."""
    return df.select(*flow_casts(df, schema))


def read_csv_flows(spark: SparkSession, path: str, schema=None, rejected: str | None = None,
                   cast: bool = True) -> DataFrame:
    """Header CSV. Columns are matched by header name, in any order, and
    extra columns are kept (:func:`cast_flow_columns`); pass ``schema`` to
    read positionally with a declared schema instead.

    ``rejected`` names a column for the text of lines that have more or fewer
    fields than the header (NULL for good lines, see
    :func:`flowlens.sources.rejects.load_checked`); ``cast=False`` leaves all
    columns as text."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        return reader.schema(schema).csv(path)
    rows = reader.csv(path)
    if rejected:
        fields = T.StructType([*rows.schema.fields, T.StructField(rejected, T.StringType())])
        rows = reader.option("columnNameOfCorruptRecord", rejected).schema(fields).csv(path)
    return cast_flow_columns(rows) if cast else rows


MAX_JSON_FIELDS = 2000


def read_json_flows(spark: SparkSession, path: str, schema=FLOW_RAW_SCHEMA, multiline: bool | None = None,
                    extra: bool = True, split_bytes: int | None = None, rejected: str | None = None,
                    cast: bool = True) -> DataFrame:
    """JSON records: one object per line, or (``multiline``) one array per
    file, which is read in byte ranges (:mod:`flowlens.sources.json_arrays`).

    Fields are matched by name; those of ``schema`` get its types, a value that
    does not fit being NULL; with ``extra`` the others are kept as text, as
    extra columns of CSV are (one pass over the records for their names).
    ``schema=None`` asks Spark to infer types. ``rejected`` names a column for
    the text of records that are no JSON object (NULL for good ones);
    ``cast=False`` leaves all fields as text."""
    if multiline is None:
        multiline = _looks_like_array(spark, path)
    if schema is None:
        return spark.read.option("multiLine", multiline).json(path)
    if multiline:
        from flowlens.sources.json_arrays import array_records
        records = array_records(spark, path, split_bytes)
    else:
        records = spark.read.text(path).where("trim(value) <> ''")
    names = [f.name for f in schema.fields]
    if extra:
        found = records.select(F.explode(F.json_object_keys("value")).alias("k")).distinct() \
            .limit(MAX_JSON_FIELDS + 1).collect()
        if len(found) > MAX_JSON_FIELDS:
            raise ValueError(f"{path} has more than {MAX_JSON_FIELDS} fields; name them in schema= with extra=False")
        names += sorted({r["k"] for r in found} - set(names))
    bad = rejected or "_corrupt_record"
    fields = T.StructType([T.StructField(n, T.StringType()) for n in names]).add(bad, T.StringType())
    rows = records.select(F.from_json("value", fields, {"columnNameOfCorruptRecord": bad}).alias("r")).select("r.*")
    rows = rows if rejected else rows.drop(bad)
    return cast_flow_columns(rows, schema) if cast else rows


def _looks_like_array(spark: SparkSession, path: str) -> bool:
    """Whether the first data file at ``path`` (a file, folder or glob on any
    Hadoop file system, possibly compressed) starts with ``[``; reads its first
    non-blank byte."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    todo = [s for s in (fs.globStatus(root) or [])]
    while todo:
        status = todo.pop(0)
        p = status.getPath()
        if p.getName().startswith(("_", ".")):
            continue
        if status.isDirectory():
            todo = [s for s in fs.listStatus(p)] + todo
            continue
        stream = fs.open(p)
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
        stream = codec.createInputStream(stream) if codec is not None else stream
        try:
            byte = stream.read()
            while byte in _JSON_SPACE:
                byte = stream.read()
        finally:
            stream.close()
        if byte >= 0:
            return byte == ord("[")
    return False


def read_flows(spark: SparkSession, path: str, fmt: str | None = None, partitions: int | None = None,
               **options) -> DataFrame:
    """Load a flow table; the reader is chosen by extension unless ``fmt`` is given.

    Unknown formats raise ``ValueError``. Capture files (``pcap``) are decoded
    and rolled up into flows by :func:`flowlens.sources.packets.read_capture_flows`.
    ``partitions`` spreads an input of too few splits over the cores (see
    :mod:`flowlens.sources.parallelism`); by default the file order is kept.
    """
    fmt = (fmt or detect_format(path)).lower()
    if fmt == "parquet":
        return spread(spark.read.parquet(path), partitions)
    if fmt == "csv":
        return spread(read_csv_flows(spark, path, **options), partitions)
    if fmt == "json":
        return spread(read_json_flows(spark, path, **options), partitions)
    if fmt == "pcap":
        from flowlens.sources.packets import read_capture_flows
        return read_capture_flows(spark, path, **options)
    raise ValueError(f"Unsupported format {fmt!r}; use one of {SUPPORTED}")
