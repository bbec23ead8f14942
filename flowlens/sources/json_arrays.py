"""JSON documents that are one array of records, read in byte ranges.

Whether a byte lies inside a string, and how deep, depends on all bytes before
it, so a file is read twice. First each range is scanned by itself for the
number of its unescaped quotes and, for both cases, whether it starts inside a
string or outside, for the depth that its brackets add. A running sum over a
file's ranges then gives every range its true start state: exact, whatever the
strings hold. Second, each range emits the records whose opening ``[`` or ``,``
at the array's level lies in it, reading past its end to finish the last one.

The scans are NumPy passes over ``READ_BYTES`` at a time; a task holds that and
one record. Files are listed by Spark, compressed ones are one range each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT_BYTES = 128 << 20
READ_BYTES = 16 << 20
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")

_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "[]{},"]] = True
_STEP = np.zeros(256, np.int64)
_STEP[[ord(c) for c in "[{"]] = 1
_STEP[[ord(c) for c in "]}"]] = -1


def _open(path: str):
    """A stream over the file's bytes, and a function that reads at a place (None if compressed)."""
    from pyarrow import fs
    where, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    if path.endswith(COMPRESSED):
        return where.open_input_stream(name), None
    file = where.open_input_file(name)
    return file, file.read_at


def _chunks(path: str, start: int, end: int | None):
    """The bytes from ``start`` to ``end`` (None: all) in pieces."""
    stream, read_at = _open(path)
    with stream:
        while end is None or start < end:
            want = READ_BYTES if end is None else min(READ_BYTES, end - start)
            piece = read_at(want, start) if read_at else stream.read(want)
            if not piece:
                return
            yield piece
            start += len(piece)


def _escaped_at(path: str, start: int) -> bool:
    """Whether an odd number of backslashes ends right before ``start``."""
    run, step = 0, 64
    stream, read_at = _open(path)
    with stream:
        while read_at and start - run > 0:
            low = max(0, start - run - step)
            before = read_at(start - run - low, low)
            tail = len(before) - len(before.rstrip(b"\\"))
            run += tail
            if tail < len(before):
                break
            step *= 4
    return run % 2 == 1


def _quotes(a: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Places of the unescaped quotes, and whether the byte after ``a`` is escaped."""
    slashes = np.flatnonzero(a == _BACKSLASH)
    quotes = np.flatnonzero(a == _QUOTE)
    if not len(slashes):
        return (quotes[quotes > 0] if escaped else quotes), False
    first = slashes[np.flatnonzero(np.diff(slashes, prepend=-2) != 1)]      # where runs of backslashes start
    run = np.searchsorted(first, quotes - 1, "right") - 1
    after = np.zeros(len(quotes), np.int64)
    before = (quotes > 0) & (a[quotes - 1] == _BACKSLASH)
    after[before] = quotes[before] - first[run[before]]
    if escaped:                                   # a run that goes on from the piece before has one more
        after[before & (first[run] == 0)] += 1
        after[quotes == 0] = 1
    ends = a[-1] == _BACKSLASH
    length = len(a) - first[-1] + (escaped and first[-1] == 0) if ends else 0
    return quotes[after % 2 == 0], bool(length % 2)


def _scan(batches):
    """Quotes of a range, and the depth it adds if it starts outside a string or inside."""
    for batch in batches:
        for path, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
            n, outside, inside, escaped = 0, 0, 0, _escaped_at(path, start) if start else False
            for piece in _chunks(path, start, end) if end is not None else ():
                a = np.frombuffer(piece, np.uint8)
                quotes, escaped = _quotes(a, escaped)
                marks = np.flatnonzero(_MARK[a])
                odd = (np.searchsorted(quotes, marks) + n) % 2 == 1
                steps = _STEP[a[marks]]
                inside += int(steps[odd].sum())
                outside += int(steps[~odd].sum())
                n += len(quotes)
            yield pa.RecordBatch.from_pydict({"path": [path], "start": [start], "end": [end], "quotes": [n],
                                              "outside": [outside], "inside": [inside]}, schema=_SCANNED)


_SCANNED = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("start", "end", "quotes", "outside", "inside"))])


def _records(batches):
    for batch in batches:
        for path, start, end, quoted, depth in zip(*(batch.column(i).to_pylist() for i in range(5))):
            out, size = [], 0
            for record in _records_of(path, start, end, bool(quoted), depth):
                out.append(record.decode("utf-8", "replace"))
                size += len(record)
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def _records_of(path: str, start: int, end: int | None, quoted: bool, depth: int):
    """Texts of the records that open in the range, given its start state."""
    escaped, at, open_parts = _escaped_at(path, start) if start else False, start, None
    for piece in _chunks(path, start, None if end is None else 1 << 62):
        a = np.frombuffer(piece, np.uint8)
        quotes, escaped = _quotes(a, escaped)
        marks = np.flatnonzero(_MARK[a])
        marks = marks[(np.searchsorted(quotes, marks) + quoted) % 2 == 0]
        quoted = (len(quotes) + quoted) % 2 == 1
        kinds = a[marks]
        before = depth + np.cumsum(_STEP[kinds]) - _STEP[kinds]          # depth in front of each mark
        depth = int(depth + _STEP[kinds].sum())
        level = ((kinds == ord("[")) & (before == 0)) | ((kinds == ord(",")) & (before == 1)) \
            | ((kinds == ord("]")) & (before == 1))
        taken = 0
        for m, closes in zip(marks[level].tolist(), (kinds[level] == ord("]")).tolist()):
            if open_parts is not None:
                open_parts.append(piece[taken:m])
                record = b"".join(open_parts).strip()
                open_parts = None
                if record:
                    yield record
            if end is not None and at + m >= end:
                return
            if not closes:
                open_parts, taken = [], m + 1
        if open_parts is not None:
            open_parts.append(piece[taken:])
        elif end is not None and at + len(piece) >= end:
            return
        at += len(piece)
    if open_parts is not None:                    # the document is cut off: its last text, as it is
        record = b"".join(open_parts).strip()
        if record:
            yield record


def array_records(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """``(value)``: the text of every record of the array documents at ``path``
    (a file, folder or glob), in ranges of about ``split_bytes``. A document
    that is cut off ends with a text that is no whole record."""
    split = split_bytes or SPLIT_BYTES
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    packed = F.col("path").rlike(r"\.(gz|bz2|zst|lz4)$")
    ranges = files.select("path", "length", F.when(packed, F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("starts"),
        packed.alias("packed"))
    n = max(1, ranges.agg(F.sum(F.size("starts"))).first()[0] or 0)
    ranges = ranges.select("path", F.explode("starts").alias("start"), "length", "packed").select(
        "path", "start", F.when(~F.col("packed"), F.least(F.col("start") + split, "length")).alias("end"))
    from flowlens.operators.common import materialize
    scanned = materialize(ranges.repartition(n).mapInArrow(
        _scan, "path string, start long, end long, quotes long, outside long, inside long"), "json-ranges")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = scanned.withColumn("quoted", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2) \
        .withColumn("added", F.when(F.col("quoted") == 1, F.col("inside")).otherwise(F.col("outside"))) \
        .withColumn("depth", F.coalesce(F.sum("added").over(earlier), F.lit(0)))
    return state.select("path", "start", "end", "quoted", "depth").repartition(n).mapInArrow(_records, "value string")
