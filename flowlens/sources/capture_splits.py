"""Capture files read in byte ranges, by a Python data source.

``spark.read.format("flowlens_capture").load(folder)``: one task per range of
about ``splitBytes`` of a plain pcap file. A range owns the records whose
header starts in it. Its task finds the first one by starting four of the
longest records before the range: the first place from which headers chain, every
one plausible (length within the file's snap length, time near its first
packet), into the range. A wrong start can only lie inside one record's data, so
its chain breaks there or joins the true one at that record's end, well before
the range. Ranges are read in pieces of ``READ_BYTES``, so neither a task's
memory nor a 2 GB limit bounds a file.

gzip files can't be entered in the middle, the packets of a pcapng file need the
interfaces described before them, and a pcap file may state no usable snap
length: these are one task per file, read in the same pieces. Files are opened by URI through pyarrow (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import fnmatch
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from flowlens.schema import PACKET_SCHEMA
from flowlens.sources.packets import (CHUNK_PACKETS, PCAP_MAGIC, PCAPNG_SHB, PcapngWalk, PcapWalk, _decode_packets,
                                      _Records, unknown_interfaces)

FORMAT = "flowlens_capture"
SPLIT_BYTES = 128 << 20
READ_BYTES = 16 << 20
MIN_RECORD = 64 << 10            # a plausible record's data: the file's snap length, or this
MAX_SNAP = 1 << 20
MAX_DAYS = 3660                  # a plausible time is this near to the file's first packet
STATUS_SCHEMA = "path string, start long, packets long, bytes_used long, bytes_total long, error string"

_PACKETS_ARROW = pa.schema([
    ("timestamp", pa.timestamp("us", "UTC")), ("src_ip", pa.string()), ("dst_ip", pa.string()),
    ("src_port", pa.int64()), ("dst_port", pa.int64()), ("protocol", pa.string()), ("bytes", pa.int64()),
    ("packets", pa.int64()), ("duration", pa.float64())])
_STATUS_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("packets", pa.int64()),
                           ("bytes_used", pa.int64()), ("bytes_total", pa.int64()), ("error", pa.string())])


# --- bytes of a file, from any place or in one pass ------------------------------

class _Plain:
    """A file read at any place."""

    def __init__(self, file):
        self.file, self.size, self.fault = file, file.size(), None

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at)


class _Gzip:
    """A gzip file (of any number of members) read forwards; what lies before the
    last place asked for is forgotten. ``fault`` says why it ended early."""

    def __init__(self, file):
        self.file, self.held, self.start, self.fault, self.ended = file, b"", 0, None, False
        self.member = zlib.decompressobj(31)
        self.begun = False
        self.rest = b""

    def _more(self) -> bytes:
        try:
            raw = self.rest or self.file.read(1 << 20)
            self.rest = b""
            if not raw:
                self.ended = True
                if self.begun and not self.member.eof:
                    self.fault = "gzip: file ends inside a member"
                return b""
            if self.member.eof:
                self.member, self.begun = zlib.decompressobj(31), False
            self.begun = True
            out = self.member.decompress(raw, 4 << 20)
            self.rest = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            return out
        except zlib.error as e:
            self.fault, self.ended = f"gzip: {e}", True
            return b""

    def read(self, at: int, n: int) -> bytes:
        parts, have = [self.held[at - self.start:]], len(self.held) - (at - self.start)
        while have < n and not self.ended:
            parts.append(self._more())
            have += len(parts[-1])
        self.held, self.start = b"".join(parts), at
        return self.held[:n]


# --- the first record of a range ---------------------------------------------------

def max_record(header: bytes) -> int | None:
    """The longest plausible record by the file header's snap length; None if
    that is no bound to search with (the file is then one range)."""
    snap = struct.unpack_from(PCAP_MAGIC[struct.unpack_from("<I", header, 0)[0]][0] + "I", header, 16)[0]
    return max(snap, MIN_RECORD) if 0 < snap <= MAX_SNAP else None


def _plausible(buf: bytes, walk: PcapWalk, longest: int, first_sec: int) -> np.ndarray:
    """For each place of ``buf`` whether a plausible record header starts there."""
    a = np.frombuffer(buf, np.uint8)
    if len(a) < 16:
        return np.zeros(0, bool)
    order = range(4) if walk.endian == "<" else range(3, -1, -1)
    words = sum(a[k:len(a) - 3 + k].astype(np.int64) << (8 * j) for j, k in enumerate(order))
    n = len(a) - 15
    sec, frac, incl = (words[4 * i:4 * i + n] for i in range(3))
    return (np.abs(sec - first_sec) <= MAX_DAYS * 86400) & (frac * walk.to_ns < 1_000_000_000) & (incl <= longest)


def first_record(source, start: int, walk: PcapWalk, longest: int, first_sec: int) -> int | None:
    """Where the first record header at or after ``start`` lies; the end of the
    file if there is none, None if no headers chain."""
    base = max(24, start - 4 * longest)
    buf = source.read(base, start - base + 4 * longest)
    good = _plausible(buf, walk, longest, first_sec)
    known = base == 24                           # the file's first header needs no search
    lost: set = set()                            # places from which no chain goes on
    for place in ([24] if known else (base + np.flatnonzero(good)).tolist()):
        at, found, seen = place, None, []
        while at not in lost:
            if found is None and at >= start:
                found = at
            if source.size - at < 16:            # the file ends here, or in a header or record cut off
                return source.size if found is None else min(found, source.size)
            if found is not None and (known or at >= place + 2 * longest):
                return found
            if at - base >= len(good) or not (known or good[at - base]):
                break
            seen.append(at)
            at += 16 + walk.record.unpack_from(buf, at - base)[2]
        lost.update(seen)
    return None


# --- packets of a range -----------------------------------------------------------

def _walked(source, walk, start: int, end: int | None, head_error: list):
    """(buffer, records) over the records that start in ``start .. end`` (None: to the end)."""
    at, want = start, READ_BYTES
    while end is None or at < end:
        buf = source.read(at, want)
        last = len(buf) < want
        records = _Records()
        try:
            moved = walk.walk(buf, 0, len(buf) if end is None else min(len(buf), end - at), records, last)
        except struct.error as e:
            records.error, moved = f"damaged: {e}", 0
        if records.error:
            head_error.append(f"from byte {at}: {records.error}")
        yield at, buf, records, moved
        if records.error or last:
            return
        at += moved
        # a record longer than what was read: read more, within what one may hold
        want = READ_BYTES if moved else want * 4
        if want > 64 * READ_BYTES:
            head_error.append(f"record at byte {at} is longer than {want // 4} bytes")
            return


class CaptureRange(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


def _open(path: str):
    from pyarrow import fs
    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def _kind(head: bytes) -> str:
    magic = struct.unpack_from("<I", head, 0)[0] if len(head) >= 4 else None
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if magic in PCAP_MAGIC and len(head) >= 24:
        return "pcap"
    return "pcapng" if magic == PCAPNG_SHB else "empty" if not head else "unknown"


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options.get("path"), options.get("glob", "*.pcap*")
        self.strict = options.get("strict", "true") == "true"
        self.status = options.get("status", "false") == "true"
        self.split = int(options.get("splitBytes") or SPLIT_BYTES)

    def partitions(self):
        from pyarrow import fs
        uri = self.path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", self.path) else os.path.abspath(self.path)
        where, name = fs.FileSystem.from_uri(uri)
        prefix = uri[:len(uri) - len(name.lstrip("/"))] if uri.endswith(name.lstrip("/")) else ""
        info = where.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else \
            where.get_file_info(fs.FileSelector(name, recursive=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            hidden = any(p.startswith(("_", ".")) for p in f.path[len(name):].split("/") if p)
            if f.type != fs.FileType.File or hidden or not fnmatch.fnmatch(os.path.basename(f.path), self.glob):
                continue
            path = prefix + f.path.lstrip("/") if prefix else f.path
            with where.open_input_file(f.path) as file:
                head = file.read(24)
            if _kind(head) == "pcap" and max_record(head):
                out += [CaptureRange(path, a, min(a + self.split, f.size)) for a in range(0, f.size, self.split)]
            else:
                out.append(CaptureRange(path, 0, None))
        return out or [CaptureRange("", 0, 0)]

    def read(self, part: CaptureRange):
        if not part.path:
            return
        with _open(part.path) as file:
            yield from self._read(part, file)

    def _read(self, part: CaptureRange, file):
        source = _Plain(file)
        if _kind(source.read(0, 24)) == "gzip":
            file.seek(0)
            source = _Gzip(file)
        head = source.read(0, 24)
        kind, errors, packets, used, walk = _kind(head), [], 0, 0, None
        if kind == "pcap":
            walk, start = PcapWalk(head), 24
            if part.start:
                first_sec = struct.unpack(walk.endian + "I", source.read(24, 4).ljust(4, b"\0"))[0]
                start = first_record(source, part.start, walk, max_record(head), first_sec)
                if start is None:
                    errors.append(f"no records chain from byte {part.start} on")
                    if self.strict:
                        raise ValueError(f"{part.path}: {errors[0]}")
                    start, walk = part.end, None
            used = 24 if not part.start else 0
        elif kind == "pcapng":
            walk, start = PcapngWalk(), 0
        elif kind == "empty":
            errors.append("empty file")
        else:
            errors.append(f"unknown magic number {head[:4].hex()}")
            if self.strict:
                raise ValueError(f"{part.path}: {errors[0]}")
        end, total = part.end, None
        if walk:
            for at, buf, records, moved in _walked(source, walk, start, end, errors):
                packets += len(records.starts)
                used += moved
                total = at + len(buf)
                for lo in range(0, len(records.starts) if not self.status else 0, CHUNK_PACKETS):
                    frame = _decode_packets(buf, *records.arrays(lo, lo + CHUNK_PACKETS))
                    if len(frame):
                        frame["timestamp"] = frame["timestamp"].dt.tz_localize("UTC")
                        yield pa.RecordBatch.from_pandas(frame, _PACKETS_ARROW, preserve_index=False)
            if kind == "pcapng":
                errors.append(unknown_interfaces(walk.unknown))
        if source.fault:
            errors.append(source.fault)
        if self.status:
            size = source.size if isinstance(source, _Plain) else total or 0
            error = next((e for e in errors if e), None)
            yield pa.RecordBatch.from_pylist(
                [{"path": part.path, "start": part.start, "packets": packets, "bytes_used": used,
                  "bytes_total": size, "error": error}], schema=_STATUS_ARROW)


class CaptureSource(DataSource):
    """Options: ``path``, ``glob``, ``strict``, ``splitBytes``; ``status`` gives a
    row per range instead of its packets."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return STATUS_SCHEMA if self.options.get("status", "false") == "true" else PACKET_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options)


def load(spark: SparkSession, path: str, glob: str = "*.pcap*", strict: bool = True,
         split_bytes: int | None = None, status: bool = False) -> DataFrame:
    """Packets (or, with ``status``, one row per range) of the captures under ``path``."""
    spark.dataSource.register(CaptureSource)
    return (spark.read.format(FORMAT).option("glob", glob).option("strict", str(strict).lower())
            .option("status", str(status).lower()).option("splitBytes", str(split_bytes or SPLIT_BYTES)).load(path))
