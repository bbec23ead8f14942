"""Capture files (pcap / pcapng) to packet rows, as a Spark job.

:func:`read_packets` reads files in byte ranges
(:mod:`flowlens.sources.capture_splits`), of any size; :func:`decode_binary`
decodes captures that are binary rows of a table. Only record boundaries are
walked in Python; all header fields are then read with NumPy gathers,
``CHUNK_PACKETS`` packets at a time.

Files may be gzip-compressed. A file that is no capture raises by default; a
file that ends or breaks in the middle gives the packets before the fault (and
those of later ranges of the file, whose headers chain again).
:func:`capture_status` reports every file: packets, bytes used, error.

Kept: IPv4 packets (Ethernet with up to two VLAN tags, raw IP, Linux cooked
v1/v2, BSD loopback). Ports are 0 when absent (ICMP, non-first fragments,
truncated headers). Protocol label: TCP, UDP, ICMP, else ``IP_<n>``.
``bytes`` is the original (wire) length of the frame.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.schema import PACKET_SCHEMA

PCAP_MAGIC = {
    0xA1B2C3D4: ("<", 1_000),      # microseconds -> nanoseconds factor
    0xD4C3B2A1: (">", 1_000),
    0xA1B23C4D: ("<", 1),          # nanoseconds
    0x4D3CB2A1: (">", 1),
}
PCAPNG_SHB = 0x0A0D0D0A
LINK_NULL, LINK_ETHERNET, LINK_RAW, LINK_SLL, LINK_IPV4, LINK_SLL2 = 0, 1, 101, 113, 228, 276
ETHERTYPE_IPV4, ETHERTYPE_VLAN, ETHERTYPE_QINQ = 0x0800, 0x8100, 0x88A8
PROTO_ICMP, PROTO_TCP, PROTO_UDP = 1, 6, 17

CHUNK_PACKETS = 100_000

PACKET_COLUMNS = [f.name for f in PACKET_SCHEMA.fields]


# --- record walking (returns per-record arrays) ---------------------------

class _Records:
    """Record boundaries of a capture as they are found: packets keep what was
    read before a fault; ``used`` bytes were understood, ``error`` says why
    the walk ended early (None at the end of the file)."""

    def __init__(self):
        self.starts, self.caps, self.origs, self.ts, self.links, self.has_ts = [], [], [], [], [], []
        self.used, self.error = 0, None

    def add(self, start, cap, orig, ts, link, has_ts=True):
        for column, value in zip((self.starts, self.caps, self.origs, self.ts, self.links, self.has_ts),
                                 (start, cap, orig, ts, link, has_ts)):
            column.append(value)

    def arrays(self, lo: int, hi: int):
        ints = [np.array(c[lo:hi], dtype=np.int64) for c in
                (self.starts, self.caps, self.origs, self.ts, self.links)]
        return *ints, np.array(self.has_ts[lo:hi], dtype=bool)


class PcapWalk:
    """Walks the records of a pcap file, buffer by buffer; ``header`` is its first 24 bytes."""

    def __init__(self, header: bytes):
        self.endian, self.to_ns = PCAP_MAGIC[struct.unpack_from("<I", header, 0)[0]]
        self.link = struct.unpack_from(self.endian + "I", header, 20)[0] & 0x0FFFFFFF
        self.record = struct.Struct(self.endian + "IIII")

    def walk(self, buf: bytes, at: int, end: int, out: _Records, last: bool) -> int:
        """Add the records that start in ``buf[at:end]`` and return where the next
        one starts. One that ``buf`` cuts off is left, and a fault if ``last``."""
        n = len(buf)
        while at < end:
            if at + 16 > n:
                out.error = f"record header cut off at byte {at}" if last else None
                break
            sec, frac, incl, orig = self.record.unpack_from(buf, at)
            if at + 16 + incl > n:
                out.error = f"record at byte {at} is longer than the file" if last else None
                break
            out.add(at + 16, incl, orig, sec * 1_000_000_000 + frac * self.to_ns, self.link)
            at += 16 + incl
            out.used = at
        return at


class PcapngWalk:
    """Walks the blocks of a pcapng file, buffer by buffer, keeping the
    interfaces of the current section. ``unknown`` counts the packets of
    interfaces that no block describes; they are not read."""

    def __init__(self):
        self.endian, self.links, self.tsres, self.unknown = "<", [], [], 0

    def walk(self, buf: bytes, at: int, end: int, out: _Records, last: bool) -> int:
        """As :meth:`PcapWalk.walk`, block by block."""
        n = len(buf)
        while at < end:
            if at + 12 > n:
                out.error = f"block cut off at byte {at}" if last else None
                break
            if struct.unpack_from("<I", buf, at)[0] == PCAPNG_SHB:
                bom = struct.unpack_from("<I", buf, at + 8)[0]
                self.endian = "<" if bom == 0x1A2B3C4D else ">"
                self.links, self.tsres = [], []
            btype, blen = struct.unpack_from(self.endian + "II", buf, at)
            if blen < 12 or at + blen > n:
                out.error = f"block at byte {at} has length {blen}" if last or blen < 12 else None
                break
            if not self._block(buf, at, btype, blen, out):
                break
            at += blen
            out.used = at
        return at

    def _block(self, buf: bytes, at: int, btype: int, blen: int, out: _Records) -> bool:
        body, endian = at + 8, self.endian
        if btype == 1:                                   # interface description
            res = 1_000                                  # default 1e-6 s -> ns factor
            o, end = body + 8, at + blen - 4
            while o + 4 <= end:
                code, ln = struct.unpack_from(endian + "HH", buf, o)
                if code == 0:
                    break
                if code == 9 and ln >= 1:
                    v = buf[o + 4]
                    res = (1e9 / (2 ** (v & 0x7F))) if v & 0x80 else (1e9 / (10 ** v))
                o += 4 + ((ln + 3) & ~3)
            self.links.append(struct.unpack_from(endian + "H", buf, body)[0])
            self.tsres.append(res)
        elif btype == 6:                                 # enhanced packet
            iface, hi, lo, incl, orig = struct.unpack_from(endian + "IIIII", buf, body)
            if incl > blen - 32:
                out.error = f"packet in the block at byte {at} is longer than the block"
                return False
            if iface < len(self.links):
                out.add(body + 20, incl, orig, int(((hi << 32) | lo) * self.tsres[iface]), self.links[iface])
            else:
                self.unknown += 1
        elif btype == 3:                                 # simple packet (no time)
            orig = struct.unpack_from(endian + "I", buf, body)[0]
            if self.links:
                out.add(body + 4, min(orig, blen - 16), orig, 0, self.links[0], False)
            else:
                self.unknown += 1
        return True


def unknown_interfaces(n: int) -> str | None:
    return f"{n} packets of undescribed interfaces" if n else None


def plain_bytes(buf: bytes) -> tuple[bytes, str | None]:
    """The bytes of a possibly gzip-compressed file, as far as they go, and the fault."""
    if buf[:2] != b"\x1f\x8b":
        return buf, None
    try:
        return gzip.decompress(buf), None
    except (OSError, EOFError, zlib.error) as e:
        parts, rest = [], buf
        try:
            while rest:
                d = zlib.decompressobj(31)
                parts.append(d.decompress(rest))
                rest = d.unused_data
        except zlib.error:
            pass
        return b"".join(parts), f"gzip: {e}"


def walk_capture(buf: bytes) -> _Records:
    """Record boundaries of a capture's (uncompressed) bytes. ``error`` starts
    with ``unknown`` for a file that is no capture."""
    out = _Records()
    magic = struct.unpack_from("<I", buf, 0)[0] if len(buf) >= 4 else None
    try:
        if magic in PCAP_MAGIC and len(buf) >= 24:
            out.used = 24
            PcapWalk(buf).walk(buf, 24, len(buf), out, True)
        elif magic == PCAPNG_SHB:
            walk = PcapngWalk()
            walk.walk(buf, 0, len(buf), out, True)
            out.error = out.error or unknown_interfaces(walk.unknown)
        elif len(buf) == 0:
            out.error = "empty file"
        else:
            out.error = f"unknown magic number {buf[:4].hex()}"
    except struct.error as e:
        out.error = f"damaged after byte {out.used}: {e}"
    return out


# --- vectorised header decoding -----------------------------------------------

def _u8(a: np.ndarray, idx: np.ndarray) -> np.ndarray:
    return a[np.clip(idx, 0, len(a) - 1)].astype(np.int64)


def _u16(a: np.ndarray, idx: np.ndarray) -> np.ndarray:
    return (_u8(a, idx) << 8) | _u8(a, idx + 1)


def _ip_text(a: np.ndarray, idx: np.ndarray) -> pd.Series:
    parts = [pd.Series(_u8(a, idx + i)).astype(str) for i in range(4)]
    return parts[0] + "." + parts[1] + "." + parts[2] + "." + parts[3]


def decode_capture(buf: bytes) -> pd.DataFrame:
    """Packet rows (PACKET schema) of one capture file's bytes: the packets
    before a fault; a file that is no capture gives no rows (see
    :func:`walk_capture` for the reason)."""
    buf, _ = plain_bytes(buf)
    records = walk_capture(buf)
    chunks = list(_decoded(buf, records))
    return pd.concat(chunks, ignore_index=True) if chunks else \
        pd.DataFrame({c: pd.Series(dtype="object") for c in PACKET_COLUMNS})


def _decoded(buf: bytes, records: _Records) -> Iterator[pd.DataFrame]:
    for lo in range(0, len(records.starts), CHUNK_PACKETS):
        out = _decode_packets(buf, *records.arrays(lo, lo + CHUNK_PACKETS))
        if len(out):
            yield out


def _decode_packets(buf: bytes, starts, caps, origs, ts, link, has_ts) -> pd.DataFrame:
    a = np.frombuffer(buf, dtype=np.uint8)
    l2 = np.full(len(starts), -1, dtype=np.int64)
    # Ethernet (+ up to two VLAN tags)
    eth = link == LINK_ETHERNET
    etype = _u16(a, starts + 12)
    shift = np.zeros_like(starts)
    for _ in range(2):
        tagged = eth & ((etype == ETHERTYPE_VLAN) | (etype == ETHERTYPE_QINQ))
        shift = np.where(tagged, shift + 4, shift)
        etype = np.where(tagged, _u16(a, starts + 12 + shift), etype)
    l2 = np.where(eth & (etype == ETHERTYPE_IPV4), 14 + shift, l2)
    # raw IP: decided by the version nibble below
    l2 = np.where((link == LINK_RAW) | (link == LINK_IPV4), 0, l2)
    l2 = np.where((link == LINK_SLL) & (_u16(a, starts + 14) == ETHERTYPE_IPV4), 16, l2)
    l2 = np.where((link == LINK_SLL2) & (_u16(a, starts) == ETHERTYPE_IPV4), 20, l2)
    fam_le = _u8(a, starts) | (_u8(a, starts + 1) << 8)
    fam_be = _u8(a, starts + 3) | (_u8(a, starts + 2) << 8)
    l2 = np.where((link == LINK_NULL) & ((fam_le == 2) | (fam_be == 2)), 4, l2)

    ip = starts + l2
    ver = _u8(a, ip) >> 4
    ihl = (_u8(a, ip) & 0x0F) * 4
    ok = (l2 >= 0) & (caps >= l2 + 20) & (ver == 4) & (ihl >= 20)
    proto = _u8(a, ip + 9)
    frag = ((_u8(a, ip + 6) & 0x1F) << 8) | _u8(a, ip + 7)
    l4 = ip + ihl
    l4_ok = (frag == 0) & (caps >= l2 + ihl + 4)
    tcp = (proto == PROTO_TCP) & l4_ok
    udp = (proto == PROTO_UDP) & l4_ok
    icmp = (proto == PROTO_ICMP) & (frag == 0)
    sport = np.where(tcp | udp, _u16(a, l4), 0)
    dport = np.where(tcp | udp, _u16(a, l4 + 2), 0)
    label = np.where(tcp, "TCP", np.where(udp, "UDP", np.where(icmp, "ICMP", None)))
    label = pd.Series(label, dtype="object")
    other = label.isna()
    label[other] = "IP_" + pd.Series(proto[other.to_numpy()]).astype(str).to_numpy()

    keep = np.flatnonzero(ok)
    ts_col = pd.to_datetime(ts[keep], unit="ns").astype("datetime64[us]")
    ts_col = pd.Series(ts_col).where(pd.Series(has_ts[keep]), pd.NaT)
    return pd.DataFrame({
        "timestamp": ts_col.reset_index(drop=True),
        "src_ip": _ip_text(a, ip[keep] + 12).reset_index(drop=True),
        "dst_ip": _ip_text(a, ip[keep] + 16).reset_index(drop=True),
        "src_port": sport[keep],
        "dst_port": dport[keep],
        "protocol": label.iloc[keep].reset_index(drop=True),
        "bytes": origs[keep],
        "packets": np.ones(len(keep), dtype=np.int64),
        "duration": np.zeros(len(keep), dtype=float),
    })


def _decoder(strict: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = pdf["path"] if "path" in pdf else [None] * len(pdf)
            for path, content in zip(paths, pdf["content"]):
                buf, _ = plain_bytes(bytes(content))
                records = walk_capture(buf)
                if strict and (records.error or "").startswith("unknown"):
                    raise ValueError(f"{path or 'capture'}: {records.error}")
                yield from _decoded(buf, records)
    return run


def decode_binary(files: DataFrame, strict: bool = True) -> DataFrame:
    """Binary rows (column ``content``, optionally ``path``) to packet rows, one
    task per file batch. ``strict`` raises on a file that is no capture."""
    cols = ["path", "content"] if "path" in files.columns else ["content"]
    return files.select(*cols).mapInPandas(_decoder(strict), PACKET_SCHEMA)


def read_packets(spark: SparkSession, path: str, glob: str = "*.pcap*", strict: bool = True,
                 split_bytes: int | None = None) -> DataFrame:
    """Packet rows of every capture file under ``path`` (a file or folder on any
    file system that pyarrow opens by URI), a plain pcap file in ranges of about
    ``split_bytes``; see :mod:`flowlens.sources.capture_splits`. ``strict``
    raises on a file that is no capture."""
    from flowlens.sources.capture_splits import load
    return load(spark, path, glob, strict, split_bytes)


def capture_status(spark: SparkSession, path: str, glob: str = "*.pcap*",
                   split_bytes: int | None = None) -> DataFrame:
    """One row per file under ``path``: path, packets, bytes_used, bytes_total
    (uncompressed), error (NULL for a whole capture; the first one found)."""
    from flowlens.sources.capture_splits import load
    parts = load(spark, path, glob, False, split_bytes, status=True)
    return parts.groupBy("path").agg(
        F.sum("packets").alias("packets"), F.sum("bytes_used").alias("bytes_used"),
        F.max("bytes_total").alias("bytes_total"), F.min_by("error", "start").alias("error"))


def read_capture_flows(spark: SparkSession, path: str, glob: str = "*.pcap*", strict: bool = True) -> DataFrame:
    """Capture files rolled up into flows by 5-tuple."""
    from flowlens.operators.flows_rollup import agg_flows
    return agg_flows(read_packets(spark, path, glob, strict))
