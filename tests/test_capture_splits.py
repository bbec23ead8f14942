"""Captures read in byte ranges give the packets of the whole file."""

import gzip
import os
import random
import struct

import pytest

import flowlens.sources.capture_splits as C
from flowlens.sources.capture_splits import CaptureReader, CaptureRange, load
from flowlens.sources.packets import capture_status, decode_capture, read_packets
from test_packets import ETH_IPV4, T0, _block, _pcapng, ipv4, pcap, tcp


def frames(rng, n, payload=200):
    out = []
    for i in range(n):
        body = bytes(rng.randrange(256) for _ in range(rng.randrange(payload)))
        if i % 9 == 0:       # a packet that carries a piece of another capture, up to its last byte
            body = pcap([(T0 + i, 5, bytes(rng.randrange(60)), 60) for _ in range(4)])[24:]
        if i % 10 == 0:
            body = b"\0" * 300
        out.append((T0 + i // 7, i % 1_000_000, ETH_IPV4 + ipv4([10, 0, i >> 8 & 255, i & 255], [9, 9, 9, 9], 6,
                                                                  tcp(i % 65536, 80) + body), 60 + i))
    return out


def small_snap(data, endian="<", snap=400):
    return data[:16] + struct.pack(endian + "I", snap) + data[20:]


def packets_of(path, split, **options):
    reader = CaptureReader({"path": path, "splitBytes": str(split), **options})
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    return rows, parts


def rows_of(frame):
    return [(t, *r) for t, *r in zip(frame.timestamp.dt.tz_localize("UTC"), *(frame[c] for c in frame.columns[1:]))]


@pytest.fixture()
def short_records(monkeypatch):
    monkeypatch.setattr(C, "MIN_RECORD", 400)
    monkeypatch.setattr(C, "READ_BYTES", 3000)


@pytest.mark.parametrize("endian, nanos", [("<", False), (">", True)])
def test_ranges_of_any_size_give_the_same_packets(tmp_out, short_records, endian, nanos):
    data = small_snap(pcap(frames(random.Random(1), 700), endian, nanos), endian)
    path = os.path.join(tmp_out, "a.pcap")
    with open(path, "wb") as fh:
        fh.write(data)
    want = rows_of(decode_capture(data))
    assert len(want) == 700
    for split in (1000, 1777, 5000, 31_337, len(data), 10**9):
        got, parts = packets_of(path, split)
        assert len(parts) == -(-len(data) // split)
        assert [tuple(r.values()) for r in got] == want


def test_every_place_finds_the_next_true_header(tmp_out, short_records):
    data = small_snap(pcap(frames(random.Random(2), 60)))
    headers, at = [], 24
    while at < len(data):
        headers.append(at)
        at += 16 + struct.unpack_from("<I", data, at + 8)[0]
    headers.append(len(data))

    class Bytes:
        size = len(data)

        def read(self, at, n):
            return data[at:at + n]
    walk = C.PcapWalk(data[:24])
    for start in range(25, len(data)):
        assert C.first_record(Bytes(), start, walk, 400, T0) == next(h for h in headers if h >= start)


def test_a_cut_file_and_a_damaged_middle(spark, tmp_out, short_records):
    data = small_snap(pcap(frames(random.Random(3), 400)))
    cut, broken = data[:-7], bytearray(data)
    broken[30_000:30_500] = b"\xff" * 500
    for name, content in (("cut.pcap", cut), ("broken.pcap", bytes(broken))):
        with open(os.path.join(tmp_out, name), "wb") as fh:
            fh.write(content)
    got, _ = packets_of(os.path.join(tmp_out, "cut.pcap"), 4000)
    assert [tuple(r.values()) for r in got] == rows_of(decode_capture(data))[:-1]
    whole, before = rows_of(decode_capture(data)), rows_of(decode_capture(bytes(broken)))
    got = [tuple(r.values()) for r in packets_of(os.path.join(tmp_out, "broken.pcap"), 4000)[0]]
    assert got[:len(before)] == before and set(got) <= set(whole) and len(got) > len(whole) - 60
    reader = CaptureReader({"path": tmp_out, "splitBytes": "4000", "status": "true"})
    errors = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist() if r["error"]]
    assert {os.path.basename(r["path"]) for r in errors} == {"cut.pcap", "broken.pcap"}


def test_gzip_pcapng_and_unusable_snap_lengths_are_one_range(tmp_out, short_records):
    many = frames(random.Random(4), 300)
    plain = pcap(many)[:16] + struct.pack("<I", 0) + pcap(many)[20:]
    blocks = [_block(6, struct.pack("<IIIII", 0, 0, i, len(f), o) + f) for i, (_, _, f, o) in enumerate(many)]
    nowhere = _block(6, struct.pack("<IIIII", 7, 0, 1, 4, 4) + b"\0" * 4)
    ng = _pcapng(*blocks, nowhere)
    files = {"zero.pcap": plain, "a.pcapng": ng, "a.pcap.gz": gzip.compress(plain[:9000]) + gzip.compress(plain[9000:])}
    for name, content in files.items():
        with open(os.path.join(tmp_out, name), "wb") as fh:
            fh.write(content)
        got, parts = packets_of(os.path.join(tmp_out, name), 1000)
        assert len(parts) == 1
        assert [tuple(r.values()) for r in got] == rows_of(decode_capture(content)) and len(got) == 300
    reader = CaptureReader({"path": os.path.join(tmp_out, "a.pcapng"), "status": "true"})
    (status,) = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert status["error"] == "1 packets of undescribed interfaces" and status["bytes_used"] == len(ng)


def test_one_file_is_read_by_several_tasks(spark, tmp_out):
    data = pcap(frames(random.Random(5), 4000, payload=1000))
    os.makedirs(os.path.join(tmp_out, "in", "sub"))
    for name in ("in/a.pcap", "in/sub/b.pcap", "in/_hidden.pcap", "in/notes.txt"):
        with open(os.path.join(tmp_out, name), "wb") as fh:
            fh.write(data)
    folder = os.path.join(tmp_out, "in")
    df = read_packets(spark, folder, split_bytes=300_000)
    assert df.rdd.getNumPartitions() == 2 * -(-len(data) // 300_000) > 10
    want = rows_of(decode_capture(data))
    got = [(r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol, r.bytes) for r in df.collect()]
    assert sorted(got) == sorted(w[1:7] for w in want * 2)
    status = capture_status(spark, "file://" + folder, split_bytes=300_000).collect()
    assert [(r.packets, r.bytes_used, r.bytes_total, r.error) for r in status] == [(4000, len(data), len(data), None)] * 2
    assert load(spark, folder, glob="*.none").count() == 0


def test_a_file_over_2_gb(tmp_out):
    """A sparse file: a capture, a hole of 3 GB that one range spans, records at its end."""
    head = pcap(frames(random.Random(6), 5))
    tail = pcap(frames(random.Random(7), 3000, payload=900))[24:]
    path = os.path.join(tmp_out, "big.pcap")
    far = 3 << 30
    with open(path, "wb") as fh:
        fh.write(head)
        fh.seek(far)
        fh.write(tail)
    reader = CaptureReader({"path": path, "splitBytes": str(64 << 20), "strict": "false"})
    parts = reader.partitions()
    assert parts[-1].end == far + len(tail) and len(parts) == 49
    rows = [r for b in reader.read(CaptureRange(parts[-1].path, far + 500_000, far + len(tail)))
            for r in b.to_pylist()]
    want = rows_of(decode_capture(head[:24] + tail))
    assert 1000 < len(rows) < 3000 and [tuple(r.values()) for r in rows] == want[-len(rows):]
