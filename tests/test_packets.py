
import datetime as dt
import gzip
import os
import struct

import pytest

from flowlens.sources.packets import capture_status, decode_capture, read_capture_flows, read_packets

ETH_IPV4 = b"\0" * 12 + b"\x08\x00"
T0 = 1704103200  # 2024-01-01 10:00:00 UTC


def ipv4(src, dst, proto, l4=b"", frag=0):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(l4), 0, frag, 64, proto, 0,
                       bytes(src), bytes(dst)) + l4


def tcp(sport, dport):
    return struct.pack(">HH", sport, dport) + b"\0" * 16


def pcap(frames, endian="<", nanos=False, link=1):
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    out = [struct.pack(endian + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)]
    for ts, frac, frame, orig in frames:
        out.append(struct.pack(endian + "IIII", ts, frac, len(frame), orig))
        out.append(frame)
    return b"".join(out)


def test_pcap_little_endian_tcp_udp_icmp_other():
    frames = [
        (T0, 0, ETH_IPV4 + ipv4([10, 0, 0, 1], [10, 0, 0, 2], 6, tcp(40000, 502)), 60),
        (T0, 500000, ETH_IPV4 + ipv4([10, 0, 0, 1], [8, 8, 8, 8], 17, tcp(5353, 53)), 70),
        (T0 + 1, 0, ETH_IPV4 + ipv4([10, 0, 0, 3], [10, 0, 0, 4], 1, b"\x08\0\0\0"), 80),
        (T0 + 2, 0, ETH_IPV4 + ipv4([10, 0, 0, 3], [10, 0, 0, 4], 47, b"\0\0\0\0"), 90),
        (T0 + 3, 0, b"\0" * 12 + b"\x86\xdd" + b"\0" * 40, 100),          # IPv6: skipped
    ]
    df = decode_capture(pcap(frames))
    assert list(df.protocol) == ["TCP", "UDP", "ICMP", "IP_47"]
    assert list(df.src_port) == [40000, 5353, 0, 0] and list(df.dst_port) == [502, 53, 0, 0]
    assert list(df.bytes) == [60, 70, 80, 90]
    assert df.timestamp.iloc[1] == dt.datetime(2024, 1, 1, 10, 0, 0, 500000)
    assert list(df.dst_ip) == ["10.0.0.2", "8.8.8.8", "10.0.0.4", "10.0.0.4"]


def test_pcap_big_endian_nanos_vlan_and_fragment():
    vlan = b"\0" * 12 + b"\x81\x00\x00\x01\x08\x00"
    frames = [
        (T0, 250_000_000, vlan + ipv4([192, 168, 1, 5], [10, 1, 1, 1], 6, tcp(1, 2)), 64),
        (T0, 0, ETH_IPV4 + ipv4([192, 168, 1, 5], [10, 1, 1, 1], 6, tcp(1, 2), frag=0x0010), 64),
    ]
    df = decode_capture(pcap(frames, endian=">", nanos=True))
    assert list(df.protocol) == ["TCP", "IP_6"]
    assert df.src_ip.iloc[0] == "192.168.1.5" and df.dst_port.iloc[0] == 2
    assert df.timestamp.iloc[0] == dt.datetime(2024, 1, 1, 10, 0, 0, 250000)


def test_pcap_raw_ip_link():
    frames = [(T0, 0, ipv4([10, 0, 0, 1], [10, 0, 0, 2], 17, tcp(1000, 2000)), 33)]
    df = decode_capture(pcap(frames, link=101))
    assert list(df.protocol) == ["UDP"] and list(df.dst_port) == [2000]


def _block(btype, body, endian="<"):
    pad = (-len(body)) % 4
    ln = 12 + len(body) + pad
    return struct.pack(endian + "II", btype, ln) + body + b"\0" * pad + struct.pack(endian + "I", ln)


def test_pcapng_blocks():
    shb = _block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    opt = struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0)    # ns resolution
    idb = _block(1, struct.pack("<HHI", 1, 0, 65535) + opt)
    frame = ETH_IPV4 + ipv4([10, 0, 0, 1], [10, 0, 0, 2], 6, tcp(1234, 102))
    ts = T0 * 1_000_000_000 + 7
    epb = _block(6, struct.pack("<IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(frame), 1500) + frame)
    df = decode_capture(shb + idb + epb + epb)
    assert len(df) == 2 and list(df.dst_port) == [102, 102] and list(df.bytes) == [1500, 1500]
    assert df.timestamp.iloc[0] == dt.datetime(2024, 1, 1, 10, 0, 0)


def _pcapng(*blocks):
    shb = _block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    return shb + _block(1, struct.pack("<HHI", 1, 0, 65535)) + b"".join(blocks)


def test_packets_before_a_fault_are_kept(spark, tmp_out):
    frame = ETH_IPV4 + ipv4([1, 2, 3, 4], [5, 6, 7, 8], 6, tcp(1, 2))
    cut = pcap([(T0, 0, frame, 60), (T0 + 1, 0, frame, 60)])[:-5]
    assert len(decode_capture(cut)) == 1
    epb = _block(6, struct.pack("<IIIII", 0, 0, 0, len(frame), 60) + frame)
    bad_length = struct.pack("<II", 6, 4) + b"\0" * 20
    short_body = _block(6, b"\0\0\0\0")
    for last in (bad_length, short_body):
        assert len(decode_capture(_pcapng(epb, epb, epb, last))) == 3
    whole = pcap([(T0, 0, frame, 60)] * 4)
    files = {"cut.pcap": cut, "bad.pcapng": _pcapng(epb, epb, epb, bad_length), "ok.pcap.gz": gzip.compress(whole),
             "half.pcap.gz": gzip.compress(whole)[:-9]}
    for name, data in files.items():
        with open(os.path.join(tmp_out, name), "wb") as fh:
            fh.write(data)
    status = {os.path.basename(r.path): r for r in capture_status(spark, tmp_out).collect()}
    assert {n: r.packets for n, r in status.items() if n != "half.pcap.gz"} == {
        "cut.pcap": 1, "bad.pcapng": 3, "ok.pcap.gz": 4}
    assert status["ok.pcap.gz"].error is None and status["ok.pcap.gz"].bytes_used == len(whole)
    assert all(status[n].error for n in ("cut.pcap", "bad.pcapng", "half.pcap.gz"))
    assert read_packets(spark, tmp_out).count() == sum(r.packets for r in status.values())


def test_a_file_that_is_no_capture_raises(spark, tmp_out):
    with open(os.path.join(tmp_out, "x.pcap"), "wb") as fh:
        fh.write(b"not a capture file at all, really")
    with pytest.raises(Exception, match="unknown magic number"):
        read_packets(spark, tmp_out).count()
    assert read_packets(spark, tmp_out, strict=False).count() == 0
    assert "unknown" in capture_status(spark, tmp_out).first().error


def test_chunks_equal_the_whole():
    import flowlens.sources.packets as P
    frames = [(T0 + i, 0, ETH_IPV4 + ipv4([10, 0, 0, i], [5, 6, 7, 8], 6, tcp(i, 2)), 60) for i in range(23)]
    whole = decode_capture(pcap(frames))
    P.CHUNK_PACKETS, before = 5, P.CHUNK_PACKETS
    try:
        assert decode_capture(pcap(frames)).equals(whole)
    finally:
        P.CHUNK_PACKETS = before


def test_binary_file_source_and_rollup(spark, tmp_out):
    frames = [
        (T0, 0, ETH_IPV4 + ipv4([10, 0, 0, 1], [10, 0, 0, 2], 6, tcp(40000, 502)), 60),
        (T0 + 2, 500000, ETH_IPV4 + ipv4([10, 0, 0, 1], [10, 0, 0, 2], 6, tcp(40000, 502)), 40),
    ]
    other = [(T0, 0, ETH_IPV4 + ipv4([10, 0, 0, 9], [10, 0, 0, 2], 17, tcp(1, 53)), 99)]
    for name, fr in (("a.pcap", frames), ("b.pcap", other)):
        with open(os.path.join(tmp_out, name), "wb") as fh:
            fh.write(pcap(fr))
    assert read_packets(spark, tmp_out).count() == 3
    got = {r.src_ip: (r.bytes, r.packets, r.duration) for r in read_capture_flows(spark, tmp_out).collect()}
    assert got == {"10.0.0.1": (100, 2, 2.5), "10.0.0.9": (99, 1, 1.0)}
    # a single capture file by path, through the format dispatch
    from flowlens.sources.flows import read_flows
    one = read_flows(spark, os.path.join(tmp_out, "a.pcap")).collect()
    assert [(r.src_ip, r.packets) for r in one] == [("10.0.0.1", 2)]
