"""JSON arrays in byte ranges: every record once, whatever the strings hold."""

import gzip
import json
import os
import random

import pytest

import flowlens.sources.json_arrays as J
from flowlens.sources.flows import read_json_flows
from flowlens.sources.json_arrays import array_records


def text(rng):
    return "".join(rng.choice(['"', "\\", "[", "]", "{", "}", ",", "a", "é", "\n", " ", "\\\\", '\\"'])
                   for _ in range(rng.randrange(12)))


def record(rng, i):
    r = {"src_ip": f"10.0.0.{i % 250}", "bytes": i, "note": text(rng), text(rng): [text(rng), {"x": [1, [2]]}]}
    return r if rng.random() < 0.9 else {}


def ranges_of(path, size, split):
    """The two passes without Spark."""
    quoted = depth = 0
    out = []
    for start in range(0, size, split):
        end = min(start + split, size)
        out += [r.decode() for r in J._records_of(path, start, end, bool(quoted), depth)]
        import pyarrow as pa
        batch = pa.RecordBatch.from_pydict({"p": [path], "s": [start], "e": [end]})
        (row,) = [r for b in J._scan([batch]) for r in b.to_pylist()]
        depth += row["inside"] if quoted else row["outside"]
        quoted = (quoted + row["quotes"]) % 2
    assert quoted == 0 and depth == 0
    return out


@pytest.mark.parametrize("read", [1, 7, 64, 1 << 20])
def test_any_cut_gives_every_record_once(tmp_out, monkeypatch, read):
    monkeypatch.setattr(J, "READ_BYTES", read)
    rng = random.Random(read)
    for case in range(4):
        want = [record(rng, i) for i in range(25)]
        data = json.dumps(want, indent=rng.choice([None, 2]), ensure_ascii=bool(case % 2))
        if case == 3:
            data = "﻿ \n" + data + "\n"
        path = os.path.join(tmp_out, f"{case}.json")
        with open(path, "w", encoding="utf-8") as fh:
            fh.write(data)
        size = os.path.getsize(path)
        for split in (1, 2, 3, 17, 100, size) if read >= 64 else (5, size):
            assert [json.loads(r) for r in ranges_of(path, size, split)] == want


def test_escapes_over_ranges(tmp_out, monkeypatch):
    monkeypatch.setattr(J, "READ_BYTES", 3)
    want = [{"a": "\\" * n + '"' + "," * (n % 3) + "]" + "\\" * n} for n in range(40)] + [{}, {"b": []}]
    path = os.path.join(tmp_out, "a.json")
    with open(path, "w") as fh:
        json.dump(want, fh)
    for split in (1, 2, 5, 50):
        assert [json.loads(r) for r in ranges_of(path, os.path.getsize(path), split)] == want


def test_one_array_is_read_by_several_tasks_and_extra_fields_stay(spark, tmp_out):
    rng = random.Random(3)
    rows = [{"timestamp": 1704103200 + i, "src_ip": f"10.0.0.{i % 9}", "bytes": i if i % 5 else str(i), "packets": 2.0,
             "label": text(rng), "geo": {"x": i}} for i in range(3000)]
    rows[7] = {"src_ip": "10.0.0.1", "bytes": "many", "duration": "1.5"}
    folder = os.path.join(tmp_out, "in")
    os.makedirs(folder)
    with open(os.path.join(folder, "a.json"), "w") as fh:
        json.dump(rows, fh)
    with gzip.open(os.path.join(folder, "b.json.gz"), "wt") as fh:
        json.dump(rows[:10], fh)
    records = array_records(spark, folder, split_bytes=20_000)
    assert records.rdd.getNumPartitions() > 10
    assert sorted(r.value for r in records.collect()) == sorted(json.dumps(r) for r in rows + rows[:10])
    df = read_json_flows(spark, folder, split_bytes=20_000)
    assert df.columns == ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes", "packets",
                          "duration", "geo", "label"]
    got = df.orderBy("timestamp", "bytes", "label").collect()
    assert len(got) == 3010
    by_time = {r.timestamp: r for r in got}
    assert by_time["1704103203"].bytes == 3 and by_time["1704103205"].bytes == 5      # a number as text
    assert by_time["1704103203"].label == rows[3]["label"] and json.loads(by_time["1704103203"].geo) == {"x": 3}
    assert [r.duration for r in got if r.timestamp is None and r.bytes is None] == [1.5, 1.5]
    assert read_json_flows(spark, folder, extra=False).columns == df.columns[:-2]


def test_lines_and_broken_records(spark, tmp_out):
    path = os.path.join(tmp_out, "a.json")
    with open(path, "w") as fh:
        fh.write('{"src_ip": "10.0.0.1", "bytes": 5, "tag": "x"}\n\n{"src_ip": \n[1]\n"text"\n{"bytes": 6}\n')
    df = read_json_flows(spark, path, rejected="_bad")
    got = sorted(((r.bytes, r.tag, r._bad) for r in df.collect()), key=repr)
    assert got == sorted([(5, "x", None), (6, None, None), (None, None, '{"src_ip": '), (None, None, "[1]"),
                          (None, None, '"text"')], key=repr)


def test_a_cut_document_and_empty_ones(spark, tmp_out):
    for name, data in (("a.json", '[{"bytes": 1}, {"bytes": 2}, {"byt'), ("b.json", "[]"), ("c.json", "")):
        with open(os.path.join(tmp_out, name), "w") as fh:
            fh.write(data)
    df = read_json_flows(spark, tmp_out, rejected="_bad")
    assert sorted(((r.bytes, r._bad) for r in df.collect()), key=repr) == [(1, None), (2, None), (None, '{"byt')]
