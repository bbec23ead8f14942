"""Host reputation, licence rules, quotation links and WARC archives."""

import gzip
import hashlib
import os
from glob import glob

import duckdb
import pytest

from flowlens.llm import host_reputation, license_rules, warc_index
from flowlens.llm.quotation_links import linked_conversations


# --- host reputation -----------------------------------------------------------

URLS = ["http://EXAMPLE.org/en/2", "https://www.example.org/en/17?x=/es/", "https://a.example.org/es/", "http://example.org",
        "http://notexample.org/es/", "https://x.com/fr/1", "https://x.com/de/#top", "https://com/fr/", "ftp://u@h.net:81/p#q",
        "no scheme", "://host.net/a", "", None, "https://É.Example.com/de/1", "http://h.net/a\nb?c", "http://10.0.0.1/x",
        "http://shop.co.uk/", "https://one.two.com.au/x"]


def test_host_path_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(0, 1)], "page_id long, good int")
    got = {r["page_id"]: r for r in host_reputation.url_verdicts(pages, outcomes).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(URLS))] == [
        ("example.org", "/en/2", "org/"), ("www.example.org", "/en/17", "example.org/en/1"),
        ("a.example.org", "/es/", "example.org/es/"), ("example.org", "", None), ("notexample.org", "/es/", "org/"),
        ("x.com", "/fr/1", "com/fr/"), ("x.com", "/de/", "com/de/"), ("com", "/fr/", "com/fr/"), ("u@h.net:81", "/p", None),
        ("", "", None), ("host.net", "/a", None), ("", "", None), ("", "", None), ("É.example.com", "/de/1", "com/de/"),
        ("h.net", "/a\nb", None), ("10.0.0.1", "/x", None), ("shop.co.uk", "/", None), ("one.two.com.au", "/x", None)]
    assert got[2]["verdict"] == "block" and got[0]["verdict"] == "allow" and got[5]["verdict"] == "allow"


def pages_with_bad_hosts():
    pages, outcomes, n = [], [], 0
    for host, good, bad, unlabelled in (("a.good.net", 90, 5, 10), ("b.good.net", 2, 0, 3), ("spam.bad.net", 5, 95, 10),
                                        ("ads.bad.net", 1, 40, 3), ("new.bad.net", 0, 0, 4), ("new.good.net", 0, 0, 4),
                                        ("x.other.io", 20, 8, 0), ("y.other.io", 30, 30, 1)):
        for k in range(good + bad + unlabelled):
            pages.append((n, f"https://{host}/p{k}"))
            if k < good + bad:
                outcomes.append((n, int(k < good)))
            n += 1
    return pages, outcomes


def test_reputation_is_shrunk_to_the_domain_and_equals_sql(spark):
    pages, outcomes = pages_with_bad_hosts()
    outcomes += [(outcomes[0][0], 0), (None, 1), (5, None)]
    p = spark.createDataFrame(pages, "page_id long, url string")
    o = spark.createDataFrame(outcomes, "page_id long, good int")
    out = host_reputation.url_verdicts(p, o)
    verdict = {r["host"]: r["verdict"] for r in out.collect()}
    assert verdict["spam.bad.net"] == verdict["ads.bad.net"] == verdict["new.bad.net"] == "block"
    assert verdict["a.good.net"] == verdict["b.good.net"] == verdict["new.good.net"] == "allow"
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.execute("create table labels (doc_id bigint, quality int)")
    con.executemany("insert into pages values (?, ?)", pages)
    con.executemany("insert into labels values (?, ?)", outcomes)
    want = con.execute(host_reputation.oracle_sql()).fetchall()
    order = ["page_id", "host", "path", "rule", "verdict", "reputation", "lower_bound"]
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in order)) for r in out.collect())


def test_reputation_without_labels_or_pages(spark):
    p = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    o = spark.createDataFrame([], "page_id long, good int")
    assert [r["reputation"] for r in host_reputation.url_verdicts(p, o).collect()] == [0.5]
    assert host_reputation.url_verdicts(p.limit(0), o).count() == 0


# --- licences --------------------------------------------------------------------

MIT = """# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in
# all copies or substantial portions of the Software.
"""


BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice,
 *    this list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
"""


def test_licences_by_ordered_rules(spark):
    rows = [(1, "Intro.\nLicensed under the Apache License, Version 2.0.\nMore text."), (2, MIT),
            (3, "x Licensed under CC BY-NC 4.0. Released under the MIT License."), (3, "Released under the MIT License!"),
            (4, "a license of no kind"), (5, None), (6, ""), (None, "ALL RIGHTS RESERVED."),
            (7, "The above copyright notice and this permission notice shall be included in all copies or substantial "
                "portions of the Software."),
            (8, "word " * 20_000 + ".\nAll rights reserved.\nAll rights reserved."),
            (9, BSD), (10, BSD.replace("1.", "(a)").replace("2.", "(b)") + " * 3. Neither the name of the copyright holder "
                "nor the names of its\n * contributors may be used to endorse or promote products derived from this\n"
                " * software without specific prior written permission."),
            (11, "This project is licensed under the MIT License."), (12, "// SPDX-License-Identifier: MIT\nint x;"),
            (13, "/* SPDX-License-Identifier: Apache-2.0 */"), (14, "Distributed under the terms of the MIT license.")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, license string")
    got = sorted((str(r["doc_id"]), r["license"], r["matches"]) for r in license_rules.licenses(docs).collect())
    assert got == sorted([("1", "Apache-2.0", 1), ("2", "MIT", 1), ("3", "MIT", 1), ("3", "MIT", 1),
                          ("None", "all-rights-reserved", 1), ("7", "fragment:mit-notice", 1),
                          ("8", "all-rights-reserved", 2), ("9", "BSD-2-Clause", 1), ("10", "BSD-3-Clause", 1),
                          ("11", "MIT", 1), ("12", "MIT", 1), ("13", "Apache-2.0", 1), ("14", "MIT", 1)])
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted((str(d), n, m) for d, n, _, m in con.execute(license_rules.oracle_sql()).fetchall()) == got
    assert license_rules.licenses(docs.limit(0)).count() == 0


def test_every_known_sentence_holds_an_anchor(spark):
    words = license_rules.anchors()
    assert len(words) < 12
    for sentence in license_rules.SENTENCES:
        assert any(a in license_rules._normalised(sentence) for a in words), sentence
    assert {i for _, ids in license_rules.RULES for i in ids} <= set(license_rules.SENTENCES.values())
    docs = spark.createDataFrame([(1, "Use it as you like!"), (2, "mit license")], "doc_id long, text string")
    got = license_rules.licenses(docs, rules=(("own", ("free-use",)),), known={"use it as you like": "free-use"}).collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(1, "own")]


# --- quotation links ---------------------------------------------------------------

def threads(spark, rows, schema="conv_id long, turn long, role string, text string, thread_turn string"):
    out = linked_conversations(spark.createDataFrame([(c, n, "user", t, "c") for c, n, t in rows], schema)).collect()
    return {(r["conv_id"], r["turn"]): (r["text"], r["thread_turn"], r["depth"], r["parent_conv"], r["parent_turn"])
            for r in out}, out


def test_nested_quotes_are_linked_and_removed(spark):
    got, _ = threads(spark, [
        (1, 0, "First question\nwith two lines"),
        (1, 1, "> First question\n> with two lines\n\nThe answer"),
        (1, 2, "Another topic"),
        (1, 3, ">> first   QUESTION\n>> with two lines\n> The answer\nThanks, and:\n> Another topic\nyes"),
        (1, 4, "> Never said anywhere\nnew"),
        (2, 0, "> Another topic\nforwarded"),
        (2, 1, ">no space\n> forwarded\nok"),
    ])
    assert got == {
        (1, 0): ("First question\nwith two lines", 0, 0, None, None), (1, 1): ("The answer", 0, 1, 1, 0),
        (1, 2): ("Another topic", 2, 0, None, None),
        (1, 3): ("Thanks, and:\nyes", 2, 1, 1, 2),          # the longest level-1 passage
        (1, 4): ("new", 4, 0, None, None), (2, 0): ("forwarded", 0, 0, 1, 2), (2, 1): ("ok", 0, 1, 2, 0)}


def test_the_first_saying_elsewhere_and_unquoted_messages(spark):
    got, _ = threads(spark, [(0, 4, "> a line that others say\nwell"), (0, 5, "a line that others say"),
                             (9, 1, "a line that others say"), (3, 2, "  indented\r\n\tcode \n"), (3, 3, " \n")])
    assert got[(0, 4)] == ("well", 4, 0, 9, 1)
    assert got[(3, 2)][0] == "  indented\r\n\tcode \n" and got[(3, 3)][0] == " \n"


def test_latest_earlier_saying_wins_and_long_chains_settle(spark):
    rows = [(1, 0, "same"), (1, 1, "same"), (1, 2, "> same\nr"), (1, 5000, "same"), (1, 9000, "> same\nlate")]
    rows += [(7, i, (f"> m{i - 1}\n" if i else "") + f"m{i}") for i in range(70)]
    got, _ = threads(spark, rows)
    assert got[(1, 2)][3:] == (1, 1) and got[(1, 9000)][3:] == (1, 5000)
    assert [got[(7, i)][1:3] for i in range(70)] == [(0, i) for i in range(70)]


def test_derived_replies_give_the_originals_back(spark):
    """Every message of the conversations but the first quotes its predecessor with all that it quoted."""
    con = duckdb.connect()
    said = con.execute("select conv_id, turn, text from '/root/testdata/sf0.001/conversations.parquet' order by 1, 2").fetchall()
    rows, before = [], {}
    for c, t, text in said:
        quote = "\n".join((">" if line.startswith(">") else "> ") + line for line in before.get(c, "").split("\n")) if c in before else None
        before[c] = text if quote is None else quote + "\n" + text
        rows.append((c, t, before[c]))
    got, _ = threads(spark, rows)
    start = {}
    for c, t, text in said:
        start.setdefault(c, t)
        place = got[(c, t)]
        assert place[0].strip() == text.strip() and place[1:3] == (start[c], t - start[c])


def test_linked_conversations_equal_sql(spark):
    import random

    from flowlens.llm import quotation_links
    rng = random.Random(8)
    said = ["Hello there", "yes", "I think  so", "Why NOT?", "the plan is\ngood", "ok"]
    rows = []
    for c in range(12):
        texts = []
        for t in range(rng.randrange(1, 14)):
            parts = []
            if texts and rng.random() < 0.7:
                quoted = rng.choice(texts if rng.random() < 0.8 else said)
                parts += [rng.choice([">", "> ", " > ", ">>", "> > "]) + x for x in quoted.split("\n")]
            if rng.random() < 0.9:
                parts.insert(rng.choice([0, len(parts)]), rng.choice(said))
            text = "\n".join(parts)
            texts.append(text)
            rows.append((c, t, "user", text))
    rows += [rows[3], (None, 1, "user", "> yes"), (3, None, "user", "yes"), (40, 0, None, None)]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = con.execute(quotation_links.ORACLE_SQL).fetchall()
    got = linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert sum(r["depth"] > 1 for r in got) > 5 and any(r["parent_conv"] not in (None, r["conv_id"]) for r in got)


def test_quotation_edge_rows(spark):
    rows = [(None, 0, "> a\nb"), (1, None, "a"), (1, 0, None), (1, 0, ""), (1, 1, ">\n> \n"), (1, 1, ">\n> \n"), (2, 0, "> a")]
    got, out = threads(spark, rows)
    assert len(out) == len(rows) and all(r["n_links"] == 0 for r in out)
    assert got[(2, 0)][0] == "" and got[(None, 0)][0] == "b"
    assert threads(spark, [])[1] == []


# --- WARC -----------------------------------------------------------------------------

def test_archives_hold_warc_records_and_index_rows_point_at_them(spark, tmp_out):
    same = "é" * 600
    rows = [(1, "http://a/1", same), (2, None, same), (7, "http://a/ x\r\ny", same), (3, "u3", "short"), (4, "u4", "short"),
            (5, "u5", None), (6, "u6", ""), (8, "u8", "x\r\n\r\nWARC/1.1\r\n" * 200_000), (7, "again", same), (None, "n", same),
            (None, "n2", "b" * 2000)]
    pages = spark.createDataFrame([(*r, "f") for r in rows], "page_id long, url string, html string, file string").repartition(3)
    index = warc_index.write_archives(pages, tmp_out, file_bytes=400)
    for r in index.collect():
        raw = open(os.path.join(tmp_out, r["file"]), "rb").read()[r["offset"]:r["offset"] + r["length"]]
        headers, payload, size = warc_index.parse_record(gzip.decompress(raw))
        assert headers["WARC-Type"] == r["record_type"] and size == r["payload_bytes"]
        assert len(payload) == (size if r["record_type"] == "response" else 0)
    assert len(glob(tmp_out + "/*.warc.gz")) > 3
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = sorted(str((p, len((h or "").encode()), sha(h), "response" if p == 7 or h != same else "revisit",
                       7 if h == same and p != 7 else None)) for p, _, h in rows)
    out = warc_index.read_records(index, tmp_out, with_payload=True).collect()
    assert sorted(str(tuple(r)[:5]) for r in out) == want
    assert all(bytes(r["payload"]).decode() == ("" if r["record_type"] == "revisit" else next(h or "" for p, _, h in rows if sha(h) == r["payload_digest"])) for r in out)
    some = warc_index.read_records(index.where("page_id in (1, 8)"), tmp_out, gap=0).collect()
    assert sorted(r["page_id"] for r in some) == [1, 8]


def test_round_trip_equals_sql(spark):
    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    want = con.execute(warc_index.ORACLE_SQL).fetchall()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in warc_index.archive_round_trip(pages).collect())
    assert warc_index.archive_round_trip(pages.limit(0)).count() == 0


def test_a_changed_archive_is_reported(spark, tmp_out):
    pages = spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string")
    index = warc_index.write_archives(pages, tmp_out)
    row = index.first()
    path = os.path.join(tmp_out, row["file"])
    changed = gzip.compress(gzip.decompress(open(path, "rb").read()).replace(b"payload", b"PAYLOAD"))
    open(path, "wb").write(changed)
    from pyspark.sql import functions as F
    with pytest.raises(Exception, match="digest"):
        warc_index.read_records(index.withColumn("length", F.lit(len(changed))), tmp_out).collect()
