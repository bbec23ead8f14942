"""WARC archives, index first.

Writing: every task streams its pages into archive files of gzip members, one
record each, and returns an index row per record (file, offset, length, url,
digest); the index is stored before anything is read. Pages with a payload
that another page holds are revisit records without payload. Reading: the
selected index rows are brought together by stretch of archive, sorted by
offset, and near ranges are coalesced into one read.

Files have names of their own for every task attempt and only the attempt
that counts returns index rows, so a lost executor leaves at most files that
no index row names. Archives are reached through ``pyarrow.fs`` by the
folder's URI (file, hdfs, s3, gs), a cluster's ``spark.checkpoint.dir`` by
default.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.common import materialize
from flowlens.session import checkpoint_dir

MIN_REVISIT_BYTES = 1000
FILE_BYTES = 1 << 30         # an archive file is closed beyond this
STRETCH_BYTES = 8 << 20      # index rows of one stretch of a file are read by one task, in one pass
GAP_BYTES = 64 << 10         # ranges with a smaller gap are one read
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
                "file string, offset long, length long")


def file_system(uri: str):
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri("file://" + uri[5:] if re.match("file:/(?!/)", uri) else uri)


def record_id(page_id) -> str:
    return f"<urn:x-page:{page_id}>"


def make_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: an HTTP response with the payload, or a revisit
    record with the response's headers alone."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict, bytes, int]:
    """WARC headers, payload and the payload's length as the HTTP headers give it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, payload, int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])


def _page_of(urn: str | None):
    number = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(number[1]) if number else None


def _writer(folder: str, file_bytes: int, level: int):
    def run(batches):
        fs, path = file_system(folder)
        out = name = None
        offset = 0
        for batch in batches:
            rows = []
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode("utf-8", "surrogatepass")
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(make_record(page_id, url, payload, digest, refers_to)) + pack.flush()
                if out is None or offset >= file_bytes:
                    if out is not None:
                        out.close()
                    name, offset = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(member)
                rows.append((page_id, url, "response" if refers_to is None else "revisit", digest, len(payload),
                             name, offset, len(member)))
                offset += len(member)
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), *(pa.array(x, pa.string()) for x in c[1:4]),
                     pa.array(c[4], pa.int64()), pa.array(c[5], pa.string()),
                     *(pa.array(x, pa.int64()) for x in c[6:])],
                    names=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "file", "offset",
                           "length"])
        if out is not None:
            out.close()
    return run


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES,
                   file_bytes: int = FILE_BYTES, level: int = 1) -> DataFrame:
    """Write ``pages(page_id, url, html)`` into ``folder`` and return the stored index.

    Of pages with equal payloads (SHA-1) of at least ``min_revisit_bytes``,
    the one with the largest page_id is the response and the others revisit
    it; all other pages are responses. Rows that repeat that page_id are
    responses too. A NULL html is empty, a NULL url gives no target URI, a
    page with NULL page_id can only revisit."""
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        F.sha1(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")).alias("digest"))
    shared = materialize(
        rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null").select("digest", "first"), "warc-shared")
    typed = rows.join(shared, "digest", "left").select(
        "page_id", "url", "html", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return materialize(typed.mapInArrow(_writer(folder, file_bytes, level), INDEX_SCHEMA), "warc-index")


def _reader(folder: str, gap: int, with_payload: bool):
    def run(batches):
        fs, path = file_system(folder)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "page_id"))))
            out, i = [], 0
            while i < len(rows):
                name, start, length, _ = rows[i]
                end, j = start + length, i + 1
                while (j < len(rows) and rows[j][0] == name and start <= rows[j][1] <= end + gap
                       and rows[j][1] + rows[j][2] - start <= max(STRETCH_BYTES, length)):
                    end = max(end, rows[j][1] + rows[j][2])
                    j += 1
                with fs.open_input_file(f"{path}/{name}") as f:
                    data = f.read_at(end - start, start)
                for _, at, n, page_id in rows[i:j]:
                    headers, payload, size = parse_record(zlib.decompress(data[at - start:at - start + n], 31))
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"{name} at {at}: the payload doesn't match its digest and length")
                    if _page_of(headers["WARC-Record-ID"]) != page_id:
                        raise ValueError(f"{name} at {at}: not the record of page {page_id}")
                    out.append((page_id, size, digest, kind, _page_of(headers.get("WARC-Refers-To")), payload))
                i = j
            if out:
                c = list(zip(*out))
                arrays = [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()),
                          pa.array(c[3], pa.string()), pa.array(c[4], pa.int64())]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                if with_payload:
                    arrays, names = [*arrays, pa.array(c[5], pa.binary())], [*names, "payload"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def read_records(selected: DataFrame, folder: str, gap: int = GAP_BYTES, with_payload: bool = False) -> DataFrame:
    """The records of the index rows ``selected(file, offset, length, page_id)``:
    page_id, payload_bytes, payload_digest, record_type, refers_to (and the
    payload, empty for revisits). Every record is checked against its digest."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    total = selected.agg(F.sum("length")).first()[0] or 0
    # as many tasks as stretches: index rows are small, so they must not be merged by their own size
    return selected.select("file", "offset", "length", "page_id") \
        .withColumn("stretch", F.floor(F.col("offset") / STRETCH_BYTES)) \
        .repartition(1 + total // STRETCH_BYTES, "file", "stretch").sortWithinPartitions("file", "offset") \
        .mapInArrow(_reader(folder, gap, with_payload), schema + ", payload binary" * with_payload)


def archive_round_trip(pages: DataFrame, folder: str | None = None,
                       min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archive all ``pages`` and read every record back through the index: one
    row per row of ``pages``. Cases as in :func:`write_archives`; other columns
    are ignored; an empty table writes no file and gives no rows."""
    folder = folder or os.path.join(checkpoint_dir(pages.sparkSession), f"warc-{uuid.uuid4().hex[:12]}")
    return read_records(write_archives(pages, folder, min_revisit_bytes), folder)


ORACLE_SQL = f"""
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select sha1(h) as d, max(page_id) as first from p where strlen(h) >= {MIN_REVISIT_BYTES} group by 1 having count(*) > 1)
select page_id, cast(strlen(h) as bigint) as payload_bytes, sha1(h) as payload_digest,
  case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from p left join g on d = sha1(h)
"""
