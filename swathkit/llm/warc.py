"""WARC archives with an index: write records, index them, then read coalesced byte ranges.

Records are gzip members of their own, so that any of them can be read alone. A task writes its
records to files that it names itself, under the shared folder, and returns a row per record for
the index (file, offset, length, url, digest); the index, a table that Spark commits, knows only
the files of tasks that ended well, so that retries leave nothing but unread files. A read picks
rows of the index, sorts them by place, merges ranges that are close, and fetches each merged
range with one read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, arrow_batches, partitions

#: Payloads from this size on are deduplicated.
REVISIT_BYTES = 100
#: A file's largest size; ranges that are read at once; gaps that are read over.
FILE_BYTES, RANGE_BYTES, GAP_BYTES = 256 << 20, 4 << 20, 64 << 10
#: Bytes of archives that a task reads on average, at most.
TASK_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path; Spark may write local paths as file:/x, which means file:///x, and has
    names of its own for stores: s3a and s3n mean s3, gs and hdfs are the same, abfss means abfs."""
    scheme, mark, rest = uri.partition("://")
    uri = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + mark + rest
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def record(page: int | None, url: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record: a response with its payload, or, with ``first``, a revisit without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    kind = "response" if first is None else "revisit"
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}"]
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def typed_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and first (the page that a revisit refers to, else null).

    Null html is an empty payload; a null url an empty target. Of rows with equal payloads of at
    least 100 bytes, the smallest page_id is the response; should that row be repeated, or all
    page_ids be null, each such row is a response. Payloads are shuffled once: who is a revisit is
    found among digests, aggregated before they are shuffled, and then joined by row.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " ").alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    keyed = base.withColumn("row", F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    narrow = keyed.where(F.octet_length("payload") >= REVISIT_BYTES).select("row", "page_id", "digest")
    repeated = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    revisits = narrow.join(repeated, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("row", "digest", "first").dropDuplicates(["row", "digest"])
    return keyed.join(revisits, ["row", "digest"], "left").select("page_id", "url", "payload", "digest", "first")


_INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"


def write_archives(pages: DataFrame, work: Workspace, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; returns the index: file, offset, length, url, digest, page_id, record_type.

    Nulls, repeated rows and ties are typed as ``typed_pages`` says; payloads of any length are whole;
    an empty table gives an empty index and no archive. Columns other than page_id, url and html,
    whatever their names, are not read.
    """
    arrow_batches(pages.sparkSession)
    folder = f"{work.path}/archives"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    raw = packer.compress(record(page, url, payload.encode(), digest, first)) + packer.flush()
                    out.write(raw)
                    rows.append((f"{folder}/{name}", at, len(raw), url, digest, page, "response" if first is None else "revisit"))
                    at += len(raw)
                if rows:
                    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["file", "offset", "length", "url", "digest", "page_id", "record_type"])
        finally:
            if out is not None:
                out.close()

    return work.save(typed_pages(pages).mapInArrow(write, _INDEX), "index")


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def parse_record(raw: bytes) -> tuple:
    """The row of one gzip member: a response's size and digest come from its payload, a revisit's from its headers."""
    raw = zlib.decompress(raw, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.partition(b": ")[::2] for x in head.split(b"\r\n")[1:])
    if len(block) != int(fields[b"Content-Length"]) + 4 or not raw.startswith(b"WARC/1.0\r\n"):
        raise ValueError("not a whole WARC record")
    http, _, payload = block[:-4].partition(b"\r\n\r\n")
    number = lambda x: None if x == b"<urn:page:null>" else int(x[10:-1])
    kind, page = fields[b"WARC-Type"].decode(), number(fields[b"WARC-Record-ID"])
    if kind == "response":
        size, digest, refers, body = len(payload), hashlib.sha256(payload).hexdigest(), None, payload
    else:
        size = int(dict(x.partition(b": ")[::2] for x in http.split(b"\r\n")[1:])[b"Content-Length"])
        digest, refers, body = fields[b"WARC-Payload-Digest"].decode().partition(":")[2], number(fields[b"WARC-Refers-To"]), None
    if fields[b"WARC-Payload-Digest"].decode() != f"sha256:{digest}":
        raise ValueError(f"payload of page {page} doesn't match its digest")
    return page, size, digest, kind, refers, fields[b"WARC-Target-URI"].decode(), body


def read_records(selected: DataFrame, payloads: bool = False) -> DataFrame:
    """Read the records of the given index rows: page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload).

    Rows fall into buckets of file and place, so that a task's list is bounded; within one, ranges
    that are less than a gap apart become one read. Buckets are dealt to tasks by the bytes that they
    stand for, not by the index's own few. An empty selection reads nothing.
    """
    spark = selected.sparkSession
    total = int(selected.agg(F.sum("length")).first()[0] or 0)
    tasks = max(partitions(spark), -(-total // TASK_BYTES))
    entry = F.struct("offset", "length")
    ranges = selected.groupBy("file", F.floor(F.col("offset") / RANGE_BYTES).alias("bucket")).agg(F.sort_array(F.collect_list(entry)).alias("entries")).repartition(tasks, "file", "bucket").select("file", "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = file_system(file)
                rows, at = [], 0
                with system.open_input_file(path) as source:
                    while at < len(entries):
                        first = entries[at]["offset"]
                        last, end = at, first + entries[at]["length"]
                        while last + 1 < len(entries) and entries[last + 1]["offset"] - end <= GAP_BYTES:
                            last += 1
                            end = max(end, entries[last]["offset"] + entries[last]["length"])
                        raw = source.read_at(end - first, first)
                        for e in entries[at : last + 1]:
                            rows.append(parse_record(raw[e["offset"] - first : e["offset"] - first + e["length"]]))
                        at = last + 1
                columns = list(zip(*rows, strict=True))
                if not payloads:
                    columns[-1] = [None] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _READ.types, strict=True)], schema=_READ)

    return ranges.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
