"""WARC as a chunked record table.

A record's bytes (header block, payload, two line ends) are rows (record_id, part, chunk_no, last, data, sha1), where
`part` is a name of its own for each record written, as ids may be null or repeat: a payload of any size crosses tasks in chunks of bounded size. Each chunk row carries the SHA-1 of the payload up to its end, so that
a reader checks every chunk as it comes and a writer never holds more than one chunk beside its input. Records of one
chunk are read where they lie; those of several are brought in order by a sort within partitions.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, small_batches

CHUNK = 256 << 10
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
ROWS = "record_id bigint, part string, chunk_no int, last boolean, data binary, sha1 binary"
OUT = pa.schema([("record_id", pa.int64()), ("part", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("sha1", pa.binary())])


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def header(kind: str, record_id, url: str | None, digest: str, payload_bytes: int, refers_to=None) -> bytes:
    """WARC/1.1 header block. A revisit has no content; X-Payload-Length tells its payload's size."""
    size = payload_bytes if kind == "response" else 0
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {EPOCH}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c not in "\r\n" else "%20" for c in url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Payload-Length: {payload_bytes}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def chunks_of(head: bytes, payload: memoryview, chunk: int = CHUNK) -> Iterator[tuple[int, bool, bytes, bytes]]:
    """(chunk_no, last, bytes, SHA-1 of the payload so far). The first chunk has the header, the last the line ends."""
    sha, n = hashlib.sha1(), max(1, -(-len(payload) // chunk))
    for i in range(n):
        part = payload[i * chunk : (i + 1) * chunk]
        sha.update(part)
        yield i, i == n - 1, (head if i == 0 else b"") + bytes(part) + (b"\r\n\r\n" if i == n - 1 else b""), sha.copy().digest()


def write_records(pages: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """pages (page_id, url, payload, digest, kind, refers_to) -> chunk rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, n, task = 0, 0, uuid.uuid4().hex
        for b in batches:
            for at in range(b.num_rows):
                page, url, payload, digest, kind, to = (b.column(n)[at] for n in ("page_id", "url", "payload", "digest", "kind", "refers_to"))
                raw = memoryview(payload.as_buffer()) if payload.is_valid and len(payload.as_buffer()) else memoryview(b"")
                head = header(kind.as_py(), page.as_py(), url.as_py(), b32(digest.as_py()), len(raw), to.as_py())
                n += 1
                for row in chunks_of(head, raw if kind.as_py() == "response" else memoryview(b""), chunk):
                    rows.append((page.as_py(), f"{task}-{n}", *row))
                    held += len(row[2])
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    small_batches(pages)
    return pages.select("page_id", "url", "payload", "digest", "kind", "refers_to").mapInArrow(run, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)


class RecordReader:
    """Takes a record's chunks in order; at the last gives its fields. Holds a digest, never the record."""

    def __init__(self):
        self.sha, self.fields, self.left, self.size = hashlib.sha1(), None, 0, 0

    def feed(self, data: bytes, last: bool, sha1: bytes) -> dict | None:
        body = memoryview(data)
        if self.fields is None:
            end = data.index(b"\r\n\r\n") + 4
            lines = data[: end - 4].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            self.left = int(self.fields["Content-Length"])
            body = body[end:]
        part = body[: self.left]
        self.sha.update(part)
        self.left -= len(part)
        self.size += len(part)
        if self.sha.digest() != sha1:
            raise ValueError("a chunk's bytes don't give the digest it carries")
        if not last:
            return None
        if self.left or bytes(body[len(part) :]) != b"\r\n\r\n":
            raise ValueError("a record's length doesn't match its Content-Length")
        f = self.fields
        revisit = f["WARC-Type"] == "revisit"
        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and digest != b32(self.sha.digest()):
            raise ValueError("a payload doesn't give its record's digest")
        page = lambda x: int(x.removeprefix("<urn:page:").rstrip(">"))
        return {"page_id": None if "None" in f["WARC-Record-ID"] else page(f["WARC-Record-ID"]), "payload_bytes": int(f["X-Payload-Length"]) if revisit else self.size, "payload_digest": digest, "record_type": f["WARC-Type"], "refers_to": page(f["WARC-Refers-To"]) if revisit else None}


RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    reader, want = RecordReader(), 0
    for b in batches:
        made = []
        for no, last, data, sha1 in zip(b.column("chunk_no").to_pylist(), b.column("last").to_pylist(), b.column("data"), b.column("sha1").to_pylist()):
            if no != want:
                raise ValueError("a record's chunks are not in order")
            got = reader.feed(data.as_py(), last, sha1)
            want = 0 if last else want + 1
            if got:
                made.append(got)
                reader = RecordReader()
        yield pa.RecordBatch.from_pylist(made, schema=out)


def read_records(chunk_rows: DataFrame) -> DataFrame:
    """Chunk rows -> one row a record. Only records of several chunks are shuffled, by record, and sorted."""
    one = chunk_rows.where("last and chunk_no = 0")
    more = chunk_rows.where("not (last and chunk_no = 0)").repartition("part").sortWithinPartitions("part", "chunk_no")
    return one.mapInArrow(_read, RESULT).union(more.mapInArrow(_read, RESULT))


def archive(pages: DataFrame, *, payload: str = "html", key: str = "page_id", url: str = "url", least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write a record per row and read the archive back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null payloads are empty. Of equal payloads of `least` bytes or more, rows with the largest page_id are responses
    (repeated rows with that id all are) and others revisit it; smaller payloads are all responses. Rows with a null id
    never are the largest; if no row of a payload has an id, they are responses. Repeated rows of one id and rows
    without one are records of their own (see `part` above).
    """
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    # the largest id of each payload: combined before the shuffle, so a hot payload is one row a task; digests only
    top = p.where(F.col("bytes") >= least).groupBy("sha", "bytes").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ids = p.select("page_id", "sha", "bytes").join(top, ["sha", "bytes"]).where("page_id < top or (page_id is null and top is not null)").select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("bytes").alias("_bytes"), "top").distinct()
    flagged = p.join(ids, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")) & (F.col("bytes") == F.col("_bytes")), "left")
    flagged = flagged.select("page_id", "url", "payload", F.unhex("sha").alias("digest"), F.when(F.col("top").isNull(), "response").otherwise("revisit").alias("kind"), F.col("top").alias("refers_to"))
    return read_records(table(write_records(flagged, chunk=chunk), "warc"))


def write_file(path: str, records: Iterable[tuple[bytes, bytes]]) -> None:
    """(header, payload) pairs to a .warc or, a gzip member a record, a .warc.gz file."""
    with open(path, "wb") as f:
        for head, payload in records:
            if path.endswith(".gz"):
                with gzip.GzipFile(fileobj=f, mode="wb", mtime=0) as g:
                    for *_, data, _ in chunks_of(head, memoryview(payload)):
                        g.write(data)
            else:
                for *_, data, _ in chunks_of(head, memoryview(payload)):
                    f.write(data)


def read_file(path: str, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bool, bytes]]:
    """(fields, chunk number, last, payload bytes) from a .warc or .warc.gz file, a chunk at a time."""
    with (gzip.open if path.endswith(".gz") else open)(path, "rb") as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC file")
            fields = {}
            while (line := f.readline()).strip():
                k, v = line.decode().rstrip("\r\n").split(":", 1)
                fields[k] = v.strip()
            left, no = int(fields["Content-Length"]), 0
            while True:
                data = f.read(min(chunk, left))
                if left and not data:
                    raise ValueError("the file ends within a record")
                left -= len(data)
                yield fields, no, not left, data
                no += 1
                if not left:
                    break


def op9(spark, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The same in DuckDB, without the archives: base32 of the digest by 5-bit groups of its hexadecimal form.
OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS hex FROM p),
b AS (SELECT *, list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((((CAST(('0x' || substr(hex || '00', 1 + (i * 5) // 4, 3)) AS BIGINT)) >> (12 - 5 - (i * 5) % 4)) & 31) AS INTEGER), 1)), lambda x, y: x || y) AS payload_digest,
      max(page_id) OVER (PARTITION BY hex, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM b
"""
