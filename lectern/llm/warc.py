"""WARC archives as a table of record chunks.

An archive is a run of rows (archive, seq, record_id, chunk_no, last, data, sha1_so_far); the data of its rows, in the order of
seq and chunk_no, are the bytes of a WARC file. A payload beyond CHUNK bytes takes several rows, cut from the column's own
buffer, and each row carries the SHA-1 of the payload up to its end, so that a reader takes it in piece by piece, checks each
piece, and never holds a whole record. Records of one row are read where they lie; only rows of longer ones are dealt out by
record, in order of chunk_no.

Records with equal payloads of at least LEAST_REVISIT bytes: the one with the largest page_id is a response, the others
revisit it. Equality goes by SHA-1 and length. A record's id is made of its page_id and payload digest, so that a revisit can
name the record it refers to without looking it up.

Defined cases: null html is an empty payload; a null page_id is never the one referred to (without any page_id all are
responses; their records are numbered instead); rows with the page_id that others refer to are all responses; rows equal in page_id
and payload are one record written twice, under one id; line ends in a url become blanks, and a url may be of any length; null url: none.
Other columns of the pages aren't archived. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import slices, staged, table

LEAST_REVISIT = 1000
CHUNK = 64 * 1024
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CHUNKS = pa.schema([("archive", pa.int32()), ("seq", pa.int64()), ("record_id", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("sha1_so_far", pa.string())])
CHUNKS_DDL = "archive int, seq bigint, record_id string, chunk_no int, last boolean, data binary, sha1_so_far string"
PAGES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("n_chunks", pa.int32())])
PAGES_DDL = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, n_chunks int"


def named(page_id: int, digest: str) -> str:
    return f"urn:lectern:page:{page_id}:{digest}"


def header(page_id: int | None, record_id: str, kind: str, url: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{named(refers_to, digest)}>", f"X-Payload-Length: {size}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if kind == 'revisit' else size}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    archive, seq, rows, held = TaskContext.get().partitionId(), 0, [], 0
    for batch in slices(batches, "payload"):
        payloads = batch.column("payload")
        ids, urls, digests, refs = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
        for i, (page_id, url, digest, ref) in enumerate(zip(ids, urls, digests, refs, strict=True)):
            body, kind = memoryview(payloads[i].as_buffer()), "response" if ref is None else "revisit"
            record_id = named(page_id, digest) if page_id is not None else f"urn:lectern:record:{archive}-{seq}"
            front, state, at, n = header(page_id, record_id, kind, url, digest, len(body), ref), hashlib.sha1(), 0, 0
            if kind == "revisit":
                body = body[:0]
            while True:
                piece = body[at : at + CHUNK]
                at += len(piece)
                state.update(piece)
                last = at == len(body)
                rows.append((archive, seq, record_id, n, last, b"".join((front, piece, b"\r\n\r\n" if last else b"")), state.hexdigest()))
                held, n, front = held + len(rows[-1][5]), n + 1, b""
                if held > 32 * CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), CHUNKS.types, strict=True)], schema=CHUNKS)
                    rows, held = [], 0
                if last:
                    break
            seq += 1
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), CHUNKS.types, strict=True)], schema=CHUNKS)


def write_archives(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as the chunk rows of archives; write them as a table of any format."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    base = base.withColumns({"size": F.octet_length("payload"), "digest": F.sha1("payload")})
    long_ones = base.where(F.col("size") >= LEAST_REVISIT)
    copied = long_ones.groupBy("digest", "size").agg(F.max("page_id").alias("chosen"), F.count("*").alias("n")).where("n > 1 and chosen is not null").drop("n")
    # Written first: the join reads it by an exchange of its own, and Spark can split the pages of a popular payload.
    met = long_ones.join(staged(copied, "warc-copied"), ["digest", "size"], "left")
    other = F.col("chosen").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chosen"))
    out = met.select("page_id", "url", "payload", "digest", F.when(other, F.col("chosen")).alias("refers_to"))
    short = base.where(F.col("size") < LEAST_REVISIT).select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to"))
    return out.unionByName(short).mapInArrow(_chunks, CHUNKS_DDL)


class Record:
    """One record, fed chunk by chunk; holds the header and running figures only."""

    def __init__(self, record_id: str):
        self.id, self.head, self.fields, self.sha, self.size, self.left, self.n = record_id, b"", None, hashlib.sha1(), 0, 0, 0

    def feed(self, number: int, data: memoryview, so_far: str | None, last: bool) -> None:
        if number != self.n:
            raise ValueError(f"{self.id}: chunk {number} where {self.n} was due")
        self.n += 1
        if self.fields is None:
            front, gap, _ = bytes(data).partition(b"\r\n\r\n")  # a record's first chunk holds its whole header
            if not gap or not front.startswith(b"WARC/1."):
                raise ValueError(f"{self.id}: no WARC header")
            lines = front.decode().split("\r\n")[1:]
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            self.left, data = int(self.fields["content-length"]), data[len(front) + 4 :]
        body = data[: self.left]
        self.sha.update(body)
        self.size, self.left = self.size + len(body), self.left - len(body)
        if so_far is not None and self.sha.hexdigest() != so_far:
            raise ValueError(f"{self.id}: chunk {number} doesn't match its digest")
        if last and (self.left or bytes(data[len(body) :]) != b"\r\n\r\n"):
            raise ValueError(f"{self.id}: its length is wrong")

    def row(self) -> tuple:
        f, kind = self.fields, self.fields["warc-type"]
        stated = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
        if kind == "revisit":
            refers_to, size, digest = int(f["warc-refers-to"].strip("<>").split(":")[3]), int(f["x-payload-length"]), stated
        else:
            refers_to, size, digest = None, self.size, self.sha.hexdigest()
            if digest != stated:
                raise ValueError(f"{self.id}: the payload doesn't match its digest")
        return int(f["x-page-id"]) if "x-page-id" in f else None, size, digest, kind, refers_to, f.get("warc-target-uri"), self.n


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, place = None, None
    for batch in slices(batches, "data"):
        data, rows = batch.column("data"), []
        columns = (batch.column(c).to_pylist() for c in ("archive", "seq", "record_id", "chunk_no", "last", "sha1_so_far"))
        for i, (archive, seq, record_id, number, last, sha) in enumerate(zip(*columns, strict=True)):
            if now is None:
                now, place = Record(record_id), (archive, seq)
            elif place != (archive, seq):
                raise ValueError(f"{now.id} has no end")
            now.feed(number, memoryview(data[i].as_buffer()), sha, last)
            if last:
                rows.append(now.row())
                now = None
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), PAGES.types, strict=True)], schema=PAGES)
    if now is not None:
        raise ValueError(f"{now.id} has no end")


def read_archives(chunks: DataFrame) -> DataFrame:
    """The records of a chunk table; raises where a length or digest is wrong."""
    whole = chunks.where("chunk_no = 0 and last").mapInArrow(_records, PAGES_DDL)
    parts = chunks.where("not (chunk_no = 0 and last)").repartition("archive", "seq").sortWithinPartitions("archive", "seq", "chunk_no")
    return whole.unionByName(parts.mapInArrow(_records, PAGES_DDL))


def op6_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = staged(write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html")), "warc")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS chosen FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND chosen <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND chosen <> page_id THEN chosen END AS refers_to
FROM m
"""
