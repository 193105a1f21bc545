"""WARC archives as a chunked record table.

A record's payload is streamed as rows of (record_no, chunk_no, data) of at most
CHUNK bytes. Chunk 0 begins with the record's WARC and HTTP heads, the others
carry payload only; each row also carries payload_upto (payload bytes so far) and
sha1_upto (SHA-1 so far), so that a reader checks chunks one by one, in order, and
never holds a whole record. Of records with equal payloads the smallest page_id
is the response and the others are revisits, which have heads only.

The equal payloads are found by a count per digest: each task combines its rows
first, so a payload copied a million times costs one row per task; what it finds
is joined back over SALT parts of each digest, and the type of a page by page_id,
which spreads evenly. Reading digests records of one chunk where they lie; only
records of several chunks are brought together by record_no and streamed in order.

Defined cases: null html is an empty payload, null url is an empty target; every
row is a record of its own, so repeated rows come out as often as they came in,
and those that bear the smallest page_id of their payload are all responses; a row
with a null page_id is a response that nothing refers to; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.scratch import gone_at_exit, shared_dir

CHUNK, SALT = 1 << 20, 16
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "record_no bigint, page_id bigint, chunk_no int, n_chunks int, payload_upto bigint, sha1_upto binary, data binary"
FIELDS = [("record_no", pa.int64()), ("page_id", pa.int64()), ("chunk_no", pa.int32()), ("n_chunks", pa.int32()), ("payload_upto", pa.int64()), ("sha1_upto", pa.binary()), ("data", pa.binary())]


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def urn(page_id: int | None, record_no: int = 0) -> str:
    """A page's record; one without an id is named by its place."""
    return f"<urn:uuid:{uuid.UUID(int=page_id % (1 << 128) if page_id is not None else (1 << 100) + record_no)}>"


def heads(name: str, url: str, size: int, digest: str, refers_to: int | None) -> bytes:
    """The WARC and HTTP heads of a record, blank lines included."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    lines.append(f"Content-Length: {len(http) + (size if refers_to is None else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest (hex), refers_to (null for a response); payloads under `least` bytes are never revisited."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    ids = pages.select(F.col("page_id").cast("long"), payload.alias("payload")).select("page_id", F.sha1("payload").alias("_d"), F.length("payload").alias("_n")).filter((F.col("_n") >= least) & F.col("page_id").isNotNull())
    first = ids.groupBy("_d").agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last")).filter("_first < _last")
    first = first.select("_d", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_s"))
    again = ids.withColumn("_s", F.pmod(F.hash("page_id"), F.lit(SALT))).join(first, ["_d", "_s"]).filter("page_id > _first").select(F.col("page_id").alias("_id"), F.col("_d").alias("_again"), F.col("_first").alias("refers_to")).distinct()
    return rows.join(again, (rows["page_id"] == again["_id"]) & (rows["digest"] == again["_again"]), "left").select("page_id", "url", "payload", "digest", "refers_to")


def write(pages: DataFrame, to: str, chunk: int = CHUNK, least: int = 0) -> None:
    """Write one record per page to the chunked record table at `to`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        record_no = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                page_id, refers_to = page_id.as_py(), refers_to.as_py()
                body = memoryview(payload.as_buffer())  # no copy of the payload
                head = heads(urn(page_id, record_no), url.as_py(), len(body), base32(digest.as_py()), refers_to)
                upto, sha = 0, hashlib.sha1()
                pieces = range(0, max(len(body), 1), chunk) if refers_to is None else range(1)
                for k, at in enumerate(pieces):
                    piece = body[at : at + chunk] if refers_to is None else b""
                    upto += len(piece)
                    sha.update(piece)
                    data = (head if not k else b"") + bytes(piece)
                    rows.append((record_no, page_id, k, len(pieces), upto, sha.copy().digest(), data))
                    held += len(data)
                    if held >= 8 * chunk:
                        yield batch(rows)
                        rows, held = [], 0
                record_no += 1
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), FIELDS)], [n for n, _ in FIELDS])

    typed(pages, least).mapInArrow(run, SCHEMA).write.parquet(to)


class Damaged(ValueError):
    """A chunk that is missing, out of order or does not have the bytes it was written with."""


def parse(data: bytes) -> tuple[dict[str, str], int]:
    """The WARC head's fields and where the payload begins."""
    end = data.index(b"\r\n\r\n")
    fields = dict(re.findall(r"([^:\r\n]+): ([^\r\n]*)", data[:end].decode()))
    return fields, data.index(b"\r\n\r\n", end + 4) + 4


class _Record:
    """One record as its chunks come by; holds a digest, not the payload."""

    def __init__(self, first: bytes):
        self.fields, begin = parse(first)
        self.http = int(re.search(rb"Content-Length: (\d+)", first[first.index(b"\r\n\r\n") : begin])[1])
        self.sha, self.size, self.next = hashlib.sha1(), 0, 0
        self.begin = begin

    def take(self, no: int, upto: int, sha1: bytes, data: memoryview) -> None:
        body = data[self.begin if not no else 0 :]
        self.sha.update(body)
        self.size += len(body)
        if no != self.next or self.size != upto or self.sha.copy().digest() != sha1:
            raise Damaged(f"{self.fields.get('WARC-Record-ID')}, chunk {no}")
        self.next += 1

    def row(self, page_id) -> tuple:
        kind, digest = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (base64.b32encode(self.sha.digest()).decode() != digest or self.size != self.http):
            raise Damaged(f"{self.fields.get('WARC-Record-ID')}: digest")
        refers = self.fields.get("WARC-Refers-To")
        to = uuid.UUID(refers[10:-1]).int if refers else None
        return page_id, self.http, digest, kind, to - (1 << 128) if to is not None and to >> 127 else to, self.fields["WARC-Target-URI"]


OUT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
OUT_FIELDS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from chunks that come in order."""
    record, key, left = None, None, 0
    for b in batches:
        rows = []
        for i, page_id, no, n, upto, sha1, data in zip(*(b.column(c) for c, _ in FIELDS)):
            i, no, n, raw = i.as_py(), no.as_py(), n.as_py(), memoryview(data.as_buffer())
            if no == 0:
                if left:
                    raise Damaged(f"record {key}: {left} chunks are missing")
                record, key, left = _Record(bytes(raw)), i, n
            if record is None or i != key or not left:
                raise Damaged(f"record {i}, chunk {no}")
            record.take(no, upto.as_py(), sha1.as_py(), raw)
            left -= 1
            if not left:
                rows.append(record.row(page_id.as_py()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), OUT_FIELDS)], [n for n, _ in OUT_FIELDS])
    if left:
        raise Damaged(f"record {key}: {left} chunks are missing")


def read(spark: SparkSession, at: str) -> DataFrame:
    """One row per record of the table at `at`, with its payload's digest checked."""
    chunks = spark.read.schema(SCHEMA).parquet(at)
    one = chunks.filter("n_chunks = 1").mapInArrow(_digests, OUT)
    many = chunks.filter("n_chunks > 1").repartition("record_no").sortWithinPartitions("record_no", "chunk_no").mapInArrow(_digests, OUT)
    return one.unionByName(many)


def payload_chunks(spark: SparkSession, at: str) -> DataFrame:
    """record_no, page_id, chunk_no, data: payload bytes of every chunk, without heads; what a consumer streams."""
    chunks = spark.read.schema(SCHEMA).parquet(at)
    before = F.coalesce(F.lag("payload_upto").over(Window.partitionBy("record_no").orderBy("chunk_no")), F.lit(0))
    head = (F.length("data") - (F.col("payload_upto") - before)).cast("int")
    return chunks.withColumn("_head", head).selectExpr("record_no", "page_id", "chunk_no", "substring(data, _head + 1) as data")


def round_trip(pages: DataFrame, to: str | None = None) -> DataFrame:
    spark = pages.sparkSession
    kept = to is not None
    to = to or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, to)
    if not kept:
        gone_at_exit(spark, to)
    return read(spark, to).drop("url")


PAGES_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', (4 * strpos('0123456789abcdef', substr(hex, (i + 1)::INT, 1)) - 3)::INT, 4)), '') AS bits FROM d),
f AS (SELECT hex, min(page_id) AS first_id FROM d GROUP BY 1)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (list_sum(list_transform(range(5), lambda j: (substr(bits, (5 * i + j + 1)::INT, 1) = '1')::INT * (16 >> j::INT)))::INT + 1), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b JOIN f USING (hex)
"""
