"""Token-ID files: ids of documents in ascending doc_id order, range coded.

A data set is a Parquet table (the store Spark itself reads and writes, so files
need no path that only one machine sees) whose rows are segments:

    part, segment   place of the segment: parts follow each other by doc_id
    start           ids of the part before the segment
    total           ids in the segment
    doc_ids         little-endian signed 64-bit, ascending
    lengths         little-endian unsigned 32-bit: ids of each document, end id included
    blocks          range_coder blocks, each with its own checksum

Documents are range partitioned by doc_id, sorted inside partitions, encoded and
written once. A reader needs the parts' totals (one row per written part) to know
where each part starts. A segment holds whole documents, SEGMENT ids or more by
less than one document.

Defined cases: null text is empty and has only the end id; a null doc_id comes
first; equal ids stay beside each other in the order of their texts; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import range_coder, vocab
from corvane.llm.scratch import gone_at_exit, shared_dir

SEGMENT = range_coder.BLOCK * range_coder.GROUP
NO_ID = -(1 << 63)
SCHEMA = "part int, segment int, start bigint, total bigint, doc_ids binary, lengths binary, blocks binary"


def write(docs: DataFrame, to: str, path: str | None = None, end_id: int = 0) -> None:
    """Encode documents (doc_id, text) into the token-ID files at `to`."""
    sent = vocab.ship(docs.sparkSession, path or vocab.default_path("byte_bpe_50k.json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, segment, start = TaskContext.get().partitionId(), 0, 0
        coder = vocab.encoder(sent.value)
        end = np.array([end_id], dtype="<u4")
        names, ids, lengths, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            stream = np.concatenate(ids)
            row = [part, segment, start, len(stream), np.array(names, dtype="<i8").tobytes(), np.array(lengths, dtype="<u4").tobytes(), range_coder.encode(stream)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["part", "segment", "start", "total", "doc_ids", "lengths", "blocks"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                x = coder(text.as_py() or "")
                names.append(NO_ID if doc_id is None else doc_id)
                ids += [x, end]
                lengths.append(len(x) + 1)
                held += len(x) + 1
                if held >= SEGMENT:
                    yield flush()
                    segment, start = segment + 1, start + held
                    names, ids, lengths, held = [], [], [], 0
        if names:
            yield flush()

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, SCHEMA).write.parquet(to)


def read(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) of every document of the files."""
    return _read(spark, at, "ids binary", lambda raw: raw, pa.binary())


def digest(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files."""
    return _read(spark, at, "ids_crc32 bigint", zlib.crc32, pa.int64())


def _read(spark: SparkSession, at: str, made: str, make, kind) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, start, names, lengths, blocks in zip(*(b.column(c).to_pylist() for c in ("part", "start", "doc_ids", "lengths", "blocks"))):
                names, lengths = np.frombuffer(names, dtype="<i8"), np.frombuffer(lengths, dtype="<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                raw = memoryview(range_coder.decode(blocks).tobytes())
                out = [make(bytes(raw[4 * i : 4 * j])) for i, j in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), part, dtype=np.int32)), pa.array(names, mask=names == NO_ID), pa.array(begins + start), pa.array(lengths), pa.array(out, kind)], ["part", "doc_id", "start", "n_tokens", made.split()[0]])

    files = spark.read.schema(SCHEMA).parquet(at)
    totals = files.groupBy("part").agg(F.sum("total").alias("n"))
    # one row per written part, however long the texts: small enough to be summed in one place and sent to all
    before = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    docs = files.mapInArrow(run, f"part int, doc_id bigint, start bigint, n_tokens bigint, {made}")
    return docs.join(F.broadcast(before), docs["part"] == before["_part"]).select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", made.split()[0])


def round_trip(docs: DataFrame, to: str | None = None, path: str | None = None) -> DataFrame:
    """Write docs and read the digest back."""
    import uuid

    spark = docs.sparkSession
    kept = to is not None
    to = to or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, to, path)
    if not kept:
        gone_at_exit(spark, to)
    return digest(spark, to)
