"""A stream of what changes in a record store, removals and edits included.

take() compares the store with the manifest of the last snapshot, in Spark, and writes
what changed under the next version; a version counts once its small file is there.
The stream's offsets are versions: it emits (version, file_path, change) of each, from
the part files that Spark wrote, so a batch can be replayed and is read by tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from corvane.operators import records
from corvane.sources import shared, store
from corvane.sources.sink import file_system

SCHEMA = "version bigint, file_path string, change string"


def versions(spark: SparkSession, state: str) -> int:
    held = [n for n in shared.names(spark, f"{state}/versions") if n.endswith(".json")]
    return int(held[-1].removesuffix(".json")) if held else 0


def take(spark: SparkSession, root: str, state: str) -> int:
    """Record the store's files as the next version under state; the version that is newest then. Nothing changed, no version."""
    last = versions(spark, state)
    new = f"{state}/data/{last + 1:09d}"
    shared.remove(spark, new)  # of a snapshot that was lost
    store.manifest(spark, root).write.parquet(f"{new}/manifest")
    now = spark.read.parquet(f"{new}/manifest")
    old = spark.read.parquet(f"{state}/data/{last:09d}/manifest") if last else now.limit(0)
    records.manifest_diff(old, now).filter("change <> 'unchanged'").write.parquet(f"{new}/changes")
    if spark.read.parquet(f"{new}/changes").isEmpty():
        return last
    shared.put_json(spark, f"{state}/versions/{last + 1:09d}.json", {"version": last + 1})
    return last + 1


class _Part(InputPartition):
    def __init__(self, version: int, path: str):
        self.version, self.path = version, path


class _Reader(DataSourceStreamReader):
    def __init__(self, state: str):
        self.state = state

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        fs, top = file_system(self.state)
        held = [x.base_name for x in fs.get_file_info(pafs.FileSelector(f"{top}/versions", allow_not_found=True)) if x.base_name.endswith(".json") and not x.base_name.startswith(".")]
        return {"version": max((int(n.removesuffix(".json")) for n in held), default=0)}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        fs, top = file_system(self.state)
        out = []
        for v in range(start["version"] + 1, end["version"] + 1):
            parts = fs.get_file_info(pafs.FileSelector(f"{top}/data/{v:09d}/changes"))
            out += [_Part(v, x.path) for x in parts if x.base_name.endswith(".parquet") and not x.base_name.startswith((".", "_"))]
        return out or [_Part(0, "")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.state)
        if partition.path:
            with fs.open_input_file(partition.path) as f:
                for b in pq.ParquetFile(f).iter_batches(columns=["file_path", "change"]):
                    yield pa.RecordBatch.from_arrays([pa.array([partition.version] * b.num_rows, pa.int64()), b.column("file_path"), b.column("change")], ["version", "file_path", "change"])


class Snapshots(DataSource):
    """format("store_snapshots"), option path: the state folder of take()."""

    @classmethod
    def name(cls) -> str:
        return "store_snapshots"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"].rstrip("/"))


def changes(spark: SparkSession, state: str) -> DataFrame:
    """The stream of SCHEMA."""
    spark.dataSource.register(Snapshots)
    return spark.readStream.format("store_snapshots").load(state)


def settled(batch: DataFrame) -> DataFrame:
    """file_path, change of a batch of one or several versions: what they come to for each file."""
    ends = batch.groupBy("file_path").agg(F.min_by("change", "version").alias("first"), F.max_by("change", "version").alias("last"))
    change = F.when((F.col("first") == "added") & (F.col("last") == "removed"), F.lit(None)).when(F.col("first") == "added", "added").when(F.col("last") == "added", "updated").otherwise(F.col("last"))
    return ends.select("file_path", change.alias("change")).filter("change is not null")


def follow(spark: SparkSession, state: str, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand the settled changes of each micro-batch to apply(changes, batch number); with once, what is there now and no more."""
    w = changes(spark, state).writeStream.foreachBatch(lambda df, n: apply(settled(df), n)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def applied(spark: SparkSession, root: str, diff: DataFrame, statements: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements, embeddings) after changes: added and updated files are read anew, an edit keeps its vector, a removal drops it."""
    fresh = diff.filter(F.col("change").isin("added", "updated")).select("file_path")
    now, _ = store.statements(spark, root)
    out = records.applied(statements, now.join(fresh, "file_path", "left_semi"), diff).select(*statements.columns)
    known = out.select(F.lit("statement").alias("source_kind"), "full_id")
    return out, records.kept_vectors(embeddings, known)
