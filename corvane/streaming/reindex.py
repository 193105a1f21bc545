"""A streaming front to derivation: new record files are parsed and upserted batch by batch.

The file source never reports removals or edits in place, so operators.records.manifest_diff
stays the complete way; this one keeps up between full runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.sources.store import front_matter


def new_files(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """file_path, mtime, front, body of record files as they appear below root."""
    raw = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_per_batch).load(root)
    f = raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("mtime"), front_matter(F.col("value")).alias("r"))
    return f.select("file_path", "mtime", F.col("r.front").alias("front"), F.col("r.body").alias("body"))


def follow(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand each micro-batch to apply(rows, batch number); with once, what is there now and no more."""
    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
