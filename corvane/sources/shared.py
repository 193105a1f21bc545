"""Folders that all executors share, and small control files in them."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where that is unset and all runs on one machine, as in tests."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("corvane.shared.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        given = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("corvane.shared.dir", given)
        gone_at_exit(spark, given)
    return given


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete path when the application ends."""
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What stands directly below path; nothing where there is no path."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def put_json(spark: SparkSession, path: str, value) -> None:
    """A small file, whole or not there: written beside its place and renamed. What is there already is never replaced."""
    p, fs = _path(spark, path)
    temp, _ = _path(spark, f"{path}.tmp")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if fs.exists(p) or not fs.rename(temp, p):
        fs.delete(temp, False)
        raise RuntimeError(f"{path} was written by another")


def get_json(spark: SparkSession, path: str):
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written under the shared folder and read back, deleted when the application ends: several steps read it, lost executors cost no more than a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
