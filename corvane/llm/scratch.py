"""Shared, recoverable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where that is unset and all runs on one machine, as in tests."""
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir", None) or spark.conf.get("corvane.scratch.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        given = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("corvane.scratch.dir", given)
    return given


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete path when the application ends: results are lazy, so no sooner."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df under the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Have the driver collect garbage: Spark's cleaner drops what finished steps shuffled and broadcast only when their plans are collected."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back(spark)


def give_back(spark: SparkSession) -> bool:
    """Memory that the driver's JVM freed outside its heap back to the system, where it knows how (a JVM command from 17.0.9 on); the C library keeps it for each of hundreds of threads else."""
    from py4j.protocol import Py4JError

    jvm = spark.sparkContext._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # the server's own class is closed to callers from outside; its interface is not
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(server, given)
    except Py4JError:
        return False
    return True
