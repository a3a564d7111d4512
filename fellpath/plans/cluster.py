"""What iterative plans need from the cluster: a shared folder and lineage that is cut without losing data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset on a single machine."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        told = tempfile.mkdtemp(prefix="fellpath-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, removed when the application ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/fellpath-{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file to a folder of its own in the shared folder until the application ends; returns its address."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/fellpath-{uuid.uuid4().hex}/{name}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target)
    out.write(data)
    out.close()
    fs.deleteOnExit(target.getParent())
    return fs.makeQualified(target).toString()


def cut(df: DataFrame) -> DataFrame:
    """df with its rows written to the shared folder and read again: lineage ends, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fellpath-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
