"""Binary files with names of their own, written by tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import ArrowInvalid
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _address(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Hadoop's settings complete it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    own = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return own.replace("file:/", "file:///", 1) if own.startswith("file:/") and not own.startswith("file://") else own


def write_files(spark: SparkSession, files: DataFrame, folder: str) -> int:
    """Write files (name, content) under folder; returns their number. A name that is there is overwritten, so that a task may run again.

    Tasks write to the store themselves where Arrow knows its scheme (file, hdfs, s3, gs, ...); a local folder must be shared by
    driver and executors. For any other scheme files stream through the driver, one by one.
    """
    address = _address(spark, folder).rstrip("/")
    try:
        stores.FileSystem.from_uri(address)
    except ArrowInvalid:
        return _streamed(spark, files, folder)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = stores.FileSystem.from_uri(address)
        made: set[str] = set()
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                target = f"{top}/{name}"
                parent = target.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(target) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(frame)]})

    return files.select("name", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def _streamed(spark: SparkSession, files: DataFrame, folder: str) -> int:
    path, conf, n = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for row in files.select("name", "content").toLocalIterator():
        target = path(f"{folder.rstrip('/')}/{row['name']}")
        out = target.getFileSystem(conf).create(target, True)
        out.write(bytearray(row["content"]))
        out.close()
        n += 1
    return n
