"""Route and status tables: Parquet, partitioned by session; the presence of a row is the mark that a route is done."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ROUTES


def write_routes(routes: DataFrame, path: str) -> None:
    """Append route features; one folder for each session."""
    routes.write.mode("append").partitionBy("session_id").parquet(path)


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """All route features; an empty table if nothing was written yet. A filter on session_id prunes the other sessions."""
    try:
        return spark.read.option("mergeSchema", "false").parquet(path).withColumn("session_id", F.col("session_id").cast("string"))
    except AnalysisException:
        return spark.createDataFrame([], ROUTES)


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session_id) of all sessions."""
    return read_routes(spark, path).select("session_id").distinct()
