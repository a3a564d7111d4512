"""Sessions: which run to resume, which destinations are left, and the status of every route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_session(sessions: DataFrame) -> DataFrame:
    """One row (session_id): the last by name of the sessions whose name starts with eight digits."""
    return sessions.where(F.col("session_id").rlike("^[0-9]{8}")).agg(F.max("session_id").alias("session_id"))


def completed(routes: DataFrame, session: str, origin: int) -> DataFrame:
    """(dest) of the final routes that a session holds for an origin, by file name in either style."""
    name = F.col("id").rlike(f"^ruta_final_(desde_)?{origin}_a_.*\\.shp$")
    return routes.where((F.col("session_id") == session) & name).select("dest").distinct()


def is_incomplete(routes: DataFrame, points: DataFrame, session: str, origin: int) -> bool:
    """Whether a session holds fewer routes of an origin than there are other points."""
    return completed(routes, session, origin).count() < points.select("id").distinct().count() - 1


def pending(points: DataFrame, routes: DataFrame, session: str, origin: int) -> DataFrame:
    """Points (id) still to be routed from an origin: all but the origin and the finished ones."""
    done = completed(routes, session, origin).withColumnRenamed("dest", "id")
    return points.where(F.col("id") != origin).select("id").distinct().join(done, "id", "left_anti")


def pending_pairs(pairs: DataFrame, routes: DataFrame, session: str) -> DataFrame:
    """The pairs (origin, dest, ...) for which a session has no final route."""
    held = routes.where((F.col("session_id") == session) & (F.col("phase") == "final")).select("origin", "dest").distinct()
    return pairs.join(held, ["origin", "dest"], "left_anti").select(*pairs.columns)


def of_kind(sessions: DataFrame, suffix: str) -> DataFrame:
    """The sessions of one origin, or of all pairs: those whose names end with a run's suffix."""
    return sessions.where(F.col("session_id").rlike("^[0-9]{8}") & F.col("session_id").endswith(suffix))


def status_rows(results: DataFrame, session: str) -> DataFrame:
    """The status table of a run's results."""
    error = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    return results.select(F.lit(session).alias("session_id"), F.col("origin").cast("int").alias("origin"), F.col("dest").cast("int").alias("dest"), "status", "factor", "plan_b", error.alias("error"))
