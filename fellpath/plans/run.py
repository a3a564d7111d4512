"""Whole runs from files to files: the engine's entry points."""

from __future__ import annotations

import datetime as dt
import logging
import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import RasterMeta, RouteConfig
from ..operators import vector as V
from ..sources import georaster, shapefile, tables
from . import routing as R
from . import session as S
from .cluster import cut

log = logging.getLogger("fellpath")


#: Name of the persistent log in the output folder.
LOG = "fellpath.log"


@contextmanager
def log_to(path: str | None) -> Iterator[None]:
    """Append the engine's messages to a file on the driver (none if path is None), and show them on its console."""
    form = logging.Formatter("%(asctime)s - %(levelname)s - %(message)s")
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path is not None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        handlers.append(logging.FileHandler(path, mode="a", encoding="utf-8"))
    for handler in handlers:
        handler.setFormatter(form)
        log.addHandler(handler)
    log.setLevel(logging.INFO)
    try:
        yield
    finally:
        for handler in handlers:
            log.removeHandler(handler)
            handler.close()


def _log_path(out: str) -> str | None:
    """Where the log goes: into an output folder that the driver sees as a local one."""
    scheme, _, rest = out.partition("://")
    return os.path.join(rest if scheme == "file" else out, LOG) if not rest or scheme == "file" else None


def load(spark: SparkSession, raster: str, points: str, polygon: str | None, config: RouteConfig) -> tuple[RasterMeta, DataFrame, DataFrame, DataFrame | None]:
    """(meta, pixels, points with row and col, mask): layers are loaded, their CRSs checked and the points' policy applied.

    No polygon, or a polygon file that does not exist, means that the whole raster is searched.
    """
    meta = georaster.load_meta(spark, raster)
    pixels = georaster.load_pixels(spark, raster, meta)
    table, crs = shapefile.load_points(spark, points, config.id_field)
    if config.policy == "skip":
        V.same_crs(meta.crs, crs, "points")
    edges, mask = None, None
    if polygon is not None:
        try:
            edges, polygon_crs = shapefile.load_polygon_edges(spark, polygon)
        except FileNotFoundError:
            log.warning("no polygon at %s: the whole raster is searched", polygon)
        else:
            V.same_crs(meta.crs, polygon_crs, "mask polygon")
            mask = cut(V.rasterize_touched(edges, meta))
    table = V.checked_points(table, edges, config.policy, config.origin)
    return meta, cut(pixels), cut(V.locate(table, meta)), mask


def chosen(done: DataFrame, pairs: DataFrame, suffix: str) -> str | None:
    """The session that a run goes on with: the last one of its kind, if it lacks a route; None: a new one."""
    last = S.latest_session(S.of_kind(done.select("session_id").distinct(), suffix)).first()["session_id"]
    if last is None:
        return None
    if S.pending_pairs(pairs, done, last).isEmpty():
        log.info("the last session %s is complete", last)
        return None
    log.info("the last session %s is incomplete and goes on", last)
    return last


def route(spark: SparkSession, raster: str, points: str, out: str, polygon: str | None = None, config: RouteConfig | None = None, everyone: bool = False, resume: bool = False, shapefiles: bool = True, session: str | None = None, log_file: str | None = None) -> DataFrame:
    """Route one origin to all points (or all pairs) and write route features; returns the status table, in the order of the point file.

    out/routes holds the features as Parquet by session, out/<session>/ the shapefiles if asked for. With resume the last session of the
    same origin (or of all pairs) goes on if it lacks a route: only what it lacks is searched; if it is complete, or there is none, a
    new session begins. A route whose search fails is a row with its error; a failure of the run is logged and raised. Messages are
    appended to log_file (by default a file in out, where out is a local folder).
    """
    config = config or RouteConfig()
    with log_to(log_file or _log_path(out)):
        try:
            return _routed(spark, raster, points, out, polygon, config, everyone, resume, shapefiles, session)
        except Exception:
            log.exception("the run stopped")
            raise
        finally:
            log.info("the run ended")


def _routed(spark: SparkSession, raster: str, points: str, out: str, polygon: str | None, config: RouteConfig, everyone: bool, resume: bool, shapefiles: bool, session: str | None) -> DataFrame:
    log.info("a run begins: %s, %s", raster, points)
    meta, pixels, located, mask = load(spark, raster, points, polygon, config)
    done = tables.read_routes(spark, f"{out}/routes")
    pairs = cut(R.all_pairs(located) if everyone else R.one_to_all_pairs(located, config.origin))
    suffix = "_AllToAll" if everyone else f"_desde_punto_{config.origin}"
    if resume and session is None:
        session = chosen(done, pairs, suffix)
    session = session or dt.datetime.now(dt.UTC).strftime("%Y%m%d_%H%M%S") + suffix
    todo = cut(S.pending_pairs(pairs, done, session)) if resume else pairs
    log.info("session %s: %d routes to find", session, todo.count())
    results = cut(R.hierarchical(todo, pixels, meta, config, mask))
    features = cut(R.emitted(results, meta, config.factors, session))
    tables.write_routes(features, f"{out}/routes")
    if shapefiles:
        shapefile.write_routes(features, out, meta.crs)
    place = located.select(F.col("id").alias("_id"), F.col("ord").alias("_ord"))
    a, b = place.select(F.col("_id").alias("origin"), F.col("_ord").alias("_a")), place.select(F.col("_id").alias("dest"), F.col("_ord").alias("_b"))
    status = cut(S.status_rows(results, session).join(a, "origin").join(b, "dest"))
    for r in status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect():
        log.info("session %s: %d routes %s", session, r["n"], r["status"])
    return status.orderBy("_a", "_b").select("session_id", "origin", "dest", "status", "factor", "plan_b", "error")
