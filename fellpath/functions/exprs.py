"""Scalar functions of the routing engine as Column expressions (all inside whole-stage code generation)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import RasterMeta

#: The eight steps to a neighbour: row and column difference; the code of a step is (dr + 1) * 3 + (dc + 1).
OFFSETS = tuple((dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0))


def inverse(meta: RasterMeta) -> tuple[float, float, float, float, float, float]:
    """The inverse affine transform (world to pixel)."""
    a, b, c, d, e, f = meta.transform
    scale = 1.0 / (a * e - b * d)
    ia, ib, id_, ie = e * scale, -b * scale, -d * scale, a * scale
    return ia, ib, -c * ia - f * ib, id_, ie, -c * id_ - f * ie


def world_to_pixel(x: Column, y: Column, meta: RasterMeta) -> tuple[Column, Column]:
    """(row, col) of a world point, truncated toward zero."""
    ia, ib, ic, id_, ie, if_ = inverse(meta)
    return (x * F.lit(id_) + y * F.lit(ie) + F.lit(if_)).cast("int"), (x * F.lit(ia) + y * F.lit(ib) + F.lit(ic)).cast("int")


def pixel_center(row: Column, col: Column, meta: RasterMeta) -> tuple[Column, Column]:
    """World (x, y) of a pixel's centre."""
    a, b, c, d, e, f = (F.lit(float(v)) for v in meta.transform)
    return a * (col + 0.5) + b * (row + 0.5) + c, d * (col + 0.5) + e * (row + 0.5) + f


def to_coarse(index: Column, factor: int) -> Column:
    """Index of the coarse cell that holds a pixel (floor division, also below zero)."""
    return F.floor(index / F.lit(float(factor))).cast("int")


def disc_center(index: Column, factor: int) -> Column:
    """Full-resolution index at the middle of a coarse cell, truncated."""
    return (index * factor + F.lit(factor / 2.0)).cast("int")


def heuristic_anisotropic(r1: Column, c1: Column, r2: Column, c2: Column, dx: float, dy: float) -> Column:
    v, h = (r2 - r1) * F.lit(dy), (c2 - c1) * F.lit(dx)
    return F.sqrt(v * v + h * h)


def heuristic_isotropic(r1: Column, c1: Column, r2: Column, c2: Column, dx: float, dy: float) -> Column:
    v, h = (r2 - r1).cast("double"), (c2 - c1).cast("double")
    return F.sqrt(v * v + h * h) * F.lit(math.sqrt(dx * dy))


def step_length(dr: Column, dc: Column, dx: float, dy: float) -> Column:
    v, h = dr * F.lit(dy), dc * F.lit(dx)
    return F.sqrt(v * v + h * h)


def edge_cost(a: Column, b: Column, length: Column) -> Column:
    """Mean of two cells times the step length; the sum keeps the raster's own type."""
    return (a + b) / F.lit(2.0) * length


def priority(g: Column, h: Column, weight: float) -> Column:
    return g + F.lit(weight) * h


def direction(dr: Column, dc: Column) -> Column:
    return ((dr + 1) * 3 + (dc + 1)).cast("smallint")


def direction_rows(code: Column) -> Column:
    return (F.floor(code / 3) - 1).cast("int")


def direction_cols(code: Column) -> Column:
    return (code % 3 - 1).cast("int")


def passable(cost: Column, nodata: float | None) -> Column:
    """Not nodata, not infinite, not NaN."""
    ok = cost.isNotNull() & ~F.isnan(cost) & (F.abs(cost) != F.lit(float("inf")))
    return ok if nodata is None else ok & (cost != F.lit(nodata))


def line_wkt(points: Column) -> Column:
    """WKT of an array of (x, y) in order."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ", "), F.lit(")"))


def route_name(phase: str, origin: Column, dest: Column, style: str = "short") -> Column:
    """File name of a route: ``ruta_<phase>_<origin>_a_<dest>.shp``, with ``desde_`` before the origin in the long style."""
    return F.concat(route_head(phase, origin, style), route_tail(dest))


def route_head(phase: str, origin: Column, style: str = "short") -> Column:
    """The part of a route's name that its origin gives."""
    return F.concat(F.lit(f"ruta_{phase}_{'desde_' if style == 'long' else ''}"), origin.cast("string"), F.lit("_a_"))


def route_tail(dest: Column) -> Column:
    """The part of a route's name that its destination gives."""
    return F.concat(dest.cast("string"), F.lit(".shp"))


def session_name(at: Column, origin: Column) -> Column:
    """Name of a run's session: its time, and the origin (null: all pairs)."""
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.coalesce(F.concat(F.lit("_desde_punto_"), origin.cast("string")), F.lit("_AllToAll")))


def point_status(inside: Column, in_raster: Column, on_mask: Column) -> tuple[Column, Column]:
    """Labels of a point against the polygon and against the raster mask; in_raster is null for a point without a pixel, on_mask without a mask."""
    vector = F.when(inside.isNull(), "N/A").when(inside, "DENTRO").otherwise("FUERA")
    raster = F.when(on_mask.isNull(), "N/A").when(in_raster.isNull(), "ERROR").when(~in_raster, "FUERA (Píxel fuera de límites)").when(on_mask, "DENTRO").otherwise("FUERA")
    return vector, raster
