"""Points and polygons: lookups, containment, rasterising and validation.

Polygons are tables of directed edges (poly_id, x1, y1, x2, y2). Rings of one polygon share its id, so that holes work by parity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..model import RasterMeta, RouteError

#: Polygon edges that may be broadcast against points; more are joined by bands of y.
BROADCAST_EDGES = 200_000


def dedupe_points(points: DataFrame) -> DataFrame:
    """One row for each id: the coordinates of its last row, at the place of its first."""
    last = F.max_by(F.struct("x", "y"), F.col("ord"))
    return points.groupBy("id").agg(F.min("ord").alias("ord"), last.alias("p")).select(F.col("id").cast("int").alias("id"), F.col("ord").cast("int").alias("ord"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def locate(points: DataFrame, meta: RasterMeta) -> DataFrame:
    """points with the row and col of their pixel."""
    row, col = X.world_to_pixel(F.col("x"), F.col("y"), meta)
    return points.withColumns({"row": row, "col": col})


def contains(points: DataFrame, edges: DataFrame) -> DataFrame:
    """points (id, x, y) with inside: strictly inside the union of the polygons.

    Crossings of a ray to the right are counted for each polygon, then polygons are united. A point on the border of one
    polygon is outside unless another polygon holds it or borders on it there too (a shared edge is inside the union).
    """
    small = edges.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES
    px, py = F.col("x"), F.col("y")
    cross = (F.col("y1") > py) != (F.col("y2") > py)
    x_at = (F.col("x2") - F.col("x1")) * (py - F.col("y1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1")
    turn = (F.col("x2") - F.col("x1")) * (py - F.col("y1")) - (px - F.col("x1")) * (F.col("y2") - F.col("y1"))
    on = (turn == 0) & px.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & py.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    reach = py.between(F.least("y1", "y2"), F.greatest("y1", "y2")) & (px <= F.greatest("x1", "x2"))
    table = F.broadcast(edges) if small else edges
    hit = points.select("id", "x", "y").join(table, reach).groupBy("id", "poly_id").agg(F.sum((cross & (px < x_at)).cast("int")).alias("crossings"), F.max(on).alias("on"))
    each = hit.groupBy("id").agg(F.max((F.col("crossings") % 2 == 1) & ~F.col("on")).alias("within"), F.sum(F.col("on").cast("int")).alias("borders"))
    inside = F.coalesce(F.col("within") | (F.col("borders") >= 2), F.lit(False))
    return points.join(each, "id", "left").withColumn("inside", inside).drop("within", "borders")


def _pixel_edges(edges: DataFrame, meta: RasterMeta) -> DataFrame:
    """Edges in pixel coordinates (c1, r1, c2, r2), for rasters without rotation."""
    a, _, c, _, e, f = meta.transform
    px = lambda v, o, s: (F.col(v) - F.lit(o)) / F.lit(s)
    return edges.select("poly_id", px("x1", c, a).alias("c1"), px("y1", f, e).alias("r1"), px("x2", c, a).alias("c2"), px("y2", f, e).alias("r2"))


def rasterize_centers(edges: DataFrame, meta: RasterMeta) -> DataFrame:
    """Pixels (row, col) whose centre is inside a polygon: crossings of each pixel row, paired to column intervals."""
    e = _pixel_edges(edges, meta).where("r1 <> r2")
    first = F.greatest(F.ceil(F.least("r1", "r2") - 0.5).cast("int"), F.lit(0))
    last = F.least((F.ceil(F.greatest("r1", "r2") - 0.5) - 1).cast("int"), F.lit(meta.height - 1))
    rows = e.withColumns({"first": first, "last": last}).where("first <= last").withColumn("row", F.explode(F.sequence("first", "last")))
    at = F.col("c1") + (F.col("row") + 0.5 - F.col("r1")) * (F.col("c2") - F.col("c1")) / (F.col("r2") - F.col("r1"))
    lines = rows.select("poly_id", "row", at.alias("at")).groupBy("poly_id", "row").agg(F.sort_array(F.collect_list("at")).alias("xs"))
    pairs = lines.select("row", F.explode(F.transform(F.sequence(F.lit(0), (F.size("xs") / 2 - 1).cast("int")), lambda i: F.struct(F.get("xs", i * 2).alias("lo"), F.get("xs", i * 2 + 1).alias("hi")))).alias("p"))
    lo, hi = F.greatest(F.ceil(F.col("p.lo") - 0.5).cast("int"), F.lit(0)), F.least((F.ceil(F.col("p.hi") - 0.5) - 1).cast("int"), F.lit(meta.width - 1))
    return _cells(pairs.select("row", lo.alias("lo"), hi.alias("hi")))


def rasterize_touched(edges: DataFrame, meta: RasterMeta) -> DataFrame:
    """Pixels that a polygon touches: centres inside, and every closed cell that an edge meets."""
    e = _pixel_edges(edges, meta)
    low, high = F.least("r1", "r2"), F.greatest("r1", "r2")
    first, last = F.greatest((F.ceil(low) - 1).cast("int"), F.lit(0)), F.least(F.floor(high).cast("int"), F.lit(meta.height - 1))
    rows = e.withColumns({"first": first, "last": last}).where("first <= last").withColumn("row", F.explode(F.sequence("first", "last")))
    top, bottom = F.greatest(low, F.col("row").cast("double")), F.least(high, F.col("row") + 1.0)
    x_at = lambda y: F.when(F.col("r1") == F.col("r2"), None).otherwise(F.col("c1") + (y - F.col("r1")) * (F.col("c2") - F.col("c1")) / (F.col("r2") - F.col("r1")))
    a, b = F.coalesce(x_at(top), F.col("c1")), F.coalesce(x_at(bottom), F.col("c2"))
    lo = F.greatest((F.ceil(F.least(a, b)) - 1).cast("int"), F.lit(0))
    hi = F.least(F.floor(F.greatest(a, b)).cast("int"), F.lit(meta.width - 1))
    return _cells(rows.select("row", lo.alias("lo"), hi.alias("hi"))).unionByName(rasterize_centers(edges, meta)).distinct()


def _cells(intervals: DataFrame) -> DataFrame:
    return intervals.where("lo <= hi").select("row", F.explode(F.sequence("lo", "hi")).alias("col")).distinct()


def same_crs(raster: str | None, layer: str | None, what: str) -> None:
    if raster is not None and layer is not None and raster != layer:
        raise RouteError(f"the CRS of the {what} differs from the raster's")


def validation_report(points: DataFrame, edges: DataFrame | None, mask: DataFrame | None, meta: RasterMeta) -> DataFrame:
    """(id, x, y, row, col, vector, raster): each point against the polygon and against the rasterised mask, as far as there are any."""
    judged = points.withColumn("inside", F.lit(None).cast("boolean")) if edges is None else contains(points, edges)
    placed = locate(judged, meta)
    if mask is not None:
        placed = placed.join(mask.select("row", "col", F.lit(True).alias("on_mask")), ["row", "col"], "left").withColumn("on_mask", F.coalesce("on_mask", F.lit(False)))
    else:
        placed = placed.withColumn("on_mask", F.lit(None).cast("boolean"))
    within = F.col("row").between(0, meta.height - 1) & F.col("col").between(0, meta.width - 1)
    vector, raster = X.point_status(F.col("inside"), within, F.col("on_mask"))
    return placed.select("id", "x", "y", "row", "col", vector.alias("vector"), raster.alias("raster"))


def invalid_ids(points: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ids of the points outside, in file order, joined by ', '."""
    out = contains(points, edges).where("not inside")
    return out.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda p: p["id"].cast("string")), ", ").alias("invalid_ids"))


def checked_points(points: DataFrame, edges: DataFrame | None, policy: str, origin: int) -> DataFrame:
    """points under a policy: 'ignore' keeps all; 'abort' stops if any is outside; 'skip' drops points outside and stops if the origin is one."""
    if edges is None or policy == "ignore":
        return points
    judged = contains(points, edges)
    out = [r["id"] for r in judged.where("not inside").select("id").orderBy("ord").take(1000)]
    if policy == "abort" and out:
        raise RouteError("points outside the mask", out)
    if origin in out:
        raise RouteError("the origin is outside the mask", [origin])
    return judged.where("inside").drop("inside")
