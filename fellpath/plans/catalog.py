"""The registered routing queries, and the SQL that computes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..model import RasterMeta, RouteConfig
from ..operators import corridor as C
from ..operators import grid as G
from ..operators import kernel as K
from ..operators import paths as P
from ..operators import vector as V
from ..sources import georaster, shapefile, tables
from . import fixture as T
from . import routing as R
from . import session as S
from .cluster import cut, scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
META, DX, DY = T.META, T.DX, T.DY

# --- pieces of SQL ----------------------------------------------------------------------------------------------------

_RASTER = """raster AS (
  SELECT CAST(l_partkey % 48 AS INT) AS row, CAST(l_orderkey % 64 AS INT) AS col, CAST(1 + SUM(CAST(l_quantity AS BIGINT)) % 9 AS DOUBLE) AS cost,
         SUM(CAST(l_quantity AS BIGINT)) % 11 = 0 AS nodata FROM lineitem GROUP BY 1, 2
), valid AS (SELECT row, col, cost FROM raster WHERE NOT nodata)"""
_POINTS = """points AS (
  SELECT id, id AS ord, row, col, 30.0::DOUBLE * (col + 0.5::DOUBLE) + 500000.0::DOUBLE AS x, -30.0::DOUBLE * (row + 0.5::DOUBLE) + 8000000.0::DOUBLE AS y
  FROM (SELECT CAST(s_suppkey AS INT) AS id, CAST((s_suppkey * 29 + 3) % 48 AS INT) AS row, CAST((s_suppkey * 37 + 5) % 64 AS INT) AS col FROM supplier)
)"""
_OFFSETS = "offsets(dr, dc) AS (VALUES " + ", ".join(f"({r}, {c})" for r, c in X.OFFSETS) + ")"


def _sql_edges(cells: str, dx: float, dy: float, name: str = "edges") -> str:
    return f"""{name} AS (
  SELECT a.row AS r1, a.col AS c1, b.row AS r2, b.col AS c2, CAST((dr + 1) * 3 + dc + 1 AS SMALLINT) AS dir,
         (a.cost + b.cost) / 2.0::DOUBLE * sqrt((dr * {dy}::DOUBLE) * (dr * {dy}::DOUBLE) + (dc * {dx}::DOUBLE) * (dc * {dx}::DOUBLE)) AS w
  FROM {cells} a, offsets, {cells} b WHERE b.row = a.row + dr AND b.col = a.col + dc
)"""


def _sql_field(start: str, edges: str = "edges", name: str = "field") -> str:
    return f"""{name}(src, row, col, g) USING KEY (src, row, col) AS (
  SELECT src, row, col, 0.0::DOUBLE FROM {start}
  UNION
  SELECT n.src, n.row, n.col, n.g FROM (
    SELECT f.src, e.r2 AS row, e.c2 AS col, min(f.g + e.w) AS g FROM {name} f JOIN {edges} e ON e.r1 = f.row AND e.c1 = f.col GROUP BY 1, 2, 3
  ) n LEFT JOIN recurring.{name} o ON o.src = n.src AND o.row = n.row AND o.col = n.col WHERE o.g IS NULL OR n.g < o.g
)"""


def _values(rows: list[tuple]) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


_POLYGON = f"poly(poly_id, x1, y1, x2, y2) AS ({_values(T.EDGES)})"
_START = f"start AS (SELECT id AS src, row, col FROM points WHERE id = {T.ORIGIN})"
#: The cells of a search from the origin: the valid ones and the origin's own, whatever it is.
_CELLS = "cells AS (SELECT row, col, cost FROM valid UNION SELECT r.row, r.col, r.cost FROM raster r JOIN start s ON r.row = s.row AND r.col = s.col)"
_FIELD = f"WITH RECURSIVE {_RASTER}, {_POINTS}, {_OFFSETS}, {_START}, {_CELLS}, {_sql_edges('cells', DX, DY)}, {_sql_field('start')}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- scans, projections, edges ----------------------------------------------------------------------------------------


@query(f"WITH {_RASTER} SELECT row, col, cost FROM valid WHERE (row * 64 + col) % 97 > 2")
def q_pixels_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passable pixels of a raster with nodata, NaN and infinite cells."""
    at = (F.col("row") * 64 + F.col("col")) % 97
    odd = F.when(F.col("nodata"), -9999.0).when(at == 0, float("nan")).when(at == 1, float("inf")).when(at == 2, float("-inf")).otherwise(F.col("cost"))
    return G.valid_pixels(T.raster(spark, sf_dir).select("row", "col", odd.alias("cost")), -9999.0)


@query(f"WITH {_RASTER}, p AS (SELECT CASE WHEN nodata THEN -9999.0::DOUBLE ELSE cost END AS cost FROM raster) SELECT count(*) AS n, count(*) FILTER (cost <> -9999) AS n_valid, min(cost) FILTER (cost <> -9999) AS min_cost, max(cost) FILTER (cost <> -9999) AS max_cost, avg(cost) FILTER (cost <> -9999) AS avg_cost FROM p")
def q_raster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = T.raster(spark, sf_dir).select("row", "col", F.when(F.col("nodata"), -9999.0).otherwise(F.col("cost")).alias("cost"))
    return G.raster_stats(cells, -9999.0)


@query(f"WITH p(id, ord, x, y) AS ({_values(T.REPEATED)}) SELECT id, CAST(min(ord) AS INT) AS ord, arg_max(x, ord) AS x, arg_max(y, ord) AS y FROM p GROUP BY id")
def q_points_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dedupe_points(spark.createDataFrame(T.REPEATED, "id int, ord int, x double, y double"))


_IA, _IB, _IC, _ID, _IE, _IF = X.inverse(META)


@query(f"WITH {_POINTS}, q(x, y) AS (SELECT x, y FROM points UNION ALL SELECT column2, column3 FROM (SELECT * FROM ({_values([(r[0], *r[2:]) for r in T.REPEATED])}) v(column1, column2, column3))) SELECT x, y, CAST(trunc(x * {_ID!r}::DOUBLE + y * {_IE!r}::DOUBLE + {_IF!r}::DOUBLE) AS INT) AS row, CAST(trunc(x * {_IA!r}::DOUBLE + y * {_IB!r}::DOUBLE + {_IC!r}::DOUBLE) AS INT) AS col FROM q")
def q_world_to_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame(T.REPEATED, "id int, ord int, x double, y double").select("x", "y")
    return V.locate(T.points(spark, sf_dir).select("x", "y").unionByName(more), META)


@query(f"WITH {_RASTER} SELECT row, col, 30.0::DOUBLE * (col + 0.5::DOUBLE) + 500000.0::DOUBLE AS x, -30.0::DOUBLE * (row + 0.5::DOUBLE) + 8000000.0::DOUBLE AS y FROM raster")
def q_pixel_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = X.pixel_center(F.col("row"), F.col("col"), META)
    return T.raster(spark, sf_dir).select("row", "col", x.alias("x"), y.alias("y"))


@query(f"WITH {_POINTS}, f(factor) AS (VALUES (16), (8), (4), (5)) SELECT id, factor, CAST(floor(row / factor::DOUBLE) AS INT) AS row, CAST(floor(col / factor::DOUBLE) AS INT) AS col, 30.0::DOUBLE * factor AS res_x, 30.0::DOUBLE * factor AS res_y, CAST(48 // factor AS INT) AS height, CAST(64 // factor AS INT) AS width FROM points, f")
def q_lowres_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, out = T.points(spark, sf_dir), None
    for f in (16, 8, 4, 5):
        m = META.scaled(f)
        part = p.select("id", F.lit(f).alias("factor"), X.to_coarse(F.col("row"), f).alias("row"), X.to_coarse(F.col("col"), f).alias("col"), F.lit(m.res[0]).alias("res_x"), F.lit(m.res[1]).alias("res_y"), F.lit(m.height).alias("height"), F.lit(m.width).alias("width"))
        out = part if out is None else out.unionByName(part)
    return out


_PAIRS = "pairs AS (SELECT a.id AS origin, b.id AS dest, a.row AS r1, a.col AS c1, b.row AS r2, b.col AS c2 FROM points a JOIN points b ON a.id < b.id)"


@query(f"WITH {_POINTS}, {_PAIRS} SELECT origin, dest, sqrt(((r2 - r1) * 10.0::DOUBLE) * ((r2 - r1) * 10.0::DOUBLE) + ((c2 - c1) * 30.0::DOUBLE) * ((c2 - c1) * 30.0::DOUBLE)) AS h FROM pairs")
def q_heuristic_aniso(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.all_pairs(T.points(spark, sf_dir))
    return p.select("origin", "dest", X.heuristic_anisotropic(*[F.col(c) for c in ("r1", "c1", "r2", "c2")], 30.0, 10.0).alias("h"))


@query(f"WITH {_POINTS}, {_PAIRS} SELECT origin, dest, sqrt((r2 - r1)::DOUBLE * (r2 - r1) + (c2 - c1)::DOUBLE * (c2 - c1)) * sqrt(300.0::DOUBLE) AS h FROM pairs")
def q_heuristic_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.all_pairs(T.points(spark, sf_dir))
    return p.select("origin", "dest", X.heuristic_isotropic(*[F.col(c) for c in ("r1", "c1", "r2", "c2")], 30.0, 10.0).alias("h"))


@query(f"WITH {_RASTER}, {_OFFSETS}, {_sql_edges('valid', DX, DY)} SELECT r1, c1, r2, c2, w FROM edges")
def q_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges(T.valid(spark, sf_dir), DX, DY).drop("dir")


@query(f"WITH {_RASTER}, {_OFFSETS}, {_sql_edges('valid', DX, DY)} SELECT dir, CAST(dir // 3 - 1 AS INT) AS dr, CAST(dir % 3 - 1 AS INT) AS dc, count(*) AS n, sum(CAST(r2 - r1 = dir // 3 - 1 AND c2 - c1 = dir % 3 - 1 AS BIGINT))::BIGINT AS agree FROM edges GROUP BY dir")
def q_edge_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.edges(T.valid(spark, sf_dir), DX, DY)
    dr, dc = X.direction_rows(F.col("dir")), X.direction_cols(F.col("dir"))
    same = ((F.col("r2") - F.col("r1") == dr) & (F.col("c2") - F.col("c1") == dc)).cast("long")
    return e.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.sum(same).alias("agree")).select("dir", dr.alias("dr"), dc.alias("dc"), "n", "agree")


# --- resampling, masks, corridors -------------------------------------------------------------------------------------


def _block_sql(f: int) -> str:
    return f"WITH {_RASTER} SELECT CAST(row // {f} AS INT) AS row, CAST(col // {f} AS INT) AS col, avg(cost) AS cost FROM valid WHERE row // {f} < {48 // f} AND col // {f} < {64 // f} GROUP BY 1, 2"


@query(_block_sql(4))
def q_downsample_f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.downsample(T.valid(spark, sf_dir), 4, META)


@query(_block_sql(8))
def q_downsample_f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.downsample(T.valid(spark, sf_dir), 8, META)


@query(_block_sql(16))
def q_downsample_f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.downsample(T.valid(spark, sf_dir), 16, META)


@query(
    f"""WITH {_RASTER}, r(i) AS (SELECT unnest(range(0, 9))), c(j) AS (SELECT unnest(range(0, 12))), o AS (
  SELECT CAST(i AS INT) AS row, CAST(j AS INT) AS col, cost,
         CAST((least((v.row + 1) * 9, (i + 1) * 48) - greatest(v.row * 9, i * 48)) * (least((v.col + 1) * 12, (j + 1) * 64) - greatest(v.col * 12, j * 64)) AS DOUBLE) AS w
  FROM valid v JOIN r ON v.row * 9 < (i + 1) * 48 AND (v.row + 1) * 9 > i * 48 JOIN c ON v.col * 12 < (j + 1) * 64 AND (v.col + 1) * 12 > j * 64
) SELECT row, col, sum(cost * w) / sum(w) AS cost FROM o GROUP BY 1, 2"""
)
def q_downsample_f5_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.downsample(T.valid(spark, sf_dir), 5, META, resample="extent")


_MASK = "mask AS (SELECT CAST(i // 64 AS INT) AS row, CAST(i % 64 AS INT) AS col FROM (SELECT unnest(range(0, 3072)) AS i) WHERE NOT (i % 64 BETWEEN 30 AND 31 AND i // 64 BETWEEN 5 AND 40))"


@query(f"WITH {_MASK} SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col FROM mask WHERE row % 4 = 0 AND col % 4 = 0")
def q_mask_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.decimate_mask(T.mask(spark), 4)


#: A coarse path at factor 8: the diagonal of the coarse grid.
_COARSE = [(i, i) for i in range(6)]
_DISCS = f"k(r, c) AS ({_values(_COARSE)}), discs AS (SELECT DISTINCT p.row, p.col FROM raster p JOIN k ON (p.row - (k.r * 8 + 4)) * (p.row - (k.r * 8 + 4)) + (p.col - (k.c * 8 + 4)) * (p.col - (k.c * 8 + 4)) < 36)"


@query(f"WITH {_MASK}, {_DISCS.replace('raster p', '(SELECT CAST(i // 64 AS INT) AS row, CAST(i % 64 AS INT) AS col FROM (SELECT unnest(range(0, 3072)) AS i)) p')} SELECT row, col FROM discs")
def q_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corridor(spark.createDataFrame(_COARSE, "row int, col int"), 8, T.RADIUS, 48, 64)


@query(f"WITH {_MASK}, {_DISCS.replace('raster p', 'mask p')} SELECT row, col FROM discs")
def q_corridor_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.within_mask(q_corridor(spark, sf_dir), T.mask(spark))


# --- fields and paths -------------------------------------------------------------------------------------------------


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.points(spark, sf_dir).where(F.col("id") == T.ORIGIN).select(F.col("id").alias("src"), "row", "col")


def _origin_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(G.with_start(T.valid(spark, sf_dir), T.pixels(spark, sf_dir), _source(spark, sf_dir)))


def _field(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = _origin_cells(spark, sf_dir)
    return cells, cut(K.tiled_field(cells, _source(spark, sf_dir), DX, DY, 32))


@query(f"{_FIELD} SELECT src, row, col, g FROM field")
def q_distance_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field(spark, sf_dir)[1]


@query(f"{_FIELD} SELECT src, row, col, g FROM field")
def q_distance_field_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same field by one tile that holds the whole raster."""
    return K.tiled_field(_origin_cells(spark, sf_dir), _source(spark, sf_dir), DX, DY, 64)


_COARSE4 = "low AS (SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, avg(cost) AS cost FROM valid GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {_RASTER}, {_OFFSETS}, {_COARSE4}, {_sql_edges('low', 120.0, 120.0)}, start(src, row, col) AS (SELECT 1, row, col FROM low ORDER BY row, col LIMIT 1), {_sql_field('start')} SELECT src, row, col, g FROM field")
def q_distance_field_relax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational relaxation on the raster at factor 4, from its first cell."""
    low = cut(G.downsample(T.valid(spark, sf_dir), 4, META))
    start = low.orderBy("row", "col").limit(1).select(F.lit(1).alias("src"), "row", "col")
    return P.relax_field(G.edges(low, 120.0, 120.0), start)


@query(f"{_FIELD} SELECT {T.ORIGIN} AS origin, p.id AS dest, f.g AS cost FROM points p LEFT JOIN field f ON f.row = p.row AND f.col = p.col WHERE p.id <> {T.ORIGIN}")
def q_one_to_all_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least cost from the origin to every other point; null where it cannot be reached."""
    routes = R.named(R.one_to_all_pairs(T.points(spark, sf_dir), T.ORIGIN))
    cells = cut(T.raster(spark, sf_dir))
    found = R.full_search(routes, cells.select("row", "col", "cost"), cells.where("not nodata").select("row", "col", "cost"), META, _config())
    return routes.join(found, "route", "left").select("origin", "dest", "cost")


_PRED = f"""{_FIELD}, pred AS (
  SELECT f2.src, f2.row, f2.col, min(e.dir) AS dir FROM edges e JOIN field f1 ON f1.row = e.r1 AND f1.col = e.c1 JOIN field f2 ON f2.row = e.r2 AND f2.col = e.c2
  WHERE f1.g + e.w = f2.g AND NOT EXISTS (SELECT 1 FROM start s WHERE s.row = f2.row AND s.col = f2.col) GROUP BY 1, 2, 3
)"""


@query(f"{_PRED} SELECT src, row, col, dir FROM pred")
def q_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, field = _field(spark, sf_dir)
    return P.predecessors(field, G.edges(cells, DX, DY), _source(spark, sf_dir))


_CHASE = f"""{_PRED}, chase AS (
  SELECT p.id AS dest, p.row, p.col, 0 AS depth FROM points p JOIN field f ON f.row = p.row AND f.col = p.col WHERE p.id <> {T.ORIGIN}
  UNION ALL
  SELECT c.dest, CAST(c.row - (d.dir // 3 - 1) AS INT), CAST(c.col - (d.dir % 3 - 1) AS INT), c.depth + 1 FROM chase c JOIN pred d ON d.row = c.row AND d.col = c.col
), path AS (SELECT dest, CAST(max(depth) OVER (PARTITION BY dest) - depth AS INT) AS seq, row, col FROM chase)"""


def _chased(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, field = _field(spark, sf_dir)
    source = cut(_source(spark, sf_dir))
    back = P.predecessors(field, G.edges(cells, DX, DY), source)
    goals = T.points(spark, sf_dir).where(F.col("id") != T.ORIGIN).select(F.lit(T.ORIGIN).alias("src"), F.col("id").alias("route"), "row", "col").join(field.select("row", "col"), ["row", "col"], "left_semi")
    return P.chase(back, goals, source).select(F.col("route").alias("dest"), F.col("seq").cast("int").alias("seq"), "row", "col")


@query(f"{_CHASE} SELECT dest, seq, row, col FROM path")
def q_path_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical least-cost paths from the origin to every other point."""
    return _chased(spark, sf_dir)


@query(f"{_CHASE} SELECT dest, CAST(count(*) AS INT) AS n, CASE WHEN count(*) >= 2 THEN 'LINESTRING (' || string_agg(CAST(30 * col + 500015 AS VARCHAR) || ' ' || CAST(7999985 - 30 * row AS VARCHAR), ', ' ORDER BY seq) || ')' END AS wkt FROM path GROUP BY dest")
def q_path_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths as WKT; pixel centres are whole numbers here and are printed as such."""
    out = P.lines(_chased(spark, sf_dir), META, "dest")
    return out.select("dest", "n", X.line_wkt(F.transform("geom", lambda p: F.struct(p["x"].cast("long").alias("x"), p["y"].cast("long").alias("y")))).alias("wkt"))


# --- polygons ---------------------------------------------------------------------------------------------------------

_INSIDE = """each AS (
  SELECT p.id, poly_id, sum(CAST((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 AS INT)) AS crossings,
         max(CAST((x2 - x1) * (y - y1) - (x - x1) * (y2 - y1) = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2) AS INT)) AS touch
  FROM points p, poly GROUP BY 1, 2
), inside AS (SELECT id, max(CAST(crossings % 2 = 1 AND touch = 0 AS INT)) = 1 OR sum(touch) >= 2 AS inside FROM each GROUP BY id)"""


@query(f"WITH {_POINTS}, {_POLYGON}, {_INSIDE} SELECT id, inside FROM inside")
def q_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.contains(T.points(spark, sf_dir), T.polygon(spark)).select("id", "inside")


_CENTERS = f"""g AS (SELECT CAST(i // 64 AS INT) AS id, CAST(i // 64 AS INT) AS row, CAST(i % 64 AS INT) AS col FROM (SELECT unnest(range(0, 3072)) AS i)),
pe AS (SELECT poly_id, (x1 - 500000.0::DOUBLE) / 30.0::DOUBLE AS c1, (y1 - 8000000.0::DOUBLE) / -30.0::DOUBLE AS r1, (x2 - 500000.0::DOUBLE) / 30.0::DOUBLE AS c2, (y2 - 8000000.0::DOUBLE) / -30.0::DOUBLE AS r2 FROM poly),
centers AS (
  SELECT DISTINCT row, col FROM (
    SELECT row, col, poly_id, sum(CAST(c1 + (row + 0.5::DOUBLE - r1) * (c2 - c1) / (r2 - r1) <= col + 0.5::DOUBLE AS INT)) AS n
    FROM g JOIN pe ON (r1 <= row + 0.5::DOUBLE) <> (r2 <= row + 0.5::DOUBLE) GROUP BY 1, 2, 3
  ) WHERE n % 2 = 1
)"""


@query(f"WITH {_POLYGON}, {_CENTERS} SELECT row, col FROM centers")
def q_rasterize_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rasterize_centers(T.polygon(spark), META)


_TOUCHED = f"""{_CENTERS}, touched AS (
  SELECT row, col FROM centers UNION
  SELECT row, col FROM (
    SELECT row, col, CASE WHEN r1 = r2 THEN c1 ELSE c1 + (greatest(least(r1, r2), row::DOUBLE) - r1) * (c2 - c1) / (r2 - r1) END AS a,
           CASE WHEN r1 = r2 THEN c2 ELSE c1 + (least(greatest(r1, r2), row + 1.0::DOUBLE) - r1) * (c2 - c1) / (r2 - r1) END AS b
    FROM g JOIN pe ON least(r1, r2) <= row + 1 AND greatest(r1, r2) >= row
  ) WHERE least(a, b) <= col + 1 AND greatest(a, b) >= col
)"""


@query(f"WITH {_POLYGON}, {_TOUCHED} SELECT row, col FROM touched")
def q_rasterize_all_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rasterize_touched(T.polygon(spark), META)


@query(f"WITH {_POINTS}, {_POLYGON}, {_INSIDE}, {_TOUCHED} SELECT p.id, p.x, p.y, p.row, p.col, CASE WHEN inside THEN 'DENTRO' ELSE 'FUERA' END AS vector, CASE WHEN t.row IS NOT NULL THEN 'DENTRO' ELSE 'FUERA' END AS raster FROM points p JOIN inside USING (id) LEFT JOIN touched t ON t.row = p.row AND t.col = p.col")
def q_validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validation_report(T.points(spark, sf_dir).drop("row", "col"), T.polygon(spark), V.rasterize_touched(T.polygon(spark), META), META)


@query(f"WITH {_POINTS}, {_POLYGON}, {_INSIDE} SELECT string_agg(CAST(id AS VARCHAR), ', ' ORDER BY ord) AS invalid_ids FROM points JOIN inside USING (id) WHERE NOT inside")
def q_validate_invalid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.invalid_ids(T.points(spark, sf_dir), T.polygon(spark))


# --- whole plans ------------------------------------------------------------------------------------------------------


def _config(**changes) -> RouteConfig:
    return RouteConfig(origin=T.ORIGIN, factors=T.FACTORS, buffer=T.RADIUS, **changes)


def _hier_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw costs, and the cells that are allowed."""
    cells = T.raster(spark, sf_dir).select("row", "col", "cost", "nodata")
    return cut(cells.select("row", "col", "cost")), cut(cells.where("not nodata").select("row", "col"))


#: Hierarchical routing in one statement: coarse fields and chases at factor 8 for each destination, corridors, fine fields.
_HIER = f"""WITH RECURSIVE {_RASTER}, {_POINTS}, {_OFFSETS}, {_START},
low AS (SELECT CAST(row // 8 AS INT) AS row, CAST(col // 8 AS INT) AS col, avg(cost) AS cost FROM valid GROUP BY 1, 2),
{_sql_edges('low', 240.0, 240.0, 'ledges')},
lstart AS (SELECT src, CAST(row // 8 AS INT) AS row, CAST(col // 8 AS INT) AS col FROM start),
{_sql_field('lstart', 'ledges', 'lfield')},
lpred AS (
  SELECT f2.row, f2.col, min(e.dir) AS dir FROM ledges e JOIN lfield f1 ON f1.row = e.r1 AND f1.col = e.c1 JOIN lfield f2 ON f2.row = e.r2 AND f2.col = e.c2
  WHERE f1.g + e.w = f2.g AND NOT EXISTS (SELECT 1 FROM lstart s WHERE s.row = f2.row AND s.col = f2.col) GROUP BY 1, 2
), lchase AS (
  SELECT p.id AS dest, CAST(p.row // 8 AS INT) AS row, CAST(p.col // 8 AS INT) AS col FROM points p WHERE p.id <> {T.ORIGIN}
  UNION
  SELECT c.dest, CAST(c.row - (d.dir // 3 - 1) AS INT), CAST(c.col - (d.dir % 3 - 1) AS INT) FROM lchase c JOIN lpred d ON d.row = c.row AND d.col = c.col
), band AS (
  SELECT DISTINCT dest, v.row, v.col, v.cost FROM lchase c JOIN valid v
  ON (v.row - (c.row * 8 + 4)) * (v.row - (c.row * 8 + 4)) + (v.col - (c.col * 8 + 4)) * (v.col - (c.col * 8 + 4)) < 36
), hcells AS (
  SELECT dest, row, col, cost FROM band UNION SELECT p.id, r.row, r.col, r.cost FROM points p, raster r JOIN start s ON r.row = s.row AND r.col = s.col WHERE p.id <> {T.ORIGIN}
), hedges AS (
  SELECT a.dest, a.row AS r1, a.col AS c1, b.row AS r2, b.col AS c2,
         (a.cost + b.cost) / 2.0::DOUBLE * sqrt((dr * 30.0::DOUBLE) * (dr * 30.0::DOUBLE) + (dc * 30.0::DOUBLE) * (dc * 30.0::DOUBLE)) AS w
  FROM hcells a, offsets, hcells b WHERE b.dest = a.dest AND b.row = a.row + dr AND b.col = a.col + dc
), hfield(dest, row, col, g) USING KEY (dest, row, col) AS (
  SELECT p.id, s.row, s.col, 0.0::DOUBLE FROM points p, start s WHERE p.id <> {T.ORIGIN}
  UNION
  SELECT n.dest, n.row, n.col, n.g FROM (
    SELECT f.dest, e.r2 AS row, e.c2 AS col, min(f.g + e.w) AS g FROM hfield f JOIN hedges e ON e.dest = f.dest AND e.r1 = f.row AND e.c1 = f.col GROUP BY 1, 2, 3
  ) n LEFT JOIN recurring.hfield o ON o.dest = n.dest AND o.row = n.row AND o.col = n.col WHERE o.g IS NULL OR n.g < o.g
)
SELECT p.id AS dest, h.g AS cost FROM points p LEFT JOIN hfield h ON h.dest = p.id AND h.row = p.row AND h.col = p.col WHERE p.id <> {T.ORIGIN}"""


@query(_HIER)
def q_hier_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of hierarchical routes at factor 8 without plan B; null where the corridor has no route."""
    cells = T.raster(spark, sf_dir)
    config = RouteConfig(origin=T.ORIGIN, factors=(8,), buffer=T.RADIUS, plan_b=False)
    pairs = R.one_to_all_pairs(T.points(spark, sf_dir), T.ORIGIN)
    out = R.hierarchical(pairs, cut(cells.select("row", "col", "cost")), META, config, cut(cells.where("not nodata").select("row", "col")), coarse_mask=False)
    return out.select("dest", "cost")


@query(f"WITH RECURSIVE {_HIER[len('WITH RECURSIVE '):].rsplit('SELECT p.id AS dest', 1)[0].rstrip()}, {_CELLS}, {_sql_edges('cells', DX, DY)}, {_sql_field('start')} SELECT p.id AS dest, coalesce(h.g, f.g) AS cost, h.g IS NULL AND f.g IS NOT NULL AS plan_b FROM points p LEFT JOIN hfield h ON h.dest = p.id AND h.row = p.row AND h.col = p.col LEFT JOIN field f ON f.row = p.row AND f.col = p.col WHERE p.id <> {T.ORIGIN}")
def q_plan_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same routes with plan B for those whose corridor has no route."""
    cells = T.raster(spark, sf_dir)
    config = RouteConfig(origin=T.ORIGIN, factors=(8,), buffer=T.RADIUS)
    pairs = R.one_to_all_pairs(T.points(spark, sf_dir), T.ORIGIN)
    out = R.hierarchical(pairs, cut(cells.select("row", "col", "cost")), META, config, cut(cells.where("not nodata").select("row", "col")), coarse_mask=False)
    return out.select("dest", "cost", "plan_b")


def _sql_level(f: int) -> str:
    """Coarse search at factor f: cells whose top left pixel is allowed and the start's own, their field, and the predecessors."""
    low, res = f"low{f}", 30.0 * f
    return f"""{low} AS (
  SELECT l.row, l.col, l.cost FROM (SELECT CAST(row // {f} AS INT) AS row, CAST(col // {f} AS INT) AS col, avg(cost) AS cost FROM raster GROUP BY 1, 2) l
  WHERE EXISTS (SELECT 1 FROM valid v WHERE v.row = l.row * {f} AND v.col = l.col * {f}) OR EXISTS (SELECT 1 FROM start s WHERE s.row // {f} = l.row AND s.col // {f} = l.col)
), {_sql_edges(low, res, res, f"ledges{f}")},
lstart{f} AS (SELECT src, CAST(row // {f} AS INT) AS row, CAST(col // {f} AS INT) AS col FROM start),
{_sql_field(f"lstart{f}", f"ledges{f}", f"lfield{f}")},
lpred{f} AS (
  SELECT f2.row, f2.col, min(e.dir) AS dir FROM ledges{f} e JOIN lfield{f} f1 ON f1.row = e.r1 AND f1.col = e.c1 JOIN lfield{f} f2 ON f2.row = e.r2 AND f2.col = e.c2
  WHERE f1.g + e.w = f2.g AND NOT EXISTS (SELECT 1 FROM lstart{f} s WHERE s.row = f2.row AND s.col = f2.col) GROUP BY 1, 2
), lchase{f} AS (
  SELECT p.id AS dest, CAST(p.row // {f} AS INT) AS row, CAST(p.col // {f} AS INT) AS col FROM points p JOIN chosen c ON c.dest = p.id WHERE c.factor = {f}
  UNION
  SELECT c.dest, CAST(c.row - (d.dir // 3 - 1) AS INT), CAST(c.col - (d.dir % 3 - 1) AS INT) FROM lchase{f} c JOIN lpred{f} d ON d.row = c.row AND d.col = c.col
)"""


def _sql_routes() -> str:
    """Hierarchical routes with all factors and plan B in one statement: the parts of _HIER, with the first factor that has a route."""
    levels = [_sql_level(f) for f in T.FACTORS]
    fields = [x.split(", lchase")[0] for x in levels]
    chases = ["lchase" + x.split(", lchase", 1)[1] for x in levels]
    reached = " UNION ALL ".join(f"SELECT p.id AS dest, {k} AS k, {f} AS factor FROM points p JOIN lfield{f} l ON l.row = p.row // {f} AND l.col = p.col // {f}" for k, f in enumerate(T.FACTORS))
    discs = " UNION ALL ".join(f"SELECT dest, row * {f} + {f // 2} AS r, col * {f} + {f // 2} AS c FROM lchase{f}" for f in T.FACTORS)
    tail = _HIER[_HIER.index("hcells AS (") : _HIER.rindex("SELECT p.id AS dest")].rstrip()
    return f"""WITH RECURSIVE {_RASTER}, {_POINTS}, {_OFFSETS}, {_START}, {", ".join(fields)},
chosen AS (SELECT dest, CAST(arg_min(factor, k) AS INT) AS factor FROM ({reached}) WHERE dest <> {T.ORIGIN} GROUP BY dest),
{", ".join(chases)},
band AS (SELECT DISTINCT d.dest, v.row, v.col, v.cost FROM ({discs}) d JOIN valid v ON (v.row - d.r) * (v.row - d.r) + (v.col - d.c) * (v.col - d.c) < {T.RADIUS**2}),
{tail}, {_CELLS}, {_sql_edges("cells", DX, DY)}, {_sql_field("start")}
SELECT {T.ORIGIN} AS origin, p.id AS dest, CASE WHEN coalesce(h.g, f.g) IS NULL THEN 'unreachable' ELSE 'ok' END AS status, coalesce(c.factor, 0) AS factor, h.g IS NULL AND f.g IS NOT NULL AS plan_b, coalesce(h.g, f.g) AS cost
FROM points p LEFT JOIN chosen c ON c.dest = p.id LEFT JOIN hfield h ON h.dest = p.id AND h.row = p.row AND h.col = p.col LEFT JOIN field f ON f.row = p.row AND f.col = p.col WHERE p.id <> {T.ORIGIN}"""


@query(_sql_routes())
def q_hier_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full hierarchical run (factors 16, 8, 4, plan B) with the status of every route."""
    raw, allowed = _hier_tables(spark, sf_dir)
    out = R.hierarchical(R.one_to_all_pairs(T.points(spark, sf_dir), T.ORIGIN), raw, META, _config(), allowed)
    return out.select("origin", "dest", "status", F.coalesce("factor", F.lit(0)).alias("factor"), "plan_b", "cost")


@query(None)
def q_hier_all_to_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for all pairs: no SQL, as DuckDB would need a field for each pair."""
    raw, allowed = _hier_tables(spark, sf_dir)
    points = T.points(spark, sf_dir)
    found = R.answers(R.asked_by_all(points), raw, META, _config(), allowed)
    out = R.answered(R.all_pairs(points), found.drop("path", "coarse_path", "error"))
    return out.select("origin", "dest", *R.settled(), "cost", "n")


@query(f"{_FIELD} SELECT p.id AS dest, round(f.g, 6) AS cost FROM points p LEFT JOIN field f ON f.row = p.row AND f.col = p.col WHERE p.id <> {T.ORIGIN}")
def q_astar_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of A* searches over the whole raster, one group for each route (the same minimum, costs being 1 at least)."""
    routes = R.named(R.one_to_all_pairs(T.points(spark, sf_dir), T.ORIGIN))
    found = R.full_search(routes, T.pixels(spark, sf_dir), T.valid(spark, sf_dir), META, _config(mode="astar"))
    return routes.join(found, "route", "left").select("dest", F.round("cost", 6).alias("cost"))


@query(f"WITH {_POINTS}, {_PAIRS} SELECT origin, dest, r1, c1, r2, c2 FROM pairs")
def q_pairs_all_to_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.all_pairs(T.points(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_RASTER}, {_POINTS}, {_OFFSETS}, start AS (SELECT id AS src, row, col FROM points),
acells AS (SELECT s.src, v.row, v.col, v.cost FROM start s, valid v UNION SELECT s.src, r.row, r.col, r.cost FROM start s JOIN raster r ON r.row = s.row AND r.col = s.col),
aedges AS (
  SELECT a.src, a.row AS r1, a.col AS c1, b.row AS r2, b.col AS c2, (a.cost + b.cost) / 2.0::DOUBLE * sqrt((dr * 30.0::DOUBLE) * (dr * 30.0::DOUBLE) + (dc * 30.0::DOUBLE) * (dc * 30.0::DOUBLE)) AS w
  FROM acells a, offsets, acells b WHERE b.src = a.src AND b.row = a.row + dr AND b.col = a.col + dc
), afield(src, row, col, g) USING KEY (src, row, col) AS (
  SELECT src, row, col, 0.0::DOUBLE FROM start
  UNION
  SELECT n.src, n.row, n.col, n.g FROM (
    SELECT f.src, e.r2 AS row, e.c2 AS col, min(f.g + e.w) AS g FROM afield f JOIN aedges e ON e.src = f.src AND e.r1 = f.row AND e.c1 = f.col GROUP BY 1, 2, 3
  ) n LEFT JOIN recurring.afield o ON o.src = n.src AND o.row = n.row AND o.col = n.col WHERE o.g IS NULL OR n.g < o.g
)
SELECT a.id AS origin, b.id AS dest, f.g AS cost FROM points a JOIN points b ON a.id < b.id LEFT JOIN afield f ON f.src = a.id AND f.row = b.row AND f.col = b.col"""
)
def q_all_to_all_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least cost of every pair of points: one search for each start cell, whose costs all pairs of the same cells share."""
    points = T.points(spark, sf_dir)
    asks = cut(R.asked_by_all(points))
    found = R.full_search(asks, T.pixels(spark, sf_dir), T.valid(spark, sf_dir), META, _config())
    costs = cut(asks.join(found.select("route", "cost"), "route").drop("route"))
    return R.answered(R.all_pairs(points), costs).select("origin", "dest", "cost")


# --- a raster that grows with the tables ------------------------------------------------------------------------------

_GROWN = """side AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n FROM lineitem),
valid AS (
  SELECT CAST((l_orderkey * 7919 + l_partkey * 31) % n AS INT) AS row, CAST((l_partkey * 104729 + l_orderkey * 13 + l_suppkey * 3 + l_linenumber) % n AS INT) AS col,
         CAST(1 + SUM(CAST(l_quantity AS BIGINT)) % 9 AS DOUBLE) AS cost FROM lineitem, side GROUP BY 1, 2
), points AS (SELECT CAST(s_suppkey AS INT) AS id, CAST((s_suppkey * 7001 + 11) % n AS INT) AS row, CAST((s_suppkey * 9001 + 7) % n AS INT) AS col FROM supplier, side)"""
_GROWN_START = "start AS (SELECT 1 AS src, row, col FROM valid ORDER BY row, col LIMIT 1)"


def _first_cell(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min(F.struct("row", "col")).alias("c")).select(F.lit(1).alias("src"), "c.row", "c.col")


@query(f"WITH {_GROWN}, {_OFFSETS}, {_sql_edges('valid', DX, DY)} SELECT r1, c1, count(*) AS n, min(w) AS least, max(w) AS most FROM edges GROUP BY 1, 2")
def q_grown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, least and greatest weight of every cell's edges, on the raster that grows."""
    cells, _ = T.grown(spark, sf_dir)
    return G.edges(cut(cells), DX, DY).groupBy("r1", "c1").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("least"), F.max("w").alias("most"))


@query(f"WITH {_GROWN} SELECT CAST(v.row // 8 AS INT) AS row, CAST(v.col // 8 AS INT) AS col, avg(cost) AS cost FROM valid v, side WHERE v.row // 8 < n // 8 AND v.col // 8 < n // 8 GROUP BY 1, 2")
def q_grown_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, n = T.grown(spark, sf_dir)
    return G.downsample(cells, 8, RasterMeta(META.transform, n, n))


@query(f"WITH RECURSIVE {_GROWN}, {_OFFSETS}, {_sql_edges('valid', DX, DY)}, {_GROWN_START}, {_sql_field('start')} SELECT p.id AS dest, f.g AS cost FROM points p LEFT JOIN field f ON f.row = p.row AND f.col = p.col")
def q_grown_one_to_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least cost from the first cell of the growing raster to every supplier: one tiled field serves them all."""
    cells, n = T.grown(spark, sf_dir)
    cells = cut(cells)
    points = T.grown_points(spark, sf_dir, n).select(F.col("id").alias("dest"), "row", "col")
    field = K.tiled_field(cells, _first_cell(cells), DX, DY, 1024, points)
    return points.join(field.select("row", "col", F.col("g").alias("cost")), ["row", "col"], "left").select("dest", "cost")


# --- files written and read again -------------------------------------------------------------------------------------


def _files_meta() -> RasterMeta:
    return RasterMeta(META.transform, META.height, META.width, -9999.0, META.crs)


def _raster_files(spark: SparkSession, sf_dir: str) -> str:
    """The fixture raster as GeoTIFF files of 20 x 20 pixels; returns their pattern."""
    cells = T.raster(spark, sf_dir).select("row", "col", F.when(F.col("nodata"), -9999.0).otherwise(F.col("cost")).alias("cost"))
    folder = scratch(spark, "raster")
    georaster.write_pixels(cells, folder, _files_meta(), 20)
    return f"{folder}/*.tif"


@query(f"WITH {_RASTER} SELECT row, col, cost FROM valid")
def q_raster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster written as files of one grid and read again."""
    path = _raster_files(spark, sf_dir)
    meta = georaster.load_meta(spark, path)
    return G.valid_pixels(georaster.load_pixels(spark, path, meta), meta.nodata)


@query("SELECT 30.0::DOUBLE AS a, 500000.0::DOUBLE AS c, -30.0::DOUBLE AS e, 8000000.0::DOUBLE AS f, CAST(48 AS INT) AS height, CAST(64 AS INT) AS width, -9999.0::DOUBLE AS nodata, 'EPSG:32719' AS crs")
def q_raster_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the raster from the headers of its files."""
    m = georaster.load_meta(spark, _raster_files(spark, sf_dir))
    return spark.createDataFrame([(m.transform[0], m.transform[2], m.transform[4], m.transform[5], m.height, m.width, m.nodata, m.crs)], "a double, c double, e double, f double, height int, width int, nodata double, crs string")


@query(f"{_CHASE} SELECT printf('ruta_final_%d_a_%d.shp', {T.ORIGIN}, dest) AS id, seq, 30.0::DOUBLE * (col + 0.5::DOUBLE) + 500000.0::DOUBLE AS x, -30.0::DOUBLE * (row + 0.5::DOUBLE) + 8000000.0::DOUBLE AS y FROM path WHERE dest IN (SELECT dest FROM path GROUP BY dest HAVING count(*) >= 2)")
def q_route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes written as shapefiles of a session, listed and read again."""
    lines = P.lines(_chased(spark, sf_dir), META, "dest").where("n >= 2")
    routes = lines.select(F.lit("20310405_101112").alias("session_id"), X.route_name("final", F.lit(T.ORIGIN), F.col("dest")).alias("id"), "geom")
    folder = scratch(spark, "layers")
    shapefile.write_routes(routes, folder, META.crs)
    rows = shapefile.load_layer(spark, f"{folder}/20310405_101112/*.shp")
    return rows.select(F.col("attributes")["id"].alias("id"), "seq", "x", "y")


@query(f"WITH f(session_id, id, dest) AS ({_values(T.FINISHED)}) SELECT session_id, count(*) AS n FROM f GROUP BY session_id")
def q_session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes written by session, and the sessions listed from the table."""
    folder = scratch(spark, "sessions")
    tables.write_routes(spark.createDataFrame(T.FINISHED, "session_id string, id string, dest int"), folder)
    return tables.sessions(spark, folder).join(tables.read_routes(spark, folder), "session_id").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


# --- sessions and names -----------------------------------------------------------------------------------------------


@query(f"WITH s(session_id) AS ({_values(T.SESSIONS)}) SELECT max(session_id) AS session_id FROM s WHERE regexp_matches(session_id, '^[0-9]{{8}}')")
def q_latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_session(spark.createDataFrame(T.SESSIONS, "session_id string"))


@query(f"WITH {_POINTS}, f(session_id, id, dest) AS ({_values(T.FINISHED)}) SELECT p.id FROM points p ANTI JOIN (SELECT dest FROM f WHERE session_id = '20310406_070809_AllToAll' AND starts_with(id, 'ruta_final_desde_{T.ORIGIN}_a_') AND ends_with(id, '.shp')) d ON p.id = d.dest WHERE p.id <> {T.ORIGIN}")
def q_resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spark.createDataFrame(T.FINISHED, "session_id string, id string, dest int")
    session = S.latest_session(spark.createDataFrame(T.SESSIONS, "session_id string")).first()["session_id"]
    return S.pending(T.points(spark, sf_dir), done, session, T.ORIGIN)


@query(f"WITH {_POINTS}, {_PAIRS} SELECT printf('ruta_final_%d_a_%d.shp', origin, dest) AS final_name, printf('ruta_fase1_desde_%d_a_%d.shp', origin, dest) AS coarse_name FROM pairs")
def q_route_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the routes of all pairs: the parts that a point gives are made once for it, and put together for each pair."""
    points = T.points(spark, sf_dir)
    a = points.select(F.col("id").alias("origin"), X.route_head("final", F.col("id")).alias("final"), X.route_head("fase1", F.col("id"), "long").alias("coarse"))
    b = points.select(F.col("id").alias("dest"), X.route_tail(F.col("id")).alias("tail"))
    return R.paired(a, b).select(F.concat("final", "tail").alias("final_name"), F.concat("coarse", "tail").alias("coarse_name"))


@query(f"WITH {_POINTS} SELECT id, '20310405_101112_desde_punto_' || CAST(id AS VARCHAR) AS one, '20310405_101112_AllToAll' AS everyone FROM points")
def q_session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the sessions of a run from each point, and of a run over all pairs."""
    at = F.to_timestamp(F.lit("2031-04-05 10:11:12"))
    return T.points(spark, sf_dir).select("id", X.session_name(at, F.col("id")).alias("one"), X.session_name(at, F.lit(None)).alias("everyone"))


_LABELS = T.REPEATED + [(11, 6, 400000.0, 7999000.0), (12, 7, 501000.0, 9000000.0)]


@query(
    f"""WITH points(id, ord, x, y) AS (SELECT column1 * 100 + column2, column2, column3, column4 FROM ({_values(_LABELS)}) v(column1, column2, column3, column4)), {_POLYGON}, {_INSIDE}, {_TOUCHED},
placed AS (SELECT *, CAST(trunc((x - 500000.0::DOUBLE) / 30.0::DOUBLE) AS INT) AS col, CAST(trunc((8000000.0::DOUBLE - y) / 30.0::DOUBLE) AS INT) AS row FROM points)
SELECT p.id, CASE WHEN i.inside THEN 'DENTRO' ELSE 'FUERA' END AS vector,
       CASE WHEN NOT (p.row BETWEEN 0 AND 47 AND p.col BETWEEN 0 AND 63) THEN 'FUERA (Píxel fuera de límites)' WHEN t.row IS NOT NULL THEN 'DENTRO' ELSE 'FUERA' END AS raster
FROM placed p JOIN inside i USING (id) LEFT JOIN touched t ON t.row = p.row AND t.col = p.col"""
)
def q_validate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of points inside, outside and beyond the raster."""
    points = spark.createDataFrame([(i * 100 + o, o, x, y) for i, o, x, y in _LABELS], "id int, ord int, x double, y double")
    return V.validation_report(points, T.polygon(spark), V.rasterize_touched(T.polygon(spark), META), META).select("id", "vector", "raster")
