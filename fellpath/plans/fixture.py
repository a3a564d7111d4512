"""The raster, points and polygons that the registered queries run on, derived from the driver's tables.

A 48 x 64 raster in 30 m pixels: a cell's cost comes from the quantities of the line items that fall on it; points are
all suppliers. A second raster grows with the table: its side is the root of the number of line items. Polygons, masks and
sessions are literals.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..model import RasterMeta

META = RasterMeta((30.0, 0.0, 500000.0, 0.0, -30.0, 8000000.0), 48, 64, None, "EPSG:32719")
DX, DY = META.res
#: Factors and corridor radius of the hierarchical queries, and their origin.
FACTORS, RADIUS, ORIGIN = (16, 8, 4), 6, 8

#: Two polygons that share the edge x = 501000, and one that overlaps the second (world coordinates): (poly_id, x, y) rings.
RINGS = {
    1: [(500100.0, 7999900.0), (501000.0, 7999900.0), (501000.0, 7998700.0), (500100.0, 7998700.0)],
    2: [(501000.0, 7999900.0), (501700.0, 7999500.0), (501500.0, 7998800.0), (501000.0, 7998700.0)],
    3: [(501300.0, 7999700.0), (501860.0, 7999650.0), (501830.0, 7999010.0), (501310.0, 7999000.0)],
}
EDGES = [(k, *ring[i], *ring[(i + 1) % len(ring)]) for k, ring in RINGS.items() for i in range(len(ring))]
#: Points with repeated ids: (id, ord, x, y).
REPEATED = [(4, 0, 500015.0, 7999985.0), (7, 1, 500500.0, 7999000.0), (4, 2, 500985.5, 7999500.25), (9, 3, 501000.0, 7999000.0), (7, 4, 501300.0, 7998750.0), (2, 5, 500000.0 - 15.0, 8000000.0 + 15.0)]
SESSIONS = [("20310405_101112",), ("20310406_070809_AllToAll",), ("notes",), ("2031040_short",), ("20240101_010101",)]
FINISHED = [("20310406_070809_AllToAll", "ruta_final_desde_8_a_3.shp", 3), ("20310406_070809_AllToAll", "ruta_final_desde_8_a_6.shp", 6), ("20310406_070809_AllToAll", "ruta_fase1_desde_8_a_0.shp", 0), ("20310405_101112", "ruta_final_desde_8_a_4.shp", 4), ("20310406_070809_AllToAll", "ruta_final_desde_5_a_4.shp", 4)]


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, cost, nodata) from lineitem; whole-number sums are the same in every engine."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_quantity")
    sums = items.groupBy((F.col("l_partkey") % 48).cast("int").alias("row"), (F.col("l_orderkey") % 64).cast("int").alias("col")).agg(F.sum(F.col("l_quantity").cast("long")).alias("s"))
    return sums.select("row", "col", (1 + F.col("s") % 9).cast("double").alias("cost"), (F.col("s") % 11 == 0).alias("nodata"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, cost): raw costs of all cells."""
    return raster(spark, sf_dir).select("row", "col", "cost")


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).where("not nodata").select("row", "col", "cost")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ord, row, col, x, y): every supplier is a point."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    out = s.select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_suppkey").cast("int").alias("ord"), ((F.col("s_suppkey") * 29 + 3) % 48).cast("int").alias("row"), ((F.col("s_suppkey") * 37 + 5) % 64).cast("int").alias("col"))
    x, y = X.pixel_center(F.col("row"), F.col("col"), META)
    return out.withColumns({"x": x, "y": y})


def side(spark: SparkSession, sf_dir: str) -> int:
    """Rows and columns of the growing raster: from the row counts in the footers of the table's files."""
    return isqrt(spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())


def grown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(row, col, cost) of the growing raster, and its side; cells without a line item are impassable."""
    n = side(spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    row, col = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31) % n, (F.col("l_partkey") * 104729 + F.col("l_orderkey") * 13 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % n
    sums = items.groupBy(row.cast("int").alias("row"), col.cast("int").alias("col")).agg(F.sum(F.col("l_quantity").cast("long")).alias("s"))
    return sums.select("row", "col", (1 + F.col("s") % 9).cast("double").alias("cost")), n


def grown_points(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(id, row, col): every supplier on the growing raster."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    return s.select(F.col("s_suppkey").cast("int").alias("id"), ((F.col("s_suppkey") * 7001 + 11) % n).cast("int").alias("row"), ((F.col("s_suppkey") * 9001 + 7) % n).cast("int").alias("col"))


def polygon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "poly_id int, x1 double, y1 double, x2 double, y2 double")


def mask(spark: SparkSession) -> DataFrame:
    """(row, col): all cells but a band of columns with a gap."""
    cells = spark.range(48 * 64).select(F.floor(F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"))
    return cells.where("not (col between 30 and 31 and row between 5 and 40)")
