"""Pixels, neighbour edges and resampling as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..model import RasterMeta


def valid_pixels(pixels: DataFrame, nodata: float | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Passable pixels, inside the mask (row, col) if there is one. Rejects negative costs, for which no minimum exists."""
    out = pixels.where(X.passable(F.col("cost"), nodata))
    out = out.withColumn("cost", F.when(F.col("cost") < 0, F.raise_error(F.lit("passable costs must not be negative"))).otherwise(F.col("cost")))
    return out if mask is None else out.join(mask.select("row", "col"), ["row", "col"], "left_semi")


def with_start(valid: DataFrame, pixels: DataFrame, start: DataFrame) -> DataFrame:
    """valid plus the start cells (row, col) with their raw cost, whether passable or not."""
    raw = pixels.join(start.select("row", "col").distinct(), ["row", "col"], "left_semi").select(*valid.columns)
    return valid.unionByName(raw.join(valid.select("row", "col"), ["row", "col"], "left_anti"))


def raster_stats(pixels: DataFrame, nodata: float | None = None) -> DataFrame:
    ok = X.passable(F.col("cost"), nodata)
    return pixels.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("n_valid"), F.min(F.when(ok, F.col("cost"))).alias("min_cost"), F.max(F.when(ok, F.col("cost"))).alias("max_cost"), F.avg(F.when(ok, F.col("cost"))).alias("avg_cost"))


def neighbours(cells: DataFrame) -> DataFrame:
    """cells (row, col, ...) eight times, with dr, dc and the neighbour's row2, col2."""
    steps = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in X.OFFSETS]))
    return cells.withColumn("s", steps).select(*cells.columns, F.col("s.dr").alias("dr"), F.col("s.dc").alias("dc"), (F.col("row") + F.col("s.dr")).alias("row2"), (F.col("col") + F.col("s.dc")).alias("col2"))


def edges(valid: DataFrame, dx: float, dy: float) -> DataFrame:
    """Directed edges (r1, c1, r2, c2, dir, w) between neighbouring cells; cells outside the raster simply have no row."""
    apart = ["src"] if "src" in valid.columns else []  # cells of each source apart
    other = valid.select(*apart, F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("cost").alias("cost2"))
    return neighbours(valid).join(other, [*apart, "row2", "col2"]).select(*apart, F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("row2").alias("r2"), F.col("col2").alias("c2"), X.direction(F.col("dr"), F.col("dc")).alias("dir"), X.edge_cost(F.col("cost"), F.col("cost2"), X.step_length(F.col("dr"), F.col("dc"), dx, dy)).alias("w"))


def downsample(pixels: DataFrame, factor: int, meta: RasterMeta, nodata: float | None = None, resample: str = "block") -> DataFrame:
    """Averages of valid cells on the coarse grid of floor(H / factor) x floor(W / factor) cells; blocks without valid cells have no row.

    resample='block' takes whole blocks of factor x factor; 'extent' fits the whole extent into the coarse grid, so that
    cells on block borders count by the part that overlaps (the same if factor divides the size). Overlaps are counted in
    whole units of 1/coarse size, so that sums are exact for whole-number costs.
    """
    small, ok = meta.scaled(factor), pixels.where(X.passable(F.col("cost"), nodata))
    if resample == "block" or (meta.height % factor == 0 and meta.width % factor == 0):
        cell = ok.select(X.to_coarse(F.col("row"), factor).alias("row"), X.to_coarse(F.col("col"), factor).alias("col"), "cost").where(F.col("row").between(0, small.height - 1) & F.col("col").between(0, small.width - 1))
        return cell.groupBy("row", "col").agg(F.avg("cost").alias("cost"))

    def parts(index: Column, fine: int, coarse: int) -> Column:
        first, last = F.floor(index * coarse / F.lit(float(fine))).cast("int"), F.floor(((index + 1) * coarse - 1) / F.lit(float(fine))).cast("int")
        return F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("i"), (F.least((index + 1) * coarse, (i + 1) * fine) - F.greatest(index * coarse, i * fine)).alias("w")))

    rows = ok.withColumn("a", F.explode(parts(F.col("row"), meta.height, small.height))).withColumn("b", F.explode(parts(F.col("col"), meta.width, small.width)))
    weight = (F.col("a.w") * F.col("b.w")).cast("double")
    return rows.select(F.col("a.i").alias("row"), F.col("b.i").alias("col"), (F.col("cost") * weight).alias("s"), weight.alias("w")).groupBy("row", "col").agg((F.sum("s") / F.sum("w")).alias("cost"))


def decimate_mask(mask: DataFrame, factor: int) -> DataFrame:
    """The coarse mask: the top-left cell of each block decides."""
    return mask.where((F.col("row") % factor == 0) & (F.col("col") % factor == 0)).select((F.col("row") / factor).cast("int").alias("row"), (F.col("col") / factor).cast("int").alias("col"))


def tiles(pixels: DataFrame, size: int) -> DataFrame:
    """pixels packed by tile: (tile_r, tile_c, cells), each tile with a border of one cell of its neighbours (own = false).

    A cell goes to at most four tiles; a tile is one row of bounded size.
    """
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col("row") + d) / F.lit(float(size))).cast("int")))
    near_c = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col("col") + d) / F.lit(float(size))).cast("int")))
    spread = pixels.withColumn("tile_r", F.explode(near)).withColumn("tile_c", F.explode(near_c))
    own = (F.floor(F.col("row") / F.lit(float(size))) == F.col("tile_r")) & (F.floor(F.col("col") / F.lit(float(size))) == F.col("tile_c"))
    keys = ["src", "tile_r", "tile_c"] if "src" in pixels.columns else ["tile_r", "tile_c"]  # cells of each source apart
    return spread.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row", "col", "cost", own.alias("own")))).alias("cells"))
