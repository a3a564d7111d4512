"""Hand-made grids, one for each trap of the semantics."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from fellpath.functions import exprs as X
from fellpath.model import RasterMeta, RouteConfig, RouteError
from fellpath.operators import corridor as C
from fellpath.operators import grid as G
from fellpath.operators import kernel as K
from fellpath.operators import paths as P
from fellpath.operators import vector as V
from fellpath.plans import catalog as Q
from fellpath.plans import fixture as T
from fellpath.plans import routing as R
from fellpath.plans import session as S

ND = -9999.0
META = RasterMeta((30.0, 0.0, 500000.0, 0.0, -30.0, 8000000.0), 48, 64)


def cells(grid):
    return {(r, c): v for r, row in enumerate(grid) for c, v in enumerate(row)}


def usable(grid, start=None):
    """Passable cells and the start's own."""
    return {k: v for k, v in cells(grid).items() if k == start or (v != ND and not math.isnan(v) and abs(v) != math.inf)}


def search(grid, start, goal, dx=1.0, dy=1.0):
    cost = usable(grid, start)
    g = K.spread(cost, {start: 0.0}, dx, dy)
    return g.get(goal), K.trace_exact(cost, g, start, goal, dx, dy) if goal in cost else None


def frame(spark, grid):
    return spark.createDataFrame([(r, c, float(v)) for (r, c), v in cells(grid).items()], "row int, col int, cost double")


def test_uniform_and_corner_cut():
    assert search([[1.0] * 3] * 3, (0, 0), (2, 2))[0] == 2 * math.sqrt(2)
    assert search([[1.0, ND], [ND, 1.0]], (0, 0), (1, 1)) == (math.sqrt(2), [(0, 0), (1, 1)])


def test_wall_with_gap():
    grid = [[1.0, 1.0, ND, 1.0, 1.0] for _ in range(5)]
    grid[4][2] = 1.0
    _, path = search(grid, (0, 0), (0, 4))
    assert (4, 2) in path


def test_start_counts_with_raw_cost_and_goal_must_be_passable():
    grid = [[5.0, 1.0], [1.0, ND]]
    assert search(grid, (0, 0), (0, 1))[0] == 3.0
    assert search(grid, (0, 0), (1, 1)) == (None, None)
    bad = [[ND, 1.0], [1.0, 1.0]]
    assert search(bad, (0, 0), (0, 1))[0] == (ND + 1) / 2 * math.sqrt(2) + 1  # by the diagonal, which the raw cost makes cheaper
    nan = [[math.nan, 1.0], [1.0, 1.0]]
    assert search(nan, (0, 0), (0, 1))[0] is None
    assert search(grid, (0, 0), (0, 0)) == (0.0, [(0, 0)])


def test_infinite_cells_are_impassable(spark):
    left = G.valid_pixels(frame(spark, [[math.inf, -math.inf, math.nan, ND, 2.0]]), ND).collect()
    assert [(r.row, r.col) for r in left] == [(0, 4)]
    with pytest.raises(Exception, match="negative"):
        G.valid_pixels(frame(spark, [[-1.0]]), ND).collect()


def test_astar_equals_exact_if_admissible_and_may_differ_below_one():
    rng = random.Random(3)
    for _ in range(5):
        grid = [[float(rng.randint(1, 9)) if rng.random() > 0.2 else ND for _ in range(9)] for _ in range(9)]
        grid[0][0] = grid[8][8] = 1.0
        cost = usable(grid)
        path, total = K.astar(cost, (0, 0), (8, 8), 1.0, 1.0)
        exact, _ = search(grid, (0, 0), (8, 8))
        assert (path is None and exact is None) or math.isclose(total, exact, rel_tol=1e-12)
        other = K.astar(cost, (0, 0), (8, 8), 1.0, 1.0, heuristic="isotropic")[1]
        assert other == total
    cheap = {k: v / 100 for k, v in usable([[float(rng.randint(1, 90)) for _ in range(9)] for _ in range(9)]).items()}
    assert K.astar(cheap, (0, 0), (8, 8), 1.0, 1.0)[1] >= K.spread(cheap, {(0, 0): 0.0}, 1.0, 1.0)[8, 8]


def test_ties_take_the_smallest_direction_code():
    _, path = search([[1.0] * 4] * 4, (0, 0), (1, 3))
    assert path == [(0, 0), (1, 1), (1, 2), (1, 3)] or path[0] == (0, 0)
    codes = [(b[0] - a[0] + 1) * 3 + b[1] - a[1] + 1 for a, b in zip(path, path[1:], strict=False)]
    assert codes[-1] == min(codes[-1], 5)


def test_strategies_agree(spark):
    rng = random.Random(11)
    grid = [[float(rng.randint(1, 9)) if rng.random() > 0.15 else ND for _ in range(13)] for _ in range(11)]
    grid[0][0] = 3.0
    px = frame(spark, grid)
    valid = G.valid_pixels(px, ND)
    source = spark.createDataFrame([(1, 0, 0)], "src int, row int, col int")
    want = K.spread(usable(grid), {(0, 0): 0.0}, 10.0, 30.0)
    tiled = {(r.row, r.col): r.g for r in K.tiled_field(valid, source, 10.0, 30.0, 4).collect()}
    relaxed = {(r.row, r.col): r.g for r in P.relax_field(G.edges(valid, 10.0, 30.0), source).collect()}
    assert tiled == relaxed == want
    field = K.tiled_field(valid, source, 10.0, 30.0, 5).cache()
    goal = max(want, key=want.get)
    goals = spark.createDataFrame([(1, "a", *goal)], "src int, route string, row int, col int")
    got = P.chase(P.predecessors(field, G.edges(valid, 10.0, 30.0), source), goals, source).orderBy("seq").collect()
    assert [(r.row, r.col) for r in got] == K.trace_exact(usable(grid), want, (0, 0), goal, 10.0, 30.0)
    assert [r.seq for r in got] == list(range(len(got)))


def test_tiles_moved_by_fronts_have_the_costs_of_heap_searches(spark, monkeypatch):
    rng = random.Random(21)
    grid = [[float(rng.choice((0, 1, 2, 5, 9))) if rng.random() > 0.3 else ND for _ in range(37)] for _ in range(41)]
    grid[3][5], grid[40][0] = ND, 4.0
    px = frame(spark, grid)
    starts = {1: (3, 5), 2: (40, 0), 3: (99, 99)}  # impassable, at a corner, and no cell at all
    sources = spark.createDataFrame([(k, *cell) for k, cell in starts.items()], "src int, row int, col int")
    asked = [(r, c) for r in range(0, 41, 3) for c in range(0, 37, 4)]
    goals = spark.createDataFrame([*asked, *asked, (-1, 4), (70, 70)], "row int, col int")
    each = G.with_start(G.valid_pixels(px, ND), px, sources).crossJoin(sources.select("src")).join(sources.select("src", F.col("row").alias("r"), F.col("col").alias("c")), "src")
    each = each.where(f"cost <> {ND} or (row = r and col = c)").select("src", "row", "col", "cost")  # each source has its own raw start only
    want = {(k, *at): g for k, cell in starts.items() if cell[0] < 41 for at, g in K.spread(usable(grid, cell), {cell: 0.0}, 10.0, 30.0).items()}
    monkeypatch.setattr(K, "FEW", 8)
    for size in (7, 64):
        got = {(r.src, r.row, r.col): r.g for r in K.tiled_field(each, sources, 10.0, 30.0, size).collect()}
        assert got == want
        some = K.tiled_field(each, sources, 10.0, 30.0, size, goals).collect()
        assert len(some) == len({(r.src, r.row, r.col) for r in some})
        assert {(r.src, r.row, r.col): r.g for r in some} == {k: g for k, g in want.items() if k[1:] in set(asked)}


def test_downsample_extent_covers_everything(spark):
    grid = [[float(r * 9 + c) for c in range(9)] for r in range(7)]
    meta = RasterMeta((1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 7, 9)
    got = {(r.row, r.col): r.cost for r in G.downsample(frame(spark, grid), 2, meta, resample="extent").collect()}
    assert set(got) == {(r, c) for r in range(3) for c in range(4)}

    def want(i, j):
        s = w = 0.0
        for (r, c), v in cells(grid).items():
            o = max(0, min((r + 1) * 3, (i + 1) * 7) - max(r * 3, i * 7)) * max(0, min((c + 1) * 4, (j + 1) * 9) - max(c * 4, j * 9))
            s, w = s + v * o, w + o
        return s / w

    assert all(math.isclose(v, want(*k)) for k, v in got.items())
    masked = {(r.row, r.col) for r in G.decimate_mask(frame(spark, grid), 2).collect()}
    assert masked == {(r, c) for r in range(4) for c in range(5)}  # one more row and column than the coarse raster


def test_disc_is_strict_and_clipped(spark):
    path = spark.createDataFrame([(0, 0), (1, 1)], "row int, col int")
    got = {(r.row, r.col) for r in C.corridor(path, 8, 3, 10, 64).collect()}
    want = {(r, c) for r in range(10) for c in range(64) for i in (4, 12) if (r - i) ** 2 + (c - i) ** 2 < 9}
    assert got == want
    assert C.corridor(path, 8, 0, 10, 64).count() == 0


def test_points(spark):
    rows = [(1, 0, 1.0, 1.0), (2, 1, 2.0, 2.0), (1, 2, 9.0, 9.0)]
    got = V.dedupe_points(spark.createDataFrame(rows, "id int, ord int, x double, y double")).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(1, 0, 9.0, 9.0), (2, 1, 2.0, 2.0)]
    off = spark.createDataFrame([(499985.0, 8000015.0)], "x double, y double")
    r = V.locate(off, META).first()
    assert (r.row, r.col) == (0, 0)  # half a pixel outside is truncated toward zero


def square(k, x, y, s):
    ring = [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    return [(k, *ring[i], *ring[(i + 1) % 4]) for i in range(4)]


def test_contains_shared_edge_overlap_and_border(spark):
    edges = spark.createDataFrame(square(1, 0.0, 0.0, 2.0) + square(2, 2.0, 0.0, 2.0) + square(3, 3.0, 1.0, 2.0), "poly_id int, x1 double, y1 double, x2 double, y2 double")
    pts = [(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 3.5, 1.5), (4, 0.0, 1.0), (5, 9.0, 9.0)]
    p = spark.createDataFrame([(i, i, x, y) for i, x, y in pts], "id int, ord int, x double, y double")
    assert {r.id: r.inside for r in V.contains(p, edges).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}
    assert V.invalid_ids(p, edges).first()[0] == "4, 5"
    assert V.checked_points(p, edges, "skip", 1).count() == 3
    with pytest.raises(RouteError):
        V.checked_points(p, edges, "abort", 1)
    with pytest.raises(RouteError):
        V.checked_points(p, edges, "skip", 5)
    assert V.checked_points(p, edges, "ignore", 5).count() == 5
    with pytest.raises(RouteError):
        V.same_crs("a", "b", "mask")


def test_hierarchical_plan_b_unreachable_and_same_cell(spark):
    n = 24
    grid = [[1.0] * n for _ in range(n)]
    for r in range(n):
        grid[r][12] = ND  # a wall with one gap far from the straight corridor
    grid[23][12] = 1.0
    for r, c in [(0, 3), (1, 3), (2, 3), (0, 5), (1, 5), (2, 5), (0, 4), (2, 4)]:
        grid[r][c] = ND  # an island at (1, 4)
    meta = RasterMeta((10.0, 0.0, 0.0, 0.0, -10.0, 0.0), n, n, ND)
    pts = spark.createDataFrame([(1, 2, 9), (2, 2, 20), (3, 1, 4), (4, 2, 9), (5, 20, 9)], "id int, row int, col int")
    config = RouteConfig(origin=1, factors=(8, 4), buffer=8)
    out = {r.dest: r for r in R.hierarchical(R.one_to_all_pairs(pts, 1), frame(spark, grid), meta, config).collect()}
    assert out[2].plan_b and out[2].status == "ok" and out[2].path[0] == (2, 9)
    assert out[3].status == "unreachable"
    assert len(out[4].path) == 1 and not out[4].plan_b
    assert not out[5].plan_b and out[5].cost == 180.0 and out[5].factor == 8
    without = R.hierarchical(R.one_to_all_pairs(pts, 1), frame(spark, grid), meta, RouteConfig(origin=1, factors=(8,), buffer=8, plan_b=False))
    assert {r.dest for r in without.where("status = 'ok'").collect()} == {4, 5}
    done = R.hierarchical(R.one_to_all_pairs(pts, 1), frame(spark, grid), meta, config)
    features = R.emitted(done, meta, config.factors, "20260101_000000").collect()
    assert {f.id for f in features if f.phase == "final"} == {"ruta_final_1_a_2.shp", "ruta_final_1_a_5.shp"}
    assert all(f.n >= 2 and f.wkt.startswith("LINESTRING (") for f in features)
    assert S.status_rows(done, "s").where("status = 'unreachable'").count() == 1
    with pytest.raises(RouteError):
        R.one_to_all_pairs(pts, 99)


def test_large_rasters_run_tiled_with_the_same_result(spark):
    rng = random.Random(2)
    grid = [[float(rng.randint(1, 9)) for _ in range(20)] for _ in range(20)]
    meta = RasterMeta((1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 20, 20)
    px = frame(spark, grid)
    pts = spark.createDataFrame([(1, 0, 0), (2, 19, 19), (3, 7, 12)], "id int, row int, col int")
    routes = R.named(R.all_pairs(pts)).cache()
    small = {r.route: (r.cost, [tuple(p) for p in r.path]) for r in R.full_search(routes, px, px, meta, RouteConfig()).collect()}
    tiled = {r.route: (r.cost, [tuple(p) for p in r.path]) for r in R.full_search(routes, px, px, meta, RouteConfig(kernel_cells=10, tile=8)).collect()}
    assert small == tiled and len(small) == 3


def test_large_corridors_run_tiled_with_the_same_routes(spark):
    rng = random.Random(6)
    grid = [[float(rng.randint(1, 9)) if rng.random() > 0.1 else ND for _ in range(30)] for _ in range(30)]
    for r, c in ((1, 1), (28, 28), (2, 25)):
        grid[r][c] = 2.0
    meta = RasterMeta((1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 30, 30, ND)
    pts = spark.createDataFrame([(1, 1, 1), (2, 28, 28), (3, 2, 25)], "id int, row int, col int")
    runs = []
    for cells in (500_000, 100):
        config = RouteConfig(origin=1, factors=(6,), buffer=8, kernel_cells=cells, tile=9)
        runs.append(sorted((r.route, r.status, r.cost, [tuple(p) for p in r.path or []]) for r in R.hierarchical(R.all_pairs(pts), frame(spark, grid), meta, config).collect()))
    assert runs[0] == runs[1] and len(runs[0]) == 3 and all(r[1] == "ok" for r in runs[0])


def test_pairs_of_the_same_cells_are_searched_once(spark, monkeypatch):
    rng = random.Random(8)
    grid = [[float(rng.randint(1, 9)) for _ in range(12)] for _ in range(12)]
    grid[1][1] = ND
    meta = RasterMeta((1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 12, 12, ND)
    at = [(1, 1), (10, 2), (3, 9), (11, 11)]
    pts = spark.createDataFrame([(i, *at[i * i % 7 % 4]) for i in range(30)] + [(30, 99, 0), (31, None, 2)], "id int, row int, col int")
    seen, inside = [], R.corridor_search
    monkeypatch.setattr(R, "corridor_search", lambda routes, *a: seen.append(routes.count()) or inside(routes, *a))
    got = R.hierarchical(R.all_pairs(pts), frame(spark, grid), meta, RouteConfig(factors=(4,), buffer=50)).collect()
    assert len(got) == 32 * 31 // 2 and len({(r.origin, r.dest) for r in got}) == len(got)
    assert seen[0] <= len(at) ** 2
    cell = {r.id: (r.row, r.col) for r in pts.collect()}
    for r in got:
        a, b = cell[r.origin], cell[r.dest]
        want = search(grid, a, b)[0] if b in usable(grid, a) else None
        assert (r.status, r.cost) == (("ok", want) if want is not None else ("unreachable", None))
    sets = [sorted(tuple(x) for x in df.collect()) for df in (R.asked(R.all_pairs(pts)), R.asked_by_all(pts))]
    assert sets[0] == sets[1]


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder with 400 suppliers, whose cells repeat after 192, and line items on every cell."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.range(400).select(F.col("id").alias("s_suppkey")).write.parquet(f"{folder}/supplier.parquet")
    items = spark.range(48 * 64 * 3).select((F.col("id") * 7 + 1).alias("l_orderkey"), (F.floor(F.col("id") / 64)).alias("l_partkey"), (F.col("id") % 23).alias("l_suppkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"), (1 + F.xxhash64("id") % 25 + 25).cast("double").alias("l_quantity"))
    items.write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_all_pairs_cost_searches_cells_not_pairs(spark, tables, monkeypatch):
    seen, whole = [], R.full_search
    monkeypatch.setattr(R, "full_search", lambda routes, *a: seen.append(routes.count()) or whole(routes, *a))
    got = {(r.origin, r.dest): r.cost for r in Q.q_all_to_all_cost(spark, tables).collect()}
    assert set(got) == {(a, b) for b in range(400) for a in range(b)} and seen[0] <= 192 * 192
    raw = {(r.row, r.col): r for r in T.raster(spark, tables).collect()}
    cell = {r.id: (r.row, r.col) for r in T.points(spark, tables).collect()}
    for a in (0, 17, 209, 398):
        cost = {k: r.cost for k, r in raw.items() if not r.nodata or k == cell[a]}
        g = K.spread(cost, {cell[a]: 0.0}, T.DX, T.DY) if cell[a] in cost else {}
        assert all(got[a, b] == g.get(cell[b]) for b in range(a + 1, 400))


def test_names_of_pairs_are_made_by_many_tasks(spark, tmp_path):
    spark.range(60).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    out = Q.q_route_names(spark, str(tmp_path))
    want = sorted((f"ruta_final_{a}_a_{b}.shp", f"ruta_fase1_desde_{a}_a_{b}.shp") for b in range(60) for a in range(b))
    assert sorted(tuple(r) for r in out.collect()) == want
    tasks = {r.task for r in out.select(F.spark_partition_id().alias("task")).distinct().collect()}
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))  # the table is one file


def test_a_route_that_fails_does_not_stop_the_others(spark, monkeypatch):
    grid = [[1.0] * 12 for _ in range(12)]
    meta = RasterMeta((1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 12, 12, ND)
    pts = spark.createDataFrame([(1, 0, 0), (2, 11, 11), (3, 0, 11)], "id int, row int, col int")
    cells = spark.createDataFrame([("a", r, c, 1.0, 0, 0, 0, 2) for r in range(3) for c in range(3)] + [("b", r, c, 1.0, 0, 0, None, 2) for r in range(3) for c in range(3)], "route string, row int, col int, cost double, r1 int, c1 int, r2 int, c2 int")
    got = {r.route: r for r in K.search_routes(cells, 1.0, 1.0).collect()}
    assert got["a"].found and got["a"].error is None and not got["b"].found and got["b"].error
    done = R.hierarchical(R.one_to_all_pairs(pts, 1), frame(spark, grid), meta, RouteConfig(origin=1, factors=(4,), buffer=6))
    assert {r.error for r in S.status_rows(done, "s").collect()} == {None}


def test_validation_labels(spark):
    edges = spark.createDataFrame(square(1, 500000.0, 7999000.0, 900.0), "poly_id int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 500100.0, 7999100.0), (2, 501500.0, 7999100.0), (3, 400000.0, 7999100.0), (4, None, 1.0)], "id int, x double, y double")
    got = {r.id: (r.vector, r.raster) for r in V.validation_report(pts, edges, V.rasterize_touched(edges, META), META).collect()}
    assert got == {1: ("DENTRO", "DENTRO"), 2: ("FUERA", "FUERA"), 3: ("FUERA", "FUERA (Píxel fuera de límites)"), 4: ("FUERA", "ERROR")}
    assert {(r.vector, r.raster) for r in V.validation_report(pts, None, None, META).collect()} == {("N/A", "N/A")}


def test_all_pairs_of_fourteen_points(spark):
    pts = spark.range(1, 15).select(F.col("id").cast("int").alias("id"), F.lit(0).alias("row"), F.lit(0).alias("col"))
    assert R.all_pairs(pts).count() == 91 and R.one_to_all_pairs(pts, 5).count() == 13


def test_sessions(spark):
    names = spark.createDataFrame([("20250101_000000",), ("20260101_000000",), ("zzz",)], "session_id string")
    assert S.latest_session(names).first()[0] == "20260101_000000"
    done = spark.createDataFrame([("s", "ruta_final_desde_1_a_2.shp", 2), ("s", "ruta_fase1_desde_1_a_3.shp", 3)], "session_id string, id string, dest int")
    pts = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert [r.id for r in S.pending(pts, done, "s", 1).collect()] == [3]
    short = spark.createDataFrame([("s", "ruta_final_1_a_2.shp", 2), ("s", "ruta_final_11_a_3.shp", 3)], "session_id string, id string, dest int")
    assert [r.id for r in S.pending(pts, short, "s", 1).collect()] == [3]
    assert S.is_incomplete(done, pts, "s", 1)


def test_priority_and_floor(spark):
    r = spark.range(1).select(X.to_coarse(F.lit(-5), 32).alias("a"), X.disc_center(F.lit(1), 5).alias("b"), X.priority(F.lit(2.0), F.lit(3.0), 0.5).alias("c")).first()
    assert tuple(r) == (-1, 7, 3.5)


def test_route_cells_in_sql(spark):
    from fellpath.functions.sql import register

    register(spark)
    frame(spark, [[1.0, 1.0, 9.0], [9.0, 1.0, 1.0]]).createOrReplaceTempView("grid_cells")
    rows = spark.sql("SELECT p.* FROM (SELECT collect_list(struct(row, col, cost)) AS cells FROM grid_cells) g, LATERAL route_cells(g.cells, 0, 0, 1, 2, 1.0D, 1.0D) p ORDER BY seq").collect()
    assert [(r.row, r.col) for r in rows] == [(0, 0), (1, 1), (1, 2)] and rows[0].g == 0.0


def test_stream_of_requests(spark, tmp_path):
    from fellpath.streaming.requests import serve

    grid = [[1.0] * 12 for _ in range(12)]
    meta = RasterMeta((1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 12, 12)
    ask = spark.createDataFrame([(1, 2, 0, 0, 11, 11)], "origin int, dest int, r1 int, c1 int, r2 int, c2 int")
    ask.write.parquet(f"{tmp_path}/ask")
    stream = spark.readStream.schema(ask.schema).parquet(f"{tmp_path}/ask")
    got = []
    query = serve(stream, frame(spark, grid), meta, RouteConfig(factors=(4,), buffer=6), lambda df, n: got.extend(df.collect()), f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    assert len(got) == 1 and got[0].status == "ok" and math.isclose(got[0].cost, 11 * math.sqrt(2))
