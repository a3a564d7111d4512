"""Round trips of rasters, layers and tables, a whole run from files, and the driver's entry."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from fellpath.model import RasterMeta, RouteConfig, RouteError
from fellpath.plans.run import LOG, route
from fellpath.sources import georaster, shapefile, tables

META = RasterMeta((10.0, 0.0, 1000.0, 0.0, -10.0, 2000.0), 70, 40, -9999.0, "EPSG:32719")


@pytest.mark.parametrize("kind", ["float32", "float64", "int16", "uint8"])
@pytest.mark.parametrize("compress", [True, False])
def test_raster_round_trip(kind, compress):
    band = (np.arange(70 * 40).reshape(70, 40) % 120).astype(kind)
    data = georaster.write_band(band, META, compress)
    assert georaster.read_meta(data) == META
    assert np.array_equal(georaster.read_band(data), band) and georaster.read_band(data).dtype == band.dtype


def test_raster_tiles_of_one_grid(spark, tmp_path):
    band = np.arange(20.0 * 12).reshape(20, 12)
    for r in (0, 10):
        for c in (0, 6):
            meta = RasterMeta((10.0, 0.0, 1000.0 + 10 * c, 0.0, -10.0, 2000.0 - 10 * r), 10, 6, None, None)
            (tmp_path / f"t{r}_{c}.tif").write_bytes(georaster.write_band(band[r : r + 10, c : c + 6], meta))
    got = {(x.row, x.col): x.cost for x in georaster.load_pixels(spark, f"{tmp_path}/*.tif").collect()}
    assert got == {(r, c): band[r, c] for r in range(20) for c in range(12)}
    with pytest.raises(FileNotFoundError):
        georaster.load_meta(spark, f"{tmp_path}/none.tif")


def point_layer(folder, name, points, field="id"):
    body = b"".join(struct.pack(">2I", i + 1, 10) + struct.pack("<i2d", 1, x, y) for i, (_, x, y) in enumerate(points))
    head = struct.pack(">7I", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<2i8d", 1000, 1, *([0.0] * 8))
    (folder / f"{name}.shp").write_bytes(head + body)
    desc = field.encode().ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14
    rows = b"".join(b" " + str(i).rjust(10).encode() for i, _, _ in points)
    (folder / f"{name}.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 95, 1, 1, len(points), 65, 11) + desc + b"\r" + rows)
    (folder / f"{name}.prj").write_text("EPSG:32719")
    (folder / f"{name}.cpg").write_text("UTF-8")


def polygon_layer(folder, name, ring):
    pts = [*ring, ring[0]]
    body = struct.pack("<i4d2ii", 5, 0, 0, 0, 0, 1, len(pts), 0) + b"".join(struct.pack("<2d", *p) for p in pts)
    head = struct.pack(">7I", 9994, 0, 0, 0, 0, 0, 54 + len(body) // 2) + struct.pack("<2i8d", 1000, 5, *([0.0] * 8))
    (folder / f"{name}.shp").write_bytes(head + struct.pack(">2I", 1, len(body) // 2) + body)
    (folder / f"{name}.prj").write_text("EPSG:32719")


def test_layers(spark, tmp_path):
    point_layer(tmp_path, "p", [(3, 1.0, 2.0), (4, 5.0, 6.0), (3, 7.0, 8.0)])
    pts, crs = shapefile.load_points(spark, f"{tmp_path}/p.shp")
    assert [tuple(r) for r in pts.orderBy("ord").collect()] == [(3, 0, 7.0, 8.0), (4, 1, 5.0, 6.0)] and crs == "EPSG:32719"
    with pytest.raises(RouteError):
        shapefile.load_points(spark, f"{tmp_path}/p.shp", "other")
    with pytest.raises(FileNotFoundError):
        shapefile.load_points(spark, f"{tmp_path}/none.shp")
    point_layer(tmp_path, "empty", [])
    with pytest.raises(RouteError):
        shapefile.load_points(spark, f"{tmp_path}/empty.shp")
    polygon_layer(tmp_path, "m", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])
    edges, _ = shapefile.load_polygon_edges(spark, f"{tmp_path}/m.shp")
    assert edges.count() == 3


def test_codecs_and_big_files():
    band = (np.arange(70 * 40).reshape(70, 40) % 57).astype("<u2")

    def lzw(data: bytes) -> bytes:
        table, codes, w, width = {bytes((i,)): i for i in range(256)}, [(256, 9)], b"", 9
        size = 258
        for i in range(len(data)):
            c = data[i : i + 1]
            if w + c in table:
                w += c
                continue
            codes.append((table[w], width))
            table[w + c] = size
            size += 1
            if size > (1 << width) - 1:
                width += 1
            w = c
            if size >= 4094:
                codes.append((table[w], width))
                codes.append((256, width))
                table, size, width, w = {bytes((i,)): i for i in range(256)}, 258, 9, b""
        codes += ([(table[w], width)] if w else []) + [(257, width)]
        bits = "".join(f"{c:0{n}b}" for c, n in codes)
        return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")

    noise = np.random.default_rng(1).integers(0, 255, 30_000).astype("uint8").tobytes()
    for raw in (b"a", b"abababababab" * 50, noise, bytes(5000)):
        assert georaster._unlzw(lzw(raw)) == raw
    assert georaster._unpack(bytes([254, 7, 1, 8, 9, 128, 0, 5])) == bytes([7, 7, 7, 8, 9, 5])

    def tiff(big: bool, codec: int, strips: list[bytes], bits: int, kind: int, predictor: int = 1) -> bytes:
        at = 16 if big else 8
        places = [at + sum(map(len, strips[:i])) for i in range(len(strips))]
        tags = [(256, [40]), (257, [70]), (258, [bits]), (259, [codec]), (273, places), (277, [1]), (278, [35]), (279, [len(s) for s in strips]), (317, [predictor]), (339, [kind])]
        body, wide = b"".join(strips), "Q" if big else "I"
        tail, entries, size = at + len(body), b"", 8 if big else 4
        extra = b""
        for tag, values in tags:
            raw = struct.pack("<" + wide * len(values), *values)
            if len(raw) > size:
                place, extra = struct.pack("<" + wide, tail + len(extra)), extra + raw
            else:
                place = raw
            entries += struct.pack("<HH" + wide, tag, 16 if big else 4, len(values)) + place.ljust(size, b"\0")
        head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, tail + len(extra)) if big else struct.pack("<2sHI", b"II", 42, tail + len(extra))
        return head + body + extra + struct.pack("<Q" if big else "<H", len(tags)) + entries + bytes(8)

    halves = [band[:35].tobytes(), band[35:].tobytes()]
    for big in (False, True):
        assert np.array_equal(georaster.read_band(tiff(big, 5, [lzw(h) for h in halves], 16, 1)), band)
        assert np.array_equal(georaster.read_band(tiff(big, 1, [halves[0], b""], 16, 1))[:35], band[:35])
    steps = np.diff(band.astype("<u2"), axis=1, prepend=np.zeros((70, 1), "<u2")).astype("<u2")
    assert np.array_equal(georaster.read_band(tiff(True, 5, [lzw(steps[:35].tobytes()), lzw(steps[35:].tobytes())], 16, 1, 2)), band)
    real = (band / 7).astype("<f4")
    planes = real.astype(">f4").view(np.uint8).reshape(70, 40, 4).transpose(0, 2, 1).reshape(70, 160)
    coded = np.diff(planes, axis=1, prepend=np.zeros((70, 1), np.uint8)).astype(np.uint8)
    assert np.array_equal(georaster.read_band(tiff(False, 1, [coded[:35].tobytes(), coded[35:].tobytes()], 32, 3, 3)), real)


def test_a_run_over_four_files_equals_the_run_over_one(spark, tmp_path):
    band = (1 + np.arange(32 * 32).reshape(32, 32) % 7).astype("float32")
    band[4:28, 16] = -9999
    meta = RasterMeta((10.0, 0.0, 100.0, 0.0, -10.0, 900.0), 32, 32, -9999.0, "EPSG:32719")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "all.tif").write_bytes(georaster.write_band(band, meta))
    pixels = georaster.load_pixels(spark, f"{tmp_path}/one/*.tif")
    assert georaster.write_pixels(pixels, f"{tmp_path}/four", meta, 16, "float32") == 4
    assert georaster.load_meta(spark, f"{tmp_path}/four/*.tif") == georaster.load_meta(spark, f"{tmp_path}/one/all.tif") == meta
    point_layer(tmp_path, "points", [(5, 115.0, 885.0), (1, 405.0, 595.0), (2, 405.0, 885.0)])
    config = RouteConfig(factors=(8, 4), buffer=6)
    found = []
    for name in ("one", "four"):
        route(spark, f"{tmp_path}/{name}/*.tif", f"{tmp_path}/points.shp", f"{tmp_path}/out_{name}", None, config, session="20260101_000000")
        found.append(sorted((r.id, r.cost or 0.0, r.wkt) for r in tables.read_routes(spark, f"{tmp_path}/out_{name}/routes").collect()))
    assert found[0] == found[1] and len(found[0]) == 4
    odd = RasterMeta((10.0, 0.0, 423.0, 0.0, -10.0, 900.0), 32, 32, -9999.0, "EPSG:32719")
    (tmp_path / "four" / "odd.tif").write_bytes(georaster.write_band(band, odd))
    with pytest.raises(RouteError, match="one grid"):
        georaster.load_meta(spark, f"{tmp_path}/four/*.tif")


def test_ids_must_be_whole_numbers(spark, tmp_path):
    point_layer(tmp_path, "p", [("3.7", 1.0, 2.0)])
    with pytest.raises(Exception, match="no whole number"):
        shapefile.load_points(spark, f"{tmp_path}/p.shp")[0].collect()


def test_line_round_trip():
    files = shapefile.encode_line([(1.0, 2.0), (3.0, 4.5)], "ruta_final_1_a_2.shp", "WKT")
    assert shapefile.parse_shp(files[".shp"]) == [[[(1.0, 2.0), (3.0, 4.5)]]]
    assert shapefile.parse_dbf(files[".dbf"], "latin-1") == [{"id": "ruta_final_1_a_2.shp"}]
    assert files[".cpg"] == b"ISO-8859-1" and files[".prj"] == b"WKT" and len(files[".shx"]) == 108


def test_whole_run_resumes(spark, tmp_path):
    band = np.ones((40, 40), dtype="float32")
    band[:30, 20] = -9999
    meta = RasterMeta((10.0, 0.0, 0.0, 0.0, -10.0, 400.0), 40, 40, -9999.0, "EPSG:32719")
    (tmp_path / "cost.tif").write_bytes(georaster.write_band(band, meta))
    point_layer(tmp_path, "points", [(5, 55.0, 345.0), (1, 355.0, 345.0), (2, 55.0, 45.0)])
    polygon_layer(tmp_path, "mask", [(-1.0, -1.0), (401.0, -1.0), (401.0, 401.0), (-1.0, 401.0)])
    config = RouteConfig(factors=(8, 4), buffer=5, policy="abort")
    out = f"{tmp_path}/out"
    status = route(spark, f"{tmp_path}/cost.tif", f"{tmp_path}/points.shp", out, f"{tmp_path}/mask.shp", config, session="20260101_000000")
    assert {(r.dest, r.status) for r in status.collect()} == {(1, "ok"), (2, "ok")}
    rows = tables.read_routes(spark, f"{out}/routes").collect()
    assert {r.id for r in rows if r.phase == "final"} == {"ruta_final_5_a_1.shp", "ruta_final_5_a_2.shp"}
    made = {p.name for p in (tmp_path / "out" / "20260101_000000").iterdir() if not p.name.startswith(".")}
    assert {"ruta_final_5_a_1.shp", "ruta_final_5_a_1.dbf", "ruta_fase1_5_a_2.shp"} <= made
    again = route(spark, f"{tmp_path}/cost.tif", f"{tmp_path}/points.shp", out, f"{tmp_path}/none.shp", config, resume=True, session="20260101_000000")
    assert again.count() == 0
    assert "session 20260101_000000: 2 routes to find" in (tmp_path / "out" / LOG).read_text() and "no polygon" in (tmp_path / "out" / LOG).read_text()


def test_resume_goes_on_with_incomplete_sessions_of_the_same_kind(spark, tmp_path):
    band = np.ones((12, 12), dtype="float32")
    meta = RasterMeta((10.0, 0.0, 0.0, 0.0, -10.0, 120.0), 12, 12, -9999.0, "EPSG:32719")
    (tmp_path / "cost.tif").write_bytes(georaster.write_band(band, meta))
    point_layer(tmp_path, "points", [(9, 15.0, 105.0), (5, 105.0, 15.0), (2, 15.0, 15.0)])
    point_layer(tmp_path, "more", [(9, 15.0, 105.0), (5, 105.0, 15.0), (2, 15.0, 15.0), (1, 55.0, 55.0)])
    config, out = RouteConfig(factors=(4,), buffer=6), f"{tmp_path}/out"
    run = lambda layer, **more: route(spark, f"{tmp_path}/cost.tif", f"{tmp_path}/{layer}.shp", out, None, config, shapefiles=False, **more).collect()
    first = run("points", session="20200101_000000_desde_punto_5")
    assert [(r.dest, r.status, r.error) for r in first] == [(9, "ok", None), (2, "ok", None)]  # in the order of the file
    run("points", session="20300101_000000_AllToAll", everyone=True)
    grown = run("more", resume=True)  # the later session is of another kind; the last of this kind lacks a point
    assert [(r.session_id, r.dest) for r in grown] == [("20200101_000000_desde_punto_5", 1)]
    new = run("more", resume=True)
    assert len(new) == 3 and {r.session_id[8:9] for r in new} == {"_"} and new[0].session_id > "20250101"
    pairs = run("more", resume=True, everyone=True)
    assert [(r.origin, r.dest) for r in pairs] == [(1, 9), (1, 5), (1, 2)]  # what the later session of all pairs lacks


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
