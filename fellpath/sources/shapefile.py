"""ESRI shapefiles as tables and as an export format, after the public shapefile and dBASE specifications.

A layer is its .shp with .dbf, .prj and .cpg beside it. The parts are read by Spark (``binaryFile``) and decoded by a task, so that
any store that Spark reads will do. Export encodes each route feature as a layer of its own and writes its files, both in tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import RouteError
from .files import write_files

_PARTS = (".shp", ".dbf", ".prj", ".cpg")


def _box(points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def parse_shp(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """The parts of every record: points are one part of one point; null shapes have none."""
    out, at = [], 100
    while at + 12 <= len(data):
        size = struct.unpack(">I", data[at + 4 : at + 8])[0] * 2
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        kind = struct.unpack("<i", body[:4])[0] % 10
        if kind == 1:
            out.append([[struct.unpack("<2d", body[4:20])]])
        elif kind in (3, 5):
            parts, points = struct.unpack("<2i", body[36:44])
            first = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            out.append([[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(first, first[1:], strict=False)])
        elif kind == 8:
            n = struct.unpack("<i", body[36:40])[0]
            flat = struct.unpack(f"<{2 * n}d", body[40 : 40 + 16 * n])
            out.append([[(flat[2 * i], flat[2 * i + 1])] for i in range(n)])
        else:
            out.append([])
    return out


def parse_dbf(data: bytes, encoding: str) -> list[dict[str, str]]:
    """Attributes of every record, as stripped text; deleted records too, as they still have a shape."""
    n, start, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while at + 32 <= start and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), data[at + 16]))
        at += 32
    out = []
    for i in range(n):
        row, place = {}, start + i * width + 1
        for name, size in fields:
            row[name] = data[place : place + size].decode(encoding, "replace").strip()
            place += size
        out.append(row)
    return out


def _codec(cpg: bytes | None) -> str:
    name = (cpg or b"ISO-8859-1").decode("ascii", "replace").strip()
    try:
        "".encode(name)
    except LookupError:
        return "latin-1"
    return name


def encode_line(points: list[tuple[float, float]], name: str, crs: str | None) -> dict[str, bytes]:
    """A layer of one LineString with the attribute id: its files by suffix."""
    box = _box(points)
    body = struct.pack("<i4d2i1i", 3, *box, 1, len(points), 0) + b"".join(struct.pack("<2d", *p) for p in points)
    head = lambda words: struct.pack(">7I", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 3, *box, 0.0, 0.0, 0.0, 0.0)
    shp = head(50 + 4 + len(body) // 2) + struct.pack(">2I", 1, len(body) // 2) + body
    shx = head(50 + 4) + struct.pack(">2I", 50, len(body) // 2)
    field = b"id".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([80, 0]) + b"\0" * 14
    dbf = struct.pack("<4BIHH20x", 3, 95, 1, 1, 1, 32 + 32 + 1, 81) + field + b"\r " + name.encode("latin-1", "replace")[:80].ljust(80) + b"\x1a"
    return {".shp": shp, ".shx": shx, ".dbf": dbf, ".prj": (crs or "").encode("latin-1", "replace"), ".cpg": b"ISO-8859-1"}


def load_layer(spark: SparkSession, path: str) -> DataFrame:
    """(fid, attributes map, part, seq, x, y, crs) of a layer given by its .shp; FileNotFoundError if there is none."""
    base = path[:-4] if path.lower().endswith(".shp") else path
    try:
        files = spark.read.format("binaryFile").load(f"{base}.{{shp,dbf,prj,cpg}}").select("path", "content")
        if files.where(F.lower("path").endswith(".shp")).isEmpty():
            raise FileNotFoundError(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        data = {p[-4:].lower(): bytes(c) for p, c in zip(frame["path"], frame["content"], strict=True)}
        shapes = parse_shp(data[".shp"])
        rows = parse_dbf(data[".dbf"], _codec(data.get(".cpg"))) if ".dbf" in data else [{}] * len(shapes)
        crs = data[".prj"].decode("latin-1").strip() if ".prj" in data else None
        out = [(i, rows[i] if i < len(rows) else {}, j, k, x, y, crs) for i, parts in enumerate(shapes) for j, ring in enumerate(parts) for k, (x, y) in enumerate(ring)]
        return pd.DataFrame(out, columns=["fid", "attributes", "part", "seq", "x", "y", "crs"])

    # the few files of one layer meet in one group
    return files.withColumn("base", F.expr("substr(path, 1, length(path) - 4)")).groupBy("base").applyInPandas(run, "fid int, attributes map<string,string>, part int, seq int, x double, y double, crs string")


def load_points(spark: SparkSession, path: str, id_field: str = "id") -> tuple[DataFrame, str | None]:
    """(id, ord, x, y) with unique ids (last coordinates, first place), and the CRS; RouteError if the layer is empty."""
    from ..operators.vector import dedupe_points

    rows = load_layer(spark, path).where("part = 0 and seq = 0")
    first = rows.first()
    if first is None:
        raise RouteError(f"the layer {path} is empty")
    if id_field not in first["attributes"]:
        raise RouteError(f"the layer {path} has no field {id_field}")
    told = F.col("attributes")[id_field]
    # a numeric field may show 3 as 3.000; anything else that is no whole number stops the load
    ids = F.when(told.rlike(r"^[+-]?[0-9]+(\.0*)?$"), told.cast("double").cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"{id_field} is no whole number: "), F.coalesce(told, F.lit("null")))).cast("int"))
    return dedupe_points(rows.select(ids.alias("id"), F.col("fid").alias("ord"), "x", "y")), first["crs"]


def load_polygon_edges(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(poly_id, x1, y1, x2, y2) of a polygon layer, and the CRS; each shape is one polygon, united when it is used."""
    rows = load_layer(spark, path)
    first = rows.first()
    if first is None:
        raise RouteError(f"the layer {path} is empty")
    rings = rows.groupBy("fid", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.struct(F.get("p", i)["x"].alias("x1"), F.get("p", i)["y"].alias("y1"), F.get("p", i + 1)["x"].alias("x2"), F.get("p", i + 1)["y"].alias("y2")))
    return rings.where(F.size("p") >= 2).select(F.col("fid").alias("poly_id"), F.explode(pairs).alias("e")).select("poly_id", "e.*"), first["crs"]


def encode_routes(routes: DataFrame, crs: str | None) -> DataFrame:
    """(session_id, name, content): the files of every route feature (session_id, id, geom); routes without geometry have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for session, name, geom in zip(frame["session_id"], frame["id"], frame["geom"], strict=True):
                stem = name.removesuffix(".shp")
                out += [(session, stem + suffix, data) for suffix, data in encode_line([(p["x"], p["y"]) for p in geom], name, crs).items()]
            yield pd.DataFrame(out, columns=["session_id", "name", "content"])

    return routes.where("size(geom) >= 2").select("session_id", "id", "geom").mapInPandas(run, "session_id string, name string, content binary")


def write_routes(routes: DataFrame, folder: str, crs: str | None) -> int:
    """Write every route as a shapefile under folder/<session>/, from tasks; returns the number of files."""
    files = encode_routes(routes, crs).select(F.concat_ws("/", "session_id", "name").alias("name"), "content")
    return write_files(routes.sparkSession, files, folder)
