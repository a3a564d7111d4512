"""GeoTIFF cost rasters as tables (and a writer for tests and exports), after the public TIFF 6.0, BigTIFF and GeoTIFF specifications.

Files are listed and read by Spark (``binaryFile``), so that any store that Spark reads will do. A task parses the header and
returns tags only: no file's content ever reaches the driver. Several files of one grid are one raster: its metadata is their union
(the same pixel size, places on one grid, one nodata value and one CRS, else the load stops), and rows and columns count from its
top left corner. Blocks (strips or tiles) of a file are decoded one by one and leave the task in chunks; ``binaryFile`` holds one file in a
task and stops at 2 GB, so that larger rasters come as several files.

Read: classic TIFF and BigTIFF, little or big endian, strips or tiles, first band, 8 to 64-bit integers and floats, uncompressed,
LZW, deflate or PackBits, horizontal predictor for integers and the floating point predictor, pixel scale and tie point or matrix,
GDAL's nodata tag, CRS from the GeoTIFF citation. Blocks that a sparse file leaves out are nodata (0 without one).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import RasterMeta, RouteError
from .files import write_files

#: Fixed values of the specification: bytes and struct codes of field types.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
_ROWS = 256


def _fields(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    version = struct.unpack(order + "H", data[2:4])[0] if order and len(data) >= 8 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF")
    count, entry, place, code = ("H", 12, 4, "I") if version == 42 else ("Q", 20, 8, "Q")
    at = struct.unpack(order + code, data[4:8] if version == 42 else data[8:16])[0]
    first = at + struct.calcsize("<" + count)
    out = {}
    for i in range(struct.unpack(order + count, data[at:first])[0]):
        own = data[first + i * entry : first + (i + 1) * entry]
        tag, kind, n = struct.unpack(order + "HH" + code, own[: 4 + place])
        if kind not in _TYPES:
            continue
        size, letter = _TYPES[kind]
        raw = own[4 + place : 4 + place + size * n]
        if size * n > place:
            start = struct.unpack(order + code, own[4 + place :])[0]
            raw = data[start : start + size * n]
        out[tag] = (bytes(raw).split(b"\0")[0].decode("latin-1"),) if kind == 2 else struct.unpack(order + letter * n if letter != "s" else f"{n}s", raw)
    return order, out


def _unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, widened one code early."""
    out, table = [], []
    bits = held = 0
    width, before = 9, None
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if before is None:
            word = table[code]
        elif code < len(table):
            word = table[code]
            table.append(before + word[:1])
        else:
            word = before + before[:1]
            table.append(word)
        out.append(word)
        before = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def _unpack(data: bytes) -> bytes:
    """PackBits: runs and literals."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            out.append(data[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
            at += 2 if n > 128 else 1
    return b"".join(out)


_CODECS = {1: bytes, 5: _unlzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack}


def read_meta(data: bytes) -> RasterMeta:
    """Metadata of a GeoTIFF."""
    _, tags = _fields(data)
    if 34264 in tags:
        m = tags[34264]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif 33550 in tags and 33922 in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[33550], tags[33922]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        transform = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    nodata = tags.get(42113, (None,))[0]
    crs = tags.get(34737, (None,))[0]
    return RasterMeta(tuple(map(float, transform)), tags[257][0], tags[256][0], float(nodata) if nodata not in (None, "") else None, crs.rstrip("|") if crs else None)


def blocks(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, column, values) of every strip or tile of the first band, clipped to the raster, in the file's own type."""
    order, t = _fields(data)
    width, height = t[256][0], t[257][0]
    bits, kind, bands = t.get(258, (1,))[0], t.get(339, (1,))[0], t.get(277, (1,))[0]
    compression, predictor = t.get(259, (1,))[0], t.get(317, (1,))[0]
    if compression not in _CODECS or bits not in (8, 16, 32, 64) or predictor > 3 or (predictor == 2) > (kind != 3) or (predictor == 3) > (kind == 3):
        raise ValueError(f"compression {compression}, predictor {predictor} with {bits} bits is not supported")
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[kind] + str(bits // 8))
    per = bands if t.get(284, (1,))[0] == 1 else 1
    tiled = 324 in t
    tall, wide = (t[323][0], t[322][0]) if tiled else (min(t.get(278, (height,))[0], height), width)
    nodata = t.get(42113, (None,))[0]
    across = -(-width // wide)
    for i, (at, size) in enumerate(zip(t[324 if tiled else 273], t[325 if tiled else 279], strict=True)):
        r, c = (i // across) * tall, (i % across) * wide
        if r >= height:  # planes of further bands
            break
        rows = tall if tiled else min(tall, height - r)
        shape = (min(rows, height - r), min(wide, width - c))
        if not size:
            yield r, c, np.full(shape, float(nodata) if nodata not in (None, "") else 0).astype(dtype.newbyteorder("="))
            continue
        raw = _CODECS[compression](data[at : at + size])
        if predictor == 3:  # bytes of a row by significance, each the difference to the one before
            flat = np.frombuffer(raw, dtype=np.uint8, count=rows * wide * per * dtype.itemsize).reshape(rows, -1, per)
            planes = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, wide * per)
            block = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, wide, per)
        else:
            block = np.frombuffer(raw, dtype=dtype, count=rows * wide * per).reshape(rows, wide, per)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=dtype)
        yield r, c, block[: shape[0], : shape[1], 0].astype(dtype.newbyteorder("="))


def read_band(data: bytes) -> np.ndarray:
    """The first band in the file's own type."""
    _, t = _fields(data)
    out = None
    for r, c, block in blocks(data):
        out = np.zeros((t[257][0], t[256][0]), dtype=block.dtype) if out is None else out
        out[r : r + block.shape[0], c : c + block.shape[1]] = block
    return out


def write_band(band: np.ndarray, meta: RasterMeta, compress: bool = True) -> bytes:
    """A GeoTIFF of one band: little endian, one strip for every 64 rows."""
    band = np.ascontiguousarray(band)
    height, width = band.shape
    strips = [band[i : i + 64].astype(band.dtype.newbyteorder("<")).tobytes() for i in range(0, height, 64)]
    strips = [zlib.compress(s) if compress else s for s in strips]
    a, b, c, d, e, f = meta.transform
    crs = ((meta.crs or "") + "|").encode("latin-1", "replace") + b"\0"
    entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [band.dtype.itemsize * 8]), (259, 3, [8 if compress else 1]), (262, 3, [1]), (273, 4, [0] * len(strips)), (277, 3, [1]), (278, 4, [64]), (279, 4, [len(s) for s in strips]), (284, 3, [1]), (339, 3, [{"u": 1, "i": 2, "f": 3}[band.dtype.kind]]), (34264, 12, [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]), (34735, 3, [1, 1, 0, 1, 1026, 34737, len(crs) - 1, 0]), (34737, 2, crs)]
    if meta.nodata is not None:
        entries.append((42113, 2, repr(float(meta.nodata)).encode() + b"\0"))
    at = 8 + 2 + 12 * len(entries) + 4
    blobs: list[bytes] = []

    def packed(kind: int, values) -> bytes:
        return bytes(values) if kind == 2 else struct.pack("<" + _TYPES[kind][1] * len(values), *values)

    sizes = [len(packed(k, v)) for _, k, v in entries]
    data_at = at + sum(s + s % 2 for s in sizes if s > 4)
    entries = [(t, k, [data_at + sum(map(len, strips[:i])) for i in range(len(strips))] if t == 273 else v) for t, k, v in entries]
    head = struct.pack("<2sHIH", b"II", 42, 8, len(entries))
    for tag, kind, values in entries:
        raw = packed(kind, values)
        if len(raw) <= 4:
            place = raw.ljust(4, b"\0")
        else:
            place = struct.pack("<I", at)
            blobs.append(raw + b"\0" * (len(raw) % 2))
            at += len(blobs[-1])
        head += struct.pack("<HHI", tag, kind, len(values)) + place
    return head + struct.pack("<I", 0) + b"".join(blobs) + b"".join(strips)


_HEADER = "path string, transform array<double>, height int, width int, nodata double, crs string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException as e:
        raise FileNotFoundError(path) from e


def _headers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        metas = [read_meta(bytes(c)) for c in frame["content"]]
        yield pd.DataFrame({"path": frame["path"], "transform": [list(m.transform) for m in metas], "height": [m.height for m in metas], "width": [m.width for m in metas], "nodata": [m.nodata for m in metas], "crs": [m.crs for m in metas]}).astype({"nodata": "float64"})


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, transform, height, width, nodata, crs) of every file, parsed in tasks."""
    return _files(spark, path).mapInPandas(_headers, _HEADER)


def load_meta(spark: SparkSession, path: str) -> RasterMeta:
    """Metadata of one raster, which may lie in several files of one grid; FileNotFoundError if there is none, RouteError if files do not fit."""
    rows = headers(spark, path)
    a, e = F.col("transform")[0], F.col("transform")[4]
    x, y = F.col("transform")[2], F.col("transform")[5]
    far_x, far_y = x + a * F.col("width"), y + e * F.col("height")
    sign = lambda v, f: F.min(v) if f > 0 else F.max(v)
    first = rows.agg(F.min_by("transform", "path").alias("t"), F.min_by("crs", "path").alias("crs"), F.min_by("nodata", "path").alias("nodata"), F.count(F.lit(1)).alias("n"), F.min_by("height", "path").alias("height"), F.min_by("width", "path").alias("width")).first()
    if not first["n"]:
        raise FileNotFoundError(path)
    t, nodata, crs = first["t"], first["nodata"], first["crs"]
    nodata = None if nodata is None or (nodata != nodata and rows.where("nodata is not null").isEmpty()) else nodata
    if first["n"] == 1:
        return RasterMeta(tuple(t), first["height"], first["width"], nodata, crs)
    if t[1] or t[3]:
        raise RouteError("rasters of several files must not be rotated")
    near = lambda v, w: F.abs(v - F.lit(w)) <= 1e-9 * max(1.0, abs(w))
    steps = lambda v, w, s: (v - F.lit(w)) / F.lit(s)
    whole = lambda v: F.abs(v - F.round(v)) <= 1e-6
    fits = near(a, t[0]) & near(e, t[4]) & (F.col("transform")[1] == 0) & (F.col("transform")[3] == 0) & F.col("crs").eqNullSafe(F.lit(crs)) & F.col("nodata").eqNullSafe(F.lit(nodata)) & whole(steps(x, t[2], t[0])) & whole(steps(y, t[5], t[4]))
    box = rows.agg(F.min(fits.cast("int")).alias("ok"), sign(x, t[0]).alias("x"), sign(far_x, -t[0]).alias("far_x"), sign(y, t[4]).alias("y"), sign(far_y, -t[4]).alias("far_y")).first()
    if not box["ok"]:
        raise RouteError("the raster's files are not of one grid, nodata value and CRS")
    return RasterMeta((t[0], 0.0, box["x"], 0.0, t[4], box["y"]), round((box["far_y"] - box["y"]) / t[4]), round((box["far_x"] - box["x"]) / t[0]), nodata, crs)


def load_pixels(spark: SparkSession, path: str, meta: RasterMeta | None = None) -> DataFrame:
    """(row, col, cost double) of one raster, or of the files of one grid; rows and columns count from the corner of meta."""
    meta = meta or load_meta(spark, path)
    a, _, x0, _, e, y0 = meta.transform

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                data = bytes(content)
                own = read_meta(data).transform
                r0, c0 = round((own[5] - y0) / e), round((own[2] - x0) / a)
                for top, left, block in blocks(data):
                    for r in range(0, block.shape[0], _ROWS):
                        part = block[r : r + _ROWS]
                        rows, cols = np.indices(part.shape)
                        yield pd.DataFrame({"row": (rows + top + r + r0).ravel().astype("int32"), "col": (cols + left + c0).ravel().astype("int32"), "cost": part.ravel().astype("float64")})

    return _files(spark, path).mapInPandas(run, "row int, col int, cost double")


def write_pixels(pixels: DataFrame, path: str, meta: RasterMeta, tile: int = 4096, dtype: str = "float64") -> int:
    """Write (row, col, cost) as GeoTIFF files of one grid, tile x tile pixels each, from tasks; returns the number of files.

    Cells without a row are nodata (meta.nodata must be given if there are any). A file is one task's group of at most tile x tile cells.
    """
    spark = pixels.sparkSession
    a, b, c, d, e, f = meta.transform

    def encode(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * tile, int(key[1]) * tile
        own = RasterMeta((a, b, c + c0 * a + r0 * b, d, e, f + c0 * d + r0 * e), min(tile, meta.height - r0), min(tile, meta.width - c0), meta.nodata, meta.crs)
        band = np.full((own.height, own.width), 0.0 if meta.nodata is None else meta.nodata)
        if meta.nodata is None and len(frame) < band.size:
            raise ValueError("cells are missing, and the raster has no nodata value")
        band[frame["row"].to_numpy() - r0, frame["col"].to_numpy() - c0] = frame["cost"].to_numpy()
        return pd.DataFrame({"name": [f"r{int(key[0]):06d}_c{int(key[1]):06d}.tif"], "content": [write_band(band.astype(dtype), own)]})

    cells = pixels.where(F.col("row").between(0, meta.height - 1) & F.col("col").between(0, meta.width - 1))
    keys = [F.floor(F.col(n) / F.lit(float(tile))).cast("int").alias(f"tile_{n}") for n in ("row", "col")]
    files = cells.groupBy(*keys).applyInPandas(encode, "name string, content binary")
    return write_files(spark, files, path)
