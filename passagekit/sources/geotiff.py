"""Depth rasters from GeoTIFF files: blocks of bytes first, and pixels of the wanted blocks alone.

A raster is one file or many that share a grid and do not overlap.  A file's
blocks (tiles or strips) become rows as they are, packed, so that only those
that a question meets are unpacked; what cannot be read is a row with a reason.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.operators.depth import Raster

#: Fixed values of the TIFF format: letters of its number types, its tags, and the packings that are read.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
WIDTH, HEIGHT, BITS, PACKING, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
PLAIN, DEFLATE = 1, (8, 32946)
#: Fixed values of GeoTIFF keys: kind of model (2: geographic), pixels as points (2), and the code of WGS 84.
MODEL, PIXEL_KIND, GEOGRAPHIC, WGS84 = 1024, 1025, 2048, 4326

#: Pixels a side of the buckets by which blocks and wanted pixels meet.
BUCKET = 256
SCHEMA = (
    "path string, reason string, block int, x int, top int, wide int, tall int, stride int, samples int, band int, packed boolean, predictor int, "
    "number string, nodata double, west double, north double, size_x double, size_y double, data binary"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


class Unreadable(ValueError):
    """A file that is not read, and why."""


def tags(content: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of a file's first image."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack_from(order + "H", content, 2)[0] != 42:
        raise Unreadable("not a TIFF file of 32-bit offsets")
    (at,) = struct.unpack_from(order + "I", content, 4)
    found = {}
    for k in range(*struct.unpack_from(order + "H", content, at)):
        place = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(order + "HHI", content, place)
        if kind in TYPES:
            inside = struct.calcsize("=" + TYPES[kind]) * n <= 4
            start = place + 8 if inside else struct.unpack_from(order + "I", content, place + 8)[0]
            found[tag] = struct.unpack_from(f"{order}{n}{TYPES[kind]}", content, start)
    return order, found


def _frame(t: dict[int, tuple]) -> tuple[float, float, float, float]:
    """Western and northern edge and pixel sizes, in degrees."""
    if PIXEL_SCALE not in t or len(t.get(TIE_POINT, ())) != 6:
        raise Unreadable("no geotransform")
    keys = t.get(GEO_KEYS, ())
    known = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    if not known:
        raise Unreadable("no spatial reference")
    if known.get(MODEL) != 2 or known.get(GEOGRAPHIC, WGS84) != WGS84:
        raise Unreadable("not in degrees of WGS 84")
    i, j, _, lon, lat, _ = t[TIE_POINT]
    size_x, size_y = t[PIXEL_SCALE][:2]
    half = 0.5 if known.get(PIXEL_KIND) == 2 else 0.0
    return lon - (i + half) * size_x, lat + (j + half) * size_y, size_x, size_y


def blocks_of(content: bytes, band: int = 1) -> Iterator[dict]:
    """The blocks of one file that hold ``band``, still packed."""
    order, t = tags(content)
    width, height = (t.get(k, (0,))[0] for k in (WIDTH, HEIGHT))
    if width < 1 or height < 1:
        raise Unreadable("empty raster")
    samples = t.get(SAMPLES, (1,))[0]
    if not 1 <= band <= samples:
        raise Unreadable("no such band")
    west, north, size_x, size_y = _frame(t)
    packing, predictor, bits = t.get(PACKING, (1,))[0], t.get(PREDICTOR, (1,))[0], set(t.get(BITS, (1,)))
    letter = {1: "u", 2: "i", 3: "f"}.get(t.get(FORMAT, (1,))[0])
    if packing != PLAIN and packing not in DEFLATE:
        raise Unreadable(f"packing {packing}")
    if len(bits) != 1 or letter is None or (bits := bits.pop()) not in ((32, 64) if letter == "f" else (8, 16, 32)):
        raise Unreadable("kind of numbers")
    if predictor not in (1, 2, 3) or (predictor == 3) != (predictor > 1 and letter == "f"):
        raise Unreadable(f"predictor {predictor}")
    tiled = TILES in t
    wide, tall = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (width, min(t.get(STRIP_ROWS, (height,))[0], height))
    starts, lengths = (t[TILES], t[TILE_BYTES]) if tiled else (t[STRIPS], t[STRIP_BYTES])
    across, down = -(-width // wide), -(-height // tall)
    apart = t.get(PLANAR, (1,))[0] == 2
    nodata = t.get(NO_DATA, (b"",))[0].rstrip(b"\0 ").decode("ascii", "replace")
    same = {
        "stride": wide, "samples": 1 if apart else samples, "band": 0 if apart else band - 1, "packed": packing != PLAIN, "predictor": predictor,
        "number": f"{order}{letter}{bits // 8}", "nodata": float(nodata) if nodata else None, "west": west, "north": north, "size_x": size_x, "size_y": size_y,
    }
    for k in range(across * down):
        at = k + (band - 1) * across * down if apart else k
        data = content[starts[at] : starts[at] + lengths[at]]
        if len(data) < lengths[at]:
            raise Unreadable("cut short")
        x, top = k % across * wide, k // across * tall
        yield same | {"block": k, "x": x, "top": top, "wide": min(wide, width - x), "tall": min(tall, height - top), "data": data}


def pixels(row: dict) -> np.ndarray:
    """The numbers of one block as doubles, rows from north to south; NaN where the file has no data."""
    number, stride, samples = np.dtype(row["number"]), row["stride"], row["samples"]
    raw = np.frombuffer(zlib.decompress(row["data"]) if row["packed"] else row["data"], np.uint8)
    line = stride * samples * number.itemsize
    raw = raw[: row["tall"] * line].reshape(row["tall"], line)
    if row["predictor"] == 3:  # bytes of all numbers of a line by their weight, each as a difference
        raw = raw.reshape(row["tall"], -1, samples).cumsum(1, np.uint8).reshape(row["tall"], number.itemsize, -1)
        values = np.ascontiguousarray(raw.transpose(0, 2, 1)).view(number.newbyteorder(">"))
    else:
        values = np.ascontiguousarray(raw).view(number)
    values = values.reshape(row["tall"], stride, samples)
    if row["predictor"] == 2:
        values = values.astype(number.newbyteorder("=")).cumsum(1, number.newbyteorder("="))
    out = values[:, : row["wide"], row["band"]].astype(np.float64)
    if row["nodata"] is not None:
        out[out == (np.float32(row["nodata"]) if number.itemsize == 4 and number.kind == "f" else row["nodata"])] = np.nan
    return out


def _split(band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda found: pa.RecordBatch.from_pylist(found, to_schema)
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
        to_schema = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in SCHEMA.split(", ")])
        for batch in batches:
            for path, content in zip(*(batch.column(k) for k in (0, 1)), strict=True):
                path, held, size = path.as_py(), [], 0
                try:
                    for block in blocks_of(content.as_py() or b"", band):
                        held.append(dict.fromkeys(NAMES) | block | {"path": path})
                        size += len(block["data"])
                        if size > 1 << 24:
                            yield rows(held)
                            held, size = [], 0
                except (Unreadable, struct.error, KeyError, IndexError, ValueError) as fault:
                    reason = str(fault) if isinstance(fault, Unreadable) else "cut short"
                    held.append(dict.fromkeys(NAMES) | {"path": path, "reason": reason})
                yield rows(held)

    return run


def blocks(files: DataFrame, band: int = 1) -> DataFrame:
    """One row a block of files (path, content), still packed; ``reason`` says why a file, or its rest, is not read."""
    return files.select("path", "content").mapInArrow(_split(band), SCHEMA)


def read_blocks(spark: SparkSession, folder: str, band: int = 1) -> DataFrame:
    """``blocks`` of the GeoTIFF files in a folder."""
    return blocks(spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][iI][fF]{,[fF]}").load(folder), band)


def raster(blocks_: DataFrame, elevation: bool = True) -> Raster | None:
    """The grid that the files share, from their outermost south-western file; null if none is readable."""
    row = blocks_.filter("reason is null").agg(
        F.min("west").alias("west"), F.min(F.col("north") - (F.col("top") + F.col("tall")) * F.col("size_y")).alias("south"), F.min("size_x").alias("size")
    ).first()
    return None if row.west is None else Raster(row.south, row.west, row.size, elevation=elevation)


def _near(value: Column) -> Column:
    return F.abs(value - F.round(value)) < 1e-3


def on_grid(blocks_: DataFrame, raster_: Raster) -> DataFrame:
    """``blocks_`` with the raster's pixel of their north-western corner (x0, y0); of files of another grid none, with a reason."""
    x, y = (F.col("west") - raster_.lon0) / raster_.size, (F.col("north") - raster_.lat0) / raster_.size
    same = _near(x) & _near(y) & (F.abs(F.col("size_x") / raster_.size - 1) < 1e-6) & (F.abs(F.col("size_y") / raster_.size - 1) < 1e-6)
    out = blocks_.withColumn("reason", F.when(F.col("reason").isNull() & ~same, "another grid").otherwise(F.col("reason")))
    return out.withColumns({"x0": (F.round(x) + F.col("x")).cast("int"), "y0": (F.round(y) - 1 - F.col("top")).cast("int")})


def met(blocks_: DataFrame, wanted: DataFrame) -> DataFrame:
    """The blocks of ``on_grid`` that hold any pixel (x, y) of ``wanted``, up to their bucket; packed bytes are moved, and only once."""
    over = lambda low, high: F.explode(F.sequence(F.floor(low / BUCKET), F.floor(high / BUCKET)))
    keys = blocks_.filter("reason is null").select("path", "block", "y0", "tall", over(F.col("x0"), F.col("x0") + F.col("wide") - 1).alias("bx"))
    keys = keys.select("path", "block", "bx", over(F.col("y0") - F.col("tall") + 1, F.col("y0")).alias("by"))
    asked = wanted.select(F.floor(F.col("x") / BUCKET).alias("bx"), F.floor(F.col("y") / BUCKET).alias("by")).distinct()
    return blocks_.join(keys.join(asked, ["bx", "by"], "left_semi").select("path", "block").distinct(), ["path", "block"], "left_semi")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            values = pixels(row)
            y, x = np.indices(values.shape, np.int32)
            raw = pa.array(values.ravel(), mask=np.isnan(values.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array((row["x0"] + x).ravel()), pa.array((row["y0"] - y).ravel()), raw], ["x", "y", "raw"])


def cells(blocks_: DataFrame, raster_: Raster, wanted: DataFrame | None = None) -> DataFrame:
    """(x, y, raw) of the pixels of ``blocks_``, of the blocks met by ``wanted`` (x, y) if given; raw is null where there is no data."""
    placed = on_grid(blocks_, raster_).filter("reason is null")
    return (met(placed, wanted) if wanted is not None else placed).mapInArrow(_unpacked, "x int, y int, raw double")


def encode(values: np.ndarray, west: float, north: float, size: float, nodata: float | None = None, rows: int = 16) -> bytes:
    """A GeoTIFF file of doubles, rows from north to south, in deflated strips."""
    height, width = values.shape
    strips = [zlib.compress(np.ascontiguousarray(values[k : k + rows], "<f8").tobytes()) for k in range(0, height, rows)]
    keys = (1, 1, 0, 3, MODEL, 0, 1, 2, PIXEL_KIND, 0, 1, 1, GEOGRAPHIC, 0, 1, WGS84)
    starts = np.cumsum([8, *map(len, strips)]).tolist()
    own = [
        (WIDTH, "I", (width,)), (HEIGHT, "I", (height,)), (BITS, "H", (64,)), (PACKING, "H", (8,)), (STRIPS, "I", starts[:-1]), (SAMPLES, "H", (1,)),
        (STRIP_ROWS, "I", (rows,)), (STRIP_BYTES, "I", [len(s) for s in strips]), (FORMAT, "H", (3,)), (PIXEL_SCALE, "d", (size, size, 0.0)),
        (TIE_POINT, "d", (0.0, 0.0, 0.0, west, north, 0.0)), (GEO_KEYS, "H", keys),
    ]
    if nodata is not None:
        own.append((NO_DATA, "s", (repr(float(nodata)).encode() + b"\0",)))
    number, table, after = {v: k for k, v in TYPES.items()}, b"", b""
    base = starts[-1] + 2 + 12 * len(own) + 4
    for tag, letter, data in own:
        n = len(data[0]) if letter == "s" else len(data)
        body = struct.pack(f"<{n}{letter}", *data)
        table += struct.pack("<HHI", tag, number[letter], n) + (body.ljust(4, b"\0") if len(body) <= 4 else struct.pack("<I", base + len(after)))
        after += body if len(body) > 4 else b""
    return b"II" + struct.pack("<HI", 42, starts[-1]) + b"".join(strips) + struct.pack("<H", len(own)) + table + bytes(4) + after
