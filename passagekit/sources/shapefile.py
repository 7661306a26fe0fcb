"""Coasts from shapefiles: polygons' rings, told apart as land and holes, and their edges."""

from __future__ import annotations

import fnmatch
import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: the number that files begin with, the bytes before the first record, kinds of polygons.
MAGIC, HEADER, NOTHING, POLYGONS = 9994, 100, 0, (5, 15, 25)
SCHEMA = "path string, record int, part int, ring_id int, lat array<double>, lon array<double>, reason string"
#: Points of a ring that is kept, the first one again at its end included.
LEAST_POINTS = 4


def records(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, body) of a file's records."""
    if len(content) < HEADER or struct.unpack_from(">i", content)[0] != MAGIC:
        raise ValueError("not a shapefile")
    at = HEADER
    while at < len(content):
        if at + 8 > len(content):
            raise ValueError("cut short")
        number, words = struct.unpack_from(">ii", content, at)
        if words < 2 or at + 8 + 2 * words > len(content):
            raise ValueError("cut short")
        yield number, content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words


def rings(body: bytes) -> list[np.ndarray]:
    """A polygon record's rings as rows (lon, lat), closed; none for an empty shape."""
    (kind,) = struct.unpack_from("<i", body)
    if kind == NOTHING:
        return []
    if kind not in POLYGONS:
        raise ValueError(f"shape type {kind}")
    n_parts, n_points = struct.unpack_from("<ii", body, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n_points]
    points = np.frombuffer(body, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
    return [points[a:b] for a, b in zip(starts, starts[1:]) if b - a >= LEAST_POINTS]


def area(ring: np.ndarray) -> float:
    """Twice the area of a closed ring about its first point, negative if it turns clockwise."""
    x, y = (ring - ring[0]).T
    return float(x[:-1] @ y[1:] - x[1:] @ y[:-1])


def holds(ring: np.ndarray, point: np.ndarray) -> bool:
    (x0, y0), (x1, y1) = ring[:-1].T, ring[1:].T
    spans = (y0 > point[1]) != (y1 > point[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return bool((spans & (point[0] < x0 + (point[1] - y0) * (x1 - x0) / (y1 - y0))).sum() % 2)


def polygons(own: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Rings as polygons, land first: clockwise rings are land, others holes of the smallest land around their first point.

    Without a clockwise ring the largest one is the land; holes outside all
    land belong to the first polygon.
    """
    if not own:
        return []
    areas = [area(r) for r in own]
    land = [k for k, a in enumerate(areas) if a < 0] or [int(np.argmax(np.abs(areas)))]
    found = {k: [own[k]] for k in land}
    for k in set(range(len(own))) - set(land):
        around = [j for j in land if abs(areas[j]) >= abs(areas[k]) and holds(own[j], own[k][0])]
        found[min(around, key=lambda j: abs(areas[j])) if around else land[0]].append(own[k])
    return list(found.values())


def _members(content: bytes, member: str) -> Iterator[bytes]:
    if not content.startswith(b"PK"):
        yield content
        return
    with zipfile.ZipFile(io.BytesIO(content)) as packed:
        for name in sorted(packed.namelist()):
            if fnmatch.fnmatch(name, member):
                yield packed.read(name)


def _parsed(member: str):
    floats = pa.list_(pa.float64())
    to_schema = pa.schema([("path", pa.string()), ("record", pa.int32()), ("part", pa.int32()), ("ring_id", pa.int32()), ("lat", floats), ("lon", floats), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda found: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), to_schema)], schema=to_schema)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size, number = [], 0, None
                try:
                    for shapes in _members(content.as_py() or b"", member):
                        number = None
                        for number, body in records(shapes):
                            try:
                                found = polygons(rings(body))
                            except (ValueError, struct.error) as fault:
                                held.append((path, number, None, None, None, None, str(fault) if isinstance(fault, ValueError) and "shape" in str(fault) else "broken record"))
                                continue
                            for part, own in enumerate(found):
                                held += [(path, number, part, k, ring[:, 1], ring[:, 0], None) for k, ring in enumerate(own)]
                                size += sum(len(ring) for ring in own)
                            if size > 1 << 18:
                                yield rows(held)
                                held, size = [], 0
                except (ValueError, zipfile.BadZipFile) as fault:
                    held.append((path, number, None, None, None, None, str(fault) or "broken archive"))
                if held:
                    yield rows(held)

    return run


def shapes(files: DataFrame, member: str = "*.shp") -> DataFrame:
    """One row a ring of files (path, content), which may be archives with files named like ``member``; others with a reason.

    (path, record, part, ring_id, lat, lon, reason): ``part`` numbers a
    record's polygons and ring 0 is land, others are holes.
    """
    return files.select("path", "content").mapInArrow(_parsed(member), SCHEMA)


def read_shapes(spark: SparkSession, folder: str, member: str = "*.shp") -> DataFrame:
    """``shapes`` of the shapefiles and archives in a folder."""
    return shapes(spark.read.format("binaryFile").option("pathGlobFilter", "*.{[sS][hH],[zZ][iI]}[pP]").load(folder), member)


def edges(shapes_: DataFrame) -> DataFrame:
    """(poly_id, ring_id, idx, lat1, lon1, lat2, lon2) of rings; poly_id is the file's name, record and part."""
    here, after = (lambda c, k=k: F.slice(c, F.lit(k), F.size(c) - 1) for k in (1, 2))
    name = F.concat_ws(":", F.element_at(F.split("path", "/"), -1), "record", "part")
    lines = shapes_.filter("reason is null").select(
        name.alias("poly_id"), "ring_id", here("lat").alias("lat1"), here("lon").alias("lon1"), after("lat").alias("lat2"), after("lon").alias("lon2")
    )
    rows = lines.select("poly_id", "ring_id", F.posexplode(F.arrays_zip("lat1", "lon1", "lat2", "lon2")).alias("idx", "e"))
    return rows.select("poly_id", "ring_id", "idx", "e.lat1", "e.lon1", "e.lat2", "e.lon2")


def encode(shapes_: list[tuple[int, list[np.ndarray]]], kind: int = 5) -> bytes:
    """A shapefile of (number, rings as closed rows (lon, lat)), each ring in the order given."""
    out = b""
    for number, own in shapes_:
        points = np.concatenate(own)
        starts = np.cumsum([0] + [len(r) for r in own])[:-1]
        box = (*points.min(0), *points.max(0))
        body = struct.pack("<i4dii", kind, *box, len(own), len(points)) + starts.astype("<i4").tobytes() + points.astype("<f8").tobytes()
        out += struct.pack(">ii", number, len(body) // 2) + body
    return struct.pack(">i20xi", MAGIC, (HEADER + len(out)) // 2) + struct.pack("<ii", 1000, kind) + bytes(64) + out
