"""Rasters, coasts and polars from files, written here by hand."""

import io
import json
import math
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagekit.functions import polar
from passagekit.operators import corridor, depth
from passagekit.sources import geotiff, polars, shapefile

from .test_operators import segs


def tiff(values, order="<", tile=None, predictor=1, packed=True, nodata=None, point=False, drop=(), model=2, planar=1, packing=None):
    """A GeoTIFF of an array (rows, columns, samples) in strips of three rows, or in tiles; west 10, north 56, pixels of 0.1 degree."""
    rows, columns, samples = values.shape
    number = values.dtype.newbyteorder(order)
    wide, tall = tile or (columns, 3)
    planes = [values] if planar == 1 else [values[:, :, k : k + 1] for k in range(samples)]
    blocks = []
    for plane in planes:
        for top in range(0, rows, tall):
            for left in range(0, columns, wide):
                part = plane[top : top + tall, left : left + wide]
                if tile:
                    part = np.pad(part, ((0, tall - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=part.dtype.type(0)).astype(part.dtype)
                    part[:, 0] = np.pad(plane[top : top + tall, left : left + wide], ((0, len(part) - len(plane[top : top + tall])), (0, 0), (0, 0)))[:, 0]
                data = part.astype(number).tobytes()
                if predictor == 3:
                    weights = part.astype(number.newbyteorder(">")).view(np.uint8).reshape(len(part), -1, number.itemsize).transpose(0, 2, 1).reshape(len(part), -1, part.shape[2])
                    data = np.diff(weights, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
                blocks.append(zlib.compress(data) if packed else data)
    starts = np.cumsum([8] + [len(b) for b in blocks]).tolist()
    kind = {"u": 1, "i": 2, "f": 3}[number.kind]
    keys = (1, 1, 0, 2, 1024, 0, 1, model, 1025, 0, 1, 2 if point else 1)
    tie = (0.0, 0.0, 0.0, 10.0 + 0.05 * point, 56.0 - 0.05 * point, 0.0)
    own = {256: ("I", [columns]), 257: ("I", [rows]), 258: ("H", [8 * number.itemsize] * samples), 259: ("H", [packing or (8 if packed else 1)]), 277: ("H", [samples]), 284: ("H", [planar])}
    own |= {317: ("H", [predictor]), 339: ("H", [kind] * samples), 33550: ("d", (0.1, 0.1, 0.0)), 33922: ("d", tie), 34735: ("H", keys)}
    own |= {322: ("I", [wide]), 323: ("I", [tall]), 324: ("I", starts[:-1]), 325: ("I", [len(b) for b in blocks])} if tile else {278: ("I", [tall]), 273: ("I", starts[:-1]), 279: ("I", [len(b) for b in blocks])}
    if nodata is not None:
        own[42113] = ("s", [nodata.encode() + b"\0"])
    own = {k: v for k, v in sorted(own.items()) if k not in drop}
    table, after, base = b"", b"", starts[-1] + 2 + 12 * len(own) + 4
    for tag, (letter, data) in own.items():
        n = len(data[0]) if letter == "s" else len(data)
        body = struct.pack(f"{order}{n}{letter}", *data)
        table += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[letter], n)
        table += body.ljust(4, b"\0") if len(body) <= 4 else struct.pack(order + "I", base + len(after))
        after += body if len(body) > 4 else b""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, starts[-1])
    return head + b"".join(blocks) + struct.pack(order + "H", len(own)) + table + bytes(4) + after


def depths(samples=1, dtype="<f4", rows=7, columns=10):
    values = np.arange(rows * columns * samples).reshape(rows, columns, samples)
    return (values * 1.5 - 60 if np.dtype(dtype).kind == "f" else values % 120).astype(dtype)


def frame(spark, files):
    return spark.createDataFrame([(n, bytearray(b)) for n, b in files.items()], "path string, content binary")


@pytest.mark.parametrize(
    "how",
    [
        dict(), dict(order=">"), dict(packed=False), dict(tile=(4, 4)), dict(predictor=3), dict(predictor=3, order=">", tile=(16, 16)), dict(point=True),
        dict(dtype="<i2"), dict(dtype="<i2", predictor=2, tile=(4, 4)), dict(dtype="<u1", order=">"), dict(dtype="<f8"), dict(samples=2, band=2),
        dict(samples=2, band=2, planar=2, tile=(4, 4)), dict(dtype="<i4", samples=3, band=1, predictor=2),
    ],
)
def test_raster_comes_back(how):
    band = how.pop("band", 1)
    values = depths(how.pop("samples", 1), how.pop("dtype", "<f4"))
    out = np.full(values.shape[:2], np.nan)
    for row in geotiff.blocks_of(tiff(values, **how), band):
        out[row["top"] : row["top"] + row["tall"], row["x"] : row["x"] + row["wide"]] = geotiff.pixels(row)
        assert math.isclose(row["west"], 10.0) and math.isclose(row["north"], 56.0)
    assert np.array_equal(out, values[:, :, band - 1].astype(float))


def test_raster_reasons(spark):
    values = depths()
    whole = tiff(values)
    files = {
        "text": b"no raster", "short": whole[:100], "none": b"", "place": tiff(values, drop=(33550,)), "reference": tiff(values, drop=(34735,)), "metres": tiff(values, model=1),
        "lzw": tiff(values, packing=5), "kind": tiff(values.astype("<f2")), "data": tiff(values, packed=False).replace(values.tobytes(), b"", 1), "good": whole,
    }
    got = {r.path: r.reason for r in geotiff.blocks(frame(spark, files)).select("path", "reason").distinct().collect()}
    assert got["good"] is None and got["text"] == got["none"] == "not a TIFF file of 32-bit offsets" and got["short"] == "cut short"
    assert (got["place"], got["reference"], got["metres"]) == ("no geotransform", "no spatial reference", "not in degrees of WGS 84")
    assert got["lzw"] == "packing 5" and got["kind"] == "kind of numbers" and got["data"] is not None
    assert geotiff.blocks(frame(spark, {"good": whole}), 2).first().reason == "no such band"
    assert geotiff.blocks(frame(spark, {})).count() == 0 and geotiff.raster(geotiff.blocks(frame(spark, {"text": b""}))) is None


def test_depths_from_a_mosaic(spark, tmp_path):
    """Two files side by side, read from a folder; only blocks that a leg meets are unpacked."""
    values = -np.abs(depths(rows=6, columns=20, dtype="<f8"))
    values[0, 0, 0] = -9999.0
    west, east = values[:, :10, 0], values[:, 10:, 0]
    (tmp_path / "a.tif").write_bytes(tiff(values[:, :10], nodata="-9999"))
    (tmp_path / "b.TIFF").write_bytes(geotiff.encode(east, 11.0, 56.0, 0.1, nodata=-9999.0, rows=2))
    (tmp_path / "c.tif").write_bytes(geotiff.encode(east, 12.03, 56.0, 0.1))
    (tmp_path / "d.txt").write_text("no raster")
    found = geotiff.read_blocks(spark, str(tmp_path)).cache()
    raster = geotiff.raster(found.filter("path not like '%c.tif'"))
    assert math.isclose(raster.lat0, 55.4) and math.isclose(raster.lon0, 10.0) and raster.elevation
    placed = geotiff.on_grid(found, raster)
    assert {r.path[-5:]: r.reason for r in placed.collect()} == {"a.tif": None, ".TIFF": None, "c.tif": "another grid"}
    got = {(r.x, r.y): r.raw for r in geotiff.cells(found, raster).collect()}
    assert len(got) == 120 and got[0, 5] is None
    for x in range(20):
        for y in range(6):
            if (x, y) != (0, 5):
                assert got[x, y] == values[5 - y, x, 0]
    ways = segs(spark, (55.65, 10.25, 55.65, 10.35), (55.45, 11.95, 55.45, 12.15), (55.95, 10.05, 55.85, 10.05))
    pixels = depth.cells_on_segments(ways, raster)
    some = geotiff.cells(found, raster, pixels.select("x", "y"))
    least = {r.id: r.depth_m for r in depth.least_depth(ways, some, raster).collect()}
    assert least == {0: min(-west[3, 2], -west[3, 3]), 1: None, 2: None}
    far = spark.createDataFrame([(5000, 5000)], "x int, y int")
    assert geotiff.met(geotiff.on_grid(found, raster), far).count() == 0 == geotiff.cells(found, raster, far).count()


def circle(lon, lat, r, clockwise=True, n=12):
    turn = np.linspace(0, 2 * math.pi, n + 1) * (-1 if clockwise else 1)
    ring = np.c_[lon + r * np.cos(turn), lat + r * np.sin(turn)]
    ring[-1] = ring[0]
    return ring


def test_shapefile_rings(spark, tmp_path):
    """Parts, holes, a hole in the smaller of two nested lands, open and wrongly turned rings, other shapes, an archive."""
    own = [
        (1, [circle(10, 55, 1)]),
        (2, [circle(20, 50, 2), circle(20, 50, 1, False), circle(20, 50, 0.5), circle(20, 50, 0.2, False), circle(30, 50, 1)]),
        (3, [circle(5, 5, 1, False), circle(5, 5, 0.1, False)]),
        (4, [circle(0, 0, 1), circle(0, 0, 0.1, False)[:3]]),
    ]
    content = shapefile.encode(own)
    point = struct.pack("<idd", 1, 3.0, 4.0)
    broken = struct.pack("<i4dii", 5, 0, 0, 1, 1, 9, 9)
    extra = b"".join(struct.pack(">ii", n, len(b) // 2) + b for n, b in ((5, point), (6, struct.pack("<i", 0)), (7, broken)))
    (tmp_path / "a.shp").write_bytes(content + extra)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as out:
        out.writestr("f/coast.shp", shapefile.encode(own[:1], 15))
        out.writestr("f/coast.dbf", b"-")
    (tmp_path / "c.shp").write_bytes(content[:-9])
    (tmp_path / "d.zip").write_bytes(b"PK no archive")
    (tmp_path / "e.shp").write_bytes(b"nothing")
    rows = shapefile.read_shapes(spark, str(tmp_path)).collect()
    a = {(r.record, r.part, r.ring_id): r for r in rows if r.path.endswith("a.shp") and r.reason is None}
    size = lambda r: round((max(r.lon) - min(r.lon)) / 2, 6)
    assert {k: size(r) for k, r in a.items()} == {(1, 0, 0): 1, (2, 0, 0): 2, (2, 0, 1): 1, (2, 1, 0): 0.5, (2, 1, 1): 0.2, (2, 2, 0): 1, (3, 0, 0): 1, (3, 0, 1): 0.1, (4, 0, 0): 1}
    reasons = {(r.path[-5:], r.record): r.reason for r in rows if r.reason}
    assert reasons == {("a.shp", 5): "shape type 1", ("a.shp", 7): "broken record", ("c.shp", 3): "cut short", ("d.zip", None): "File is not a zip file", ("e.shp", None): "not a shapefile"}
    assert [(r.record, r.ring_id) for r in rows if r.path.endswith("b.zip")] == [(1, 0)]
    edges = [r for r in shapefile.edges(shapefile.read_shapes(spark, str(tmp_path / "a.shp"))).collect() if r.poly_id == "a.shp:1:0"]
    edges.sort(key=lambda r: r.idx)
    assert [r.idx for r in edges] == list(range(12)) and all((p.lat2, p.lon2) == (q.lat1, q.lon1) for p, q in zip(edges, edges[1:] + edges[:1]))


GOOD = {
    "kind": "polarTable", "name": " Swift ", "units": {"tws": "m/s", "twa": "rad", "boatSpeed": "m/s"}, "symmetry": {"portStarboardSymmetric": True},
    "axes": {"tws": [2, 6], "twa": [0.5, 1.5, 3.0]}, "values": {"boatSpeedMatrix": [[1, 2, 3], [4, 5, 6]]},
}


def without(**changes):
    return json.dumps(GOOD | changes)


def test_polar_reasons(spark, tmp_path):
    cases = {
        "good": (without(), None), "text": ("not json", "unreadable"), "list": ("[1]", "unreadable"), "empty": ("", "unreadable"), "null": (None, "unreadable"),
        "kind": (without(kind="x"), "kind"), "units": (without(units={"tws": "kn", "twa": "rad", "boatSpeed": "m/s"}), "units"), "no-units": (without(units=None), "units"),
        "symmetry": (without(symmetry={"portStarboardSymmetric": False}), "symmetry"), "word": (without(symmetry={"portStarboardSymmetric": "true"}), "symmetry"),
        "no-axes": (without(axes=None), "axes"), "no-winds": (without(axes={"tws": [], "twa": [1]}), "axes"), "hole": (without(axes={"tws": [2, None], "twa": [1]}), "axes"),
        "back": (without(axes={"tws": [6, 2], "twa": [0.5, 1.5, 3.0]}), "axis-order"), "twice": (without(axes={"tws": [2, 2], "twa": [0.5, 1.5, 3.0]}), "axis-order"),
        "below": (without(axes={"tws": [-1, 2], "twa": [0.5, 1.5, 3.0]}), "axis-order"), "beyond": (without(axes={"tws": [2, 6], "twa": [0.5, 1.5, 3.2]}), "axis-order"),
        "rows": (without(values={"boatSpeedMatrix": [[1, 2, 3]]}), "matrix"), "columns": (without(values={"boatSpeedMatrix": [[1, 2, 3], [4, 5]]}), "matrix"),
        "negative": (without(values={"boatSpeedMatrix": [[1, 2, 3], [4, -5, 6]]}), "matrix"), "no-matrix": (without(values=None), "matrix"), "unknown": (without(values={"boatSpeedMatrix": [[1, 2, 3], [4, None, 6]]}), "matrix"),
        "one": (without(axes={"tws": [0], "twa": [math.pi]}, values={"boatSpeedMatrix": [[0]]}), None), "unnamed": (without(name=None), None),
    }
    table = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "polar_id string, resource string")
    got = {r.polar_id: r for r in polars.checked(table).collect()}
    assert {k: r.reason for k, r in got.items()} == {k: v[1] for k, v in cases.items()}
    assert got["good"].name == "Swift" and got["unnamed"].name == "unnamed"
    (tmp_path / "swift.json").write_text(json.dumps(GOOD, indent=1))
    assert [(r.polar_id, json.loads(r.resource) == GOOD) for r in polars.read_resources(spark, str(tmp_path)).collect()] == [("swift", True)]


def test_active_polar(spark):
    of = lambda **x: json.dumps({"enabled": True, "configuration": {"activePolar": "p"} | x})
    cases = [
        (of(perfAdjust=0.9), 0.9, None), (of(perfAdjust="1.1"), 1.1, None), (of(perfAdjust=-1), 1.0, None), (of(perfAdjust="fast"), 1.0, None), (of(), 1.0, None), (of(perfAdjust=None), 1.0, None),
        (of(activePolar="../p"), 1.0, "invalid-id"), (of(activePolar=""), 1.0, "no-active-polar"), (of(activePolar="q"), 1.0, "no-resource"), ("{", 1.0, "settings-unreadable"), (None, 1.0, "settings-unreadable"),
        (json.dumps({"enabled": "true", "configuration": {"activePolar": "p"}}), 1.0, "disabled"), (json.dumps({"enabled": True}), 1.0, "no-configuration"), (json.dumps({"enabled": True, "configuration": "p"}), 1.0, "no-configuration"),
    ]
    settings = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "vessel long, settings string")
    resources = spark.createDataFrame([("p", without())], "polar_id string, resource string")
    found = polars.loaded(settings, resources).cache()
    assert {r.vessel: (r.adjustment, r.reason) for r in found.collect()} == {k: c[1:] for k, c in enumerate(cases)}
    cells = polar.normalise(found.filter("vessel = 0 and reason is null"))
    assert {(round(r.tws / polar.IMPORT_KNOTS, 6), round(math.radians(r.twa), 6)): round(r.speed / polar.IMPORT_KNOTS, 6) for r in cells.collect()} == {
        (2, 0.5): 0.9, (2, 1.5): 1.8, (2, 3.0): 2.7, (6, 0.5): 3.6, (6, 1.5): 4.5, (6, 3.0): 5.4,
    }


def test_motor_route_stops(spark):
    """The first fault of a route names it: cover before wind and wave, limits of zero are none, unknown waves are no fault."""
    walked = spark.createDataFrame([(r, s, float(s)) for r in range(1, 6) for s in range(3)], "route_id long, seq long, t_ms double")
    fine = {(r, s): (True, 10.0, 1.0) for r in range(1, 6) for s in range(3)}
    fine |= {(1, 2): (False, None, None), (2, 1): (True, 20.1, None), (2, 2): (False, None, None), (3, 0): (True, 20.0, 3.1), (4, 1): (True, 20.0, None)}
    del fine[5, 1]
    table = spark.createDataFrame([(*k, *v) for k, v in fine.items()], "route_id long, seq long, covered boolean, tws double, wave double")
    first = lambda *most: {r.route_id: (r.reason, r.stopped_seq) for r in corridor.motor_route(walked, table, *most).collect()}
    assert first(20.0, 3.0) == {1: ("grib_exhausted", 2), 2: ("wind", 1), 3: ("wind", 0), 4: (None, None), 5: ("grib_exhausted", 1)}
    assert first(0.0, 0.0) == {1: ("grib_exhausted", 2), 2: ("grib_exhausted", 2), 3: (None, None), 4: (None, None), 5: ("grib_exhausted", 1)}
    assert corridor.motor_route(walked.filter(F.lit(False)), table, 20.0, 3.0).count() == 0
