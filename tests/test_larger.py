"""What must hold on larger tables: rows that are not multiplied, and results that stay those of plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from passagekit.operators import depth, forecast, legs, scratch, spatial
from tests.test_operators import HOUR, T0, at, edges, files, ring, segs


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def many_files(spark, seed=5, n=150):
    """Files of few boxes and periods, so that many share both."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lat, lon, start = rng.choice([40.0, 40.5, 41.0]), rng.choice([10.0, 11.0]), T0 + rng.choice([0, 12, 30]) * HOUR
        hours = rng.choice([6, 48])
        rows.append(dict(path=f"f{k}", reference_ms=T0 + rng.choice([0, 6]) * HOUR, start_ms=start, end_ms=start + hours * HOUR, n_times=hours + 1, lat_min=lat, lat_max=lat + rng.choice([1.0, 3.0]), lon_min=lon, lon_max=lon + 2.0, mtime=rng.randrange(50)))
    spots = [(40 + 4 * rng.random(), 9.5 + 4 * rng.random(), T0 + rng.randrange(90 * HOUR)) for _ in range(200)]
    return files(spark, *rows), at(spark, *spots)


def plain_choice(files_, r):
    fits = [f for f in files_ if f.lat_min <= r.lat <= f.lat_max and f.lon_min <= r.lon <= f.lon_max and f.start_ms <= r.t_ms <= f.end_ms]
    return min(fits, key=lambda f: (-f.reference_ms, (f.end_ms - f.start_ms) / (f.n_times - 1), f.lat_step, -f.mtime, f.path)).path if fits else ""


def test_a_point_meets_one_list_of_files(spark):
    known, spots = many_files(spark)
    found = forecast.select_file(spots, known)
    assert "Aggregate" not in plan(found)  # points are not grouped, since no join multiplied them
    own = known.collect()
    want = {r.id: plain_choice(own, r) for r in spots.collect()}
    assert {r.id: r.path for r in found.collect()} == want and len(set(want.values())) > 5


def test_files_after_one_that_holds_the_cell_are_left_out(spark):
    """A cell and day's list ends at the first file that holds all of it; others of the same box and period are not in it."""
    day = T0 // (24 * HOUR) * 24 * HOUR
    whole = dict(start_ms=day - HOUR, end_ms=day + 25 * HOUR, n_times=27)
    known = files(spark, *[whole | dict(path=f"same{k}", mtime=k) for k in range(20)], *[whole | dict(path=f"late{k}", reference_ms=T0 - HOUR, lat_max=42.0 + k) for k in range(20)])
    spots = at(spark, (40.5, 10.5, day + HOUR))
    assert forecast.select_file(spots, known).first().path == "same19"
    assert forecast.foremost(known).count() == 20  # one of 20, and 19 of other boxes than it


def waves(spark):
    return spark.createDataFrame([("f", 0, i, j, float(i + j), float(i * j), 9999.0 if i == j == 1 else float(i)) for i in range(3) for j in range(3)], "path string, frame int, i int, j int, u double, v double, swh double")


def test_a_sample_reads_four_cells_as_one_row(spark):
    """Points are neither multiplied by corners nor grouped again; a missing or masked corner counts nothing."""
    known, spots = files(spark, {}), at(spark, (40.25, 10.5, T0), (41.5, 11.5, T0), (50.0, 10.0, T0))
    found = forecast.sample(spots, known, lambda wanted: waves(spark), ["u", "v"])
    assert not {"Aggregate", "Generate"} & {word for line in plan(found).splitlines() for word in line.replace("+-", " ").split()}
    assert {r.id: (r.path, r.u, r.v) for r in found.collect()} == {0: ("f", 0.75, 0.125), 1: ("f", 3.0, 2.25), 2: ("", 0.0, 0.0)}


def test_a_wave_leaves_out_masked_corners(spark):
    known, spots = files(spark, {}), at(spark, (40.5, 10.5, T0), (41.5, 11.5, T0), (50.0, 10.0, T0))
    found = forecast.sample_wave(spots, known, lambda wanted: waves(spark))
    assert not {"Aggregate", "Generate"} & {word for line in plan(found).splitlines() for word in line.replace("+-", " ").split()}
    assert {r.id: r.swh for r in found.collect()} == {0: 1 / 3, 1: (1 + 2 + 2) / 3}


def plain_pixels(lat1, lon1, lat2, lon2, raster):
    """Pixels whose open square a piece enters, by clipping, and those of its ends."""
    n, found = max(1, math.ceil(apart(lat1, lon1, lat2, lon2))), set()
    for k in range(1, n + 1):
        (x0, y0), (x1, y1) = ((((lon1 + (lon2 - lon1) * (m / n)) - raster.lon0) / raster.size, ((lat1 + (lat2 - lat1) * (m / n)) - raster.lat0) / raster.size) for m in (k - 1, k))
        found |= {(math.floor(x0), math.floor(y0)), (math.floor(x1), math.floor(y1))}
        for x in range(math.floor(min(x0, x1)), math.floor(max(x0, x1)) + 1):
            for y in range(math.floor(min(y0, y1)), math.floor(max(y0, y1)) + 1):
                (a, b), (c, d) = (sorted(((p - s) / (e - s), (p + 1 - s) / (e - s))) if e != s else (0.0, 1.0) for p, s, e in ((x, x0, x1), (y, y0, y1)))
                if max(0.0, a, c) < min(1.0, b, d):
                    found.add((x, y))
    return found


def apart(lat1, lon1, lat2, lon2):
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 3440.065 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def test_pixels_at_a_corner(spark):
    """Legs that meet a pixel's corner to within rounding pass the pixels that clipping gives, as the SQL has them."""
    raster = depth.Raster(54.0, 10.0, 0.1)
    rng = random.Random(3)
    ways = [(57.482000000000006, 12.103333333333333, 57.5, 12.1), (54.708, 15.886666666666667, 54.698, 15.903333333333332), (55.9792, 16.165333333333333, 56.0032, 16.205333333333332), (55.0, 11.0, 55.3, 11.0), (55.0, 11.0, 55.0, 11.0)]
    ways += [(54 + rng.random(), 10 + rng.random(), 54 + rng.random(), 10 + rng.random()) for _ in range(40)]
    got = {}
    for r in depth.cells_on_segments(segs(spark, *ways), raster).collect():
        got.setdefault(r.id, set()).add((r.x, r.y))
    assert got == {k: plain_pixels(*way, raster) for k, way in enumerate(ways)}


def test_files_of_one_box_are_compared_once(spark):
    """What holds a file is told for its box and period, whatever number of files share them."""
    wide = dict(lat_min=39.0, lat_max=43.0, start_ms=T0 - HOUR, end_ms=T0 + 2 * HOUR)
    rows = [dict(path=f"s{k}", mtime=k) for k in range(40)] + [wide | dict(path=f"w{k}", reference_ms=T0 - HOUR + k % 2 * 2 * HOUR, mtime=k) for k in range(40)] + [dict(path="old", end_ms=T0 - 2 * HOUR, start_ms=T0 - 9 * HOUR)]
    found = forecast.combination(files(spark, *rows), T0)
    got = {r.path: (r.recommended, r.reason) for r in found.collect()}
    assert [p for p, (good, _) in got.items() if good] == ["w39"] and got["old"] == (False, "ended hours ago: 2")
    assert {why for p, (_, why) in got.items() if p not in ("w39", "old")} == {"covered by w39"}
    assert "Window" not in plan(found)  # no order of all files in one task


def test_currents_make_the_freshest_files_cells_alone(spark):
    known = files(spark, dict(type="current", path="a", mtime=1), dict(type="current", path="b", mtime=2), dict(type="wind", path="c", mtime=3))
    asked = []

    def made(wanted):
        asked.extend(sorted(tuple(r) for r in wanted.collect()))
        return waves(spark).withColumn("path", F.lit("b"))

    found = forecast.currents_at(at(spark, (40.5, 10.5, T0), (50.0, 10.0, T0)), known, made)
    assert asked == [("b", 0), ("b", 1)] and {r.id: (r.u, r.v) for r in found.collect()} == {0: (1.0, 0.25), 1: (0.0, 0.0)}
    every = waves(spark).withColumn("path", F.explode(F.array(F.lit("a"), F.lit("b"))))
    assert {r.id: r.u for r in forecast.currents_at(at(spark, (40.5, 10.5, T0)), known, every).collect()} == {0: 1.0}


def coast_and_ways(spark, seed=11):
    rng = random.Random(seed)
    rings = [ring(square(lon, lat, lon + 0.3, lat + 0.2)) for lon, lat in ((10.0, 55.0), (11.05, 55.4), (10.5, 56.3), (13.0, 54.0))]
    coast = edges(spark, *rings)
    ways = [(lat := 54 + 3 * rng.random(), lon := 9 + 5 * rng.random(), lat + rng.uniform(-0.1, 0.1), lon + rng.uniform(-0.2, 0.2)) for _ in range(150)]
    return coast, ways + [(55.0, 10.0, 55.0, 10.0), (55.1, 10.1, 55.1, 10.1)]


def square(west, south, east, north):
    return [(west, south), (east, south), (east, north), (west, north)]


def plain_shore(way, sides):
    """Least distance of a way that touches no side, in the plane of its middle."""
    lat1, lon1, lat2, lon2 = way
    scale = 60 * math.cos(math.radians((lat1 + lat2) / 2))
    flat = lambda lat, lon: (lon * scale, lat * 60)

    def gap(p, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        n = d[0] ** 2 + d[1] ** 2
        t = 0 if n == 0 else min(1, max(0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n))
        return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])

    a, b = flat(lat1, lon1), flat(lat2, lon2)
    return min(min(gap(a, c, d), gap(b, c, d), gap(c, a, b), gap(d, a, b)) for c, d in ((flat(e.lat1, e.lon1), flat(e.lat2, e.lon2)) for e in sides))


def test_coasts_are_joined_by_their_real_size(spark, monkeypatch):
    """Edges are copied while they are few and merged otherwise; segments, multiplied by cells, are never sent through the driver."""
    coast, ways = coast_and_ways(spark)
    found = lambda rows: {r.id: r.shore_nm for r in rows.collect()}
    few = spatial.shore_distances(segs(spark, *ways), coast, 12.0)
    assert "strategy=broadcast" in plan(few)
    monkeypatch.setattr(scratch, "FEW", 0)
    coast, _ = coast_and_ways(spark)
    many = spatial.shore_distances(segs(spark, *ways), coast, 12.0)
    assert "strategy=merge" in plan(many) and "strategy=broadcast" not in plan(many)
    sides, got = coast.collect(), found(few)
    assert got == found(many)
    want = {k: d for k, way in enumerate(ways) if (d := plain_shore(way, sides)) <= 12}
    assert want.keys() == got.keys() and len(want) > 20
    assert all(got[k] == pytest.approx(d, abs=1e-9) or got[k] == 0 for k, d in want.items())


@pytest.mark.parametrize("within", [4.0, 60.0, 150.0])
def test_nearest_coast_by_short_lists(spark, within):
    """A place meets the few edges that can be the nearest in its cell, and has the distance to the nearest of all."""
    coast, ways = coast_and_ways(spark)
    rows = spark.createDataFrame([(k, w[0], w[1]) for k, w in enumerate(ways)], "id long, lat double, lon double")
    found = spatial.with_nearest(rows, coast, within)
    assert "Aggregate" not in plan(found)
    sides = coast.collect()
    for r in found.collect():
        want = plain_shore((r.lat, r.lon, r.lat, r.lon), sides)
        assert r.shore_nm == pytest.approx(want, abs=1e-9) if want <= within else r.shore_nm is None
    cells = rows.select(F.floor(F.col("lat") * 10).alias("_row"), F.floor(F.col("lon") * 10).alias("_col")).distinct()
    assert spatial._nearest_edges(cells, coast, within).agg(F.max(F.size("near"))).first()[0] < 12  # of 16


def test_course_of_a_leg_without_length(spark):
    """What rounding leaves of a course is that of the C library, as in the SQL; other legs, and pairs that are one place, have their course."""
    spots = [(58.95680000000001, 22.181333333333335), (58.9568, 22.18133333333334), (56.25599999999999, 17.333333333333332), (56.256, 17.333333333333336), (56.256, 17.333333333333336), (57.256, 17.333333333333336)]
    rows = spark.createDataFrame([(0, k, lat, lon, k, 0.0, 0.0, 5.0, 5.0) for k, (lat, lon) in enumerate(spots)], "route_id long, seq long, lat double, lon double, t_ms long, heading double, wind_from double, tws double, speed double")
    got = [round(r.course, 6) for r in legs.kinematics(rows).orderBy("seq").collect()]
    assert (got[0], got[2], got[3], got[4]) == (169.131018, 31.818801, 0.0, 0.0) and len(got) == 5
