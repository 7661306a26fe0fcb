import pytest
from pyspark.sql import functions as F

from passagekit.functions.polar import Polar
from passagekit.operators import alternatives, depth, forecast, isochrone, legs, quality, spatial
from passagekit.sources import geojson

HOUR = 3_600_000
DAY = 24 * HOUR
T0 = 1_781_913_600_000  # 2026-06-20 00:00


def files(spark, *rows):
    base = dict(path="f", type="wind", reference_ms=T0, start_ms=T0, end_ms=T0 + HOUR, n_times=2, step_ms=HOUR, lat_min=40.0, lat_max=42.0, lon_min=10.0, lon_max=12.0, lat_step=1.0, lon_step=1.0, mtime=0)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in base.items())).withColumn("n_times", F.col("n_times").cast("int"))


def at(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, lat double, lon double, t_ms long")


@pytest.mark.parametrize(
    "a,b,want",
    [
        (dict(mtime=1000), dict(mtime=2000), "b"),
        (dict(mtime=9000), dict(mtime=1000, reference_ms=T0 + 6 * HOUR), "b"),
        (dict(end_ms=T0 + 9 * HOUR, n_times=4, step_ms=3 * HOUR), dict(end_ms=T0 + 9 * HOUR, n_times=10), "b"),
    ],
)
def test_file_choice(spark, a, b, want):
    got = forecast.select_file(at(spark, (41.0, 11.0, T0)), files(spark, dict(path="a") | a, dict(path="b") | b)).collect()
    assert [r.path for r in got] == [want]


def test_no_file_covers(spark):
    both = files(spark, dict(path="a"), dict(path="b", lon_min=13.0, lon_max=15.0, start_ms=T0 + DAY, end_ms=T0 + 2 * DAY))
    got = forecast.select_file(at(spark, (60.0, 20.0, T0), (41.0, 14.0, T0), (41.0, 14.0, T0 + DAY)), both).collect()
    assert {r.id: r.path for r in got} == {0: "", 1: "", 2: "b"}


def test_sampling(spark):
    box = dict(lat_min=0.0, lat_max=1.0, lon_min=0.0, lon_max=1.0, end_ms=T0 + 3 * HOUR, step_ms=3 * HOUR)
    one = files(spark, box)
    cells = [("f", 0, i, j, float(u), float(v), float(w)) for (i, j), u, v, w in zip(((0, 0), (0, 1), (1, 0), (1, 1)), (0, 2, 4, 6), (6, 4, 2, 0), (2, 2, 2, 9999))]
    cells += [("f", 1, i, j, 1.0, 1.0, float(w)) for (i, j), w in zip(((0, 0), (0, 1), (1, 0), (1, 1)), (10, 12, 14, 16))]
    raster = spark.createDataFrame(cells, "path string, frame int, i int, j int, u double, v double, swh double")
    points = at(spark, (0.5, 0.5, T0), (0.5, 0.5, T0 + 2 * HOUR), (0.5, 0.5, T0 + 3 * HOUR // 2))
    got = {r.id: (r.u, r.v, r.frame) for r in forecast.sample(points, one, raster, ["u", "v"]).collect()}
    assert got == {0: (3, 3, 0), 1: (1, 1, 1), 2: (3, 3, 0)}  # a tie goes to the earlier frame
    placed = forecast.with_grid(spark.createDataFrame([(0, "f", 0, 0.5, 0.5), (1, "f", 1, 0.5, 0.5)], "id long, path string, frame int, lat double, lon double"), one)
    assert {r.id: r.swh for r in forecast.bilinear_masked(placed, raster, "swh").collect()} == {0: 2, 1: 13}


def test_axes(spark):
    one = files(spark, dict(end_ms=T0 + 3 * HOUR, step_ms=3 * HOUR))
    times = sorted(r.valid_ms for r in forecast.resampled_axis(one, HOUR // 4).collect())
    assert len(times) == 13 and times[1] - T0 == HOUR // 4
    three = files(spark, dict(end_ms=T0 + 6 * HOUR, step_ms=3 * HOUR, n_times=3))
    start = spark.createDataFrame([("f", T0 + 5 * HOUR // 4)], "path string, departure_ms long")
    assert sorted((r.valid_ms - T0) / HOUR for r in forecast.departure_axis(forecast.frames(three), start).collect()) == [1.25, 3, 6]


def test_combination(spark):
    area = dict(lat_min=50.0, lat_max=60.0, lon_min=10.0, lon_max=20.0, end_ms=T0 + 5 * DAY, n_times=121)
    said = lambda rows, **k: {r.path: (r.recommended, r.reason) for r in forecast.combination(files(spark, *[area | r for r in rows]), T0 + 8 * HOUR, **k).collect()}
    new, old = dict(path="new", reference_ms=T0 + 6 * HOUR), dict(path="old")
    assert said([new, old]) == {"new": (True, ""), "old": (False, "covered by new")}
    assert all(ok for ok, _ in said([dict(path="a"), dict(path="b", lon_min=15.0, lon_max=25.0)]).values())
    past = dict(path="past", start_ms=T0 - 10 * DAY, end_ms=T0 - 9 * DAY)
    assert said([past, dict(path="future")])["past"] == (False, f"ended hours ago: {9 * 24 + 8}")
    assert said([past, dict(path="future")], departure_ms=T0 - 10 * DAY + HOUR)["future"] == (False, "departure outside its period")
    assert said([dict(path="coarse", n_times=41), dict(path="fine")])["coarse"][0] is False


def test_grid_bounds(spark):
    row = forecast.grid_bounds(files(spark, dict(lat_step=0.5, lon_step=0.5), dict(lat_min=41.0, lat_max=44.0, lon_min=11.0, lon_max=14.0, lat_step=0.5, lon_step=0.5))).first()
    assert (row.lat_min, row.lat_max, row.lon_min, row.lon_max, row.n_lat, row.n_lon) == (40, 44, 10, 14, 8, 8)


def ring(corners, poly=0, ring_id=0):
    return [(poly, ring_id, i, *a[::-1], *b[::-1]) for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1]))]


def edges(spark, *rings):
    return spark.createDataFrame([e for r in rings for e in r], "poly_id long, ring_id int, idx int, lat1 double, lon1 double, lat2 double, lon2 double")


def square(low, high):
    return [(low, low), (high, low), (high, high), (low, high)]


def segs(spark, *rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, lat1 double, lon1 double, lat2 double, lon2 double")


def test_land(spark):
    land = edges(spark, ring(square(1.0, 3.0)))
    legs_ = segs(spark, (2, -1, 2, 5), (0, 2, 2, 2), (0, 0, 0, 5), (-10, -10, -9, -9), (2, 1.5, 2, 2.5))
    assert sorted(r.id for r in spatial.crossing_segments(legs_, land).collect()) == [0, 1]
    assert sorted(r.id for r in spatial.clear_segments(legs_, land).collect()) == [2, 3, 4]
    points = at(spark, (2.0, 2.0, 0), (0.0, 0.0, 0))
    assert [r.id for r in spatial.points_on_land(points, land).collect()] == [0]
    holed = edges(spark, ring(square(0.0, 4.0)), ring(square(1.0, 3.0), ring_id=1))
    assert spatial.points_on_land(at(spark, (2.0, 2.0, 0)), holed).count() == 0
    assert [r.id for r in spatial.crossing_segments(segs(spark, (2, 1.5, 2, 2.5), (2, 0.5, 2, 1.5)), holed).collect()] == [1]


def test_shore(spark):
    coast = edges(spark, ring([(0.0, 0.0), (1.0, 0.0), (1.0, 2.0), (0.0, 2.0)]))
    leg = segs(spark, (0.5, 1.1, 1.5, 1.1))
    assert spatial.shore_distances(leg, coast, 10.0).first().shore_nm == pytest.approx(6, abs=0.1)
    assert [spatial.has_clearance(leg, coast, m).first().clear for m in (5.0, 7.0)] == [True, False]
    assert spatial.within_offshore(leg, coast, 10.0).first().within
    assert not spatial.within_offshore(segs(spark, (0.5, 1.5, 1.5, 1.5)), coast, 10.0).first().within
    assert spatial.shore_distances(segs(spark, (0.5, 0.5, 0.5, 1.5)), coast, 5.0).first().shore_nm == 0


def test_depth(spark):
    rows = [(x, y, float(v)) for y, line in enumerate(((-10, -8, -6, -4), (-3, -2, -1, 0))) for x, v in enumerate(line)]
    cells = spark.createDataFrame(rows, "x int, y int, raw double")
    up = depth.Raster(0.0, 0.0, 1.0, elevation=True)
    assert [r.depth_m for r in depth.depth_at(at(spark, (0.2, 0.2, 0), (0.2, 3.2, 0), (9.0, 9.0, 0)), cells, up).orderBy("id").collect()] == [10, 4, None]
    down = spark.createDataFrame([(x, 0, float(v)) for x, v in enumerate((10, 8, 2, 9))], "x int, y int, raw double")
    assert depth.least_depth(segs(spark, (0.2, 0.2, 0.2, 3.2)), down, depth.Raster(0.0, 0.0, 1.0)).first().depth_m == 2
    gap = spark.createDataFrame([(x, 0, float(v)) for x, v in enumerate((10, -9999, 8, 7))], "x int, y int, raw double")
    assert depth.least_depth(segs(spark, (0.2, 0.2, 0.2, 2.2)), gap, depth.Raster(0.0, 0.0, 1.0, nodata=-9999.0)).first().depth_m is None


POINT = "route_id long, seq long, lat double, lon double, t_ms long, heading double, twa double, tws double, wind_from double, wave double, speed double, propulsion string, cleared boolean, path string"


def route(spark, *points, route_id=0):
    base = dict(lat=58.6, lon=19.0, t_ms=T0 + 6 * HOUR, heading=90.0, twa=90.0, tws=10.0, wind_from=180.0, wave=None, speed=6.0, propulsion="sail", cleared=None, path=None)
    return spark.createDataFrame([(route_id, i, *(base | p).values()) for i, p in enumerate(points)], POINT)


HOME, AWAY = {}, dict(lon=19.1, t_ms=T0 + 7 * HOUR)
CONTEXT = quality.Context(Polar((6.0, 20.0), (45.0, 90.0, 135.0, 180.0), ((4.0, 6.0), (5.0, 8.0), (5.0, 8.0), (4.0, 6.0))))


def codes(points, context=CONTEXT, **more):
    return {r.code: r.severity for r in quality.issues(points, context, **more).collect()}


def test_quality_of_a_sound_route(spark):
    points = route(spark, HOME, AWAY)
    assert codes(points) == {}
    row = quality.metrics(points).first()
    assert (row.wind_avg, row.wind_p95, row.wind_max, row.point_count, row.passage_days) == (10, 10, 10, 2, 1)


def test_weighted_conditions(spark):
    points = route(spark, dict(wave=1.0), dict(t_ms=T0 + 6 * HOUR + HOUR // 10, tws=30.0, wave=3.0, lon=19.05), AWAY | dict(wave=1.0))
    row = quality.metrics(points).first()
    assert (row.wind_avg, row.wind_p95, row.wave_avg, row.wave_p95) == (pytest.approx(20), 30, pytest.approx(2), 3)


@pytest.mark.parametrize(
    "change,context,want",
    [
        (dict(twa=45.0), {}, {"twa-mismatch": "error"}),
        (dict(speed=2.0), {}, {"polar-speed-mismatch": "warning"}),
        (dict(tws=19438.0), {}, {"invalid-conditions": "error", "polar-wind-cap": "warning"}),
        (dict(speed=-1.0), {}, {"invalid-boat-speed": "error"}),
        (dict(lat=99.0), {}, {"invalid-coordinate": "error"}),
        (dict(t_ms=T0), {}, {"time-reversal": "error"}),
        (dict(t_ms=T0 + 6 * HOUR), dict(land_avoidance=False), {"zero-duration-leg": "warning", "land-check-disabled": "warning"}),
        (dict(wind_from=100.0, twa=10.0), {}, {"abrupt-wind-shift": "warning"}),
        (dict(t_ms=T0 + 9 * HOUR), dict(max_hours_per_day=2.0), {"daily-hours-exceeded": "error"}),
        ({}, dict(minimum_depth_m=2.0), {"depth-coverage-missing": "error"}),
        ({}, dict(minimum_shore_nm=2.0), {"shore-clearance-not-established": "warning"}),
    ],
)
def test_issues(spark, change, context, want):
    got = codes(route(spark, HOME, AWAY | change), quality.Context(**(CONTEXT.__dict__ | context)))
    assert want.items() <= got.items()


def test_more_issues(spark):
    points = route(spark, HOME, AWAY)
    island = edges(spark, ring([(19.04, 58.5), (19.06, 58.5), (19.06, 58.7), (19.04, 58.7)]))
    assert codes(points, land=island) == {"land-crossing": "error"}
    assert "avoid-region-crossing" in codes(points, regions=island.withColumn("region_id", F.lit(1)))
    night = route(spark, dict(t_ms=T0), dict(lon=19.1, t_ms=T0 + HOUR))
    assert codes(night, quality.Context(CONTEXT.polar, daylight_only=True)) == {"night-sailing": "error"}
    shallow = spark.createDataFrame([(0, 1, 1.5)], "route_id long, seq long, depth_m double")
    assert codes(points, quality.Context(CONTEXT.polar, minimum_depth_m=2.0), depths=shallow) == {"minimum-depth-violated": "error"}
    late = route(spark, dict(path="f"), AWAY | dict(path="f", t_ms=T0 + 108 * HOUR, speed=None))
    assert "low-forecast-confidence" in codes(late, files=files(spark, {}))
    ends = spark.createDataFrame([(0, 58.0, 19.0, 58.6, 19.1)], "route_id long, start_lat double, start_lon double, end_lat double, end_lon double")
    assert codes(points, requests=ends) == {"start-mismatch": "error"}
    assert codes(route(spark, HOME)) == {"too-few-points": "error"}


def test_maneuvers(spark):
    tacks = [dict(t_ms=T0 + i * 60_000, heading=h, wind_from=0.0) for i, h in enumerate((45.0, 315.0, 45.0, 315.0, 45.0))]
    got = legs.maneuvers(route(spark, *tacks)).collect()
    assert len(got) == 3 and all(r.headway_nm < 0.5 for r in got)
    waits = [tacks[0], tacks[1], tacks[2] | dict(propulsion="wait"), tacks[2] | dict(t_ms=T0 + 150_000)]
    assert legs.maneuvers(route(spark, *waits)).count() == 1
    motors = [tacks[0], tacks[1], tacks[2] | dict(propulsion="motor"), tacks[2]]
    assert legs.maneuvers(route(spark, *motors)).count() == 0


def test_day_budget(spark):
    points = route(spark, HOME, AWAY | dict(t_ms=T0 + 11 * HOUR), dict(t_ms=T0 + 30 * HOUR, speed=None, lon=19.1), dict(lon=19.2, t_ms=T0 + 33 * HOUR))
    got = {r.day: (r.hours, r.first_excess) for r in legs.day_budget(points, 4.0).collect()}
    assert got == {0: (5, 1), 1: (3, None)}
    across = route(spark, HOME, AWAY | dict(t_ms=T0 + 6 * HOUR + 30 * HOUR))
    assert {r.day: r.hours for r in legs.day_budget(across, 0.0).collect()} == {0: 24, 1: 6}


def options(spark, *rows):
    base = dict(request_id=0, attempt=0, geometry="", complete=True, warning_count=0, duration_hours=8.0, distance_nm=20.0, motor_hours=0.0, wave_avg=1.0, wave_p95=1.4, wind_avg=13.0, wind_p95=13.8, maneuvers=0, low_headway=0)
    kinds = {k: "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "double" if isinstance(v, float) else "int" for k, v in base.items()}
    return spark.createDataFrame([tuple((base | dict(attempt=i, geometry=str(i)) | r).values()) for i, r in enumerate(rows)], ", ".join(f"{k} {v}" for k, v in kinds.items()))


@pytest.mark.parametrize(
    "objective,rows,order",
    [
        ("fastest", [dict(), dict(duration_hours=4.0), dict(duration_hours=4.0, geometry="1")], [1, 0]),
        ("fastest", [dict(duration_hours=4.0, maneuvers=6, low_headway=4), dict(duration_hours=5.0)], [1, 0]),
        ("leastMotoring", [dict(duration_hours=5.0, motor_hours=2.0), dict()], [1, 0]),
        ("bestWeather", [dict(duration_hours=5.0, wave_avg=2.0, wind_avg=20.0), dict(wave_avg=0.7)], [1, 0]),
        ("bestWeather", [dict(wave_p95=2.5, wind_p95=25.0), dict(wave_p95=1.4, wind_p95=16.0)], [1, 0]),
        ("bestWeather", [dict(wave_avg=None, wave_p95=None), dict(wave_avg=1.5)], [1, 0]),
        ("fastest", [dict(duration_hours=4.0, warning_count=1), dict(duration_hours=5.0)], [1, 0]),
        ("fastest", [dict(duration_hours=4.0, complete=False), dict(duration_hours=5.0)], [1, 0]),
    ],
)
def test_ranking(spark, objective, rows, order):
    got = alternatives.rank(options(spark, *rows), objective, 10).orderBy("place").collect()
    assert [r.attempt for r in got] == order


def test_planning(spark):
    rows = [(0, "leastMotoring", 5, False, 5.0), (1, "allMotoring", 5, False, 5.0), (2, "fastest", 10, True, 5.0), (3, "fastest", 1, True, 5.0), (4, "fastest", 10, False, 5.0)]
    got = alternatives.plan_attempts(spark.createDataFrame(rows, "request_id int, objective string, wanted int, shared boolean, heading_step double")).collect()
    by = {(r.request_id, r.attempt): r for r in got}
    assert [sum(k[0] == i for k in by) for i in range(5)] == [10, 10, 1, 1, 20]
    assert by[0, 1].heading_offset == 0.5 and by[0, 1].wait_for_wind and not by[0, 1].force_motor
    assert by[1, 2].heading_offset == 1 and by[1, 2].force_motor


def plain_fold(items):
    slots = []
    for x in items:
        if len(slots) < 3:
            slots.append(x)
            continue
        i = 0 if slots[0]["out"] <= slots[1]["out"] else 1
        if x["out"] > slots[i]["out"]:
            slots[i] = x
        elif x["left"] < slots[2]["left"]:
            slots[2] = x
    return slots


def test_frontier_fold(spark):
    opts = isochrone.Options(sector_size=30.0)
    rng = __import__("random").Random(1)
    rows = [(0, i // 7, i % 7, 50 + rng.uniform(-1, 1), 10 + rng.uniform(-1, 1), 50.0, 10.0, 51.0, 11.0) for i in range(300)]
    frame = spark.createDataFrame(rows, "request_id int, parent_id long, heading_idx int, lat double, lon double, start_lat double, start_lon double, end_lat double, end_lon double")
    placed = isochrone._placed(frame, 30.0).collect()
    want = set()
    for s in {r.sector for r in placed}:
        want |= {(r["parent_id"], r["heading_idx"]) for r in plain_fold(sorted((r for r in placed if r.sector == s), key=lambda r: (r.parent_id, r.heading_idx)))}
    got = isochrone.folded_frontier(frame, opts).collect()
    assert {(r.parent_id, r.heading_idx) for r in got} == want
    assert sorted(r.node_id for r in got) == list(range(len(got)))


def test_search_arrives(spark):
    from passagekit.operators.search import backtrack, search

    requests = spark.createDataFrame([(1, 40.0, 10.0, 40.3, 10.0)], "request_id long, start_lat double, start_lon double, end_lat double, end_lon double")
    wind = lambda rows, step: rows.withColumn("u", F.lit(5.0)).withColumn("v", F.lit(0.0))
    polar = Polar((5.0, 20.0), (40.0, 180.0), ((6.0, 6.0), (6.0, 6.0)))
    nodes, ends, _ = search(requests, wind, polar, isochrone.Options(heading_step=15.0, sector_size=10.0), 4, 1.0)
    path = backtrack(nodes, ends).orderBy("seq").collect()
    assert [r.seq for r in path] == list(range(len(path))) and (path[0].lat, path[0].lon) == (40.0, 10.0)
    assert ends.first().gap_nm <= 2.0 and abs(path[-1].lat - 40.3) < 0.05


def test_geojson(spark):
    import json

    row = geojson.routes_geojson(route(spark, HOME, AWAY)).first()
    feature = json.loads(row.feature)
    assert feature["geometry"]["coordinates"] == [[19.0, 58.6], [19.1, 58.6]] and feature["properties"]["coordinatesMeta"][1]["time"] == "2026-06-20T07:00:00.000Z"
    assert row.distance_m == round(legs.legs(route(spark, HOME, AWAY)).agg(F.sum("leg_nm")).first()[0] * 1852)
    shape = json.loads(geojson.polygons_geojson(edges(spark, ring(square(1.0, 3.0)))).first().feature)["geometry"]
    assert shape["coordinates"][0][0] == shape["coordinates"][0][-1] and len(shape["coordinates"][0]) == 5
    text = json.dumps({"type": "Feature", "geometry": shape})
    back = geojson.region_rings(spark.createDataFrame([("r", text)], "region_id string, feature string"))
    assert back.count() == 4 and [r.id for r in spatial.points_in_regions(at(spark, (2.0, 2.0, 0), (5.0, 5.0, 0)), back).collect()] == [0]
