"""The search's constraints against plain searches on small grids of courses."""

import dataclasses
import math

import pytest
from pyspark.sql import functions as F

from passagekit.functions.polar import Polar
from passagekit.operators import legs, search, spatial
from passagekit.operators.isochrone import Options

LINE = "request_id long, start_lat double, start_lon double, end_lat double, end_lon double, departure_ms long"
HOUR = 3_600_000
STEADY = Polar((5.0, 20.0), (40.0, 180.0), ((6.0, 6.0), (6.0, 6.0)))
COARSE = Options(heading_step=45.0, sector_size=45.0)


def windy(**columns):
    fixed = {"u": 5.0, "v": 0.0} | columns
    return lambda rows, step: rows.withColumns({n: F.lit(x) for n, x in fixed.items()})


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), LINE)


def plain_budget(start, end, departure, day, used, most):
    """(allowed, day, used) hour by hour of time, in small pieces."""
    piece, now = 60_000, start
    current = max(0, (start - departure) // (24 * HOUR))
    used, worst = (used if day == current else 0.0), 0.0
    while now < end:
        used += piece / HOUR
        now += piece
        worst = max(worst, used)
        if (now - departure) % (24 * HOUR) == 0:
            used = 0.0
    return most <= 0 or worst <= most + 1e-9, max(0, (end - departure) // (24 * HOUR)), used


def test_hours_of_a_day_against_small_pieces(spark):
    cases = [(s * HOUR, (s + n) * HOUR, 0, d, u) for s in (0, 5, 20, 23, 24, 30) for n in (0, 1, 4, 24, 30, 60) for d in (0, 1) for u in (0.0, 3.0, 7.5)]
    frame = spark.createDataFrame(cases, "a long, b long, dep long, day int, used double")
    ok, day, used = legs.underway(F.col("a"), F.col("b"), F.col("dep"), F.col("day"), F.col("used"), 8.0)
    rest = legs.rested(F.col("a"), F.col("b"), F.col("dep"), F.col("day"), F.col("used"))
    for r in frame.select("*", ok.alias("ok"), day.alias("d1"), used.alias("u1"), rest[0].alias("rd"), rest[1].alias("ru")).collect():
        want = plain_budget(r.a, r.b, r.dep, r.day, r.used, 8.0)
        assert (r.ok, r.d1) == want[:2] and (r.u1 == pytest.approx(want[2], abs=1e-9)), r
        same_day = r.day == r.a // (24 * HOUR) and r.b < (r.a // (24 * HOUR) + 1) * 24 * HOUR
        assert (r.rd, r.ru) == (r.b // (24 * HOUR), r.used if same_day else 0.0)


def test_a_day_budget_stops_the_boat_until_the_next_day(spark):
    # a passage under way for 20 hours, one of them used today: an hour is left of two
    far = asked(spark, (1, 50.0, 10.0, 50.0, 11.5, 0)).withColumn("passage_ms", F.lit(-20 * HOUR)).withColumn("day", F.lit(0)).withColumn("used", F.lit(1.0))
    nodes, ends, _ = search.search(far, windy(), STEADY, dataclasses.replace(COARSE, max_hours_per_day=2.0), 5, 1.0)
    ways = {r.step: r for r in nodes.groupBy("step").agg(F.max("used").alias("used"), F.min("propulsion").alias("low"), F.max("propulsion").alias("high"), F.max("day").alias("day")).collect()}
    assert [round(ways[k].used, 6) for k in (1, 2, 3, 4, 5)] == [2.0, 2.0, 2.0, 0.0, 1.0]
    assert all(ways[k].low == ways[k].high == ("sail" if k in (1, 5) else "wait") for k in range(1, 6)) and (ways[3].day, ways[4].day) == (0, 1)


def test_nights_are_waited_for(spark):
    evening = 1718906400000  # 2024-06-20 18:00 UTC; the sun sets after eight
    far = asked(spark, (1, 50.0, 0.0, 50.0, 3.0, evening))
    nodes, _, _ = search.search(far, windy(), STEADY, dataclasses.replace(COARSE, daylight_only=True), 4, 1.0)
    by = {k: {r.propulsion for r in nodes.filter(F.col("step") == k).select("propulsion").distinct().collect()} for k in range(1, 5)}
    assert by == {1: {"sail"}, 2: {"sail"}, 3: {"wait"}, 4: {"wait"}}


def test_a_current_shifts_every_arrival_and_waves_hold_back(spark):
    requests = asked(spark, (1, 50.0, 10.0, 50.5, 10.0, 0))
    still = {(r.parent_id, r.heading): r for r in search.search(requests, windy(), STEADY, COARSE, 1, 1.0)[0].filter("step = 1").collect()}
    drift = {(r.parent_id, r.heading): r for r in search.search(requests, windy(cu=1.0, cv=-0.5), STEADY, COARSE, 1, 1.0)[0].filter("step = 1").collect()}
    assert still.keys() == drift.keys() and len(still) > 3
    for k, r in drift.items():
        assert r.lat - still[k].lat == pytest.approx(-0.5 * 3600 / (1852 * 60)) and r.lon - still[k].lon == pytest.approx(3600 / (1852 * 60 * math.cos(math.radians(50.0))))
    calm, rough = dataclasses.replace(COARSE, max_wave_m=2.0), windy(wave=2.5)
    nodes, _, stopped = search.search(requests, rough, STEADY, calm, 1, 1.0)
    assert nodes.count() == 1 and stopped.count() == 1
    assert search.search(requests, rough, STEADY, COARSE, 1, 1.0)[0].count() > 1


def wall(spark, *sides):
    rows = [(k, 0, 0, *s, region) for k, (*s, region) in enumerate(sides)]
    return spark.createDataFrame(rows, "poly_id long, ring_id int, idx int, lat1 double, lon1 double, lat2 double, lon2 double, region boolean")


def test_a_headland_widens_the_cone_and_is_passed(spark):
    # a wall between start and destination: only a way back and around it arrives
    requests = asked(spark, (1, 50.0, 10.0, 50.0, 10.5, 0))
    land = wall(spark, (49.85, 10.2, 50.4, 10.2, False), (50.4, 10.2, 50.4, 9.9, False))
    options = Options(heading_step=15.0, sector_size=5.0, cone_deg=60.0, arrival_nm=3.0)
    nodes, ends, stopped = search.search(requests, windy(), STEADY, options, 14, 1.0, barriers=land)
    assert ends.count() == 1 and stopped.count() == 0
    path = search.backtrack(nodes, ends).orderBy("seq").collect()
    lines = spark.createDataFrame([(k, a.lat, a.lon, b.lat, b.lon) for k, (a, b) in enumerate(zip(path, path[1:]))], "id long, lat1 double, lon1 double, lat2 double, lon2 double")
    assert spatial.crossing_segments(lines, land).count() == 0
    goal = lambda **k: search.search(requests, windy(), STEADY, k.pop("options", options), 1, 1.0, barriers=k["land"])[0].filter("step = 1 and abs(heading - 90) > 60")
    assert goal(options=dataclasses.replace(options, look_ahead_nm=0.001), land=land).count() == 0
    assert goal(land=land.withColumn("region", F.lit(True))).count() == goal(land=land).count() > 0


def test_the_shore_is_kept_off_in_the_row_as_by_the_join(spark):
    import random

    from passagekit.operators.safety import clearance_allowed, clearance_in_row

    rng = random.Random(4)
    coast = wall(spark, *[(50 + rng.uniform(-0.3, 0.3), 10 + rng.uniform(-0.3, 0.3), 50 + rng.uniform(-0.3, 0.3), 10 + rng.uniform(-0.3, 0.3), False) for _ in range(6)])
    rows = [(k, *[c + rng.uniform(-0.3, 0.3) for c in (50.0, 10.0) * 4], rng.choice([True, False, None])) for k in range(200)]
    hops = spark.createDataFrame(rows, "id long, lat1 double, lon1 double, lat2 double, lon2 double, start_lat double, start_lon double, end_lat double, end_lon double, established boolean")
    want = {r.id for r in clearance_allowed(hops, coast, 3.0).filter("allowed").collect()}
    near = spatial.edges_near(hops.select("id", F.col("lat1").alias("lat"), F.col("lon1").alias("lon"), F.lit(80.0).alias("reach_nm")), coast, 80.0)
    own = hops.join(near, "id", "left").withColumnsRenamed({"lat1": "p_lat", "lon1": "p_lon", "lat2": "lat", "lon2": "lon"})
    assert {r.id for r in clearance_in_row(own, 3.0).collect()} == want and 0 < len(want) < 200


def test_several_routes_of_one_search_and_their_weather(spark):
    requests = asked(spark, (1, 50.0, 10.0, 50.0, 10.3, 0), (2, 50.0, 10.0, 50.15, 10.1, 0))
    island = wall(spark, (49.97, 10.15, 50.03, 10.15, False))
    options = Options(heading_step=15.0, sector_size=5.0, alternatives=3)
    nodes, ends, stopped = search.search(requests, windy(), STEADY, options, 12, 1.0, barriers=island)
    assert stopped.count() == 0 and ends.count() > 6 and ends.filter("first").count() == 2
    points = search.routes(nodes, ends, 3)
    places = {(r.request_id, r.place): r for r in points.groupBy("request_id", "place").agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.min("separation_nm").alias("gap")).collect()}
    assert {k for k in places} >= {(1, 0), (1, 1), (2, 0)} and all(p.n == p.last + 1 for p in places.values()) and all(p.gap is None or p.gap >= 0.25 for p in places.values())
    single = search.search(requests, windy(), STEADY, dataclasses.replace(options, alternatives=1), 12, 1.0, barriers=island)
    first = search.backtrack(single[0], single[1]).select("request_id", "seq", "lat", "lon")
    assert points.filter("place = 0").select("request_id", "seq", "lat", "lon").exceptAll(first).count() == 0
    weather = lambda spots: spots.select("id", (F.col("lat") / 10).alias("u"), F.lit(0.0).alias("v"), F.lit(1.5).alias("wave")).filter("id.seq <> 1")
    for r in search.resampled(points, weather).collect():
        assert (r.wave, r.wind_from) == ((None, None) if r.seq == 1 else (1.5, 270.0))
        assert r.seq == 1 or (r.tws == pytest.approx(r.lat / 10 * 1.94384) and (r.twa == 0.0) == (r.seq == 0 or abs(r.heading - 270) < 1e-9))


def test_cells_follow_a_line(spark):
    import random

    rng = random.Random(6)
    lines = [(k, 50 + rng.uniform(-2, 2), 10 + rng.uniform(-2, 2), 50 + rng.uniform(-2, 2), 10 + rng.uniform(-2, 2)) for k in range(60)]
    lines += [(90, 50.0, 10.0, 50.0, 12.0), (91, 50.0, 10.0, 52.0, 10.0), (92, 50.1, 10.1, 50.1, 10.1), (93, 50.0, 10.0, 52.0, 12.0)]
    got = {}
    for r in spatial._filed(spark.createDataFrame(lines, "id long, lat1 double, lon1 double, lat2 double, lon2 double")).collect():
        got.setdefault(r.id, set()).add(r.cell)
    for k, a, b, c, d in lines:
        n = 4000
        passed = {int((math.floor((a + (c - a) * t / n) / 0.1) + 900) * 3600 + math.floor((b + (d - b) * t / n) / 0.1) % 3600) for t in range(n + 1)}
        assert passed <= got[k]
        assert len(got[k]) <= 10 * (abs(c - a) + abs(d - b)) + 8 or k in (90, 91, 93)
    assert len(got[93]) <= 100
