import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagekit.operators import corridor, requests, safety
from passagekit.sources import grib2
from passagekit.streaming import live

from .test_operators import HOUR, T0, at, edges, ring, segs, square


def signed(value, size):
    return ((1 << (size * 8 - 1)) | -value if value < 0 else value).to_bytes(size, "big")


def bits_of(numbers, width):
    return np.packbits([int(b) for n in numbers for b in format(int(n), f"0{width}b")]).tobytes() if width else b""


def complex_packing(whole, order, decimal, missing):
    """Sections 5 and 7 of complex packing (with differences of an ``order``) of whole numbers, null for missing ones."""
    known = [v for v in whole if v is not None]
    extra, numbers = b"", whole
    if order:
        steps = np.diff(known, order).tolist()
        least = min(steps, default=0)
        extra = b"".join(signed(v, 4) for v in [*known[:order], least])
        rest = iter([0] * order + [s - least for s in steps])
        numbers = [None if v is None else next(rest) for v in whole]
    lengths = [min(5, len(numbers) - at) for at in range(0, len(numbers), 5)]
    groups = [numbers[k * 5 : k * 5 + n] for k, n in enumerate(lengths)]
    base = [min((v for v in g if v is not None), default=None) for g in groups]
    widths = [0 if b is None else max(max(v - b for v in g if v is not None) + 1 + bool(missing), 1).bit_length() if len(set(g)) > 1 else 0 for g, b in zip(groups, base)]
    bits = 24
    stream = "".join(format((1 << w) - 1 if v is None else v - b, f"0{w}b") for g, b, w in zip(groups, base, widths) if w for v in g)
    body = extra + bits_of([(1 << bits) - 1 if b is None else b for b in base], bits) + bits_of(widths, 6) + bits_of([0] * len(groups), 1)
    body += np.packbits([int(c) for c in stream]).tobytes()
    head = struct.pack(">IHf", len(whole), 3 if order else 2, 0.0) + signed(0, 2) + signed(decimal, 2) + struct.pack(">BBBB", bits, 0, 1, int(missing))
    head += bytes(8) + struct.pack(">IBBIBIB", len(groups), 0, 6, 5, 1, lengths[-1], 1) + (struct.pack(">BB", order, 4) if order else b"")
    return head, body


def message(discipline, category, number, hours, values, bits=12, decimal=1, missing=(), complex_=None, level=10, kind=0):
    """A GRIB2 message of a regular grid, rows from north to south, with simple packing, or complex packing with differences of an order."""
    rows = np.asarray(values, float)[::-1]
    n_lat, n_lon = rows.shape
    there = np.array([i not in missing for i in range(rows.size)])
    flat = rows.ravel()[there] * 10**decimal
    base = float(np.float32(flat.min()))
    packed = np.rint(flat - base).astype(int)
    body = np.packbits([int(b) for p in packed for b in format(p, f"0{bits}b")]).tobytes()
    section = lambda n, data: struct.pack(">IB", len(data) + 5, n) + data
    one = section(1, struct.pack(">HHBBBHBBBBBBB", 7, 0, 2, 1, 1, 2026, 6, 20, 0, 0, 0, 0, 1))
    lat = lambda x: signed(round(x * 1e6), 4)
    grid = struct.pack(">BIBBH", 0, rows.size, 0, 0, 0) + bytes(16) + struct.pack(">II", n_lon, n_lat) + bytes(8)
    grid += lat(40.0 + (n_lat - 1) * 0.5) + lat(350.0) + bytes(1) + lat(40.0) + lat(350.0 + (n_lon - 1) * 0.5) + struct.pack(">IIB", 500_000, 500_000, 0)
    product = struct.pack(">HHBBBBBHBBIBBIBBI", 0, 0, category, number, 2, 0, 0, 0, 0, 1, hours, 103, 0, level, 255, 0, 0)
    packing = struct.pack(">IHf", len(flat), 0, base) + signed(0, 2) + signed(decimal, 2) + struct.pack(">BB", bits, 0)
    bitmap = bytes([0]) + np.packbits(there).tobytes() if missing else bytes([255])
    if complex_ is not None:
        whole = [None if i in missing else int(np.rint(v * 10**decimal)) for i, v in enumerate(rows.ravel())]
        shift = min(v for v in whole if v is not None)
        packing, body = complex_packing([None if v is None else v - (shift if not complex_ else 0) for v in whole], complex_, decimal, bool(missing))
        packing = packing[:6] + struct.pack(">f", shift if not complex_ else 0.0) + packing[10:]
        bitmap = bytes([255])
    if kind:
        grid = grid[:7] + struct.pack(">H", kind) + grid[9:]
    parts = one + section(3, grid) + section(4, product) + section(5, packing) + section(6, bitmap) + section(7, body)
    return b"GRIB" + bytes(2) + bytes([discipline, 2]) + struct.pack(">Q", len(parts) + 20) + parts + b"7777"


@pytest.fixture()
def folder(tmp_path):
    u, v = [[1.0, 2.0, 3.0], [-4.5, 5.0, 6.0]], [[0.5, 0.0, -1.0], [2.0, 2.5, 3.0]]
    wind = b"junk" + b"".join(message(0, 2, n, h, x) for h in (3, 0) for n, x in ((2, u), (3, v))) + message(0, 2, 2, 6, u) + message(10, 0, 3, 0, [[1.0, 2.0, 0.5]] * 2, missing=(1,))
    (tmp_path / "a.grib2").write_bytes(wind)
    (tmp_path / "b.GRB").write_bytes(b"".join(message(10, 1, n, 0, [[0.5, 9999.0, 0.1]] * 2, bits=20) for n in (2, 3)))
    (tmp_path / "c.txt").write_bytes(wind)
    (tmp_path / "d.grib").write_bytes(b"GRIB")
    return str(tmp_path)


def test_grib2(spark, folder):
    found = grib2.read_messages(spark, folder).cache()
    assert found.count() == 8
    files = {r.path.rsplit("/", 1)[1]: r for r in grib2.file_table(found).collect()}
    a, b = files["a.grib2"], files["b.GRB"]
    assert set(files) == {"a.grib2", "b.GRB"} and (a.type, b.type, a.has_wave, b.has_wave) == ("wind", "current", True, False)
    assert (a.reference_ms, a.start_ms, a.end_ms, a.n_times) == (T0, T0, T0 + 6 * HOUR, 3)
    assert (a.lat_min, a.lat_max, a.lon_min, a.lon_max, a.lat_step, a.lon_step) == (40.0, 40.5, -10.0, -9.0, 0.5, 0.5)
    pairs = grib2.frames(found).orderBy("frame").collect()
    assert [(r.frame, r.valid_ms) for r in pairs] == [(0, T0), (1, T0 + 3 * HOUR)]  # the unpaired third time is left out
    assert pairs[0].u == pytest.approx([1, 2, 3, -4.5, 5, 6], abs=0.06) and pairs[0].v[3] == pytest.approx(2, abs=0.06)
    current = grib2.frames(found, "current").first()
    assert current.u == pytest.approx([0.5, 0, 0.1] * 2, abs=0.06)
    wave = found.filter("field = 'wave'").first()["values"]
    assert np.isnan(wave[4]) and wave[0] == pytest.approx(1, abs=0.06)
    cells = {(r.i, r.j): r.u for r in grib2.cells(grib2.frames(found), grib2.file_table(found)).filter("frame = 0").collect()}
    assert cells[1, 0] == pytest.approx(-4.5, abs=0.06) and len(cells) == 6


@pytest.mark.parametrize("order", [0, 1, 2])
@pytest.mark.parametrize("missing", [(), (3, 4, 17)])
def test_complex_packing_comes_back_exactly(order, missing):
    rng = np.random.default_rng(order)
    values = np.round(np.cumsum(rng.normal(size=(7, 9)), axis=1) * 3, 1)
    ((discipline, sections),) = grib2.messages(message(0, 2, 2, 3, values, missing=missing, complex_=order))
    got = grib2.decode(discipline, sections)["values"].reshape(7, 9)[::-1].ravel()
    want = values[::-1].ravel().astype(np.float32)
    assert all(np.isnan(g) if i in missing else g == pytest.approx(w, abs=1e-4) for i, (g, w) in enumerate(zip(got, want)))


def test_messages_that_cannot_be_read_say_why(spark, tmp_path):
    u = [[1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "x.Grib2").write_bytes(message(0, 2, 2, 0, u) + message(0, 2, 3, 0, u, level=80) + message(0, 2, 2, 3, u, kind=30) + message(0, 0, 0, 0, u) + message(10, 0, 3, 0, u))
    found = grib2.read_messages(spark, str(tmp_path))
    assert sorted((r.message, r.field, r.reason) for r in found.collect()) == [(0, "wind_u", None), (1, "wind_v", "level 103: 80"), (2, "wind_u", "grid 30"), (4, "wave", None)]
    assert grib2.file_table(found).first().n_times == 1 and grib2.frames(found).count() == 0
    wave = grib2.cells(grib2.frames(found, "wave"), grib2.wave_table(found)).collect()
    assert {(r.i, r.j): round(r.wave) for r in wave} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}


def streamed(spark, frames, tmp_path, job, mode="append"):
    """Rows of a stream that is given ``frames`` one after another, each processed before the next is there."""
    folder = str(tmp_path / "in")
    frames[0].limit(0).write.parquet(folder)
    name = f"live_{abs(hash(str(tmp_path)))}"
    source = spark.readStream.schema(frames[0].schema).parquet(folder)
    query = job(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).start()
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_live_conditions(spark, tmp_path):
    rows = [(1, T0 + i * HOUR // 2, float(i)) for i in range(10)] + [(1, T0 + 40 * HOUR, 5.0)]
    frame = spark.createDataFrame(rows, "route_id long, t_ms long, tws double").withColumn("ts", F.timestamp_millis("t_ms"))
    got = sorted(streamed(spark, [frame.filter(F.col("t_ms") < T0 + 20 * HOUR), frame.filter(F.col("t_ms") >= T0 + 20 * HOUR)], tmp_path, lambda s: live.conditions(s)), key=lambda r: r.start)
    assert [(r.n, r.wind_avg, r.wind_max) for r in got] == [(2, 0.5, 1), (2, 2.5, 3), (2, 4.5, 5), (2, 6.5, 7), (2, 8.5, 9)]


def test_live_sessions(spark, tmp_path):
    rows = [(1, T0 + h * HOUR) for h in (0, 1, 2, 20, 21, 80)]
    frame = spark.createDataFrame(rows, "route_id long, t_ms long").withColumn("ts", F.timestamp_millis("t_ms"))
    parts = [frame.filter(F.col("t_ms").between(T0 + a * HOUR, T0 + b * HOUR)) for a, b in ((0, 2), (20, 21), (80, 80))]
    assert sorted(r.n for r in streamed(spark, parts, tmp_path, live.passages)) == [2, 3]


def test_live_budget(spark, tmp_path):
    rows = [(7, T0, 5.0), (7, T0 + 5 * HOUR, 5.0), (7, T0 + 23 * HOUR, 0.0), (7, T0 + 26 * HOUR, 5.0)]
    frame = spark.createDataFrame(rows, "route_id long, t_ms long, speed double").coalesce(1)
    got = streamed(spark, [frame], tmp_path, lambda s: live.day_budget(s, 4.0))
    assert [(r.day, r.hours_today, r.allowed) for r in sorted(got, key=lambda r: (r.t_ms, r.day))] == [(0, 0, True), (0, 5, False), (0, 5, False), (0, 6, False), (1, 2, True)]


def test_silent_route_closes_its_day(spark, tmp_path):
    """A route without fixes for two days gets a closing row and begins anew; old fixes are counted and change nothing."""
    shape = "route_id long, t_ms long, speed double"
    day = [(7, T0, 5.0), (7, T0 + 5 * HOUR, 5.0), (8, T0, 5.0), (8, None, 5.0)]
    second = [(7, T0 + 4 * HOUR, 5.0), (7, T0 + 6 * HOUR, 5.0), (8, T0 + 80 * HOUR, 0.0)]
    frames = [spark.createDataFrame(x, shape).coalesce(1) for x in (day, second, [(8, T0 + 81 * HOUR, 0.0)], [(7, T0 + 82 * HOUR, 5.0), (7, T0 + 83 * HOUR, 5.0)])]
    got = sorted(streamed(spark, frames, tmp_path, lambda s: live.day_budget(s, 5.5, quiet_hours=48.0)), key=lambda r: (r.route_id, r.t_ms, r.closed))
    seven = [(round((r.t_ms - T0) / HOUR), r.day, r.hours_today, r.allowed, r.closed, r.late) for r in got if r.route_id == 7]
    assert seven == [(0, 0, 0, True, False, 0), (5, 0, 5, True, False, 0), (6, 0, 6, False, False, 1), (6, 0, 6, False, True, 1), (82, 0, 0, True, False, 0), (83, 0, 1, True, False, 0)]
    assert not any(r.closed for r in got if r.route_id == 8)


def test_corridor_goes_round_land(spark):
    wall = edges(spark, ring([(10.1, 49.93), (10.12, 49.93), (10.12, 50.07), (10.1, 50.07)]))
    line = "request_id long, start_lat double, start_lon double, end_lat double, end_lon double"
    path = corridor.corridors(spark.createDataFrame([(1, 50.0, 10.0, 50.0, 10.2)], line), wall).orderBy("seq").collect()
    assert (path[0].lat, path[0].lon) == (50, 10) and (path[-1].lat, path[-1].lon) == (50, 10.2)
    assert max(abs(p.lat - 50) for p in path) > 0.05
    hops = segs(spark, *[(a.lat, a.lon, b.lat, b.lon) for a, b in zip(path, path[1:])])
    assert __import__("passagekit.operators.spatial", fromlist=["x"]).crossing_segments(hops, wall).count() == 0
    direct = 7.72
    assert direct * 1.05 < path[-1].cost_nm < direct * 2.25 + 10
    boxed = edges(spark, ring([(9.9, 49.9), (10.1, 49.9), (10.1, 50.1), (9.9, 50.1)]))
    none = corridor.corridors(spark.createDataFrame([(1, 50.0, 10.0, 50.0, 10.2)], line), boxed).collect()
    assert [r.seq for r in none] == [None] and none[0].problem


def test_hand_offs(spark):
    rows = [(0, i, float(r), i >= 1) for i, r in enumerate((0, 1, 3, 26, 27, 28, 60))]
    got = corridor.hand_offs(spark.createDataFrame(rows, "route_id long, seq int, run_nm double, cleared boolean")).collect()
    assert sorted((r.seq, r.after_nm) for r in got) == [(3, 5.0), (4, 10.0), (5, 20.0)]


@pytest.mark.parametrize(
    "start,state,segment,want",
    [
        ((0.5, 1.001), None, (0.5, 1.001, 0.5, 1.005), True),
        ((0.5, 1.001), None, (0.5, 1.001, 0.5, 1.01), True),
        ((0.5, 1.001), None, (0.51, 1.001, 0.52, 1.001), False),
        ((0.5, 1.0001), False, (0.5, 1.0001, 0.5, 1.002), True),
        ((0.5, 1.0001), False, (0.5, 1.002, 0.5, 1.01), True),
        ((0.5, 1.0001), True, (0.5, 1.01, 0.5, 1.002), False),
    ],
)
def test_endpoint_allowance(spark, start, state, segment, want):
    coast = edges(spark, ring([(0.0, 0.0), (1.0, 0.0), (1.0, 2.0), (0.0, 2.0)]))
    rows = segs(spark, segment).withColumns({"start_lat": F.lit(start[0]), "start_lon": F.lit(start[1]), "end_lat": F.lit(5.0), "end_lon": F.lit(5.0), "established": F.lit(state).cast("boolean")})
    assert safety.clearance_allowed(rows, coast, 0.5).first().allowed is want


def test_missing_data_never_passes(spark):
    far = segs(spark, (40.0, 40.0, 40.1, 40.1)).withColumns({c: F.lit(0.0) for c in ("start_lat", "start_lon", "end_lat", "end_lon")}).withColumn("established", F.lit(True))
    coast = edges(spark, ring(square(1.0, 3.0)))
    assert safety.violations(far, coast, None, minimum_depth_m=2.0).first().violation == "depth-unavailable"
    assert safety.violations(far, coast, None, maximum_offshore_nm=5.0).first().violation == "too-far-offshore"
    assert safety.violations(far, coast, None, minimum_shore_nm=5.0).first().violation is None


def test_requests(spark):
    base = dict(start_lat=0.0, start_lon=0.0, end_lat=-5.0, end_lon=-7.0, departure="2026-06-20T10:00:00Z", max_hours_per_day=8.0, **{k: 0.0 for k in requests.BOUNDS}, objective="fastest", alternative_count=5.0)
    cases = [{}, dict(start_lat=None), dict(departure=""), dict(departure="soon"), dict(max_hours_per_day=25.0), dict(minimum_depth_m=-1.0), dict(objective="quick"), dict(alternative_count=0.0), dict(alternative_count=1.5), dict(objective="allMotoring")]
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in base.items())
    frame = spark.createDataFrame([tuple((base | c).values()) for c in cases], kinds)
    got = [r[0] for r in frame.select(requests.validation_error()).collect()]
    assert got[0] is None and all(got[1:])
    names = spark.createDataFrame([("a.grib2",), ("../x/B.GRB",), ("a.txt",), (".grib",), (None,)], "n string").select(requests.safe_file_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["a.grib2", "B.GRB", None, None, None]
    assert at(spark, (0.0, 0.0, 0)).count() == 1
