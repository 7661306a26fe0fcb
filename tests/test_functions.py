import math

import pytest
from pyspark.sql import functions as F

from passagekit.functions import geo, polar, solar, units
from passagekit.functions.numbers import half_up

HOUR = 3_600_000


def value(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def lits(*xs):
    return [F.lit(float(x)) for x in xs]


def test_distance_and_bearing(spark):
    zero, far, degree = value(spark, geo.distance_nm(*lits(51, 4, 51, 4)), geo.distance_nm(*lits(51.5, -0.12, 48.85, 2.35)), geo.distance_nm(*lits(50, 10, 51, 10)))
    assert zero == 0 and 183 < far < 187 and abs(degree - 60) < 0.5
    courses = value(spark, *[geo.bearing(*lits(50, 10, *to)) for to in ((51, 10), (50, 11), (49, 10), (50, 9))])
    assert all(abs(a - b) < 1 for a, b in zip(courses, (0, 90, 180, 270)))


def test_destination(spark):
    lat, lon = value(spark, *geo.destination(*lits(50, 10, 60, 0)))
    assert abs(lat - 51) < 0.01 and abs(lon - 10) < 0.01
    lat, lon = geo.destination(*lits(48, 2, 100, 45))
    assert abs(value(spark, geo.distance_nm(F.lit(48.0), F.lit(2.0), lat, lon)) - 100) < 0.01
    same = geo.destination_prepared(*lits(48, 2, 100), F.sin(F.radians(F.lit(45.0))), F.cos(F.radians(F.lit(45.0))))
    assert value(spark, *same) == value(spark, lat, lon)


def test_wind(spark):
    assert value(spark, geo.wind_speed_kn(*lits(1, 0)), geo.wind_speed_kn(*lits(3, 4))) == (1.94384, pytest.approx(9.7192))
    assert value(spark, *[geo.wind_from(*lits(*x)) for x in ((0, -5), (0, 5), (5, 0))]) == (0, 180, pytest.approx(270))
    assert value(spark, *[geo.true_wind_angle(*lits(*x)) for x in ((10, 350), (350, 10), (90, 270))]) == (20, 20, 180)
    sail, motor = F.lit("sail"), F.lit("motor")
    sides = [geo.sailing_side(p, *lits(w, h)) for p, w, h in ((sail, 60, 10), (sail, 10, 60), (sail, 10.2, 10), (sail, 190, 10), (motor, 60, 10))]
    assert value(spark, *sides) == (1, -1, None, None, None)


TABLE = polar.Polar((10.0, 20.0), (30.0, 90.0, 180.0), ((3.0, 5.0), (5.0, 10.0), (3.0, 6.0)))


@pytest.mark.parametrize(
    "twa,tws,want",
    [(90, 10, 5), (90, 20, 10), (90, 15, 7.5), (135, 10, 4), (135, 15, 6), (0, 15, 0), (15, 15, 0), (30, 10, 3), (90, 40, 10), (200, 10, 3), (90, 5, 2.5), (90, 2.5, 1.25), (90, 0, 0), (-90, 10, 5)],
)
def test_boat_speed(spark, twa, tws, want):
    assert polar.with_boat_speed(spark.range(1), TABLE, *lits(twa, tws)).first().boat_speed == pytest.approx(want)


def test_polar_import(spark):
    table = polar.from_si([5, 10], [math.pi / 4, math.pi / 2], [[2, 3], [4, 5]], 0.9)
    assert table.tws == pytest.approx((9.719, 19.438), abs=1e-3) and table.twa == pytest.approx((45, 90))
    assert table.speeds[0] == pytest.approx((3.499, 6.998), abs=1e-3) and table.speeds[1] == pytest.approx((5.248, 8.747), abs=1e-3)
    raw = spark.createDataFrame([("a", 0.9, [5.0, 10.0], [math.pi / 4, math.pi / 2], [[2.0, 3.0], [4.0, 5.0]])], "polar_id string, adjustment double, tws_ms array<double>, twa_rad array<double>, matrix array<array<double>>")
    cells = {(round(r.twa), round(r.tws, 2)): round(r.speed, 3) for r in polar.normalise(raw).collect()}
    assert cells == {(45, 9.72): 3.499, (90, 9.72): 5.248, (45, 19.44): 6.998, (90, 19.44): 8.747}
    for bad in (((2.0, 1.0), (30.0,), ((1.0, 1.0),)), ((1.0,), (30.0,), ((1.0, 2.0),))):
        with pytest.raises(ValueError):
            polar.Polar(*bad)


def test_sun(spark):
    noon = 1_782_043_200_000  # 2026-06-21 12:00
    high, low = value(spark, solar.elevation(F.lit(noon), *lits(51.5, 0)), solar.elevation(F.lit(noon - 12 * HOUR), *lits(51.5, 0)))
    assert high > 50 and low < 0
    leg = lambda a, b: solar.leg_in_daylight(F.lit(noon + a * HOUR), F.lit(noon + b * HOUR), *lits(51.5, 0, 51.5, 0))
    assert value(spark, leg(-2, 0), leg(8, 11)) == (True, False)


def test_units(spark):
    apply = lambda f, v: units.apply_formula(F.lit(f), F.lit(float(v)))
    got = value(spark, apply("value * 3.6", 10), apply("value / 0.514444", 0.514444), apply("value + 273.15", 0), apply("value ^ 2", 5))
    assert got == (36, 1, 273.15, 5)
    mph = units.Preference("value * 2.236936", "value / 2.236936", "mph", "0.0")
    assert value(spark, units.to_display(F.lit(1.0), "speed", mph)) == pytest.approx(1.151, abs=1e-3)
    assert value(spark, units.formatted(F.lit(10.0), "speed"), units.formatted(F.lit(3.0), "depth"), units.formatted(F.lit(1.0), "speed", None, True)) == ("10.0 kn", "3.0 m", "0.51 m/s")
    assert value(spark, units.from_display(F.lit(1.0), "speed", None, True)) == 1.94384


def test_half_up(spark):
    assert value(spark, half_up(F.lit(-2.5)), half_up(F.lit(2.5)), half_up(F.lit(0.125), 2)) == (-2, 3, 0.13)
