"""Geometry on the sphere as column expressions; degrees, nautical miles, knots."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius in nm; knots in a metre a second; metres in a degree of latitude for drift.
EARTH_NM = 3440.065
KNOTS = 1.94384
METRES_PER_DEGREE = 1852.0 * 60.0
NM_PER_DEGREE = 60.0


def _wrap360(angle: Column) -> Column:
    return (angle + 360.0) % 360.0


def half_turn(delta: Column) -> Column:
    """An angle brought to [-180, 180): right while it is at least -540."""
    return (delta + 540.0) % 360.0 - 180.0


def distance_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    up, over = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * over * over
    return EARTH_NM * 2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial course in [0, 360)."""
    turn = F.radians(lon2 - lon1)
    p, q = F.radians(lat1), F.radians(lat2)
    return _wrap360(F.degrees(F.atan2(F.sin(turn) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(turn))))


def destination(lat: Column, lon: Column, nm: Column, course: Column) -> tuple[Column, Column]:
    """Where ``nm`` along ``course`` leads."""
    return destination_prepared(lat, lon, nm, F.sin(F.radians(course)), F.cos(F.radians(course)))


def destination_prepared(lat: Column, lon: Column, nm: Column, sin_course: Column, cos_course: Column) -> tuple[Column, Column]:
    """The same with the course's sine and cosine from a dimension of headings."""
    arc, p = nm / EARTH_NM, F.radians(lat)
    sin_q = F.sin(p) * F.cos(arc) + F.cos(p) * F.sin(arc) * cos_course
    turn = F.atan2(sin_course * F.sin(arc) * F.cos(p), F.cos(arc) - F.sin(p) * sin_q)
    return F.degrees(F.asin(sin_q)), half_turn(lon + F.degrees(turn))


def wind_speed_kn(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v) * KNOTS


def wind_from(u: Column, v: Column) -> Column:
    """Direction the wind comes from."""
    return _wrap360(F.degrees(F.atan2(-u, -v)))


def angle_between(a: Column, b: Column) -> Column:
    """The smaller angle between two directions, in [0, 180]."""
    turn = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.when(turn > 180.0, 360.0 - turn).otherwise(turn)


def true_wind_angle(heading: Column, from_: Column) -> Column:
    return angle_between(heading, from_)


def sailing_side(propulsion: Column, from_: Column, heading: Column) -> Column:
    """1 or -1 for the side the wind is on; null unless sailing, or within half a degree of ahead or astern."""
    side = half_turn((from_ - heading) % 360.0)
    defined = (propulsion == "sail") & (F.abs(side) >= 0.5) & (F.abs(side) <= 179.5)
    return F.when(defined, F.when(side > 0, 1).otherwise(-1))


def local_xy(lat: Column, lon: Column, at_lat: Column, at_lon: Column) -> tuple[Column, Column]:
    """Nautical miles east and north of a reference point, on a plane."""
    return half_turn(lon - at_lon) * NM_PER_DEGREE * F.cos(F.radians(at_lat)), (lat - at_lat) * NM_PER_DEGREE


def tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web-mercator tile of a place."""
    n = float(2**zoom)
    return (
        F.floor((lon + 180.0) / 360.0 * n).cast("int"),
        F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * n).cast("int"),
    )


def drifted(lat: Column, lon: Column, u: Column, v: Column, seconds: Column) -> tuple[Column, Column]:
    """A place after a current of u, v metres a second; the scale of longitude is that of the origin."""
    return lat + v * seconds / METRES_PER_DEGREE, lon + u * seconds / (METRES_PER_DEGREE * F.cos(F.radians(lat)))


def along_track_kn(u: Column, v: Column, heading: Column) -> Column:
    return (u * F.sin(F.radians(heading)) + v * F.cos(F.radians(heading))) * KNOTS


def speed_over_ground_kn(u: Column, v: Column, heading: Column, motor_kn: Column) -> Column:
    """Motor speed and the current along the track, 0.3 kn at least."""
    return F.greatest(F.lit(0.3), motor_kn + along_track_kn(u, v, heading))


def turn_cost(before: Column, after: Column, step: Column) -> Column:
    """A corridor's cost of a change of course: a fifth of a step for half a turn."""
    return F.abs(half_turn((after - before) % 360.0)) / 180.0 * step * 0.2
