"""Legs of routes: each point beside the one before it, and sums over a passage's days.

Points: (route_id, seq, t_ms, lat, lon, heading, tws, wind_from, wave, speed,
propulsion, ...), ordered by seq.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from passagekit.functions.geo import angle_between, bearing, distance_nm, sailing_side, true_wind_angle
from passagekit.functions.solar import DAY_MS, leg_in_daylight

HOUR_MS = 3_600_000.0
#: Fixed value: a maneuver's headway that is no headway.
LOW_HEADWAY_NM = 0.5
#: Fixed value: degrees in both directions below which a leg's course is what rounding leaves of it.
NO_LENGTH = 1e-9


def by_route() -> WindowSpec:
    return W.partitionBy("route_id").orderBy("seq")


def up_to_here() -> WindowSpec:
    return by_route().rowsBetween(W.unboundedPreceding, 0)


def legs(points: DataFrame) -> DataFrame:
    """Points with p_ columns of the previous one, leg_nm, elapsed_ms, and underway; the first has nulls."""
    kept = [c for c in ("lat", "lon", "t_ms", "wind_from", "tws") if c in points.columns]
    rows = points.select("*", *[F.lag(c).over(by_route()).alias(f"p_{c}") for c in kept])
    rows = rows.withColumn("leg_nm", distance_nm(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")))
    rows = rows.withColumn("elapsed_ms", F.col("t_ms") - F.col("p_t_ms"))
    moving = (F.col("elapsed_ms") > 0) & (F.col("leg_nm") > 0.01) & (F.coalesce("speed", F.lit(0.0)) > 0)
    return rows.withColumn("underway", F.coalesce(moving, F.lit(False)))


def _course_of_rounding(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """``bearing`` by the C library's functions, where the places are not null: the JVM's differ from them in a last bit, which there is all."""

    def courses(*places: pd.Series) -> pd.Series:
        def one(a, b, c, d):
            p, q, turn = math.radians(a), math.radians(c), math.radians(d - b)
            return (math.degrees(math.atan2(math.sin(turn) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(turn))) + 360.0) % 360.0

        found = pd.concat(places, axis=1).dropna()
        return pd.Series([one(*x) for x in found.itertuples(index=False)], found.index, float).reindex(places[0].index)

    return F.pandas_udf(courses, "double")(lat1, lon1, lat2, lon2)


def kinematics(points: DataFrame) -> DataFrame:
    """(route_id, seq, leg_nm, course, twa, wind_shift) of every leg."""
    rows = legs(points).filter("p_lat is not null")
    still = (F.abs(F.col("lat") - F.col("p_lat")) < NO_LENGTH) & (F.abs(F.col("lon") - F.col("p_lon")) < NO_LENGTH)
    course = F.when(still, _course_of_rounding(*[F.when(still, F.col(x)) for x in ("p_lat", "p_lon", "lat", "lon")])).otherwise(bearing(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")))
    return rows.select(
        "route_id",
        "seq",
        "leg_nm",
        course.alias("course"),
        true_wind_angle(F.col("heading"), F.col("wind_from")).alias("twa"),
        angle_between(F.col("wind_from"), F.col("p_wind_from")).alias("wind_shift"),
    )


def time_weighted(points: DataFrame, value: str) -> DataFrame:
    """(route_id, seq, value, weight): half of both legs' hours beside each finite value."""
    before = F.greatest(F.lit(0), F.coalesce(F.col("t_ms") - F.lag("t_ms").over(by_route()), F.lit(0)))
    after = F.greatest(F.lit(0), F.coalesce(F.lead("t_ms").over(by_route()) - F.col("t_ms"), F.lit(0)))
    rows = points.select("route_id", "seq", F.col(value).alias("value"), ((before + after) / (2 * HOUR_MS)).alias("weight"))
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def weighted_stats(samples: DataFrame, share: float = 0.95) -> DataFrame:
    """(route_id, mean, percentile, maximum) of weighted samples; no weight: null mean and percentile.

    The percentile is the first value at which the running weight reaches its
    share of the whole; weights of zero are left out of it.
    """
    whole = samples.groupBy("route_id").agg(
        F.try_divide(F.sum(F.col("value") * F.col("weight")), F.sum("weight")).alias("mean"), F.max("value").alias("maximum")
    )
    some = samples.filter("weight > 0")
    order = W.partitionBy("route_id").orderBy("value", "seq")
    run = some.withColumn("run", F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, 0)))
    run = run.withColumn("all", F.sum("weight").over(W.partitionBy("route_id")))
    reached = run.filter(F.col("run") >= F.col("all") * share).groupBy("route_id").agg(F.min("value").alias("percentile"))
    return whole.join(reached, "route_id", "left").select("route_id", "mean", "percentile", "maximum")


def day_chunks(points: DataFrame) -> DataFrame:
    """(route_id, seq, day, hours): underway legs divided at every 24 hours after departure."""
    rows = legs(points).withColumn("departure_ms", F.first("t_ms").over(by_route())).filter("underway")
    day = lambda t: F.greatest(F.lit(0).cast("long"), F.floor((F.col(t) - F.col("departure_ms")) / DAY_MS))
    last = F.greatest(day("p_t_ms"), F.ceil((F.col("t_ms") - F.col("departure_ms")) / DAY_MS) - 1)
    rows = rows.withColumn("day", F.explode(F.sequence(day("p_t_ms"), last)))
    start = F.greatest(F.col("p_t_ms"), F.col("departure_ms") + F.col("day") * DAY_MS)
    end = F.least(F.col("t_ms"), F.col("departure_ms") + (F.col("day") + 1) * DAY_MS)
    return rows.select("route_id", "seq", "day", ((end - start) / HOUR_MS).alias("hours")).filter("hours > 0")


def rested(start: Column, end: Column, departure: Column, day: Column, used: Column) -> tuple[Column, Column]:
    """(day, used) after a time without way: hours used so far hold until the next 24 hours from departure begin."""
    first = _day_of(start, departure)
    return _day_of(end, departure), F.when((day == first) & (end < departure + (first + 1) * DAY_MS), used).otherwise(0.0)


def underway(start: Column, end: Column, departure: Column, day: Column, used: Column, most: float) -> tuple[Column, Column, Column]:
    """(allowed, day, used) of a leg after ``used`` hours of ``day``: its hours are divided at every 24 hours from departure.

    Allowed: no day's hours exceed ``most`` (0: any).
    """
    first = _day_of(start, departure)
    border = departure + (first + 1) * DAY_MS
    own = F.when(day == first, used).otherwise(0.0) + F.greatest(F.lit(0), F.least(end, border) - start) / HOUR_MS
    beyond = F.greatest(F.lit(0), end - border)
    rest, whole = F.pmod(beyond, F.lit(DAY_MS)) / HOUR_MS, F.when(beyond >= DAY_MS, 24.0).otherwise(0.0)
    allowed = F.lit(True) if most <= 0 else F.greatest(own, rest, whole) <= most + 1e-9
    return allowed, _day_of(end, departure), F.when(end < border, own).otherwise(rest)


def _day_of(time: Column, departure: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((time - departure) / DAY_MS)).cast("int")


def day_budget(points: DataFrame, max_hours: float) -> DataFrame:
    """(route_id, day, hours, first_excess): hours underway of each day, and the leg that first exceeds the limit (0: none)."""
    order = W.partitionBy("route_id", "day").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    run = day_chunks(points).withColumn("run", F.sum("hours").over(order))
    over = F.when((F.lit(max_hours) > 0) & (F.col("run") > max_hours + 1e-9), F.col("seq"))
    return run.groupBy("route_id", "day").agg(F.sum("hours").alias("hours"), F.min(over).alias("first_excess"))


def daylight(points: DataFrame) -> DataFrame:
    """(route_id, seq, in_daylight) of underway legs."""
    rows = legs(points).filter("underway")
    light = leg_in_daylight(F.col("p_t_ms"), F.col("t_ms"), F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    return rows.select("route_id", "seq", light.alias("in_daylight"))


def maneuvers(points: DataFrame, end_lat: Column | None = None, end_lon: Column | None = None) -> DataFrame:
    """(route_id, seq, headway_nm): points where the wind changes side, and the gain since the maneuver before.

    A waiting point keeps the side; any other point without a side forgets it
    and the last maneuver.  The route's last point is the destination unless
    one is given.
    """
    whole = W.partitionBy("route_id")
    last = lambda c: F.max_by(c, "seq").over(whole)
    rows = points.select(
        "route_id", "seq", "lat", "lon",
        sailing_side(F.col("propulsion"), F.col("wind_from"), F.col("heading")).alias("side"),
        F.coalesce(F.col("propulsion") == "wait", F.lit(False)).alias("waits"),
        (end_lat if end_lat is not None else last("lat")).alias("end_lat"), (end_lon if end_lon is not None else last("lon")).alias("end_lon"),
        F.min_by("lat", "seq").over(whole).alias("first_lat"), F.min_by("lon", "seq").over(whole).alias("first_lon"),
        F.min("seq").over(whole).alias("first_seq"),
    )
    rows = rows.filter(F.col("seq") > F.col("first_seq"))
    forgets = F.col("side").isNull() & ~F.col("waits")
    rows = rows.withColumn("stretch", F.sum(forgets.cast("int")).over(up_to_here()))
    inside = W.partitionBy("route_id", "stretch").orderBy("seq")
    before = F.last("side", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1))
    turned = rows.withColumn("before", before).filter(F.col("side").isNotNull() & F.col("before").isNotNull() & (F.col("side") != F.col("before")))
    to_go = lambda lat, lon: distance_nm(lat, lon, F.col("end_lat"), F.col("end_lon"))
    from_lat, from_lon = (F.coalesce(F.lag(c).over(inside), f"first_{c}") for c in ("lat", "lon"))
    return turned.select("route_id", "seq", (to_go(from_lat, from_lon) - to_go(F.col("lat"), F.col("lon"))).alias("headway_nm"))


def clearance_state(points: DataFrame) -> DataFrame:
    """(route_id, seq, cleared): whether open water has been reached before or at each point; explicit flags override."""
    return points.select("route_id", "seq", F.coalesce(F.last("cleared", ignorenulls=True).over(up_to_here()), F.lit(False)).alias("cleared"))
