"""Alternatives of a request: planning attempts, distinct geometries, ranking by objective, and spread.

Alternatives: (request_id, attempt, geometry, complete, warning_count,
duration_hours, distance_nm, motor_hours, wave_avg, wave_p95, wind_avg,
wind_p95, maneuvers, low_headway).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagekit.functions.geo import distance_nm
from passagekit.operators.scratch import written

OBJECTIVES = ("fastest", "leastMotoring", "allMotoring", "bestWeather")
#: Hours a maneuver and a maneuver without headway cost in the ranking; the most attempts.
MANEUVER_HOURS, LOW_HEADWAY_HOURS, MOST_ATTEMPTS = 0.05, 0.25, 20


def plan_attempts(requests: DataFrame) -> DataFrame:
    """(request_id, attempt, heading_offset, force_motor, wait_for_wind, motor_below_off) of requests.

    Requests: (request_id, objective, wanted, shared, heading_step).  A shared
    search of several routes is one attempt, a single route one, and else
    there are two for each route wanted, 20 at most.
    """
    n = F.when((F.col("shared") & (F.col("wanted") > 1)) | (F.col("wanted") == 1), 1).otherwise(F.least(F.lit(MOST_ATTEMPTS), F.col("wanted") * 2))
    rows = requests.select("*", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("attempt"))
    slots = F.greatest(F.col("wanted") * 2, F.lit(1))
    return rows.select(
        "request_id",
        "attempt",
        (F.col("attempt") * F.col("heading_step") / slots).alias("heading_offset"),
        (F.col("objective") == "allMotoring").alias("force_motor"),
        (F.col("objective") == "leastMotoring").alias("wait_for_wind"),
        F.col("objective").isin("allMotoring", "leastMotoring").alias("motor_below_off"),
    )


def distinct_geometry(alternatives: DataFrame) -> DataFrame:
    """The first attempt of each geometry of a request."""
    first = W.partitionBy("request_id", "geometry").orderBy("attempt")
    return alternatives.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def penalty_hours() -> Column:
    return F.col("maneuvers") * MANEUVER_HOURS + F.col("low_headway") * LOW_HEADWAY_HOURS


def weather_score() -> Column:
    wave = F.when(F.col("wave_avg").isNull(), 0.0).otherwise(F.col("wave_avg") * 100 + F.coalesce("wave_p95", "wave_avg") * 30)
    return wave + F.col("wind_avg") * 2 + F.col("wind_p95")


def ranking(objective: str) -> list[Column]:
    """Sort keys: complete routes first, then fewer warnings, then the objective; the attempt settles ties."""
    time = F.col("duration_hours") + penalty_hours()
    own = {
        "leastMotoring": [F.col("motor_hours"), time, F.col("distance_nm")],
        "bestWeather": [F.col("wave_avg").isNull(), weather_score(), penalty_hours(), F.col("duration_hours"), F.col("distance_nm")],
    }.get(objective, [time, F.col("distance_nm")])
    return [F.desc("complete"), F.col("warning_count"), *own, F.col("attempt")]


def rank(alternatives: DataFrame, objective: str, wanted: int) -> DataFrame:
    """The best ``wanted`` distinct alternatives of each request, with their place from 0."""
    order = W.partitionBy("request_id").orderBy(*ranking(objective))
    best = distinct_geometry(alternatives).withColumn("place", F.row_number().over(order) - 1)
    return best.filter(F.col("place") < wanted)


def geometry_keys(points: DataFrame, places: int = 5) -> DataFrame:
    """(route_id, geometry): a route's points in order, rounded to ``places``, as one text; a route is one row."""
    text = F.format_string(f"%.{places}f,%.{places}f", "lat", "lon")
    rows = points.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("seq", text.alias("text")))).alias("all"))
    return rows.select("route_id", F.array_join(F.transform("all", lambda x: x["text"]), ";").alias("geometry"))


def durations(points: DataFrame) -> DataFrame:
    """(route_id, hours) from a route's first point to its last; never negative."""
    hours = (F.max_by("t_ms", "seq") - F.min_by("t_ms", "seq")) / 3_600_000.0
    return points.groupBy("route_id").agg(F.greatest(F.lit(0.0), hours).alias("hours"))


def expanded(outcomes: DataFrame) -> DataFrame:
    """(request_id, attempt, route_id, warning) of outcomes (request_id, attempt, routes, warning).

    An outcome of several routes becomes one of each, numbered from 0; one
    without routes (null) stays as it is.
    """
    shared = outcomes.filter("routes is not null").select("request_id", F.posexplode("routes").alias("attempt", "route_id"), "warning")
    return shared.unionByName(outcomes.filter("routes is null").select("request_id", "attempt", F.lit(None).cast(shared.schema["route_id"].dataType).alias("route_id"), "warning"))


#: The most arrivals that are compared, the earliest; the least separation worth another route, nm.
MOST_ARRIVALS, LEAST_SEPARATION_NM = 2000, 0.25


def diverse(points: DataFrame, primary: DataFrame, wanted: int) -> DataFrame:
    """(request_id, place, route_id, separation_nm): of each request's arrivals the ones farthest from those chosen before.

    Points: (request_id, route_id, seq from 0, lat, lon, t_ms); primary:
    (request_id, route_id), chosen first.  Arrivals of the same geometry count
    once, and only the earliest few are compared.  Every round takes, for all
    requests, the arrival whose nearest chosen route is farthest, until that
    is nearer than the least separation.
    """
    keys = geometry_keys(points, 6)
    ends = points.groupBy("request_id", "route_id").agg(F.max("t_ms").alias("end_ms")).join(keys, "route_id")
    ends = ends.join(primary.select("route_id", F.lit(0).alias("first")), "route_id", "left").fillna(1, ["first"])
    once = W.partitionBy("request_id", "geometry").orderBy("first", "end_ms", "route_id")
    early = W.partitionBy("request_id").orderBy("first", "end_ms", "route_id")
    some = ends.withColumn("n", F.row_number().over(once)).filter("n = 1").withColumn("n", F.row_number().over(early)).filter(F.col("n") <= MOST_ARRIVALS + 1)
    left = written(some.filter("first = 1").select("request_id", "route_id"))
    chosen = primary.select("request_id", F.lit(0).alias("place"), "route_id", F.lit(None).cast("double").alias("separation_nm"))
    latest, near = chosen, None
    lines = written(points.select("route_id", "seq", "lat", "lon"))
    for place in range(1, wanted):
        pairs = left.join(latest.select("request_id", F.col("route_id").alias("b")), "request_id").select(F.col("route_id").alias("a"), "b")
        apart = separations(lines, pairs).select(F.col("a").alias("route_id"), "separation_nm")
        apart = left.join(apart, "route_id")
        near = apart if near is None else apart.unionByName(near.select(apart.columns)).groupBy("route_id", "request_id").agg(F.min("separation_nm").alias("separation_nm"))
        near = written(near)
        best = near.filter(F.col("separation_nm") >= LEAST_SEPARATION_NM).groupBy("request_id").agg(F.min_by(F.struct("route_id", "separation_nm"), F.struct(-F.col("separation_nm"), "route_id")).alias("b"))
        latest = written(best.select("request_id", F.lit(place).alias("place"), "b.route_id", "b.separation_nm"))
        if latest.isEmpty():
            break
        chosen = chosen.unionByName(latest)
        near = near.join(latest.select("route_id"), "route_id", "left_anti")
        left = near.select("request_id", "route_id")
    return chosen


def separations(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, separation_nm): mean distance of routes at up to 12 matching places between their ends.

    Points: (route_id, seq from 0, lat, lon); pairs: (a, b) of routes.
    """
    sizes = points.groupBy("route_id").agg(F.count("*").alias("n"))
    met = pairs.join(sizes.select(F.col("route_id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("route_id").alias("b"), F.col("n").alias("nb")), "b")
    met = met.withColumn("samples", F.least(F.lit(12), F.greatest(F.lit(2), F.least("na", "nb"))))
    met = met.withColumn("k", F.explode_outer(F.filter(F.sequence(F.lit(1), F.lit(10)), lambda k: k < F.col("samples") - 1)))
    part = F.col("k") / (F.col("samples") - 1)
    index = lambda n: F.floor(part * (F.col(n) - 1) + 0.5)
    met = met.withColumn("ia", index("na")).withColumn("ib", index("nb"))
    at = lambda s: points.select(F.col("route_id").alias(s), F.col("seq").alias(f"i{s}"), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"))
    met = met.join(at("a"), ["a", "ia"], "left").join(at("b"), ["b", "ib"], "left")
    apart = distance_nm(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return met.groupBy("a", "b").agg(F.coalesce(F.avg(apart), F.lit(0.0)).alias("separation_nm"))
