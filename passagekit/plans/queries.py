"""The queries of the passage domain over the driver's tables."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagekit.functions import geo, polar, solar, units
from passagekit.functions.numbers import half_up
from passagekit.operators import alternatives, corridor, depth, forecast, isochrone, legs, quality, requests, safety, search, spatial
from passagekit.operators.scratch import written
from passagekit.plans.bindings import BASE_MS, POLAR, view
from passagekit.sources import geotiff, polars, shapefile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: 2024-01-05 00:00 UTC, the time of overlays and scopes.
NOW_MS = BASE_MS + 4 * 86_400_000
RASTER = depth.Raster(54.0, 10.0, 0.1, nodata=-9999.0, elevation=True)
#: Courses half-way between sector bounds: from the start itself they would lie on them.
OPTIONS = isochrone.Options(heading_step=10.0, heading_offset=2.5, sector_size=5.0)
#: The whole search: courses every five degrees, sectors of one, hours as steps, limits of wind and wave.
SEARCH_OPTIONS, SEARCH_HOURS = isochrone.Options(max_wind_kn=40.0, max_wave_m=3.9), 1.0


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))
    return f


def r6(value: Column, name: str) -> Column:
    return (F.round(value, 6) + 0.0).alias(name)


def c(name: str) -> Column:
    return F.col(name)


def points(of: Callable[[str], DataFrame]) -> DataFrame:
    fix = of("fix")
    twa = geo.true_wind_angle(c("heading"), c("wind_from"))
    return fix.withColumn("twa", F.when(c("event_id") % 13 == 0, F.least(F.lit(180.0), twa + 2.0)).otherwise(twa))


def segments(of: Callable[[str], DataFrame]) -> DataFrame:
    rows = legs.legs(of("fix")).filter("p_lat is not null")
    return rows.select(c("event_id").alias("id"), c("p_lat").alias("lat1"), c("p_lon").alias("lon1"), c("lat").alias("lat2"), c("lon").alias("lon2"))


def spots(of: Callable[[str], DataFrame]) -> DataFrame:
    return of("fix").select(c("event_id").alias("id"), "lat", "lon", "t_ms")


def files(of: Callable[[str], DataFrame]) -> DataFrame:
    return of("forecast_file").filter("type = 'wind'")


def cells(of: Callable[[str], DataFrame], kind: str = "wind", wanted: DataFrame | None = None) -> DataFrame:
    """(path, frame, i, j, u, v, swh) of all files of a kind, or of the ``wanted`` frames: rasters by arithmetic on the file, frame and place."""
    axis = lambda low, high, step: F.sequence(F.lit(0), F.round((c(high) - c(low)) / c(step)).cast("int"))
    rows = of("forecast_file").filter(c("type") == kind)
    if wanted is None:
        rows = rows.withColumn("frame", F.explode(F.sequence(F.lit(0), c("n_times") - 1)))
    else:
        rows = rows.join(wanted, "path")
    rows = rows.select("path", "seq", "frame", F.explode(axis("lat_min", "lat_max", "lat_step")).alias("i"), axis("lon_min", "lon_max", "lon_step").alias("js"))
    rows = rows.select("path", "seq", "frame", "i", F.explode("js").alias("j"))
    k = c("seq") * 7 + c("frame") * 5 + c("i") * 3 + c("j") * 11
    swh = F.when(k % 17 == 0, 9999.0).otherwise((k % 40) / 10.0)
    return rows.select("path", "frame", "i", "j", ((k % 41 - 20) / 2.0).alias("u"), ((k * 3 % 37 - 18) / 2.0).alias("v"), swh.alias("swh"))


def stored(of: Callable[[str], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The wind cells of the frames asked for."""
    return lambda wanted: cells(of, "wind", wanted)


@query
def leg_kinematics(of):
    rows = legs.kinematics(of("fix"))
    return rows.select("route_id", "seq", r6(c("leg_nm"), "leg_nm"), r6(c("course"), "course"), r6(c("twa"), "twa"), r6(c("wind_shift"), "wind_shift"))


@query
def route_totals(of):
    rows = legs.legs(of("fix"))
    return rows.groupBy("route_id").agg(F.count("*").alias("points"), r6(F.sum("leg_nm"), "distance_nm"), r6(F.max("leg_nm"), "longest_nm"), r6(F.sum(F.when(c("underway"), c("elapsed_ms"))) / 3.6e6, "underway_hours"))


@query
def destination_points(of):
    lat, lon = geo.destination(c("lat"), c("lon"), c("speed") * 3.0, c("heading"))
    return of("fix").filter("speed is not null").select("event_id", r6(lat, "lat"), r6(lon, "lon"))


@query
def wind_vectors(of):
    return of("fix").select("event_id", r6(geo.wind_speed_kn(c("u"), c("v")), "tws"), r6(geo.wind_from(c("u"), c("v")), "wind_from"))


@query
def true_wind_angle(of):
    side = geo.sailing_side(c("propulsion"), c("wind_from"), c("heading"))
    return of("fix").select("event_id", r6(geo.true_wind_angle(c("heading"), c("wind_from")), "twa"), side.alias("side"))


@query
def current_drift(of):
    lat, lon = geo.drifted(c("lat"), c("lon"), c("u") / 10, c("v") / 10, F.lit(3600.0))
    sog = geo.speed_over_ground_kn(c("u") / 10, c("v") / 10, c("heading"), F.lit(5.0))
    return of("fix").select("event_id", r6(lat, "lat"), r6(lon, "lon"), r6(sog, "sog_kn"), r6(geo.along_track_kn(c("u"), c("v"), c("heading")), "along_kn"))


@query
def map_tiles(of):
    x, y = geo.tile(c("lat"), c("lon"), 9)
    return of("fix").groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"))


@query
def local_plane(of):
    x, y = geo.local_xy(c("lat"), c("lon"), F.lit(55.0), F.lit(11.0))
    return of("fix").select("event_id", r6(x, "x_nm"), r6(y, "y_nm"), r6(geo.turn_cost(c("heading"), c("wind_from"), F.lit(1.5)), "turn_cost"))


@query
def solar_elevation(of):
    return of("fix").select("event_id", r6(solar.elevation(c("t_ms"), c("lat"), c("lon")), "elevation"))


@query
def daylight_legs(of):
    return legs.daylight(of("fix")).groupBy("route_id").agg(F.count("*").alias("legs"), F.count_if("in_daylight").alias("in_daylight"))


@query
def polar_speed(of):
    twa = geo.true_wind_angle(c("heading"), c("wind_from"))
    return polar.with_boat_speed(of("fix"), POLAR, twa, c("tws")).select("event_id", r6(c("boat_speed"), "boat_speed"))


@query
def display_units(of):
    knots = units.Preference("value * 3.6", "value / 3.6", "km/h", "0.00")
    return of("fix").select(
        "event_id",
        r6(units.to_display(c("tws"), "speed", knots), "kmh"),
        r6(units.to_display(c("tws"), "speed", None, True), "ms"),
        r6(units.from_display(c("tws"), "speed", knots), "from_kmh"),
        r6(units.from_display(c("tws"), "distance", units.Preference("value / 1000", "value * 1000", "km")), "nmi_from_km"),
        units.formatted(c("event_id") / 3.0, "depth").alias("depth_text"),
    )


@query
def presentation_rounding(of):
    return of("fix").select("event_id", half_up(c("u"), 0).alias("u0"), half_up(c("tws"), 1).alias("tws1"), half_up(c("wave"), 0).alias("wave0"))


@query
def file_priority(of):
    return forecast.ranked(of("forecast_file")).select("path", "type", "rank")


@query
def select_file(of):
    return forecast.select_file(spots(of), files(of)).select(c("id").alias("event_id"), "path")


@query
def nearest_frame(of):
    chosen = forecast.chosen(spots(of), files(of), c("path")).filter("f is not null")
    return forecast.nearest_frame(chosen.select("id", c("f").alias("path"), "t_ms"), forecast.frames(files(of))).select(c("id").alias("event_id"), "path", "frame")


@query
def time_axis(of):
    return forecast.time_axis(forecast.frames(files(of))).select("valid_ms", "axis_idx")


@query
def resample_axis(of):
    return forecast.resampled_axis(files(of), 5_400_000).groupBy("path").agg(F.count("*").alias("n"), F.sum(c("valid_ms") - BASE_MS).alias("total_ms"))


@query
def departure_axis(of):
    start = files(of).select("path", (c("start_ms") + 9_000_000).alias("departure_ms"))
    rows = forecast.departure_axis(forecast.frames(files(of)), start)
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.min("valid_ms").alias("first_ms"), F.sum(c("valid_ms") - BASE_MS).alias("total_ms"))


@query
def bilinear_wind(of):
    rows = forecast.sample(spots(of), files(of), stored(of), ["u", "v"])
    return rows.select(c("id").alias("event_id"), "path", r6(c("u"), "u"), r6(c("v"), "v"))


@query
def masked_wave(of):
    rows = forecast.sample_wave(spots(of), files(of), stored(of))
    return rows.select(c("id").alias("event_id"), r6(c("swh"), "wave_m"))


@query
def grid_bounds(of):
    return forecast.grid_bounds(files(of)).select(*[r6(c(x), x) for x in ("lat_min", "lat_max", "lon_min", "lon_max", "lat_step", "lon_step")], "n_lat", "n_lon")


@query
def wind_grid(of):
    return forecast.wind_grid(files(of), stored(of), NOW_MS)


@query
def combination_now(of):
    return forecast.combination(of("forecast_file"), NOW_MS)


@query
def combination_departure(of):
    return forecast.combination(of("forecast_file"), NOW_MS, BASE_MS + 6 * 86_400_000)


@query
def expired_files(of):
    return forecast.expired(of("forecast_file"), NOW_MS).select("path", "end_ms")


@query
def freshest_current(of):
    return forecast.freshest(of("forecast_file")).join(of("forecast_file"), "path").select("path", "mtime")


@query
def edge_cells(of):
    return spatial.edge_cells(of("edge")).groupBy("cell").agg(F.count("*").alias("edges"), F.count_distinct("poly_id").alias("polygons"))


@query
def segment_crosses_land(of):
    return spatial.crossing_segments(segments(of), of("edge")).select(c("id").alias("event_id"))


@query
def legs_clear_of_land(of):
    clear = spatial.clear_segments(segments(of), of("edge")).select(c("id").alias("event_id"))
    return of("fix").join(clear, "event_id").groupBy("route_id").agg(F.count("*").alias("clear_legs"))


@query
def point_on_land(of):
    return spatial.points_on_land(spots(of), of("edge")).select(c("id").alias("event_id"))


@query
def region_points(of):
    edges = of("region_edge").withColumn("ring_id", F.lit(0))
    return spatial.points_in_regions(spots(of), edges).select(c("id").alias("event_id"), "region_id")


@query
def region_segments(of):
    return spatial.segments_in_regions(segments(of), of("region_edge")).select(c("id").alias("event_id"), "region_id")


@query
def shore_distance(of):
    return spatial.shore_distances(segments(of), of("edge"), 6.0).select(c("id").alias("event_id"), r6(c("shore_nm"), "shore_nm"))


@query
def shore_clearance(of):
    return spatial.has_clearance(segments(of), of("edge"), 3.0).groupBy("clear").agg(F.count("*").alias("legs"))


@query
def offshore_samples(of):
    rows = spatial.offshore_samples(segments(of), 10.0)
    return rows.groupBy(c("id").alias("event_id")).agg(F.count("*").alias("samples"), r6(F.min("limit_nm"), "limit_nm"), r6(F.sum("lat"), "lat_sum"))


@query
def offshore_limit(of):
    return spatial.within_offshore(segments(of), of("edge"), 12.0).select(c("id").alias("event_id"), "within")


@query
def polygons_in_box(of):
    return spatial.polygons_in_box(of("edge"), 54.5, 57.0, 11.0, 16.0)


@query
def depth_at(of):
    return depth.depth_at(spots(of), of("depth_cell"), RASTER).select(c("id").alias("event_id"), r6(c("depth_m"), "depth_m"))


@query
def depth_min(of):
    return depth.least_depth(segments(of), of("depth_cell"), RASTER).select(c("id").alias("event_id"), r6(c("depth_m"), "depth_m"))


@query
def day_budget(of):
    return legs.day_budget(of("fix"), 8.0).select("route_id", "day", r6(c("hours"), "hours"), "first_excess")


@query
def weighted_stats(of):
    rows = legs.weighted_stats(legs.time_weighted(of("fix"), "wave"))
    return rows.select("route_id", r6(c("mean"), "wave_avg"), r6(c("percentile"), "wave_p95"), r6(c("maximum"), "wave_max"))


@query
def maneuvers(of):
    return legs.maneuvers(of("fix")).select("route_id", "seq", r6(c("headway_nm"), "headway_nm"))


@query
def clearance_state(of):
    return legs.clearance_state(of("fix")).groupBy("route_id").agg(F.count_if("cleared").alias("cleared_points"))


@query
def forecast_lead(of):
    rows = quality.lead_hours(of("fix"), of("forecast_file"))
    return rows.groupBy("route_id").agg(r6(F.max("lead_hours"), "max_lead_hours"), F.count("*").alias("known"))


@query
def route_metrics(of):
    rows = quality.metrics(points(of), of("forecast_file"))
    whole = {"route_id", "point_count", "passage_days", "maneuvers", "low_headway"}
    return rows.select(*[c(x).cast("long").alias(x) if x in whole else r6(c(x), x) for x in rows.columns])


CONTEXT = quality.Context(POLAR, horizon_hours=96.0, daylight_only=True, max_hours_per_day=8.0, minimum_depth_m=5.0, minimum_shore_nm=1.0, maximum_offshore_nm=12.0)


def _issues(of):
    depths = depth.least_depth(segments(of), of("depth_cell"), RASTER).join(of("fix").select(c("event_id").alias("id"), "route_id", "seq"), "id")
    regions = of("region_edge").withColumn("ring_id", F.lit(0))
    return quality.issues(points(of), CONTEXT, of("forecast_file"), of("edge"), regions, depths.select("route_id", "seq", "depth_m"))


@query
def route_issues(of):
    return _issues(of)


@query
def route_verdicts(of):
    return quality.verdicts(points(of), _issues(of))


@query
def plan_attempts(of):
    wanted = of("orders").groupBy(c("o_custkey").alias("request_id")).agg(F.least(F.count("*"), F.lit(10)).cast("int").alias("wanted"))
    objective = F.element_at(F.array(*map(F.lit, alternatives.OBJECTIVES)), (c("request_id") % 4 + 1).cast("int"))
    rows = wanted.select("request_id", "wanted", objective.alias("objective"), (c("request_id") % 3 == 0).alias("shared"), F.lit(5.0).alias("heading_step"))
    out = alternatives.plan_attempts(rows)
    return out.select("request_id", "attempt", r6(c("heading_offset"), "heading_offset"), "force_motor", "wait_for_wind")


@query
def distinct_geometry(of):
    return alternatives.distinct_geometry(of("alternative")).select("request_id", "attempt", "geometry")


def _ranked(objective: str):
    return lambda of: alternatives.rank(of("alternative"), objective, 5).select("request_id", "place", "attempt", "geometry")


for _name, _objective in (("rank_fastest", "fastest"), ("rank_least_motoring", "leastMotoring"), ("rank_all_motoring", "allMotoring"), ("rank_best_weather", "bestWeather")):
    QUERIES[_name] = (lambda rank: lambda spark, sf_dir: rank(lambda name: view(spark, sf_dir, name)))(_ranked(_objective))


@query
def route_separation(of):
    routes = of("fix").select("route_id").distinct()
    pairs = routes.select(c("route_id").alias("a"), (c("route_id") + 1).alias("b")).join(routes.withColumnRenamed("route_id", "b"), "b")
    rows = alternatives.separations(of("fix").select("route_id", "seq", "lat", "lon"), pairs.select("a", "b"))
    return rows.select("a", "b", r6(c("separation_nm"), "separation_nm"))


def _frontier(of) -> DataFrame:
    fix = of("fix")
    ends = fix.groupBy("route_id").agg(
        F.min_by("lat", "seq").alias("start_lat"), F.min_by("lon", "seq").alias("start_lon"), F.max_by("lat", "seq").alias("end_lat"), F.max_by("lon", "seq").alias("end_lon")
    )
    rows = fix.join(ends, "route_id")
    return rows.select(c("route_id").alias("request_id"), c("event_id").alias("node_id"), "lat", "lon", "u", "v", "heading", "start_lat", "start_lon", "end_lat", "end_lon")


def _candidates(of) -> DataFrame:
    frontier = _frontier(of)
    return isochrone.candidates(frontier, isochrone.headings(OPTIONS), POLAR, OPTIONS, 1.0)


@query
def iso_candidates(of):
    return _candidates(of).select("request_id", "parent_id", "heading_idx", r6(c("speed"), "speed"), r6(c("lat"), "lat"), r6(c("lon"), "lon"))


@query
def step_candidates(of):
    """One step of a search under a current, a limit of waves, daylight and hours of a day: what its nodes can reach."""
    nodes = _frontier(of).join(of("fix").select(c("event_id").alias("node_id"), "wave", "t_ms", c("u").alias("cu"), c("v").alias("cv")), "node_id")
    hour, k = 3_600_000, c("node_id")
    nodes = nodes.withColumns({
        "cu": c("cu") / 10, "cv": c("cv") / 10, "step_ms": F.lit(hour).cast("long"), "step": F.lit(0), "departure_ms": c("t_ms"), "passage_ms": c("t_ms") - k % 23 * hour,
        "day": F.lit(0), "used": (k % 9).cast("double"), "cleared": F.lit(None).cast("boolean"), "until_ms": F.lit(None).cast("long"),
    })
    rows = search.stepped(nodes, POLAR, dataclasses.replace(OPTIONS, max_wave_m=3.9, daylight_only=True, max_hours_per_day=8.0))
    return rows.select("request_id", "parent_id", "heading_idx", r6(c("speed"), "speed"), r6(c("lat"), "lat"), r6(c("lon"), "lon"), r6(c("used"), "used"))


@query
def look_ahead(of):
    """Points whose way straight to their route's end, 25 miles of it at most, land or a region crosses."""
    nodes = _frontier(of).select(c("node_id").alias("id"), "lat", "lon", "end_lat", "end_lon")
    return search.blocked_ahead(nodes, _barriers(of), 25.0).select(c("id").alias("event_id"))


@query
def hours_of_day(of):
    """A day's hours under way before and after every point's next hours, moving or at rest."""
    k, hour = c("event_id"), 3_600_000
    start, end, departure, day, used = c("t_ms"), c("t_ms") + k % 40 * hour, c("t_ms") - k % 31 * hour, (k % 2).cast("int"), (k % 9).cast("double")
    ok, day1, used1 = legs.underway(start, end, departure, day, used, 8.0)
    rest_day, rest_used = legs.rested(start, end, departure, day, used)
    return of("fix").select("event_id", ok.alias("allowed"), day1.alias("day"), r6(used1, "used"), rest_day.alias("rest_day"), r6(rest_used, "rest_used"))


@query
def iso_frontier(of):
    rows = isochrone.canonical_frontier(_candidates(of), OPTIONS)
    return rows.select("request_id", "sector", "parent_id", "heading_idx", r6(c("lat"), "lat"), r6(c("lon"), "lon"))


@query
def iso_frontier_fold(of):
    rows = isochrone.folded_frontier(_candidates(of), OPTIONS)
    return rows.select("request_id", "sector", "parent_id", "heading_idx", r6(c("lat"), "lat"), r6(c("lon"), "lon"))


@query
def iso_closest(of):
    return isochrone.closest(_candidates(of)).select("request_id", "parent_id", "heading_idx", r6(c("gap_nm"), "gap_nm"))


#: A voyage's least length, and the hours that its forecast lasts at least.
VOYAGE_NM, VOYAGE_HOURS = 20.0, 8.0


def _voyages(of) -> DataFrame:
    """From each route's first point to its first later one ``VOYAGE_NM`` off, or its last: within a forecast file over both ends, or the start.

    The file is the shortest that lasts long enough; the voyage departs when
    it begins and is searched until it ends.  Without one it has no forecast.
    """
    fix = of("fix")
    first = fix.filter("seq = 0").select("route_id", c("lat").alias("start_lat"), c("lon").alias("start_lon"))
    far = geo.distance_nm(c("start_lat"), c("start_lon"), c("lat"), c("lon")) >= VOYAGE_NM
    order = F.struct(~far, F.when(far, c("seq")).otherwise(-c("seq")))
    ends = fix.join(first, "route_id").groupBy(c("route_id").alias("request_id"), "start_lat", "start_lon").agg(F.min_by("lat", order).alias("end_lat"), F.min_by("lon", order).alias("end_lon"))
    cell = lambda low, high: F.sequence(F.floor(low), F.floor(high))
    filed = files(of).withColumn("cy", F.explode(cell("lat_min", "lat_max"))).withColumn("cx", F.explode(cell("lon_min", "lon_max")))
    met = ends.withColumn("cy", F.floor("start_lat")).withColumn("cx", F.floor("start_lon")).join(filed, ["cy", "cx"])
    over = lambda n: c(f"{n}_lat").between(c("lat_min"), c("lat_max")) & c(f"{n}_lon").between(c("lon_min"), c("lon_max"))
    hours = (c("end_ms") - c("start_ms")) / legs.HOUR_MS
    better = F.struct(~over("end"), hours < VOYAGE_HOURS, hours, "path")
    best = met.filter(over("start")).groupBy("request_id").agg(F.min_by(F.struct(c("start_ms").alias("departure_ms"), c("end_ms").alias("until_ms")), better).alias("f"))
    return ends.join(best.select("request_id", "f.*"), "request_id", "left").withColumn("departure_ms", F.coalesce("departure_ms", F.lit(NOW_MS)))


def _barriers(of) -> DataFrame:
    """Land, and the regions that are avoided."""
    sides = ["ring_id", "lat1", "lon1", "lat2", "lon2"]
    land = of("edge").select(c("poly_id").cast("long").alias("poly_id"), *sides, F.lit(False).alias("region"))
    return land.unionByName(of("region_edge").select(c("region_id").cast("long").alias("poly_id"), F.lit(0).alias("ring_id"), *sides[1:], F.lit(True).alias("region")))


def _sampled(of) -> Callable[[DataFrame], DataFrame]:
    known = files(of)
    return lambda spots_: forecast.sample_weather(spots_, known, stored(of))


def _weather(of) -> Callable[[DataFrame, int], DataFrame]:
    """A step's nodes with wind and wave at their own time, the current at the step's end, and the boxes of files within reach."""
    sampled, currents = _sampled(of), written(cells(of, "current", forecast.current_frames(of("forecast_file"))))
    fastest = max(s for row in POLAR.speeds for s in row)

    def at(nodes: DataFrame, step: int) -> DataFrame:
        keyed = nodes.drop("path").withColumn("id", F.struct("request_id", "step_ms", "node_id"))
        flow = forecast.currents_at(keyed.select("id", "lat", "lon", (c("t_ms") + c("step_ms")).alias("t_ms")), of("forecast_file"), currents)
        keyed = keyed.join(flow.select("id", c("u").alias("cu"), c("v").alias("cv")), "id")
        reach = (F.lit(fastest) + geo.wind_speed_kn(c("cu"), c("cv"))) * c("step_ms") / legs.HOUR_MS
        return keyed.join(sampled(keyed.select("id", "lat", "lon", "t_ms", reach.alias("reach_nm"))), "id").drop("id")

    return at


def _searched(of, options: isochrone.Options = SEARCH_OPTIONS):
    """(nodes, ends, stopped) of the voyages, to the end of the forecast."""
    return search.search(_voyages(of), _weather(of), POLAR, options, None, SEARCH_HOURS, barriers=_barriers(of))


@query
def isochrone_route(of):
    """Sailing between each route's ends: wind, wave limit, current, land and regions; requests without an arrival end where they came nearest, with a reason."""
    nodes, ends, stopped = _searched(of)
    arrived = search.backtrack(nodes, ends).withColumn("reason", F.lit(None).cast("string"))
    partial = search.backtrack(nodes, stopped).join(stopped.select("request_id", c("step").alias("end_step"), c("node_id").alias("end_node"), "reason"), ["request_id", "end_step", "end_node"])
    rows = search.resampled(arrived.unionByName(partial), _sampled(of))
    kept = [r6(c(x), x) for x in ("lat", "lon", "speed", "hours", "tws", "twa", "wave")]
    return rows.select("request_id", "seq", "t_ms", *kept, "propulsion", "path", "reason")


def _several(of) -> DataFrame:
    """Up to three routes of every voyage out of one search, with the weather at their points."""
    nodes, ends, _ = _searched(of, dataclasses.replace(SEARCH_OPTIONS, alternatives=3))
    return search.resampled(search.routes(nodes, ends, 3), _sampled(of))


@query
def searched_quality(of):
    """Metrics and issues of searched routes: a route is a voyage's alternative."""
    rows = written(_several(of).withColumn("route_id", c("request_id") * 10 + c("place")))
    context = quality.Context(POLAR, horizon_hours=96.0, minimum_depth_m=5.0)
    ways = legs.legs(rows).filter("p_lat is not null").select(F.struct("route_id", "seq").alias("id"), c("p_lat").alias("lat1"), c("p_lon").alias("lon1"), c("lat").alias("lat2"), c("lon").alias("lon2"))
    depths = depth.least_depth(ways, of("depth_cell"), RASTER).select("id.route_id", "id.seq", "depth_m")
    regions = of("region_edge").withColumn("ring_id", F.lit(0))
    found = quality.issues(rows, context, of("forecast_file"), of("edge"), regions, depths)
    told = found.groupBy("route_id").agg(F.count("*").alias("issues"), F.count_if(c("severity") == "error").alias("errors"))
    whole = {"route_id", "point_count", "passage_days", "maneuvers", "low_headway"}
    measured = quality.metrics(rows, of("forecast_file"))
    measured = measured.select(*[c(x).cast("long").alias(x) if x in whole else r6(c(x), x) for x in measured.columns])
    return measured.join(told, "route_id", "left").fillna(0, ["issues", "errors"])


@query
def diverse_routes(of):
    """Routes whose number has the same remainder are the arrivals of one request; the one with the smallest number is chosen first."""
    rows = of("fix").select((c("route_id") % 10).alias("request_id"), "route_id", "seq", "lat", "lon", "t_ms")
    primary = rows.groupBy("request_id").agg(F.min("route_id").alias("route_id"))
    return alternatives.diverse(rows, primary, 4).select("request_id", "place", "route_id", r6(c("separation_nm"), "separation_nm"))


@query
def geojson_export(of):
    from passagekit.sources.geojson import routes_geojson

    return routes_geojson(points(of)).select("route_id", "distance_m", F.sha2("feature", 256).alias("feature_sha256"))


def _clearance_segments(of) -> DataFrame:
    whole = W.partitionBy("route_id")
    ends = [by(x, "seq").over(whole).alias(f"{n}_{x}") for n, by in (("start", F.min_by), ("end", F.max_by)) for x in ("lat", "lon")]
    rows = legs.legs(of("fix")).select("event_id", "p_lat", "p_lon", "lat", "lon", "cleared", *ends).filter("p_lat is not null")
    kept = [f"{n}_{x}" for n in ("start", "end") for x in ("lat", "lon")]
    return rows.select(c("event_id").alias("id"), c("p_lat").alias("lat1"), c("p_lon").alias("lon1"), c("lat").alias("lat2"), c("lon").alias("lon2"), *kept, c("cleared").alias("established"))


@query
def shore_allowance(of):
    rows = safety.clearance_allowed(_clearance_segments(of), of("edge"), 3.0)
    return rows.select(c("id").alias("event_id"), "allowed")


@query
def constraint_violations(of):
    ways = written(_clearance_segments(of))  # read by every test
    depths = depth.least_depth(ways.select("id", "lat1", "lon1", "lat2", "lon2"), of("depth_cell"), RASTER)
    rows = safety.violations(ways, of("edge"), depths, minimum_shore_nm=3.0, maximum_offshore_nm=60.0, minimum_depth_m=5.0)
    return rows.groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count("*").alias("legs"))


@query
def request_validation(of):
    k, pick = c("o_orderkey"), lambda n: c("o_orderkey") % n
    rows = of("orders").select(
        "o_orderkey",
        F.when(pick(13) == 0, None).otherwise(k % 90 * 1.0).alias("start_lat"), (k % 180 * 1.0).alias("start_lon"), (k % 80 * 1.0).alias("end_lat"), (k % 170 * 1.0).alias("end_lon"),
        F.when(pick(17) == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("departure"),
        (pick(29) * 1.0).alias("max_hours_per_day"),
        *[F.when(pick(n) == 1, most + 1.0).otherwise(1.0).alias(name) for n, (name, most) in zip((31, 37, 41, 43, 47, 53), requests.BOUNDS.items())],
        F.when(pick(19) == 0, "quickest").when(pick(7) == 0, "allMotoring").otherwise("fastest").alias("objective"), (pick(11)).alias("alternative_count"),
    )
    rows = rows.withColumn("motor_kn", F.when(pick(14) == 0, 0.0).otherwise(c("motor_kn")))
    return rows.groupBy(F.coalesce(requests.validation_error(), F.lit("ok")).alias("answer")).agg(F.count("*").alias("n"))


@query
def capability_readiness(of):
    k = c("c_custkey")
    ready, reason = requests.readiness(k % 2 == 0, k % 3 != 0, k % 5 != 0)
    return of("customer").groupBy(ready.alias("ready"), reason.alias("reason")).agg(F.count("*").alias("n"))


@query
def file_names(of):
    raw = F.concat(F.lit("up/../"), c("p_name"), F.element_at(F.array(*map(F.lit, (".grib2", ".GRB", ".txt", "", ".grb2/x"))), (c("p_partkey") % 5 + 1).cast("int")))
    return of("part").select("p_partkey", requests.safe_file_name(raw).alias("name"))


@query
def stop_reasons(of):
    k = c("o_orderkey")
    reason = requests.dominant_reason(k % 4, k * 3 % 5, k * 7 % 6, k * 5 % 7)
    text = requests.joined_warnings(F.when(k % 2 == 0, "late"), F.when(k % 3 == 0, "").otherwise("shallow"))
    return of("orders").groupBy(reason.alias("reason"), text.alias("warning")).agg(F.count("*").alias("n"))


@query
def download_plan(of):
    areas = of("forecast_file").select(
        c("path").alias("area_id"), "lat_min", "lat_max", "lon_min", "lon_max", (c("start_ms") + (c("seq") * 37 % 500 - 40) * 3_600_000).alias("departure_ms"), (c("start_ms") + 5_000_000).alias("now_ms")
    )
    return requests.download_plan(areas).select("area_id", "cycle_ms", "hour", "key", "rejected")


@query
def stale_regions(of):
    wanted = of("orders").select((c("o_custkey") % 40).alias("id"))
    return requests.stale_ids(wanted, of("nation").select(c("n_nationkey").alias("id")))


@query
def reusable_files(of):
    now = of("forecast_file")
    return requests.reusable(now, now.withColumn("mtime", F.when(c("seq") % 3 == 0, c("mtime") + 1).otherwise(c("mtime"))))


@query
def nearest_rank(of):
    rows = requests.nearest_rank(of("events"), "event_type", "value")
    return rows.select("event_type", *[r6(c(x), x) for x in ("mean", "p50", "p95", "least", "most")])


@query
def corridor_times(of):
    rows = corridor.timed(of("fix").select("route_id", "seq", "lat", "lon", "cleared"), F.lit(BASE_MS), 6.0)
    return rows.select("route_id", "seq", r6(c("run_nm"), "run_nm"), r6((c("t_ms") - BASE_MS) / 3.6e6, "hours"))


@query
def corridor_anchors(of):
    rows = corridor.timed(of("fix").select("route_id", "seq", "lat", "lon"), F.lit(BASE_MS), 6.0)
    axis = rows.select("route_id").distinct().select("route_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: i.cast("long") * 3_600_000 + BASE_MS)).alias("valid_ms"))
    return corridor.anchors(rows, axis)


@query
def hand_offs(of):
    rows = corridor.timed(of("fix").select("route_id", "seq", "lat", "lon"), F.lit(BASE_MS), 6.0)
    state = legs.clearance_state(of("fix"))
    return corridor.hand_offs(rows.join(state, ["route_id", "seq"]))


@query
def motor_walk(of):
    fix = of("fix")
    currents = fix.select("route_id", "seq", "u", "v", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    currents = currents.select("route_id", "seq", (F.lit(BASE_MS) + c("k") * 6 * 3_600_000).alias("valid_ms"), (c("u") / 10 + c("k") / 10).alias("u"), (c("v") / 10 - c("k") / 20).alias("v"))
    rows = corridor.motor_walk(fix.select("route_id", "seq", "lat", "lon", F.lit(BASE_MS).alias("t_ms")), currents, 6.0)
    return rows.select("route_id", "seq", r6((c("t_ms") - BASE_MS) / 3.6e6, "hours"))


@query
def usable_files(of):
    """Files that reach each customer's departure and are enabled: every third one of the first 30, and those the engine fetched."""
    named = of("forecast_file").withColumn("path", F.when(c("seq") % 5 == 0, F.concat(F.lit("auto-"), c("path"))).otherwise(c("path")))
    return requests.usable(named, NOW_MS, [f"file-{k}" for k in range(0, 30, 3)]).select("path", "type", "end_ms")


@query
def lane_candidates(of):
    """Candidates within three miles of the nearest anchor of their step: points of the routes of other numbers."""
    at = of("fix").select(c("route_id").alias("request_id"), F.lit(3_600_000).cast("long").alias("step_ms"), (c("seq") % 12).alias("step"), c("event_id").alias("parent_id"), F.lit(0).alias("heading_idx"), "lat", "lon")
    anchors = at.filter(c("parent_id") % 3 == 0).select("request_id", "step", c("parent_id").alias("lane"), "lat", "lon")
    rows = search.lanes_within(at.withColumn("blocked", c("parent_id") % 7 == 0), anchors, 3.0)
    return rows.select("request_id", "step", c("parent_id").alias("event_id"), "lane")


@query
def motor_limits(of):
    """Routes motored from the forecast's third day on, and the first point where cover, wind or wave stop them."""
    fix = of("fix")
    still = fix.filter("false").select("route_id", "seq", F.lit(BASE_MS).alias("valid_ms"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    start = F.lit(BASE_MS + 2 * 86_400_000)
    walked = written(corridor.motor_walk(fix.select("route_id", "seq", "lat", "lon", start.alias("t_ms")), still, 6.0))
    minute = F.floor(c("t_ms") / 60_000).cast("long")
    spots_ = fix.select("route_id", "seq", "lat", "lon").join(walked, ["route_id", "seq"]).select(F.struct("route_id", "seq").alias("id"), "lat", "lon", (minute * 60_000).alias("t_ms"))
    found = forecast.sample_weather(spots_, files(of), stored(of)).select("id.*", F.lit(True).alias("covered"), geo.wind_speed_kn(c("u"), c("v")).alias("tws"), "wave")
    rows = corridor.motor_route(walked, found, 16.0, 3.4)
    return rows.select("route_id", "seq", r6((c("t_ms") - BASE_MS) / 3.6e6, "hours"), r6(c("tws"), "tws"), r6(c("wave"), "wave"), "reason", "stopped_seq")


def _row_files(cells_: DataFrame) -> DataFrame:
    """(path, content): the raster's pixels as GeoTIFF files of ten rows each, 100 pixels wide."""

    def file(frame):
        low = int(frame.y.min()) // 10 * 10
        values = np.full((10, 100), -9999.0)
        values[9 - (frame.y - low), frame.x] = frame.raw
        return pd.DataFrame({"path": [f"depth-{low}.tif"], "content": [geotiff.encode(values, RASTER.lon0, RASTER.lat0 + (low + 10) * RASTER.size, RASTER.size, nodata=-9999.0, rows=4)]})

    return cells_.groupBy(F.floor(c("y") / 10)).applyInPandas(file, "path string, content binary")


@query
def depth_files(of):
    """Least depths of legs from raster files, of which only the blocks that a leg meets are unpacked."""
    found = written(geotiff.blocks(_row_files(of("depth_cell"))))
    grid = dataclasses.replace(RASTER, nodata=None)
    ways = segments(of)
    pixels = geotiff.cells(found, grid, depth.cells_on_segments(ways, grid).select("x", "y"))
    return depth.least_depth(ways, pixels, grid).select(c("id").alias("event_id"), r6(c("depth_m"), "depth_m"))


def _shape_files(edges_: DataFrame) -> DataFrame:
    """(path, content): polygons of edges as shapefiles, every fifth polygon in one; land clockwise, holes not."""

    def file(frame):
        shapes = []
        for number, own in frame.groupby("poly_id"):
            rings = [np.vstack([g.sort_values("idx")[["lon1", "lat1"]].to_numpy()] * 2)[: len(g) + 1] for _, g in own.groupby("ring_id")]
            shapes.append((int(number) + 1, [r if (shapefile.area(r) < 0) == (k == 0) else r[::-1] for k, r in enumerate(rings)]))
        return pd.DataFrame({"path": [f"coast-{int(frame.poly_id.iloc[0]) % 5}.shp"], "content": [shapefile.encode(shapes)]})

    return edges_.groupBy(c("poly_id") % 5).applyInPandas(file, "path string, content binary")


@query
def coast_files(of):
    """Edges of coasts that were shapefiles, without their direction."""
    rows = shapefile.edges(shapefile.shapes(_shape_files(of("edge"))))
    a, b = (F.struct(F.round(c(f"lat{k}"), 6).alias("lat"), F.round(c(f"lon{k}"), 6).alias("lon")) for k in (1, 2))
    ends = rows.select((F.split("poly_id", ":")[1].cast("long") - 1).alias("poly_id"), "ring_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return ends.select("poly_id", "ring_id", *[c(f"{p}.{x}").alias(f"{x}_{p}") for p in "ab" for x in ("lat", "lon")])


def _polar_files(of) -> tuple[DataFrame, DataFrame]:
    """Settings of suppliers' vessels and the resources that they name, with one fault in most."""
    k = c("s_suppkey")
    number = lambda x: x.cast("double")
    tws = F.when(k % 17 == 5, F.array(*[F.lit(x) for x in (4.0, 3.0, 8.0)])).when(k % 17 == 6, F.array(F.lit(-1.0), F.lit(3.0), F.lit(8.0))).otherwise(F.array(number(2 + k % 3), F.lit(6.0), F.lit(10.0)))
    twa = F.when(k % 17 == 7, F.array(F.lit(0.5), F.lit(3.2))).when(k % 17 == 8, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.5), F.lit(3.0)))
    speed = lambda i, j: number((k * 3 + i * 5 + j * 7) % 11) / 2 - F.when(k % 17 == 9, 20.0).otherwise(0.0)
    lines = F.when(k % 17 == 10, F.array(F.array(speed(0, 0), speed(0, 1)))).otherwise(F.array(*[F.array(speed(i, 0), speed(i, 1)) for i in range(3)]))
    made = F.to_json(F.struct(
        F.when(k % 17 == 1, "table").otherwise("polarTable").alias("kind"), F.when(k % 2 == 0, c("s_name")).otherwise(" ").alias("name"),
        F.struct(F.when(k % 17 == 2, "kn").otherwise("m/s").alias("tws"), F.lit("rad").alias("twa"), F.lit("m/s").alias("boatSpeed")).alias("units"),
        F.struct((k % 17 != 3).alias("portStarboardSymmetric")).alias("symmetry"), F.struct(tws.alias("tws"), twa.alias("twa")).alias("axes"),
        F.struct(lines.alias("boatSpeedMatrix")).alias("values"),
    ))
    name = F.concat(F.lit("polar-"), k.cast("string"))
    rows = of("supplier")
    resources = rows.filter(k % 17 != 4).select(name.alias("polar_id"), F.when(k % 17 == 11, F.substring(made, 1, 20)).otherwise(made).alias("resource"))
    settings = F.to_json(F.struct(
        (k % 17 != 12).alias("enabled"),
        F.when(k % 17 != 13, F.struct(F.when(k % 17 == 14, F.concat(F.lit("../"), name)).when(k % 17 != 15, name).alias("activePolar"), F.when(k % 3 == 1, "0.9").when(k % 3 == 2, "-2").alias("perfAdjust"))).alias("configuration"),
    ))
    return rows.select(k.alias("vessel"), F.when(k % 17 == 16, "{").otherwise(settings).alias("settings")), resources


@query
def polar_files(of):
    """Cells of the polars that vessels' settings name, or why there is none."""
    found = polars.loaded(*_polar_files(of))
    good = polar.normalise(found.filter("reason is null").select(c("vessel").alias("polar_id"), "adjustment", "tws_ms", "twa_rad", "matrix"))
    rows = found.select("vessel", F.when(c("reason").isNull(), c("name")).alias("name"), "reason").join(good.withColumnRenamed("polar_id", "vessel"), "vessel", "left")
    return rows.select("vessel", "name", "reason", r6(c("tws"), "tws"), r6(c("twa"), "twa"), r6(c("speed"), "speed"))


@query
def corridor_path(of):
    """From each route's first point to its last, around land and regions."""
    ends = of("fix").groupBy("route_id").agg(*[by(x, "seq").alias(f"{n}_{x}") for n, by in (("start", F.min_by), ("end", F.max_by)) for x in ("lat", "lon")])
    rows = corridor.corridors(ends.withColumnRenamed("route_id", "request_id"), of("edge"), of("region_edge").withColumn("ring_id", F.lit(0)), minimum_shore_nm=0.2)
    return rows.select("request_id", "seq", r6(c("lat"), "lat"), r6(c("lon"), "lon"), r6(c("cost_nm"), "cost_nm"), "cleared", "problem")


@query
def wave_grid(of):
    return forecast.wave_grid(files(of), stored(of), NOW_MS)


@query
def polygons_export(of):
    from passagekit.sources.geojson import polygons_geojson

    return polygons_geojson(of("edge")).select("poly_id", F.sha2("feature", 256).alias("feature_sha256"))


@query
def current_grid(of):
    rows = forecast.current_grid(of("forecast_file"), cells(of, "current"), NOW_MS)
    return rows.select("lat", "lon", r6(c("u"), "u"), r6(c("v"), "v"))


@query
def currents_at(of):
    rows = forecast.currents_at(spots(of), of("forecast_file"), lambda wanted: cells(of, "current", wanted))
    return rows.select(c("id").alias("event_id"), r6(c("u"), "u"), r6(c("v"), "v"))


@query
def geometry_keys(of):
    rows = alternatives.geometry_keys(of("fix"))
    return rows.select("route_id", F.length("geometry").alias("size"), F.sha2("geometry", 256).alias("geometry_sha256"))


@query
def route_hours(of):
    return alternatives.durations(of("fix")).select("route_id", r6(c("hours"), "hours"))


@query
def shared_outcomes(of):
    """A customer's orders of a year are the routes of one attempt; those of a single order had none."""
    rows = of("orders").groupBy(c("o_custkey").alias("request_id"), F.year("o_orderdate").alias("year")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("routes"))
    rows = rows.select("request_id", (c("year") - 1990).alias("attempt"), F.when(F.size("routes") > 1, c("routes")).alias("routes"), F.when(c("year") % 2 == 0, "late").alias("warning"))
    return alternatives.expanded(rows).select("request_id", "attempt", "route_id", "warning")


@query
def search_progress(of):
    rows = of("orders").select(c("o_custkey").alias("request_id"), ((c("o_orderkey") % 23 - 3) / 16.0).alias("fraction"))
    return requests.progress(rows).select("request_id", r6(c("percent"), "percent"))


@query
def step_summary(of):
    rows = of("events").select((c("event_id") % 97).alias("frontier"), (c("event_id") % 1013).alias("candidates"), c("value").alias("total_ms"))
    rows = requests.step_summary(rows, ["frontier", "candidates", "total_ms"])
    return rows.select("field", r6(c("least"), "least"), r6(c("most"), "most"), F.round("total", 2).alias("total"))


@query
def departure_error(of):
    k = c("o_orderkey")
    rows = of("orders").select(k.alias("request_id"), (F.lit(BASE_MS) + (k % 1200 - 200) * 3_600_000).alias("departure_ms"))
    return requests.departure_error(files(of), rows).groupBy(F.coalesce("error", F.lit("none")).alias("answer")).agg(F.count("*").alias("n"))


@query
def vessel_draft(of):
    """A supplier is a vessel; it has a number at some of the places, and names one of them or another."""
    k = c("s_suppkey")
    names = F.array(*map(F.lit, (*requests.DRAFT_PATHS, "steering.draft")))
    values = of("supplier").select(k.alias("vessel_id"), F.posexplode(names).alias("n", "path"))
    values = values.select("vessel_id", "path", F.when((k_ := c("vessel_id") * 7 + c("n") * 3) % 4 == 0, None).when(k_ % 5 == 0, -1.0).otherwise(k_ % 30 / 10.0).alias("value"))
    configured = of("supplier").select(k.alias("vessel_id"), F.when(k % 3 == 0, "").when(k % 3 == 1, "steering.draft").otherwise("design.draft.maximum").alias("path"))
    return requests.vessel_draft(values, configured).select("vessel_id", "path", r6(c("draft_m"), "draft_m"))


@query
def segments_on_land(of):
    return spatial.segments_on_land(segments(of), of("edge")).select(c("id").alias("event_id"))


@query
def bounded_polygons(of):
    rows = spatial.with_boundary(of("edge"), 54.0, 60.0, 9.0, 22.0)
    return rows.groupBy("poly_id").agg(F.count("*").alias("edges"), r6(F.sum("lat1"), "lat_sum"), r6(F.max("lon2"), "lon_max"))


@query
def route_boxes(of):
    rows = spatial.route_boxes(of("fix"))
    return rows.select("route_id", *[r6(c(x), x) for x in ("lat_min", "lat_max", "lon_min", "lon_max")])


@query
def region_index(of):
    from passagekit.sources.geojson import region_index as index

    rings = of("ring").select(F.concat(F.lit("area-"), c("poly_id").cast("string"), F.when(c("ring_id") > 0, F.concat(F.lit("__"), c("ring_id").cast("string"))).otherwise("")).alias("key"), "idx", c("lat").alias("lat1"), c("lon").alias("lon1"))
    rows = index(rings).withColumn("line", F.flatten(F.from_json("rings", "array<array<array<double>>>")))
    total = lambda k: F.aggregate("line", F.lit(0.0), lambda acc, p: acc + p[k])
    return rows.select("key", "region", F.size("line").alias("points"), r6(total(0), "lon_sum"), r6(total(1), "lat_sum"))
