"""GeoJSON in and out: routes, polygons and avoided regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.functions.numbers import half_up
from passagekit.operators.legs import legs

def routes_geojson(points: DataFrame) -> DataFrame:
    """(route_id, distance_m, feature): each route as a LineString with rounded conditions of its points."""
    rows = legs(points)
    iso = F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    meta = F.struct(
        iso.alias("time"), half_up(F.col("wind_from")).cast("int").alias("windDir"), half_up(F.col("heading")).cast("int").alias("heading"),
        half_up(F.col("twa")).cast("int").alias("twa"), half_up(F.col("tws"), 1).alias("tws"), half_up(F.col("speed"), 1).alias("boatSpeed"),
        "propulsion", half_up(F.col("wave"), 2).alias("waveHeight"), F.col("path").alias("gribFile"),
    )
    item = F.struct("seq", F.array("lon", "lat").alias("at"), meta.alias("meta"))
    lists = rows.groupBy("route_id").agg(F.sort_array(F.collect_list(item)).alias("all"), F.sum("leg_nm").alias("nm"))
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("all", lambda x: x["at"]).alias("coordinates"))
    properties = F.struct(F.concat(F.lit("route-"), F.col("route_id").cast("string")).alias("name"), F.transform("all", lambda x: x["meta"]).alias("coordinatesMeta"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))
    return lists.select("route_id", half_up(F.coalesce("nm", F.lit(0.0)) * 1852).cast("long").alias("distance_m"), feature.alias("feature"))


def save_routes(points: DataFrame, path: str) -> None:
    """One JSON line a route."""
    routes_geojson(points).select(F.col("feature").alias("value")).write.text(path)


def polygons_geojson(edges: DataFrame) -> DataFrame:
    """(poly_id, feature): polygons of edge rows (poly_id, ring_id, idx, lat1, lon1), rings closed."""
    rings = edges.groupBy("poly_id", "ring_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.array("lon1", "lat1").alias("at")))).alias("all"))
    line = F.transform("all", lambda x: x["at"])
    rings = rings.select("poly_id", "ring_id", F.concat(line, F.slice(line, 1, 1)).alias("line"))
    shapes = rings.groupBy("poly_id").agg(F.sort_array(F.collect_list(F.struct("ring_id", "line"))).alias("rings"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.transform("rings", lambda r: r["line"]).alias("coordinates"))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return shapes.select("poly_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), empty.alias("properties"))).alias("feature"))


def region_of(key: Column) -> Column:
    """The region that a ring's key belongs to: what stands before the number."""
    return F.substring_index(key, "__", 1)


def region_index(rings: DataFrame) -> DataFrame:
    """(key, region, rings): each ring of edges (key, idx, lat1, lon1) as a list of one line of [lon, lat]."""
    line = F.sort_array(F.collect_list(F.struct("idx", F.array("lon1", "lat1").alias("at"))))
    rows = rings.groupBy("key").agg(line.alias("all"))
    return rows.select("key", region_of(F.col("key")).alias("region"), F.to_json(F.array(F.transform("all", lambda x: x["at"]))).alias("rings"))


def region_rings(features: DataFrame) -> DataFrame:
    """(region_id, ring_id, idx, lat1, lon1, lat2, lon2) from rows (region_id, feature) of Polygon and MultiPolygon features."""
    parsed = features.select("region_id", F.from_json("feature", "struct<geometry:struct<type:string,coordinates:string>>")["geometry"].alias("g"))
    line = "array<array<array<double>>>"
    shapes = F.when(F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", line))).when(
        F.col("g.type") == "MultiPolygon", F.from_json("g.coordinates", f"array<{line}>")
    )
    rings = parsed.select("region_id", F.posexplode(F.flatten(shapes)).alias("ring_id", "ring"))
    n = F.size("ring")
    closed = F.get("ring", F.lit(0)) == F.get("ring", n - 1)
    last = F.when(closed, n - 1).otherwise(n)
    rings = rings.withColumn("n", last).withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    here, after = F.get("ring", F.col("idx")), F.get("ring", (F.col("idx") + 1) % F.col("n"))
    xy = lambda p, i: F.get(p, F.lit(i))
    return rings.select("region_id", "ring_id", "idx", xy(here, 1).alias("lat1"), xy(here, 0).alias("lon1"), xy(after, 1).alias("lat2"), xy(after, 0).alias("lon2"))
