"""Requests and the answers about them: validation, readiness, warnings, file scopes and downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagekit.operators.scratch import written

from passagekit.functions.numbers import finite
from passagekit.operators.alternatives import OBJECTIVES

#: Upper bounds of bounded options, in the order they are checked.
BOUNDS = {"minimum_depth_m": 12_000, "minimum_shore_nm": 50, "maximum_offshore_nm": 1_000, "vessel_draft_m": 100, "motor_kn": 100, "motor_below_kn": 100}
GRIB_EXTENSIONS = ("grib2", "grib", "grb2", "grb")
CYCLE_MS, CYCLE_DELAY_MS, SLICE_HOURS, LAST_HOUR = 6 * 3_600_000, 8 * 3_600_000, 3, 384


def validation_error() -> Column:
    """The first thing wrong with a request, or null.

    Columns: start_lat, start_lon, end_lat, end_lon, departure (text),
    max_hours_per_day, the bounded options, objective, alternative_count.
    """
    c = F.col
    places = [c(x) for x in ("start_lat", "start_lon", "end_lat", "end_lon")]
    missing = F.lit(False)
    for p in places:
        missing = missing | p.isNull() | F.isnan(p)
    missing = missing | c("departure").isNull() | c("departure").try_cast("timestamp").isNull()
    outside = lambda name, low, high: c(name).isNotNull() & (~finite(c(name).cast("double")) | (c(name) < low) | (c(name) > high))
    out = F.when(missing, "incomplete: places and departure")
    out = out.when(outside("max_hours_per_day", 0, 24), "out of range: max_hours_per_day")
    for name, most in BOUNDS.items():
        out = out.when(outside(name, 0, most), f"out of range: {name}")
    out = out.when(c("objective").isNotNull() & ~c("objective").isin(*OBJECTIVES), "unknown: objective")
    out = out.when(outside("alternative_count", 1, 10) | (c("alternative_count") % 1 != 0), "out of range: alternative_count")
    return out.when((c("objective") == "allMotoring") & ~F.coalesce(c("motor_kn") > 0, F.lit(False)), "needed by the objective: motor_kn")


def readiness(has_polar: Column, has_forecast: Column, has_shoreline: Column) -> tuple[Column, Column]:
    """Whether a passage can be planned, and which parts are missing."""
    lacks = F.concat_ws(", ", F.when(~has_polar, "polar"), F.when(~has_forecast, "forecast"), F.when(~has_shoreline, "shoreline"))
    return lacks == "", F.when(lacks != "", F.concat(F.lit("missing: "), lacks))


def safe_file_name(name: Column) -> Column:
    """The last part of a path if it has a GRIB extension, else null."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.when(F.lower(base).rlike(r"^.+\.(" + "|".join(GRIB_EXTENSIONS) + ")$"), base)


def joined_warnings(*messages: Column) -> Column:
    """Messages that are there, joined; none: null."""
    text = F.concat_ws("; ", *[F.when(m != "", m) for m in messages])
    return F.when(text != "", text)


def dominant_reason(safety: Column, coverage: Column, land: Column, wind: Column) -> Column:
    """Why a search stopped: the largest of the rejection counts, the later of equals; none: null."""
    none = F.greatest(safety, coverage, land, wind) == 0
    ahead = lambda x, *rest: x > F.greatest(*rest)
    return F.when(none, None).when(ahead(safety, coverage, land, wind), "safety").when(ahead(coverage, land, wind), "grib_exhausted").when(land > wind, "land").otherwise("wind")


def download_plan(areas: DataFrame) -> DataFrame:
    """(area_id, cycle_ms, hour, key, rejected) of forecast slices of areas (area_id, lat_min, lat_max, lon_min, lon_max, departure_ms, now_ms).

    The cycle is the last six-hourly one at least eight hours old; slices go
    every three hours from the one at or before the departure to the last hour
    of the model, however short the passage.  An area whose departure is more
    than three hours before the cycle, or beyond the last hour, is one row
    without an hour that says so.
    """
    cycle = F.floor((F.col("now_ms") - CYCLE_DELAY_MS) / CYCLE_MS) * CYCLE_MS
    rows = areas.withColumn("cycle_ms", cycle.cast("long"))
    lead = F.greatest(F.lit(0.0), (F.col("departure_ms") - F.col("cycle_ms")) / 3_600_000.0)
    low = (F.floor(lead / SLICE_HOURS) * SLICE_HOURS).cast("int")
    early = F.col("departure_ms") < F.col("cycle_ms") - SLICE_HOURS * 3_600_000
    rows = rows.withColumn("rejected", F.when(early, "before the cycle").when(lead > LAST_HOUR, "beyond the horizon"))
    box = F.concat_ws("_", *[(f(F.col(c) + pad)).cast("int").cast("string") for f, c, pad in ((F.floor, "lat_min", -1), (F.ceil, "lat_max", 1), (F.floor, "lon_min", -1), (F.ceil, "lon_max", 1))])
    rows = rows.withColumn("hour", F.explode_outer(F.when(F.col("rejected").isNull(), F.sequence(low, F.lit(LAST_HOUR), F.lit(SLICE_HOURS)))))
    stamp = F.date_format(F.timestamp_millis("cycle_ms"), "yyyyMMddHH")
    key = F.when(F.col("rejected").isNull(), F.concat_ws("-", stamp, box, F.lpad(F.col("hour").cast("string"), 3, "0")))
    return rows.select("area_id", "cycle_ms", "hour", key.alias("key"), "rejected")


def stale_ids(wanted: DataFrame, valid: DataFrame) -> DataFrame:
    """Ids that are wanted and no longer there."""
    return wanted.select("id").distinct().join(valid.select("id"), "id", "left_anti")


def reusable(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, mtime, reuse): whether a scanned file's decoded entry is still good: same path and time."""
    known = cache.select("path", "mtime", F.lit(True).alias("reuse")).distinct()
    return files.select("path", "mtime").join(known, ["path", "mtime"], "left").fillna(False, ["reuse"])


def usable(files: DataFrame, departure_ms: int, enabled: list[str] | None = None) -> DataFrame:
    """Files that reach the departure, and are enabled or fetched by the engine itself."""
    rows = files.filter(F.col("end_ms") >= departure_ms)
    return rows if enabled is None else rows.filter(F.col("path").isin(enabled) | F.col("path").startswith("auto-"))


#: Where a vessel's draft is kept, in order, besides a configured place.
DRAFT_PATHS = ("design.draft.current", "design.draft.maximum", "design.draft.minimum")


def vessel_draft(values: DataFrame, configured: DataFrame, standard: bool = True) -> DataFrame:
    """(vessel_id, path, draft_m): of each vessel the first positive finite number among its own place and the standard ones.

    Values: (vessel_id, path, value); configured: (vessel_id, path), null or
    empty for none.  A place that is named twice counts once, where it is
    first; vessels without a number have no row.
    """
    listed = F.concat(F.array("path"), F.array(*map(F.lit, DRAFT_PATHS)) if standard else F.array().cast("array<string>"))
    paths = F.array_distinct(F.filter(listed, lambda p: p.isNotNull() & (p != "")))
    asked = configured.select("vessel_id", F.posexplode(paths).alias("place", "path"))
    good = values.filter(finite(F.col("value").cast("double")) & (F.col("value") > 0))
    best = asked.join(good, ["vessel_id", "path"]).groupBy("vessel_id").agg(F.min_by(F.struct("path", "value"), "place").alias("b"))
    return best.select("vessel_id", "b.path", F.col("b.value").cast("double").alias("draft_m"))


def departure_error(files: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, error) of requests (request_id, departure_ms): whether the forecast reaches the departure and begins before it."""
    span = files.agg(F.min("start_ms").alias("_first"), F.max("end_ms").alias("_last"))
    error = F.when(F.col("_last").isNull() | (F.col("departure_ms") > F.col("_last")), "forecast ends before").when(F.col("departure_ms") < F.col("_first"), "forecast starts after")
    return requests.join(F.broadcast(span)).select("request_id", error.alias("error"))  # span is one row


def progress(fractions: DataFrame) -> DataFrame:
    """(request_id, percent) of parts (request_id, fraction): their mean, each held between 0 and 1; none: all done."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fraction")))
    return fractions.groupBy("request_id").agg((F.coalesce(F.avg(held), F.lit(1.0)) * 100).alias("percent"))


def step_summary(steps: DataFrame, fields: list[str]) -> DataFrame:
    """(field, least, most, total) of numbers kept for every step of a search."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])
    return steps.select(F.inline(pairs)).groupBy("field").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.sum("x").alias("total"))


def nearest_rank(samples: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Per group the mean, extremes and nearest-rank percentiles.

    Equal values are counted first; running counts go block by block over the
    values in order, so no task holds a whole group.
    """
    rows = samples.select(F.col(by).alias("_by"), F.col(value).alias("_value"))
    stats = rows.groupBy("_by").agg(F.avg("_value").alias("mean"), F.min("_value").alias("least"), F.max("_value").alias("most"), F.count("_value").alias("_all"))
    counts = rows.filter("_value is not null").groupBy("_by", "_value").agg(F.count("*").alias("_n"))
    blocks = written(counts.repartitionByRange("_by", "_value").withColumn("_block", F.spark_partition_id()))
    before = W.partitionBy("_by").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.groupBy("_by", "_block").agg(F.sum("_n").alias("_sum")).select(F.col("_by").alias("_of"), F.col("_block").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_by", "_block").orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
    placed = blocks.withColumn("_own", F.sum("_n").over(inside)).join(offsets, F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_at")))
    placed = placed.select("_by", "_value", (F.col("_own") + F.col("_offset")).alias("_to"), "_n")
    sizes = stats.select(F.col("_by").alias("_of"), "_all")
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.col("_all") * p))
    hit = lambda p: F.when((F.col("_to") >= rank(p)) & (F.col("_to") - F.col("_n") < rank(p)), F.col("_value"))
    names = [f"p{round(p * 100)}" for p in shares]
    found = placed.join(sizes, F.col("_by").eqNullSafe(F.col("_of"))).groupBy(F.col("_by").alias("_of")).agg(*[F.max(hit(p)).alias(n) for p, n in zip(shares, names, strict=True)])
    return stats.join(found, F.col("_by").eqNullSafe(F.col("_of")), "left").select(F.col("_by").alias(by), "mean", *names, "least", "most")
