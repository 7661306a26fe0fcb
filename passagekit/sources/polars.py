"""Polar tables from settings and resource files in JSON: checked, with a reason for each one that is not used."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = "enabled boolean, configuration struct<activePolar: string, perfAdjust: string>"
RESOURCE = (
    "kind string, name string, units struct<tws: string, twa: string, boatSpeed: string>, symmetry struct<portStarboardSymmetric: boolean>, "
    "axes struct<tws: array<double>, twa: array<double>>, values struct<boatSpeedMatrix: array<array<double>>>"
)


def _finite(values: Column) -> Column:
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(values) > 0) & good, F.lit(False))


def _ascends(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values)) == values


def active(settings: DataFrame) -> DataFrame:
    """(vessel, polar_id, adjustment, reason) from each vessel's settings (vessel, settings): the polar in use, and the factor of its speeds.

    The factor is 1 unless a positive number is given.  ``reason`` is one of
    settings-unreadable, disabled, no-configuration, no-active-polar and
    invalid-id (a name with a folder in it).
    """
    text = F.col("settings")
    rows = settings.select("vessel", text, F.from_json(text, SETTINGS).alias("s"), F.get_json_object(text, "$.configuration").alias("c"))
    name, factor = F.col("s.configuration.activePolar"), F.expr("try_cast(s.configuration.perfAdjust as double)")
    reason = (
        F.when(F.coalesce(~F.get_json_object(text, "$").startswith("{"), F.lit(True)), "settings-unreadable")
        .when(~F.coalesce("s.enabled", F.lit(False)), "disabled")
        .when(F.coalesce(~F.col("c").startswith("{"), F.lit(True)), "no-configuration")
        .when(F.coalesce(name, F.lit("")) == "", "no-active-polar")
        .when(F.contains(name, F.lit("/")), "invalid-id")
    )
    fits = (factor > 0) & ~F.isnan(factor) & (factor != float("inf"))
    return rows.select("vessel", F.when(reason.isNull() | (reason == "invalid-id"), name).alias("polar_id"), F.when(fits, factor).otherwise(1.0).alias("adjustment"), reason.alias("reason"))


def checked(resources: DataFrame) -> DataFrame:
    """(polar_id, name, tws_ms, twa_rad, matrix, reason) of resources (polar_id, resource).

    ``reason`` is the first of: unreadable, kind, units, symmetry, axes (none,
    empty or with numbers that are not finite), axis-order (not ascending, or
    winds below zero, or angles outside 0 to pi), matrix (a shape other than
    the axes', or speeds below zero or not finite).
    """
    text = F.col("resource")
    rows = resources.select("polar_id", text, F.from_json(text, RESOURCE).alias("r"))
    tws, twa, matrix, units = F.col("r.axes.tws"), F.col("r.axes.twa"), F.col("r.values.boatSpeedMatrix"), F.col("r.units")
    line = lambda x: _finite(x) & (F.size(x) == F.size(twa)) & F.forall(x, lambda v: v >= 0)
    reason = (
        F.when(F.coalesce(~F.get_json_object(text, "$").startswith("{"), F.lit(True)), "unreadable")
        .when(~F.coalesce(F.col("r.kind") == "polarTable", F.lit(False)), "kind")
        .when(~F.coalesce((units["tws"] == "m/s") & (units["twa"] == "rad") & (units["boatSpeed"] == "m/s"), F.lit(False)), "units")
        .when(~F.coalesce("r.symmetry.portStarboardSymmetric", F.lit(False)), "symmetry")
        .when(~(_finite(tws) & _finite(twa)), "axes")
        .when(~(_ascends(tws) & _ascends(twa)) | (F.array_min(tws) < 0) | (F.array_min(twa) < 0) | (F.array_max(twa) > pi), "axis-order")
        .when(~F.coalesce((F.size(matrix) == F.size(tws)) & F.forall(matrix, line), F.lit(False)), "matrix")
    )
    name = F.trim(F.col("r.name"))
    return rows.select("polar_id", F.when(F.coalesce(name, F.lit("")) == "", F.col("polar_id")).otherwise(name).alias("name"), tws.alias("tws_ms"), twa.alias("twa_rad"), matrix.alias("matrix"), reason.alias("reason"))


def loaded(settings: DataFrame, resources: DataFrame) -> DataFrame:
    """Each vessel's polar in use: (vessel, polar_id, name, adjustment, tws_ms, twa_rad, matrix, reason); a resource that is not there has the reason no-resource.

    ``functions.polar.normalise`` takes the rows without a reason.
    """
    found = checked(resources).withColumn("there", F.lit(True)).withColumnRenamed("reason", "fault")
    rows = active(settings).join(found, "polar_id", "left")
    reason = F.coalesce("reason", F.when(F.col("there").isNull(), "no-resource"), "fault")
    return rows.select("vessel", "polar_id", "name", "adjustment", "tws_ms", "twa_rad", "matrix", reason.alias("reason"))


def read_resources(spark: SparkSession, folder: str) -> DataFrame:
    """(polar_id, resource) of the JSON files in a folder; the id is the file's name."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), "value")
    return files.select(F.regexp_replace("file", r"\.json$", "").alias("polar_id"), F.col("value").alias("resource"))
