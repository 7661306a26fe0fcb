"""Forecast files: priority, selection, time axes, sampling and overlays.

Files: (path, type, reference_ms, start_ms, end_ms, n_times, lat_min, lat_max,
lon_min, lon_max, lat_step, lon_step, mtime).  Frames: (path, frame, valid_ms).
Cells: (path, frame, i, j, values), row 0 in the south.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagekit.functions.numbers import half_up
from passagekit.operators.scratch import by_size, written

#: The mean step of a file with fewer than two times; bounds of a valid wave height.
NO_STEP = 9007199254740991
WAVE_BELOW = 100.0


def mean_step(start: Column, end: Column, n: Column) -> Column:
    return F.when(n < 2, F.lit(NO_STEP).cast("double")).otherwise((end - start) / (n - 1))


def ranked(files: DataFrame) -> DataFrame:
    """``files`` with ``rank`` in each type: newest run, finest time step, finest grid, newest file, then path."""
    order = W.partitionBy("type").orderBy(
        F.desc("reference_ms"), mean_step(F.col("start_ms"), F.col("end_ms"), F.col("n_times")), "lat_step", F.desc("mtime"), "path"
    )
    return files.withColumn("rank", F.row_number().over(order))


def priority() -> Column:
    """The order of ``ranked`` as one value, for minima without a window over all files."""
    return F.struct(
        (-F.col("reference_ms")).alias("run"), mean_step(F.col("start_ms"), F.col("end_ms"), F.col("n_times")).alias("step"), F.col("lat_step").alias("grid"),
        (-F.col("mtime")).alias("age"), F.col("path").alias("name"),
    )


def _degree_cells(low_lat: Column, high_lat: Column, low_lon: Column, high_lon: Column) -> tuple[Column, Column]:
    whole = lambda x: F.floor(x).cast("long")
    return F.sequence(whole(low_lat), whole(high_lat)), F.sequence(whole(low_lon), whole(high_lon))


DAY_MS = 86_400_000


EXTENT = ("lat_min", "lat_max", "lon_min", "lon_max", "start_ms", "end_ms")


def foremost(files: DataFrame) -> DataFrame:
    """Of files with the same box and period the best: where one of them is, no other is chosen."""
    rest = [c for c in files.columns if c not in EXTENT]
    return files.groupBy(*EXTENT).agg(F.min_by(F.struct(*rest), priority()).alias("f")).select(*EXTENT, "f.*").select(*files.columns)


def _filed(files: DataFrame) -> DataFrame:
    """``files`` once for each one-degree cell of their box and day of their period."""
    rows, columns = _degree_cells(F.col("lat_min"), F.col("lat_max"), F.col("lon_min"), F.col("lon_max"))
    day = lambda t: F.floor(F.col(t) / DAY_MS).cast("long")
    return files.withColumn("cy", F.explode(rows)).withColumn("cx", F.explode(columns)).withColumn("day", F.explode(F.sequence(day("start_ms"), day("end_ms"))))


def chosen(points: DataFrame, files: DataFrame, what: Column) -> DataFrame:
    """Points (id, lat, lon, t_ms) with ``what`` of the file of best rank that covers each in space and time as ``f``; null where none does.

    A cell and day has the list of its files, the best first, up to the first
    that holds all of it: none after that can be chosen. A point meets one
    list, so rows are neither multiplied nor grouped.
    """
    c, cell = F.col, ["cy", "cx", "day"]
    holds = (
        (c("lat_min") <= c("cy")) & (c("lat_max") >= c("cy") + 1) & (c("lon_min") <= c("cx")) & (c("lon_max") >= c("cx") + 1)
        & (c("start_ms") <= c("day") * DAY_MS) & (c("end_ms") >= (c("day") + 1) * DAY_MS)
    )
    filed = _filed(foremost(files)).select(*cell, priority().alias("order"), *EXTENT, what.alias("what"), holds.alias("holds"))
    filed = filed.withColumn("most", F.min(F.when(c("holds"), c("order"))).over(W.partitionBy(*cell))).filter("most is null or order <= most")
    lists = by_size(filed.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("order", *EXTENT, "what"))).alias("files")), F.size("files"))
    inside = lambda f: (
        c("lat").between(f["lat_min"], f["lat_max"]) & c("lon").between(f["lon_min"], f["lon_max"]) & c("t_ms").between(f["start_ms"], f["end_ms"])
    )
    at = points.select("id", "lat", "lon", "t_ms", F.floor("lat").alias("cy"), F.floor("lon").alias("cx"), F.floor(c("t_ms") / DAY_MS).cast("long").alias("day"))
    return at.join(lists, cell, "left").select("id", "lat", "lon", "t_ms", F.get(F.filter("files", inside), F.lit(0))["what"].alias("f"))


def select_file(points: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path): the file of best rank that covers each point; an empty path where none does."""
    return chosen(points, files, F.col("path")).select("id", F.coalesce("f", F.lit("")).alias("path"))


def _grid() -> Column:
    n = lambda a, b, s: (F.round((F.col(b) - F.col(a)) / F.col(s)) + 1).cast("int")
    return F.struct("path", "start_ms", "step_ms", "n_times", "lat_min", "lat_step", n("lat_min", "lat_max", "lat_step").alias("n_lat"), "lon_min", "lon_step", n("lon_min", "lon_max", "lon_step").alias("n_lon"))


def _with_frame(best: DataFrame, *more: str) -> DataFrame:
    """The chosen file ``f``, opened, and its frame nearest in time, the earlier of two."""
    frame = F.greatest(F.lit(0), F.least(F.col("f.n_times") - 1, F.ceil((F.col("t_ms") - F.col("f.start_ms")) / F.col("f.step_ms") - 0.5)))
    kept = [F.col(f"f.{c}") for c in ("path", "lat_min", "lat_step", "n_lat", "lon_min", "lon_step", "n_lon")]
    return best.select("id", "lat", "lon", F.when(F.col("f").isNotNull(), frame.cast("int")).alias("frame"), *kept, *more)


def placed(points: DataFrame, files: DataFrame) -> DataFrame:
    """(id, lat, lon, path, frame, and the file's grid) of points (id, lat, lon, t_ms): the best file and its frame nearest in time, the earlier of two; nulls where none covers.

    For files with an even time step.
    """
    return _with_frame(chosen(points, files, _grid()))


def placed_within(points: DataFrame, files: DataFrame) -> DataFrame:
    """``placed`` of the points (id, lat, lon, t_ms, reach_nm) that a file covers, with ``boxes``: those of all files of the time within reach.

    A point meets files under the cells of its reach: whether a place near it
    is covered is then told from its row.
    """
    c, pad = F.col, F.col("reach_nm") / 59.0
    over = pad / F.greatest(F.lit(0.01), F.cos(F.radians("lat")))
    day = lambda t: F.floor(c(t) / DAY_MS).cast("long")
    near_rows, near_columns = _degree_cells(c("lat") - c("_up"), c("lat") + c("_up"), c("lon") - c("_over"), c("lon") + c("_over"))
    at = points.select("id", "lat", "lon", "t_ms", pad.alias("_up"), over.alias("_over"))
    at = at.withColumn("cy", F.explode(near_rows)).withColumn("cx", F.explode(near_columns)).withColumn("day", day("t_ms"))
    within = lambda x, low, high, by: (c(high) >= c(x) - c(by)) & (c(low) <= c(x) + c(by))
    known = files.__dict__  # a search asks the same files at every step
    if "_filed" not in known:
        known["_filed"] = by_size(_filed(foremost(files)))
    met = at.join(known["_filed"], ["cy", "cx", "day"]).filter(c("t_ms").between(c("start_ms"), c("end_ms")) & within("lat", "lat_min", "lat_max", "_up") & within("lon", "lon_min", "lon_max", "_over"))
    own = c("lat").between(c("lat_min"), c("lat_max")) & c("lon").between(c("lon_min"), c("lon_max"))
    box = F.struct("lat_min", "lat_max", "lon_min", "lon_max")
    best = met.groupBy("id", "lat", "lon", "t_ms").agg(F.min_by(F.when(own, _grid()), F.when(own, priority())).alias("f"), F.collect_set(box).alias("boxes"))
    return _with_frame(best.filter("f is not null"), "boxes")


def frames(files: DataFrame) -> DataFrame:
    """(path, frame, valid_ms) of files with an even time step."""
    return files.select("path", F.explode(F.sequence(F.lit(0), F.col("n_times") - 1)).alias("frame"), "start_ms", "step_ms").select(
        "path", "frame", (F.col("start_ms") + F.col("frame") * F.col("step_ms")).alias("valid_ms")
    )


def nearest_frame(points: DataFrame, frames_: DataFrame) -> DataFrame:
    """(id, path, frame): the frame of the point's file (id, path, t_ms) nearest in time, the earlier of two.

    A file's times are one short array, so a point meets one row.
    """
    axes = frames_.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("valid_ms", "frame"))).alias("axis"))
    gaps = F.transform("axis", lambda x: F.struct(F.abs(x["valid_ms"] - F.col("t_ms")).alias("gap"), x["valid_ms"].alias("at"), x["frame"].alias("frame")))
    return points.join(axes, "path").select("id", "path", F.array_min(gaps)["frame"].alias("frame"))


def time_axis(frames_: DataFrame) -> DataFrame:
    """Distinct times of all files, numbered in order; times are few beside cells and points."""
    return frames_.select("valid_ms").distinct().withColumn("axis_idx", F.row_number().over(W.orderBy("valid_ms")) - 1)


def resampled_axis(files: DataFrame, step_ms: int) -> DataFrame:
    """(path, valid_ms) of each file's axis at ``step_ms``: from the first time on, and the last time."""
    last = F.col("start_ms") + (F.col("n_times") - 1) * F.col("step_ms")
    steps = F.filter(F.sequence(F.col("start_ms"), last, F.lit(step_ms)), lambda t: t < last)
    return files.select("path", F.explode(F.concat(steps, F.array(last))).alias("valid_ms"))


def departure_axis(frames_: DataFrame, departures: DataFrame) -> DataFrame:
    """(path, valid_ms): the departure (path, departure_ms), then the frames after it."""
    later = frames_.join(departures, "path").filter(F.col("valid_ms") > F.col("departure_ms")).select("path", "valid_ms")
    return departures.select("path", F.col("departure_ms").alias("valid_ms")).unionByName(later)


#: Corners of a point's cell, north and east of its base.
CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))


def _based(points: DataFrame) -> DataFrame:
    """Points with the base (i, j) of their cell on their file's grid and the weights of its ``CORNERS``.

    The cell is clamped to the grid, its fraction is not: outside, the sample
    extrapolates.  Points carry lat_min, lat_step, n_lat and the same for lon.
    """

    def axis(value: str, low: str, step: str, n: str) -> tuple[Column, Column]:
        place = (F.col(value) - F.col(low)) / F.col(step)
        base = F.greatest(F.lit(0), F.least(F.floor(place), F.col(n) - 2)).cast("int")
        return base, place - base

    i, y = axis("lat", "lat_min", "lat_step", "n_lat")
    j, x = axis("lon", "lon_min", "lon_step", "n_lon")
    rows = points.withColumns({"i": i, "j": j, "_y": y, "_x": x})
    part = lambda a, b: (F.col("_y") if a else 1 - F.col("_y")) * (F.col("_x") if b else 1 - F.col("_x"))
    return rows.withColumns({f"_w{k}": part(*corner) for k, corner in enumerate(CORNERS)}).drop("_y", "_x")


def _quads(cells: DataFrame, values: list[str]) -> DataFrame:
    """(path, frame, i, j, quad): of every base the ``values`` at its ``CORNERS``, so that a point meets one row."""
    items = F.array(*[F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.lit(k).alias("k")) for k, (a, b) in enumerate(CORNERS)])
    rows = cells.select("path", "frame", *values, F.inline(items)).filter("i >= 0 and j >= 0")
    at = lambda v, k: F.max(F.when(F.col("k") == k, F.col(v))).alias(f"_{v}{k}")
    return rows.groupBy("path", "frame", "i", "j").agg(*[at(v, k) for v in values for k in range(len(CORNERS))])


def _met(points: DataFrame, cells: DataFrame, values: list[str], how: str) -> DataFrame:
    return _based(points).join(by_size(_quads(cells, values)), ["path", "frame", "i", "j"], how)


def _weighted(value: str) -> Column:
    """The weighted sum of the corners that there are; null without any."""
    parts = [F.col(f"_w{k}") * F.col(f"_{value}{k}") for k in range(len(CORNERS))]
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0))))


def _weighted_fit(value: str) -> Column:
    """The same by the corners whose value is a wave height, the weights renormalised; null without any."""
    parts = []
    for k in range(len(CORNERS)):
        v = F.col(f"_{value}{k}")
        fit = v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < WAVE_BELOW)
        parts.append((F.when(fit, F.col(f"_w{k}")).otherwise(0.0), F.when(fit, F.col(f"_w{k}") * v).otherwise(0.0)))
    weight, whole = (sum((p[n] for p in parts[1:]), parts[0][n]) for n in (0, 1))
    return F.when(weight > 0, whole / weight)


def bilinear(points: DataFrame, cells: DataFrame, values: list[str]) -> DataFrame:
    """(id, values): the weighted sum of the four corners."""
    return _met(points, cells, values, "inner").select("id", *[_weighted(v).alias(v) for v in values])


def bilinear_masked(points: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """(id, value): corners that are not finite, negative or 100 or more are left out and the weights renormalised; none left: null."""
    return _met(points, cells, [value], "left").select("id", _weighted_fit(value).alias(value))


def with_grid(points: DataFrame, files: DataFrame) -> DataFrame:
    """Points (path) with the grid of their file."""
    steps = lambda a, b, s: (F.round((F.col(b) - F.col(a)) / F.col(s)) + 1).cast("int")
    grids = files.select(
        "path", "lat_min", "lat_step", steps("lat_min", "lat_max", "lat_step").alias("n_lat"), "lon_min", "lon_step", steps("lon_min", "lon_max", "lon_step").alias("n_lon")
    )
    return points.join(grids, "path")


#: Cells as a table, or as what gives those of the frames (path, frame) that are asked for.
Cells = DataFrame | Callable[[DataFrame], DataFrame]


def _cells(cells: Cells, at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and the cells of their frames alone."""
    if isinstance(cells, DataFrame):
        return at, cells
    at = written(at)
    return at, cells(at.filter("path is not null").select("path", "frame").distinct())


def sample(points: DataFrame, files: DataFrame, cells: Cells, values: list[str]) -> DataFrame:
    """(id, path, frame, values) of points (id, lat, lon, t_ms): best file, nearest frame, bilinear; 0 and an empty path where none covers."""
    at, cells = _cells(cells, placed(points, files))
    zero = lambda v: F.coalesce(_weighted(v), F.lit(0.0)).alias(v)
    return _met(at, cells, values, "left").select("id", F.coalesce("path", F.lit("")).alias("path"), "frame", *map(zero, values))


def sample_wave(points: DataFrame, files: DataFrame, cells: Cells, value: str = "swh") -> DataFrame:
    """(id, lat, lon, value) of points that a file covers: the wave height by the corners that have one, null where none has."""
    at, cells = _cells(cells, placed(points, files).filter("path is not null"))
    return _met(at, cells, [value], "left").select("id", "lat", "lon", _weighted_fit(value).alias(value))


def sample_weather(points: DataFrame, files: DataFrame, cells: Cells, wave: str = "swh") -> DataFrame:
    """(id, path, u, v, wave) of points (id, lat, lon, t_ms) that a file covers: wind and wave from one visit of its four cells.

    Points with reach_nm get ``boxes`` too, as of ``placed_within``.
    """
    wide = "reach_nm" in points.columns
    at, cells = _cells(cells, placed_within(points, files) if wide else placed(points, files).filter("path is not null"))
    wind = [F.coalesce(_weighted(n), F.lit(0.0)).alias(n) for n in ("u", "v")]
    return _met(at, cells, ["u", "v", wave], "left").select("id", "path", *wind, _weighted_fit(wave).alias("wave"), *(["boxes"] if wide else []))


def grid_bounds(files: DataFrame) -> DataFrame:
    """The union of the boxes at the finest steps; n counts intervals."""
    box = files.agg(
        F.min("lat_min").alias("lat_min"), F.max("lat_max").alias("lat_max"), F.min("lon_min").alias("lon_min"), F.max("lon_max").alias("lon_max"),
        F.min("lat_step").alias("lat_step"), F.min("lon_step").alias("lon_step"),
    )
    n = lambda a, b, s: F.floor((F.col(b) - F.col(a)) / F.col(s) + 0.5).cast("long")
    return box.withColumn("n_lat", n("lat_min", "lat_max", "lat_step")).withColumn("n_lon", n("lon_min", "lon_max", "lon_step"))


def overlay_points(files: DataFrame, t_ms: int) -> DataFrame:
    """(id, lat, lon, t_ms): the inclusive grid over the bounds of ``files``."""
    line = lambda low, step, n: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n)), lambda k: F.col(low) + k * F.col(step))
    grid = grid_bounds(files).select(F.explode(line("lat_min", "lat_step", "n_lat")).alias("lat"), line("lon_min", "lon_step", "n_lon").alias("lons"))
    grid = grid.select("lat", F.explode("lons").alias("lon"))
    return grid.select(F.concat_ws(",", "lat", "lon").alias("id"), "lat", "lon", F.lit(t_ms).cast("long").alias("t_ms"))


def wind_grid(files: DataFrame, cells: Cells, t_ms: int) -> DataFrame:
    """(lat, lon, u, v) over the covered part of the grid, rounded for display."""
    points = overlay_points(files, t_ms)
    found = sample(points, files, cells, ["u", "v"]).filter("path <> ''").join(points.select("id", "lat", "lon"), "id")
    return found.select(half_up(F.col("lat"), 4).alias("lat"), half_up(F.col("lon"), 4).alias("lon"), half_up(F.col("u"), 2).alias("u"), half_up(F.col("v"), 2).alias("v"))


def wave_grid(files: DataFrame, cells: Cells, t_ms: int) -> DataFrame:
    """(lat, lon, wave) over the covered part of the grid, rounded for display."""
    rows = sample_wave(overlay_points(files, t_ms), files, cells)
    return rows.select(half_up(F.col("lat"), 4).alias("lat"), half_up(F.col("lon"), 4).alias("lon"), half_up(F.col("swh"), 3).alias("wave"))


def combination(files: DataFrame, now_ms: int, departure_ms: int | None = None) -> DataFrame:
    """(path, recommended, reason): which files to use.

    Files out of scope name why; of the others one is redundant if a file of
    better rank covers all of it, which names the best such file.  Containment
    is transitive, so that file is itself recommended.
    """
    if departure_ms is None:
        fits = F.col("end_ms") >= now_ms
        why = F.concat(F.lit("ended hours ago: "), F.floor((now_ms - F.col("end_ms")) / 3600000 + 0.5).cast("string"))
    else:
        fits, why = F.lit(departure_ms).between(F.col("start_ms"), F.col("end_ms")), F.lit("departure outside its period")
    known = files.select("path", *EXTENT, F.coalesce(fits, F.lit(False)).alias("fits"), why.alias("why"), priority().alias("order"))
    # files of one box and period are held by the same others, so one of them stands for all
    boxes = written(known.filter("fits").groupBy(*EXTENT).agg(F.min("order").alias("order")).withColumn("place", F.struct(*EXTENT)))
    cell = ["cy", "cx", "day"]
    outer = by_size(_filed(boxes).select(*cell, *[F.col(c).alias(f"o_{c}") for c in ("order", *EXTENT)]))
    inner = boxes.withColumns({"cy": F.floor("lat_min"), "cx": F.floor("lon_min"), "day": F.floor(F.col("start_ms") / DAY_MS).cast("long")})
    holds = (
        (F.col("o_start_ms") <= F.col("start_ms")) & (F.col("o_end_ms") >= F.col("end_ms"))
        & (F.col("o_lat_min") <= F.col("lat_min")) & (F.col("o_lat_max") >= F.col("lat_max"))
        & (F.col("o_lon_min") <= F.col("lon_min")) & (F.col("o_lon_max") >= F.col("lon_max"))
    )
    held = inner.join(outer, cell).filter(holds).groupBy("place").agg(F.min("o_order").alias("best"))
    held = by_size(held.select("place.*", "best"))
    out = known.join(held, list(EXTENT), "left")
    by = F.when(F.col("best") < F.col("order"), F.col("best")["name"])
    reason = F.when(~F.col("fits"), F.col("why")).when(by.isNotNull(), F.concat(F.lit("covered by "), by)).otherwise("")
    return out.select("path", (F.col("fits") & by.isNull()).alias("recommended"), reason.alias("reason"))


def expired(files: DataFrame, now_ms: int) -> DataFrame:
    """Files whose period is over: the ones to archive."""
    return files.filter(F.col("end_ms") < now_ms)


def freshest(files: DataFrame) -> DataFrame:
    """The one current file with the newest modification time."""
    return files.filter("type = 'current'").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def current_frames(files: DataFrame) -> DataFrame:
    """(path, frame) of the freshest current file."""
    return frames(files.join(F.broadcast(freshest(files)), "path")).select("path", "frame")  # one row


def currents_at(points: DataFrame, files: DataFrame, cells: Cells) -> DataFrame:
    """(id, u, v) of points (id, lat, lon, t_ms): the freshest current file, its nearest frame, bilinear; outside it and without one 0.

    For files with an even time step.  Of cells given as what gives them, those of that file alone are made.
    """
    best = files.join(F.broadcast(freshest(files)), "path").select(_grid().alias("f"), "lat_max", "lon_max")  # one row
    inside = F.col("lat").between(F.col("f.lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("f.lon_min"), F.col("lon_max"))
    at = _with_frame(points.select("id", "lat", "lon", "t_ms").join(F.broadcast(best), inside, "left"))
    wanted = current_frames(files)
    own = cells.join(F.broadcast(wanted.select("path").distinct()), "path") if isinstance(cells, DataFrame) else cells(wanted)
    return _met(at, own, ["u", "v"], "left").select("id", *[F.coalesce(_weighted(v), F.lit(0.0)).alias(v) for v in ("u", "v")])


#: Fixed value: a current of a smaller square is land or fill and is not shown.
NO_CURRENT = 1e-4


def current_grid(files: DataFrame, cells: DataFrame, t_ms: int) -> DataFrame:
    """(lat, lon, u, v) of the nodes of the freshest current file at its frame nearest to ``t_ms``, where there is a current."""
    best = files.join(F.broadcast(freshest(files)), "path")  # one row
    frame = nearest_frame(best.select(F.col("path").alias("id"), "path", F.lit(t_ms).cast("long").alias("t_ms")), frames(best)).drop("id")
    nodes = cells.join(F.broadcast(frame), ["path", "frame"]).join(F.broadcast(best.select("path", "lat_min", "lat_step", "lon_min", "lon_step")), "path")
    nodes = nodes.filter(F.col("u") * F.col("u") + F.col("v") * F.col("v") >= NO_CURRENT)
    at = lambda low, step, k: half_up(F.col(low) + F.col(k) * F.col(step), 4)
    return nodes.select(at("lat_min", "lat_step", "i").alias("lat"), at("lon_min", "lon_step", "j").alias("lon"), "u", "v")
