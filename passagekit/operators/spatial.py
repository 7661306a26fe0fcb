"""Coastlines: segments, points and distances against edges filed under grid cells.

Edges: (poly_id, ring_id, lat1, lon1, lat2, lon2), ring 0 outside and others
water.  Segments: (id, lat1, lon1, lat2, lon2).  Points: (id, lat, lon).
Nothing crosses the antimeridian.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekit.functions.geo import NM_PER_DEGREE, distance_nm, half_turn, local_xy
from passagekit.operators.scratch import by_size

#: Sides of the edge cells and of the polygon cells, degrees; parallels below it do not cross.
EDGE_CELL, POLY_CELL, PARALLEL = 0.1, 1.0, 1e-12
#: Degrees by which rounding may move a line across a cell's side.
WALK_SLACK = 1e-9


def cell_key(row: Column, column: Column) -> Column:
    """One number for a 0.1 degree cell; columns wrap."""
    return ((row + 900) * 3600 + F.pmod(column, F.lit(3600))).cast("long")


def _filed(rows: DataFrame, pad_lat: Column | float = 0.0, pad_lon: Column | float = 0.0, size: float = EDGE_CELL) -> DataFrame:
    """``rows`` once for each cell of ``size`` degrees that their line passes, or comes as near to as the pads.

    Row by row of cells: the part of the line between the row's parallels,
    wider by the pad, spans the columns.  Cells grow with a line's length and
    not with its box; a line along a cell's side is in the cells of both
    sides' rounding, so the list is never short of a cell.
    """
    c = F.col
    row = lambda x: F.floor(x / size)
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    rows = rows.withColumn("_r", F.explode(F.sequence(row(low - pad_lat), row(high + pad_lat))))
    # the line's share in the row, as parts of its length; level lines are whole in it
    part = lambda lat: F.when(c("lat1") == c("lat2"), None).otherwise((lat - c("lat1")) / (c("lat2") - c("lat1")))
    south, north = part(c("_r") * size - pad_lat - WALK_SLACK), part((c("_r") + 1) * size + pad_lat + WALK_SLACK)
    clipped = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    rows = rows.withColumn("_a", clipped(F.coalesce(F.least(south, north), F.lit(0.0)))).withColumn("_b", clipped(F.coalesce(F.greatest(south, north), F.lit(1.0))))
    at = lambda k: c("lon1") + (c("lon2") - c("lon1")) * c(k)
    west, east = F.least(at("_a"), at("_b")) - pad_lon - WALK_SLACK, F.greatest(at("_a"), at("_b")) + pad_lon + WALK_SLACK
    rows = rows.withColumn("_c", F.explode(F.sequence(row(west), row(east))))
    return rows.withColumn("cell", cell_key(c("_r"), c("_c"))).drop("_r", "_c", "_a", "_b")


def edge_cells(edges: DataFrame) -> DataFrame:
    """(cell, and the edge): the index to write, clustered by cell."""
    return _filed(edges)


def _index(edges: DataFrame, size: float = EDGE_CELL) -> DataFrame:
    """``edges`` under their cells, as the side of a join that is copied or merged by its real size; made once for a table that is asked again."""
    known = edges.__dict__.setdefault("_filed_by", {})
    if size not in known:
        known[size] = by_size(_as_edges(_filed(edges, size=size)))
    return known[size]


def edges_near(points: DataFrame, edges: DataFrame, nominal_nm: float) -> DataFrame:
    """(id, near): of points (id, lat, lon, reach_nm) with edges whose box is within reach, those edges as one list.

    Cells are as wide as ``nominal_nm``, about what most points reach.  A list
    holds the coast in a place's own surroundings: its size goes with the
    reach and the coast's detail, not with the number of rows.
    """
    c, pad = F.col, F.col("reach_nm") / NM_PER_DEGREE
    size = EDGE_CELL * max(1, round(nominal_nm / NM_PER_DEGREE / EDGE_CELL))
    spots = points.select("id", c("lat").alias("lat1"), c("lon").alias("lon1"), c("lat").alias("lat2"), c("lon").alias("lon2"), pad.alias("_up"), (pad / F.greatest(F.lit(0.01), F.cos(F.radians("lat")))).alias("_over"))
    filed = _filed(spots, c("_up"), c("_over"), size).select("id", "cell", c("lat1").alias("lat"), c("lon1").alias("lon"), "_up", "_over")
    met = filed.join(_index(edges, size), "cell")
    within = lambda e, at, by: (F.least(f"e_{e}1", f"e_{e}2") <= c(at) + c(by)) & (F.greatest(f"e_{e}1", f"e_{e}2") >= c(at) - c(by))
    item = F.struct("e_lat1", "e_lon1", "e_lat2", "e_lon2", (F.coalesce("region", F.lit(False)) if "region" in edges.columns else F.lit(False)).alias("region"))
    return met.filter(within("lat", "lat", "_up") & within("lon", "lon", "_over")).groupBy("id").agg(F.collect_set(item).alias("near"))


def with_shore(rows: DataFrame, a: tuple[str, str], b: tuple[str, str], name: str) -> DataFrame:
    """``rows`` with the least distance of the segment between columns a and b (latitude, longitude) to the coasts of their list ``near``; none: null.

    On the segment's own plane, as ``shore_distances``; every stage is
    computed once, since each is used many times by the next.
    """
    from passagekit.operators.isochrone import _barrier

    c = F.col
    xy = lambda lat, lon: local_xy(lat, lon, (c(a[0]) + c(b[0])) / 2, c(a[1]))
    (px, py), (qx, qy) = xy(c(a[0]), c(a[1])), xy(c(b[0]), c(a[1]) + half_turn(c(b[1]) - c(a[1])))
    rows = _barrier(rows, rows.columns, {"_px": px, "_py": py, "_qx": qx, "_qy": qy})

    def flat(e: Column) -> Column:
        (cx, cy), (dx, dy) = xy(e["e_lat1"], e["e_lon1"]), xy(e["e_lat2"], e["e_lon2"])
        return F.struct(cx.alias("cx"), cy.alias("cy"), dx.alias("dx"), dy.alias("dy"))

    rows = _barrier(rows, rows.columns, {"_flat": F.transform(F.filter("near", lambda e: ~e["region"]), flat)})
    p, q = (c("_px"), c("_py")), (c("_qx"), c("_qy"))

    def gap(e: Column) -> Column:
        one, two = (e["cx"], e["cy"]), (e["dx"], e["dy"])
        apart = F.least(_point_to_segment(*p, *one, *two), _point_to_segment(*q, *one, *two), _point_to_segment(*one, *p, *q), _point_to_segment(*two, *p, *q))
        return F.when(_touch(p, q, one, two), 0.0).otherwise(F.sqrt(apart))

    rows = _barrier(rows, rows.columns, {name: F.array_min(F.transform("_flat", gap))})
    return rows.drop("_px", "_py", "_qx", "_qy", "_flat")


def _as_edges(edges: DataFrame) -> DataFrame:
    return edges.select("cell", *[F.col(c).alias(f"e_{c}") for c in ("lat1", "lon1", "lat2", "lon2")], *[c for c in edges.columns if c in ("poly_id", "ring_id", "idx", "region_id", "region")])


def crosses(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    """Segments ab and cd, of (latitude, longitude), cross inside both: touching ends do not count, parallels never cross."""
    dx, dy = b[1] - a[1], b[0] - a[0]
    ex, ey = d[1] - c[1], d[0] - c[0]
    det = dx * ey - dy * ex
    ox, oy = c[1] - a[1], c[0] - a[0]
    t, s = (ox * ey - oy * ex) / det, (ox * dy - oy * dx) / det
    return (F.abs(det) >= PARALLEL) & (t > 0) & (t < 1) & (s > 0) & (s < 1)


def proper_crossing() -> Column:
    """The segment and the edge of a row cross."""
    at = lambda n: (F.col(f"{n}"), F.col(f"{n}".replace("lat", "lon")))
    return crosses(at("lat1"), at("lat2"), at("e_lat1"), at("e_lat2"))


def crossing_segments(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of segments that cross an edge."""
    met = _filed(segments.select("id", "lat1", "lon1", "lat2", "lon2")).join(_index(edges), "cell")
    return met.filter(proper_crossing()).select("id").distinct()


def clear_segments(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Segments that cross no edge."""
    return segments.join(crossing_segments(segments, edges), "id", "left_anti")


def _crossings(points: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(id, keys, n): edges of each ring that a ray to the east crosses.

    A point meets the areas (the first key) whose box has its one-degree cell,
    and of each area the edges filed under its row of latitude.
    """
    area = keys[0]
    low, high = (lambda c: F.min(F.least(f"{c}1", f"{c}2"))), (lambda c: F.max(F.greatest(f"{c}1", f"{c}2")))
    box = edges.groupBy(area).agg(low("lat").alias("a"), high("lat").alias("b"), low("lon").alias("c"), high("lon").alias("d"))
    cell = lambda c: F.floor(F.col(c) / POLY_CELL)
    boxes = box.withColumn("_y", F.explode(F.sequence(cell("a"), cell("b")))).withColumn("_x", F.explode(F.sequence(cell("c"), cell("d"))))
    near = points.select("id", "lat", "lon", cell("lat").alias("_y"), cell("lon").alias("_x")).join(by_size(boxes), ["_y", "_x"])
    near = near.filter(F.col("lat").between(F.col("a"), F.col("b")) & F.col("lon").between(F.col("c"), F.col("d")))
    row = lambda c: F.floor(F.col(c) / EDGE_CELL)
    filed = edges.withColumn("_r", F.explode(F.sequence(F.least(row("lat1"), row("lat2")), F.greatest(row("lat1"), row("lat2")))))
    at = near.select("id", area, "lat", "lon", row("lat").alias("_r"))
    astride = (F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))
    where = (F.col("lon2") - F.col("lon1")) * (F.col("lat") - F.col("lat1")) / (F.col("lat2") - F.col("lat1")) + F.col("lon1")
    return at.join(by_size(filed), [area, "_r"]).filter(astride & (F.col("lon") < where)).groupBy("id", *keys).agg(F.count("*").alias("n"))


def points_on_land(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of points inside an outer ring and no inner ring of it: even-odd."""
    inside = _crossings(points, edges, ["poly_id", "ring_id"]).filter("n % 2 = 1")
    by_polygon = inside.groupBy("id", "poly_id").agg(F.min("ring_id").alias("low"), F.max("ring_id").alias("high"))
    return by_polygon.filter("low = 0 and high = 0").select("id").distinct()


def points_in_regions(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, region_id): every ring of a region is a filled area."""
    return _crossings(points, edges, ["region_id", "ring_id"]).filter("n % 2 = 1").select("id", "region_id").distinct()


def segments_in_regions(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, region_id): segments that cross an edge of a region."""
    met = _filed(segments.select("id", "lat1", "lon1", "lat2", "lon2")).join(_index(edges), "cell")
    return met.filter(proper_crossing()).select("id", "region_id").distinct()


def _point_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / length)))
    x, y = px - (ax + t * dx), py - (ay + t * dy)
    return x * x + y * y


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _turns(a: tuple, b: tuple, c: tuple, d: tuple) -> list[Column]:
    return [_turn(*a, *b, *c), _turn(*a, *b, *d), _turn(*c, *d, *a), _turn(*c, *d, *b)]


def _touch(a: tuple, b: tuple, c: tuple, d: tuple, turns: list[Column] | None = None) -> Column:
    """Segments ab and cd share a point, ends included; ``turns``: theirs, if they are columns already."""
    abc, abd, cda, cdb = turns or _turns(a, b, c, d)
    on = lambda p, q, r: (
        (q[0] >= F.least(p[0], r[0]) - PARALLEL) & (q[0] <= F.greatest(p[0], r[0]) + PARALLEL)
        & (q[1] >= F.least(p[1], r[1]) - PARALLEL) & (q[1] <= F.greatest(p[1], r[1]) + PARALLEL)
    )
    small = lambda x: F.abs(x) <= PARALLEL
    ends = (small(abc) & on(a, c, b)) | (small(abd) & on(a, d, b)) | (small(cda) & on(c, a, d)) | (small(cdb) & on(c, b, d))
    return ends | (((abc > 0) != (abd > 0)) & ((cda > 0) != (cdb > 0)))


def shore_distances(segments: DataFrame, edges: DataFrame, within_nm: float) -> DataFrame:
    """(id, shore_nm) of segments with a coast within ``within_nm``: the least distance to an edge, on the segment's own plane.

    Every stage is columns of its own, since the next uses them many times;
    pairs whose boxes are farther apart go before any of them.
    """
    c = F.col
    pad_lat = within_nm / NM_PER_DEGREE
    size = EDGE_CELL * max(1, round(pad_lat / EDGE_CELL))  # cells as wide as the reach: a few for each segment whatever it is
    rows = segments.select("id", "lat1", "lon1", "lat2", (c("lon1") + half_turn(c("lon2") - c("lon1"))).alias("lon2"), ((c("lat1") + c("lat2")) / 2).alias("_mid"))
    rows = rows.withColumn("_cos", F.cos(F.radians("_mid"))).withColumn("_over", within_nm / (NM_PER_DEGREE * F.greatest(F.lit(0.01), c("_cos"))))
    xy = lambda lat, lon: (half_turn(c(lon) - c("lon1")) * NM_PER_DEGREE * c("_cos"), (c(lat) - c("_mid")) * NM_PER_DEGREE)
    pairs = lambda ends: {f"_{n}{axis}": value for n, (lat, lon) in ends.items() for axis, value in zip("xy", xy(lat, lon))}
    rows = rows.withColumns(pairs({"a": ("lat1", "lon1"), "b": ("lat2", "lon2")}))
    met = _filed(rows, F.lit(pad_lat), c("_over"), size).join(_index(edges, size), "cell")
    east = [half_turn(c(f"e_lon{k}") - c("lon1")) for k in (1, 2)]
    here = c("lon2") - c("lon1")
    met = met.filter(
        (F.least("e_lat1", "e_lat2") <= F.greatest("lat1", "lat2") + pad_lat + WALK_SLACK) & (F.greatest("e_lat1", "e_lat2") >= F.least("lat1", "lat2") - pad_lat - WALK_SLACK)
        & (F.least(*east) <= F.greatest(F.lit(0.0), here) + c("_over") + WALK_SLACK) & (F.greatest(*east) >= F.least(F.lit(0.0), here) - c("_over") - WALK_SLACK)
    )
    met = met.withColumns(pairs({"c": ("e_lat1", "e_lon1"), "d": ("e_lat2", "e_lon2")}))
    p, q, r, s = ((c(f"_{n}x"), c(f"_{n}y")) for n in "abcd")
    turns = {f"_t{k}": x for k, x in enumerate(_turns(p, q, r, s))}
    gaps = {f"_g{k}": _point_to_segment(*x) for k, x in enumerate(((*p, *r, *s), (*q, *r, *s), (*r, *p, *q), (*s, *p, *q)))}
    met = met.select("id", *[f"_{n}{axis}" for n in "abcd" for axis in "xy"], *[x.alias(n) for n, x in (turns | gaps).items()])
    nearest = met.select("id", F.when(_touch(p, q, r, s, [c(n) for n in turns]), 0.0).otherwise(F.sqrt(F.least(*gaps))).alias("shore_nm")).groupBy("id").agg(F.min("shore_nm").alias("shore_nm"))
    return nearest.filter(c("shore_nm") <= within_nm)


def has_clearance(segments: DataFrame, edges: DataFrame, minimum_nm: float) -> DataFrame:
    """(id, clear): no coast nearer than the minimum."""
    near = shore_distances(segments, edges, minimum_nm)
    return segments.select("id").join(near, "id", "left").select("id", (F.col("shore_nm").isNull() | (F.col("shore_nm") >= minimum_nm)).alias("clear"))


def offshore_samples(segments: DataFrame, maximum_nm: float) -> DataFrame:
    """(id, k, limit_nm, lat, lon): places along each segment and the distance each must keep."""
    length = distance_nm(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    n = F.greatest(F.lit(1), F.ceil(length / min(2.0, maximum_nm / 4.0))).cast("int")
    rows = segments.withColumn("n", n).withColumn("limit_nm", maximum_nm - length / n / 2.0)
    part = F.col("k") / F.col("n")
    return rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n")))).select(
        "id", "k", "limit_nm", (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * part).alias("lat"), (F.col("lon1") + half_turn(F.col("lon2") - F.col("lon1")) * part).alias("lon")
    )


def _nearest_edges(cells: DataFrame, edges: DataFrame, within_nm: float) -> DataFrame:
    """(_row, _col, near): of 0.1 degree cells the edges that may be the nearest to a place in them, within ``within_nm``.

    An edge is left out if another is nearer to every place of the cell: its
    least distance is beyond the other's greatest. Distances are those of the
    places' planes, whose scale of longitude is bounded by the cell's parallels.
    """
    c, half = F.col, EDGE_CELL / 2
    size = EDGE_CELL * max(1, round(within_nm / NM_PER_DEGREE / EDGE_CELL))
    south, north = (F.cos(F.radians((c("_row") + k) * EDGE_CELL)) for k in (0, 1))
    rows = cells.select("_row", "_col", ((c("_row") + 0.5) * EDGE_CELL).alias("lat1"), ((c("_col") + 0.5) * EDGE_CELL).alias("lon1"), F.least(south, north).alias("_low"), F.greatest(south, north).alias("_high"))
    rows = rows.withColumns({"lat2": c("lat1"), "lon2": c("lon1")})
    filed = _filed(rows, F.lit(within_nm / NM_PER_DEGREE + half), within_nm / (NM_PER_DEGREE * F.greatest(F.lit(0.01), c("_low"))) + half, size)
    met = filed.join(_index(edges, size), "cell")
    up, over = ([at(f"e_{n}{k}") - c(f"{n}1") for k in (1, 2)] for n, at in (("lat", c), ("lon", c)))
    over = [half_turn(x) for x in over]
    beyond = lambda d: F.greatest(F.lit(0.0), F.least(*d) - half, -F.greatest(*d) - half) * NM_PER_DEGREE
    length = lambda x, y: F.sqrt(x * x + y * y)
    least = length(beyond(over) * c("_low"), beyond(up))
    most = F.least(*[length((F.abs(x) + half) * NM_PER_DEGREE * c("_high"), (F.abs(y) + half) * NM_PER_DEGREE) for x, y in zip(over, up)])
    item = F.struct(least.alias("least"), c("e_lat1").alias("lat1"), c("e_lon1").alias("lon1"), c("e_lat2").alias("lat2"), c("e_lon2").alias("lon2"))
    lists = met.select("_row", "_col", item.alias("e"), most.alias("most")).groupBy("_row", "_col").agg(F.collect_set("e").alias("near"), F.least(F.min("most"), F.lit(within_nm)).alias("most"))
    return lists.select("_row", "_col", F.filter("near", lambda e: e["least"] <= c("most") + WALK_SLACK).alias("near"))


def with_nearest(points: DataFrame, edges: DataFrame, within_nm: float) -> DataFrame:
    """``points`` (lat, lon) with ``shore_nm``, the distance to the nearest coast on the place's own plane; null beyond ``within_nm``.

    As ``shore_distances`` of places, for wide reaches: a place meets one list
    of the few edges that can be the nearest in its cell, and is not grouped.
    """
    c = F.col
    rows = points.withColumns({"_row": F.floor(c("lat") / EDGE_CELL).cast("long"), "_col": F.floor(c("lon") / EDGE_CELL).cast("long"), "_cos": F.cos(F.radians("lat"))})
    lists = by_size(_nearest_edges(rows.select("_row", "_col").distinct(), edges, within_nm), F.size("near"))
    x = lambda lon: half_turn(lon - c("lon")) * NM_PER_DEGREE * c("_cos")
    y = lambda lat: (lat - c("lat")) * NM_PER_DEGREE
    flat = F.transform("near", lambda e: F.struct(x(e["lon1"]).alias("ax"), y(e["lat1"]).alias("ay"), x(e["lon2"]).alias("bx"), y(e["lat2"]).alias("by")))
    zero = F.lit(0.0)
    gaps = F.transform(flat, lambda e: _point_to_segment(zero, zero, e["ax"], e["ay"], e["bx"], e["by"]))
    rows = rows.join(lists, ["_row", "_col"], "left").withColumn("shore_nm", F.sqrt(F.array_min(gaps)))
    return rows.withColumn("shore_nm", F.when(c("shore_nm") <= within_nm, c("shore_nm"))).drop("_row", "_col", "_cos", "near")


def within_offshore(segments: DataFrame, edges: DataFrame, maximum_nm: float) -> DataFrame:
    """(id, within): every sample has a coast within the maximum less half a gap."""
    samples = with_nearest(offshore_samples(segments, maximum_nm), edges, maximum_nm)
    good = F.coalesce((F.col("limit_nm") > 0) & (F.col("shore_nm") <= F.col("limit_nm")), F.lit(False))
    return samples.groupBy("id").agg(F.bool_and(good).alias("within"))


def segments_on_land(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of segments that cross an edge, or begin or end on land."""
    ends = F.array(*[F.struct(F.struct("id", F.lit(n).alias("end")).alias("at"), F.col(f"lat{n}").alias("lat"), F.col(f"lon{n}").alias("lon")) for n in (1, 2)])
    spots = segments.select(F.inline(ends)).select(F.col("at").alias("id"), "lat", "lon")
    inside = points_on_land(spots, edges).select(F.col("id.id").alias("id"))
    return crossing_segments(segments, edges).unionByName(inside).distinct()


def with_boundary(edges: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float, poly_id: int = -1) -> DataFrame:
    """``edges`` and the four sides of the box they are known in, as a polygon of its own."""
    corners = [(lat_min, lon_min), (lat_min, lon_max), (lat_max, lon_max), (lat_max, lon_min)]
    sides = [(poly_id, 0, k, *a, *b) for k, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1]))]
    box = edges.sparkSession.createDataFrame(sides, "poly_id long, ring_id int, idx int, lat1 double, lon1 double, lat2 double, lon2 double")
    return edges.select("poly_id", "ring_id", "idx", "lat1", "lon1", "lat2", "lon2").unionByName(box)


#: Degrees that a route's box is wider than the route, and the box of the map.
PADDING_DEG, MAP_BOX = 0.5, (-85.0, 85.0, -180.0, 180.0)


def route_boxes(points: DataFrame) -> DataFrame:
    """(route_id, lat_min, lat_max, lon_min, lon_max) of points (route_id, lat, lon), padded and inside the map."""
    low = lambda c, end: F.greatest(F.lit(end), F.min(c) - PADDING_DEG)
    high = lambda c, end: F.least(F.lit(end), F.max(c) + PADDING_DEG)
    a, b, c, d = MAP_BOX
    return points.groupBy("route_id").agg(low("lat", a).alias("lat_min"), high("lat", b).alias("lat_max"), low("lon", c).alias("lon_min"), high("lon", d).alias("lon_max"))


def polygons_in_box(edges: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
    """(poly_id) of polygons whose box overlaps the box; one pass over the edges, summed before they are shuffled."""
    box = edges.groupBy("poly_id").agg(
        F.min(F.least("lat1", "lat2")).alias("a"), F.max(F.greatest("lat1", "lat2")).alias("b"), F.min(F.least("lon1", "lon2")).alias("c"), F.max(F.greatest("lon1", "lon2")).alias("d")
    )
    return box.filter((F.col("a") <= lat_max) & (F.col("b") >= lat_min) & (F.col("c") <= lon_max) & (F.col("d") >= lon_min)).select("poly_id")
