"""DuckDB SQL for the queries, written apart from the operators it checks."""

from __future__ import annotations

from passagekit.plans.bindings import BASE_MS, POLAR, duck

NOW = BASE_MS + 4 * 86_400_000
DEPARTURE = BASE_MS + 6 * 86_400_000
R = 3440.065


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * {R} * atan2(sqrt({h}), sqrt(1 - {h})))"


def brg(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d} - {b})) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))"
    return f"((degrees(atan2({y}, {x})) + 360) % 360)"


def fold(a: str, b: str) -> str:
    return f"(CASE WHEN abs({a} - {b}) % 360 > 180 THEN 360 - abs({a} - {b}) % 360 ELSE abs({a} - {b}) % 360 END)"


def half_turn(x: str) -> str:
    return f"((({x}) + 540) % 360 - 180)"


FIX, FILE, EDGE = duck("fix"), duck("forecast_file"), duck("edge")
LEG = f"""(SELECT *, {hav('p_lat', 'p_lon', 'lat', 'lon')} AS leg_nm, t_ms - p_t AS elapsed,
 coalesce(t_ms > p_t AND {hav('p_lat', 'p_lon', 'lat', 'lon')} > 0.01 AND coalesce(speed, 0) > 0, FALSE) AS underway
 FROM (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(t_ms) OVER w AS p_t, lag(wind_from) OVER w AS p_from, lag(tws) OVER w AS p_tws
       FROM {FIX} f WINDOW w AS (PARTITION BY route_id ORDER BY seq)) l)"""
SEGMENT = f"(SELECT event_id AS id, p_lat AS lat1, p_lon AS lon1, lat AS lat2, lon AS lon2 FROM {LEG} g WHERE p_lat IS NOT NULL)"
WIND = f"(SELECT * FROM {FILE} w WHERE type = 'wind')"
STEP = "CASE WHEN n_times < 2 THEN 9007199254740991.0 ELSE (end_ms - start_ms) / (n_times - 1) END"
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY type ORDER BY reference_ms DESC, {STEP}, lat_step, mtime DESC, path) AS rank FROM {FILE} a)"
CHOSEN = f"""(SELECT event_id AS id, f.lat, f.lon, t_ms, coalesce(min_by(path_, rank), '') AS path FROM {FIX} f
 LEFT JOIN (SELECT path AS path_, * EXCLUDE (path) FROM {RANKED} r WHERE type = 'wind') w
 ON f.lat BETWEEN lat_min AND lat_max AND f.lon BETWEEN lon_min AND lon_max AND t_ms BETWEEN start_ms AND end_ms GROUP BY ALL)"""
FRAMES = f"(SELECT path, unnest(range(0, n_times)) AS frame, start_ms, step_ms FROM {WIND} v)"
VALID = f"(SELECT path, frame, start_ms + frame * step_ms AS valid_ms FROM {FRAMES} v)"
NEAR = f"""(SELECT id, c.path, c.lat, c.lon, min_by(frame, (abs(valid_ms - t_ms), valid_ms)) AS frame FROM {CHOSEN} c JOIN {VALID} v ON c.path = v.path GROUP BY ALL)"""
CELL = f"""(SELECT path, frame, i, j, (k % 41 - 20) / 2.0 AS u, (k * 3 % 37 - 18) / 2.0 AS v, CASE WHEN k % 17 = 0 THEN 9999.0 ELSE (k % 40) / 10.0 END AS swh FROM
 (SELECT path, frame, i, j, seq * 7 + frame * 5 + i * 3 + j * 11 AS k FROM
  (SELECT path, seq, frame, i, unnest(range(0, CAST(round((lon_max - lon_min) / lon_step) AS BIGINT) + 1)) AS j FROM
   (SELECT *, unnest(range(0, CAST(round((lat_max - lat_min) / lat_step) AS BIGINT) + 1)) AS i FROM (SELECT *, unnest(range(0, n_times)) AS frame FROM {WIND} q) q1) q2) q3) q4)"""


def corners(points: str) -> str:
    return f"""(SELECT p.id, p.path, p.frame, p.i0 + a AS i, p.j0 + b AS j,
 (CASE WHEN a = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN b = 1 THEN fx ELSE 1 - fx END) AS weight FROM
 (SELECT *, (lat - lat_min) / lat_step - i0 AS fy, (lon - lon_min) / lon_step - j0 AS fx FROM
  (SELECT n.*, lat_min, lat_step, lon_min, lon_step,
   greatest(0, least(floor((lat - lat_min) / lat_step), round((lat_max - lat_min) / lat_step) - 1)) AS i0,
   greatest(0, least(floor((lon - lon_min) / lon_step), round((lon_max - lon_min) / lon_step) - 1)) AS j0
   FROM {points} n JOIN {WIND} g ON n.path = g.path) n1) p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS s(a, b))"""


SAMPLED = f"(SELECT id, sum(weight * u) AS u, sum(weight * v) AS v FROM {corners(NEAR)} k JOIN {CELL} c ON k.path = c.path AND k.frame = c.frame AND k.i = c.i AND k.j = c.j GROUP BY id)"
CELLS_OF = "unnest(range(CAST(floor(least(lat1, lat2) / 0.1) AS BIGINT), CAST(floor(greatest(lat1, lat2) / 0.1) AS BIGINT) + 1))"
DET = "((s.lon2 - s.lon1) * (e.lat2 - e.lat1) - (s.lat2 - s.lat1) * (e.lon2 - e.lon1))"
T = f"(((e.lon1 - s.lon1) * (e.lat2 - e.lat1) - (e.lat1 - s.lat1) * (e.lon2 - e.lon1)) / {DET})"
S = f"(((e.lon1 - s.lon1) * (s.lat2 - s.lat1) - (e.lat1 - s.lat1) * (s.lon2 - s.lon1)) / {DET})"
OVERLAP = (
    "greatest(s.lat1, s.lat2) >= least(e.lat1, e.lat2) AND least(s.lat1, s.lat2) <= greatest(e.lat1, e.lat2) "
    "AND greatest(s.lon1, s.lon2) >= least(e.lon1, e.lon2) AND least(s.lon1, s.lon2) <= greatest(e.lon1, e.lon2)"
)
CROSSES = f"{OVERLAP} AND abs({DET}) >= 1e-12 AND {T} > 0 AND {T} < 1 AND {S} > 0 AND {S} < 1"
CROSSING = f"(SELECT DISTINCT s.id FROM {SEGMENT} s JOIN {EDGE} e ON {CROSSES})"


def ray(edges: str, keys: str) -> str:
    return f"""(SELECT event_id, {keys}, count(*) AS n FROM {FIX} p JOIN {edges} e ON (e.lat1 > p.lat) <> (e.lat2 > p.lat)
 AND p.lon < (e.lon2 - e.lon1) * (p.lat - e.lat1) / (e.lat2 - e.lat1) + e.lon1 GROUP BY ALL)"""


ON_LAND = f"(SELECT DISTINCT event_id FROM (SELECT event_id, poly_id FROM {ray(EDGE, 'poly_id, ring_id')} r WHERE n % 2 = 1 GROUP BY ALL HAVING min(ring_id) = 0 AND max(ring_id) = 0) q)"
IN_REGION = f"(SELECT event_id, region_id FROM {ray(duck('region_edge'), 'region_id')} r WHERE n % 2 = 1)"
REGION_SEGMENT = f"(SELECT DISTINCT s.id, region_id FROM {SEGMENT} s JOIN {duck('region_edge')} e ON {CROSSES})"


def seg_point(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Squared distance of a point and a segment of positive length."""
    length = f"(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2))"
    t = f"(CASE WHEN {length} = 0 THEN 0 ELSE least(1, greatest(0, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / {length})) END)"
    return f"(pow({px} - {ax} - {t} * ({bx} - {ax}), 2) + pow({py} - {ay} - {t} * ({by} - {ay}), 2))"


def shore(segments: str, within: float) -> str:
    x = lambda lon: f"{half_turn(f'{lon} - s.lon1')} * 60 * cos(radians((s.lat1 + s.lat2) / 2))"
    y = lambda lat: f"({lat} - (s.lat1 + s.lat2) / 2) * 60"
    up, side = within / 60 + 0.01, within / 25 + 0.02
    inner = f"""(SELECT s.id, {x('s.lon1')} AS ax, {y('s.lat1')} AS ay, {x('s.lon2')} AS bx, {y('s.lat2')} AS by_, {x('e.lon1')} AS cx, {y('e.lat1')} AS cy,
 {x('e.lon2')} AS dx, {y('e.lat2')} AS dy, CASE WHEN {OVERLAP} AND abs({DET}) >= 1e-12 AND {T} BETWEEN 0 AND 1 AND {S} BETWEEN 0 AND 1 THEN 1 ELSE 0 END AS hit
 FROM {segments} s JOIN {EDGE} e ON greatest(s.lat1, s.lat2) + {up} >= least(e.lat1, e.lat2) AND least(s.lat1, s.lat2) - {up} <= greatest(e.lat1, e.lat2)
 AND greatest(s.lon1, s.lon2) + {side} >= least(e.lon1, e.lon2) AND least(s.lon1, s.lon2) - {side} <= greatest(e.lon1, e.lon2))"""
    near = f"least({seg_point('ax', 'ay', 'cx', 'cy', 'dx', 'dy')}, {seg_point('bx', 'by_', 'cx', 'cy', 'dx', 'dy')}, {seg_point('cx', 'cy', 'ax', 'ay', 'bx', 'by_')}, {seg_point('dx', 'dy', 'ax', 'ay', 'bx', 'by_')})"
    return f"(SELECT id, min(CASE WHEN hit = 1 THEN 0 ELSE sqrt({near}) END) AS shore_nm FROM {inner} z GROUP BY id HAVING shore_nm <= {within})"


LEN = hav("lat1", "lon1", "lat2", "lon2")


def samples(most: float) -> str:
    n = f"greatest(1, ceil({LEN} / {min(2.0, most / 4)}))"
    return f"""(SELECT id, k, {most} - len_nm / n / 2 AS limit_nm, lat1 + (lat2 - lat1) * (k / n) AS lat, lon1 + {half_turn('lon2 - lon1')} * (k / n) AS lon FROM
 (SELECT *, unnest(range(0, CAST(n AS BIGINT) + 1)) AS k FROM (SELECT *, {LEN} AS len_nm, {n} AS n FROM {SEGMENT} s) a) b)"""


DEPTH = duck("depth_cell")
M = "CASE WHEN raw <> -9999.0 AND -raw >= 0 THEN -raw END"
# pixels that a piece passes: those whose open square it enters, by clipping
PIECES = f"""(SELECT id, (lon1 + (lon2 - lon1) * ((k - 1) / n) - 10.0) / 0.1 AS x0, (lat1 + (lat2 - lat1) * ((k - 1) / n) - 54.0) / 0.1 AS y0,
 (lon1 + (lon2 - lon1) * (k / n) - 10.0) / 0.1 AS x1, (lat1 + (lat2 - lat1) * (k / n) - 54.0) / 0.1 AS y1
 FROM (SELECT *, unnest(range(1, CAST(n AS BIGINT) + 1)) AS k FROM (SELECT *, greatest(1, ceil({LEN})) AS n FROM {SEGMENT} s) a) b)"""
PIXELS = f"""(SELECT id, x, y FROM (SELECT *, unnest(range(CAST(floor(least(y0, y1)) AS BIGINT), CAST(floor(greatest(y0, y1)) AS BIGINT) + 1)) AS y FROM
 (SELECT *, unnest(range(CAST(floor(least(x0, x1)) AS BIGINT), CAST(floor(greatest(x0, x1)) AS BIGINT) + 1)) AS x FROM {PIECES} p) p1) p2
 WHERE greatest(0, least((x - x0) / (x1 - x0), (x + 1 - x0) / (x1 - x0)), least((y - y0) / (y1 - y0), (y + 1 - y0) / (y1 - y0)))
     < least(1, greatest((x - x0) / (x1 - x0), (x + 1 - x0) / (x1 - x0)), greatest((y - y0) / (y1 - y0), (y + 1 - y0) / (y1 - y0)))
 UNION SELECT id, CAST(floor(x0) AS BIGINT), CAST(floor(y0) AS BIGINT) FROM {PIECES} p3 UNION SELECT id, CAST(floor(x1) AS BIGINT), CAST(floor(y1) AS BIGINT) FROM {PIECES} p4)"""
LEAST_DEPTH = f"(SELECT id, CASE WHEN count(*) = count({M}) THEN min({M}) END AS depth_m FROM {PIXELS} q LEFT JOIN {DEPTH} d ON q.x = d.x AND q.y = d.y GROUP BY id)"

CHUNKS = f"""(SELECT route_id, seq, day, (least(t_ms, dep + (day + 1) * 86400000) - greatest(p_t, dep + day * 86400000)) / 3600000.0 AS hours FROM
 (SELECT *, unnest(range(greatest(0, (p_t - dep) // 86400000), greatest(greatest(0, (p_t - dep) // 86400000), CAST(ceil((t_ms - dep) / 86400000.0) AS BIGINT) - 1) + 1)) AS day FROM
  (SELECT *, first_value(t_ms) OVER (PARTITION BY route_id ORDER BY seq) AS dep FROM {LEG} g) a WHERE underway) b WHERE hours > 0)"""
BUDGET = f"""(SELECT route_id, day, sum(hours) AS hours, min(CASE WHEN run > 8 + 1e-9 THEN seq END) AS first_excess FROM
 (SELECT *, sum(hours) OVER (PARTITION BY route_id, day ORDER BY seq) AS run FROM {CHUNKS} c) c1 GROUP BY ALL)"""


def weighted(value: str) -> str:
    base = f"""(SELECT route_id, seq, {value} AS val, (greatest(0, coalesce(t_ms - lag(t_ms) OVER w, 0)) + greatest(0, coalesce(lead(t_ms) OVER w - t_ms, 0))) / 7200000.0 AS wt
 FROM {FIX} f WINDOW w AS (PARTITION BY route_id ORDER BY seq))"""
    return f"""(SELECT a.route_id, mean, p95, top FROM (SELECT route_id, sum(val * wt) / nullif(sum(wt), 0) AS mean, max(val) AS top FROM {base} b WHERE val IS NOT NULL GROUP BY route_id) a
 LEFT JOIN (SELECT route_id, min(val) AS p95 FROM (SELECT *, sum(wt) OVER (PARTITION BY route_id ORDER BY val, seq) AS run, sum(wt) OVER (PARTITION BY route_id) AS tot
  FROM {base} b WHERE val IS NOT NULL AND wt > 0) c WHERE run >= tot * 0.95 GROUP BY route_id) d ON a.route_id = d.route_id)"""


SIDE = f"CASE WHEN propulsion = 'sail' AND abs({half_turn('(wind_from - heading) % 360')}) BETWEEN 0.5 AND 179.5 THEN CASE WHEN {half_turn('(wind_from - heading) % 360')} > 0 THEN 1 ELSE -1 END END"
TURNS = f"""(SELECT route_id, seq, {hav('coalesce(lag(lat) OVER v, lat0)', 'coalesce(lag(lon) OVER v, lon0)', 'lat9', 'lon9')} - {hav('lat', 'lon', 'lat9', 'lon9')} AS headway_nm FROM
 (SELECT * FROM (SELECT *, last_value(side IGNORE NULLS) OVER (PARTITION BY route_id, stretch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM
  (SELECT *, sum(CASE WHEN side IS NULL AND coalesce(propulsion, '') <> 'wait' THEN 1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY seq) AS stretch FROM
   (SELECT *, {SIDE} AS side, first_value(lat) OVER a AS lat0, first_value(lon) OVER a AS lon0, last_value(lat) OVER a AS lat9, last_value(lon) OVER a AS lon9
    FROM {FIX} f WINDOW a AS (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) x WHERE seq > 0) x1) x2
  WHERE side <> before) x3 WINDOW v AS (PARTITION BY route_id, stretch ORDER BY seq))"""
TWA = fold("heading", "wind_from")
STORED_TWA = f"(CASE WHEN event_id % 13 = 0 THEN least(180, {TWA} + 2) ELSE {TWA} END)"


def polar(twa: str, tws: str) -> str:
    """Boat speed by the polar as nested CASEs over its cells."""
    a, w, s = POLAR.twa, POLAR.tws, POLAR.speeds
    out = []
    for i in range(len(a) - 1):
        p = f"({twa} - {a[i]}) / {a[i + 1] - a[i]}"
        rows = [f"WHEN {tws} < {w[0]} THEN ((1 - {p}) * {s[i][0]} + {p} * {s[i + 1][0]}) * {tws} / {w[0]}"]
        for j in range(len(w) - 1):
            q = f"least(1, ({tws} - {w[j]}) / {w[j + 1] - w[j]})"
            value = f"(1 - {q}) * ((1 - {p}) * {s[i][j]} + {p} * {s[i + 1][j]}) + {q} * ((1 - {p}) * {s[i][j + 1]} + {p} * {s[i + 1][j + 1]})"
            rows.append(f"ELSE {value}" if j == len(w) - 2 else f"WHEN {tws} <= {w[j + 1]} THEN {value}")
        out.append(f"WHEN {twa} <= {a[i + 1]} THEN (CASE {' '.join(rows)} END)")
    return f"(CASE WHEN {twa} < {a[0]} THEN 0.0 {' '.join(out)} END)"


RADIANS = "radians({0})"
DAY = "dayofyear(make_timestamp(t_ms * 1000))"


def elevation(t: str, lat: str, lon: str) -> str:
    """Solar elevation of an expression of milliseconds."""
    hours = f"(floor(({t} % 86400000) / 1000) / 3600.0)"
    g = f"(2 * pi() * (dayofyear(make_timestamp(CAST(floor({t}) AS BIGINT) * 1000)) - 1 + ({hours} - 12) / 24) / 365)"
    eot = f"(229.18 * (0.000075 + 0.001868 * cos({g}) - 0.032077 * sin({g}) - 0.014615 * cos(2 * {g}) - 0.040849 * sin(2 * {g})))"
    dec = f"(0.006918 - 0.399912 * cos({g}) + 0.070257 * sin({g}) - 0.006758 * cos(2 * {g}) + 0.000907 * sin(2 * {g}) - 0.002697 * cos(3 * {g}) + 0.00148 * sin(3 * {g}))"
    angle = f"radians((({hours} * 60 + {eot} + 4 * {lon}) % 1440 + 1440) % 1440 / 4 - 180)"
    return f"degrees(asin(least(1, greatest(-1, sin(radians({lat})) * sin({dec}) + cos(radians({lat})) * cos({dec}) * cos({angle})))))"


LIGHT = f"""(SELECT route_id, seq, {elevation('p_t', 'p_lat', 'p_lon')} > 0 AND {elevation('floor((p_t + t_ms) / 2)', '((p_lat + lat) / 2)', '((p_lon + lon) / 2)')} > 0
 AND {elevation('t_ms', 'lat', 'lon')} > 0 AS in_daylight FROM {LEG} g WHERE underway)"""
LEAD = f"(SELECT route_id, x.seq, (t_ms - reference_ms) / 3600000.0 AS lead_hours FROM {FIX} x JOIN {FILE} y ON x.path = y.path WHERE x.seq > 0)"
DEST_LAT = f"degrees(asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(radians(h))))"
DEST_LON = f"{half_turn('lon + degrees(atan2(sin(radians(h)) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * (sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(radians(h)))))')}"

ALT = duck("alternative")
DISTINCT = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, geometry ORDER BY attempt) AS n FROM {ALT} a) b WHERE n = 1)"
PENALTY = "(maneuvers * 0.05e0 + low_headway * 0.25e0)"
TIME = f"duration_hours + {PENALTY}"


def ranked(keys: str) -> str:
    return f"""SELECT request_id, place, attempt, geometry FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY complete DESC, warning_count, {keys}, attempt) - 1 AS place
 FROM {DISTINCT} d) e WHERE place < 5"""


ENDS = f"(SELECT route_id, min_by(lat, seq) AS start_lat, min_by(lon, seq) AS start_lon, max_by(lat, seq) AS end_lat, max_by(lon, seq) AS end_lon FROM {FIX} f GROUP BY route_id)"
NODE = f"""(SELECT f.route_id AS request_id, event_id AS parent_id, lat, lon, heading, tws, wind_from, start_lat, start_lon, end_lat, end_lon, h_idx AS heading_idx, h_idx * 10.0 + 2.5 AS h
 FROM {FIX} f JOIN {ENDS} e ON f.route_id = e.route_id CROSS JOIN (SELECT unnest(range(0, 36)) AS h_idx) hh)"""
CANDIDATE = f"""(SELECT *, {DEST_LAT} AS lat_, {DEST_LON} AS lon_ FROM (SELECT *, speed / {R} AS d FROM
 (SELECT *, {polar('twa', 'tws')} AS speed FROM (SELECT *, {fold('h', 'wind_from')} AS twa FROM {NODE} n
  WHERE {fold('h', brg('lat', 'lon', 'end_lat', 'end_lon'))} <= 100 AND {fold('h', 'heading')} <= 120) n1) n2 WHERE speed >= 0.3) n3)"""
PLACED = f"""(SELECT request_id, parent_id, heading_idx, lat_ AS lat, lon_ AS lon, CAST(floor({brg('start_lat', 'start_lon', 'lat_', 'lon_')} / 5) AS INT) AS sector,
 pow(lat_ - start_lat, 2) + pow((lon_ - start_lon) * cos(radians(start_lat)), 2) AS out_, pow(lat_ - end_lat, 2) + pow((lon_ - end_lon) * cos(radians(start_lat)), 2) AS left_ FROM {CANDIDATE} c)"""


def combination(fits: str, why: str) -> str:
    known = f"(SELECT *, row_number() OVER (PARTITION BY {fits} ORDER BY reference_ms DESC, {STEP}, lat_step, mtime DESC, path) AS rank, {fits} AS fits FROM {FILE} a)"
    return f"""WITH k AS {known}, held AS (SELECT b.path, min_by(a.path, a.rank) AS by_ FROM k a JOIN k b ON a.fits AND b.fits AND a.rank < b.rank AND a.start_ms <= b.start_ms
 AND a.end_ms >= b.end_ms AND a.lat_min <= b.lat_min AND a.lat_max >= b.lat_max AND a.lon_min <= b.lon_min AND a.lon_max >= b.lon_max GROUP BY b.path)
SELECT k.path, fits AND by_ IS NULL AS recommended, CASE WHEN NOT fits THEN {why} WHEN by_ IS NOT NULL THEN 'covered by ' || by_ ELSE '' END AS reason
FROM k LEFT JOIN held ON k.path = held.path"""


def allowed(minimum: float, narrow: float, established: str) -> str:
    """(id, allowed) of legs that keep ``minimum`` from the shore; ``established``: (event_id, est) of the state before each leg."""
    begin = "free" if narrow <= 0 else "whole"
    return f"""(WITH a AS (SELECT s.*, est, {hav('lat1', 'lon1', 'start_lat', 'start_lon')} AS s1, {hav('lat2', 'lon2', 'start_lat', 'start_lon')} AS s2,
 {hav('lat1', 'lon1', 'end_lat', 'end_lon')} AS e1, {hav('lat2', 'lon2', 'end_lat', 'end_lon')} AS e2 FROM {SEGMENT} s JOIN {FIX} f ON s.id = f.event_id JOIN {ENDS} e ON f.route_id = e.route_id JOIN {established} t ON s.id = t.event_id),
 b AS (SELECT *, CASE WHEN est IS NULL THEN CASE WHEN (s1 <= {minimum} AND s2 <= {minimum}) OR (e1 <= {minimum} AND e2 <= {minimum}) THEN 'free' WHEN s1 <= {minimum} THEN 'second' WHEN e2 <= {minimum} THEN 'first' ELSE 'whole' END
  WHEN NOT est THEN CASE WHEN {narrow} > 0 AND s1 <= {narrow} THEN 'second' ELSE '{begin}' END ELSE CASE WHEN e1 <= {minimum} AND e2 <= {minimum} THEN 'free' WHEN e2 <= {minimum} THEN 'first' ELSE 'whole' END END AS what FROM a),
 p AS (SELECT id, CASE WHEN what = 'second' THEN lat2 ELSE lat1 END AS lat1, CASE WHEN what = 'second' THEN lon2 ELSE lon1 END AS lon1, CASE WHEN what = 'first' THEN lat1 ELSE lat2 END AS lat2,
  CASE WHEN what = 'first' THEN lon1 ELSE lon2 END AS lon2 FROM b)
 SELECT b.id, what = 'free' OR shore_nm IS NULL OR shore_nm >= CASE WHEN est = FALSE THEN {narrow} ELSE {minimum} END AS allowed FROM b LEFT JOIN {shore('p', minimum)} d ON b.id = d.id)"""


ALLOWED = allowed(3.0, 0.05, f"(SELECT event_id, cleared AS est FROM {FIX} f)")
def offshore(most: float) -> str:
    """(id, within) of legs that stay within ``most`` of the shore."""
    return f"""(WITH s AS (SELECT *, id * 1000 + k AS sid FROM {samples(most)} s), p AS (SELECT sid AS id, lat AS lat1, lon AS lon1, lat AS lat2, lon AS lon2 FROM s)
SELECT s.id, bool_and(coalesce(limit_nm > 0 AND shore_nm <= limit_nm, FALSE)) AS within FROM s LEFT JOIN {shore('p', most)} d ON s.sid = d.id GROUP BY s.id)"""


OFFSHORE = offshore(60.0)
ISSUES = f"""
WITH shore_ AS (SELECT route_id, seq, event_id, coalesce(cleared, CASE WHEN shore_nm IS NULL OR shore_nm >= 1 THEN TRUE END) AS flag FROM {FIX} f
 LEFT JOIN {shore(f"(SELECT event_id AS id, lat AS lat1, lon AS lon1, lat AS lat2, lon AS lon2 FROM {FIX} f)", 1.0)} d ON f.event_id = d.id),
state_ AS (SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY seq), FALSE) AS reached FROM shore_),
before_ AS (SELECT event_id, lag(reached) OVER (PARTITION BY route_id ORDER BY seq) AS est FROM state_),
pt AS (SELECT *, {STORED_TWA} AS twa FROM {LEG} g), pr AS (SELECT *, {fold('heading', 'p_from')} AS twa0 FROM pt WHERE p_lat IS NOT NULL),
sp AS (SELECT *, {polar('twa0', 'p_tws')} AS predicted FROM pr WHERE speed > 0 AND coalesce(propulsion, '') <> 'motor'),
hit AS (
 SELECT route_id, seq, 'twa-mismatch' AS code, 'error' AS severity FROM pr WHERE abs({TWA} - twa) > 1
 UNION ALL SELECT route_id, seq, 'abrupt-wind-shift', 'warning' FROM pr WHERE {fold('wind_from', 'p_from')} > 60
 UNION ALL SELECT route_id, seq, 'polar-wind-cap', 'warning' FROM pr WHERE tws > {POLAR.tws[-1]}
 UNION ALL SELECT route_id, seq, 'polar-no-go-angle', 'warning' FROM sp WHERE twa0 < {POLAR.twa[0]}
 UNION ALL SELECT route_id, seq, 'polar-speed-mismatch', 'warning' FROM sp WHERE abs(speed - predicted) > greatest(0.75, predicted * 0.25)
 UNION ALL SELECT route_id, seq, 'time-reversal', 'error' FROM pr WHERE elapsed < 0
 UNION ALL SELECT route_id, seq, 'zero-duration-leg', 'warning' FROM pr WHERE elapsed = 0 AND leg_nm > 0.01
 UNION ALL SELECT route_id, min(seq), 'too-few-points', 'error' FROM pt GROUP BY route_id HAVING count(*) < 2
 UNION ALL SELECT route_id, seq, 'point-on-land', 'error' FROM pt WHERE event_id IN (SELECT event_id FROM {ON_LAND} o)
 UNION ALL SELECT route_id, seq, 'land-crossing', 'error' FROM pt WHERE event_id IN (SELECT id FROM {CROSSING} o)
 UNION ALL SELECT route_id, seq, 'point-in-avoid-region', 'error' FROM pt WHERE event_id IN (SELECT event_id FROM {IN_REGION} o)
 UNION ALL SELECT route_id, seq, 'avoid-region-crossing', 'error' FROM pt WHERE event_id IN (SELECT id FROM {REGION_SEGMENT} o)
 UNION ALL SELECT route_id, seq, 'night-sailing', 'error' FROM {LIGHT} l WHERE NOT in_daylight
 UNION ALL SELECT route_id, first_excess, 'daily-hours-exceeded', 'error' FROM {BUDGET} b WHERE first_excess IS NOT NULL
 UNION ALL SELECT route_id, seq, CASE WHEN NOT allowed THEN 'shore-clearance-violated' WHEN NOT within THEN 'offshore-limit-violated' WHEN depth_m IS NULL THEN 'depth-coverage-missing' ELSE 'minimum-depth-violated' END, 'error'
   FROM pr JOIN {allowed(1.0, 0.0, '(SELECT * FROM before_)')} a ON pr.event_id = a.id JOIN {offshore(12.0)} o ON pr.event_id = o.id LEFT JOIN {LEAST_DEPTH} d ON pr.event_id = d.id
   WHERE NOT allowed OR NOT within OR depth_m IS NULL OR depth_m < 5
 UNION ALL SELECT route_id, seq, 'low-forecast-confidence', 'warning' FROM {LEAD} l WHERE lead_hours > 96
 UNION ALL SELECT route_id, max(seq), 'shore-clearance-not-established', 'warning' FROM state_ GROUP BY route_id HAVING NOT max_by(reached, seq))
SELECT route_id, code, severity, min(seq) AS seq, replace(code, '-', ' ') || ': point ' || min(seq) AS message FROM hit GROUP BY route_id, code, severity"""

TIMED = f"""(SELECT route_id, seq, lat, lon, run_nm, {BASE_MS} + run_nm / 6.0 * 3600000.0 AS t FROM (SELECT *, sum(nm) OVER (PARTITION BY route_id ORDER BY seq) AS run_nm FROM
 (SELECT *, coalesce(leg_nm, 0) AS nm FROM {LEG} g) a) b)"""
STATE = f"(SELECT route_id, seq, coalesce(last_value(cleared IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY seq), FALSE) AS cleared FROM {FIX} f)"
LIMITS = (("minimum_depth_m", 12000, 31), ("minimum_shore_nm", 50, 37), ("maximum_offshore_nm", 1000, 41), ("vessel_draft_m", 100, 43), ("motor_kn", 100, 47), ("motor_below_kn", 100, 53))
GRID_NEAR = f"""b AS (SELECT min(lat_min) AS y0, min(lon_min) AS x0, min(lat_step) AS dy, min(lon_step) AS dx, max(lat_max) AS y1, max(lon_max) AS x1 FROM {WIND} w),
p AS (SELECT y0 + i * dy AS lat, x0 + j * dx AS lon, {NOW} AS t_ms FROM (SELECT *, unnest(range(0, CAST(round((x1 - x0) / dx) AS BIGINT) + 1)) AS j FROM
 (SELECT *, unnest(range(0, CAST(round((y1 - y0) / dy) AS BIGINT) + 1)) AS i FROM b) b1) b2),
f AS (SELECT p.lat || ',' || p.lon AS id, p.lat, p.lon, t_ms, min_by(path, rank) AS path FROM p JOIN (SELECT * FROM {RANKED} r WHERE type = 'wind') w
 ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max AND t_ms BETWEEN start_ms AND end_ms GROUP BY ALL),
n AS (SELECT id, f.path, lat, lon, min_by(frame, (abs(valid_ms - t_ms), valid_ms)) AS frame FROM f JOIN {VALID} v ON f.path = v.path GROUP BY ALL)"""
#: The newest current file and its frame nearest to a time.
FRESH = f"(SELECT * FROM {FILE} f WHERE type = 'current' ORDER BY mtime DESC, path DESC LIMIT 1)"
FLOW = f"""(SELECT path, frame, i, j, (k % 41 - 20) / 2.0 AS u, (k * 3 % 37 - 18) / 2.0 AS v FROM (SELECT *, seq * 7 + frame * 5 + i * 3 + j * 11 AS k FROM
 (SELECT *, unnest(range(0, CAST(round((lon_max - lon_min) / lon_step) AS BIGINT) + 1)) AS j FROM
  (SELECT *, unnest(range(0, CAST(round((lat_max - lat_min) / lat_step) AS BIGINT) + 1)) AS i FROM (SELECT *, unnest(range(0, n_times)) AS frame FROM {FRESH} q) q1) q2) q3) q4)"""
IN_FLOW = f"""(SELECT id, path, lat, lon, min_by(frame, (abs(start_ms + frame * step_ms - t_ms), frame)) AS frame FROM
 (SELECT event_id AS id, w.path, f.lat, f.lon, f.t_ms, start_ms, step_ms, unnest(range(0, n_times)) AS frame FROM {FIX} f JOIN {FRESH} w ON f.lat BETWEEN lat_min AND lat_max AND f.lon BETWEEN lon_min AND lon_max) x GROUP BY ALL)"""

SQL = {
    "leg_kinematics": f"SELECT route_id, seq, {r6('leg_nm')} AS leg_nm, {r6(brg('p_lat', 'p_lon', 'lat', 'lon'))} AS course, {r6(TWA)} AS twa, {r6(fold('wind_from', 'p_from'))} AS wind_shift FROM {LEG} g WHERE p_lat IS NOT NULL",
    "route_totals": f"SELECT route_id, count(*) AS points, {r6('sum(leg_nm)')} AS distance_nm, {r6('max(leg_nm)')} AS longest_nm, {r6('sum(CASE WHEN underway THEN elapsed END) / 3.6e6')} AS underway_hours FROM {LEG} g GROUP BY route_id",
    "destination_points": f"SELECT event_id, {r6(DEST_LAT)} AS lat, {r6(DEST_LON)} AS lon FROM (SELECT *, speed * 3 / {R} AS d, heading AS h FROM {FIX} f WHERE speed IS NOT NULL) x",
    "wind_vectors": f"SELECT event_id, {r6('sqrt(u * u + v * v) * 1.94384')} AS tws, {r6('(degrees(atan2(-u, -v)) + 360) % 360')} AS wind_from FROM {FIX} f",
    "true_wind_angle": f"SELECT event_id, {r6(TWA)} AS twa, {SIDE} AS side FROM {FIX} f",
    "current_drift": f"""SELECT event_id, {r6('lat + v / 10 * 3600 / 111120')} AS lat, {r6('lon + u / 10 * 3600 / (111120 * cos(radians(lat)))')} AS lon,
 {r6('greatest(0.3, 5 + (u / 10 * sin(radians(heading)) + v / 10 * cos(radians(heading))) * 1.94384)')} AS sog_kn, {r6('(u * sin(radians(heading)) + v * cos(radians(heading))) * 1.94384')} AS along_kn FROM {FIX} f""",
    "map_tiles": f"SELECT CAST(floor((lon + 180) / 360 * 512) AS INT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 512) AS INT) AS y, count(*) AS n FROM {FIX} f GROUP BY ALL",
    "local_plane": f"SELECT event_id, {r6(half_turn('lon - 11') + ' * 60 * cos(radians(55))')} AS x_nm, {r6('(lat - 55) * 60')} AS y_nm, {r6('abs(' + half_turn('(wind_from - heading) % 360') + ') / 180 * 0.3')} AS turn_cost FROM {FIX} f",
    "solar_elevation": f"SELECT event_id, {r6(elevation('t_ms', 'lat', 'lon'))} AS elevation FROM {FIX} f",
    "daylight_legs": f"SELECT route_id, count(*) AS legs, count(*) FILTER (WHERE in_daylight) AS in_daylight FROM {LIGHT} l GROUP BY route_id",
    "polar_speed": f"SELECT event_id, {r6(polar('twa', 'tws'))} AS boat_speed FROM (SELECT *, {TWA} AS twa FROM {FIX} f) x",
    "display_units": f"""SELECT event_id, {r6('tws * 0.514444 * 3.6')} AS kmh, {r6('tws * 0.514444')} AS ms, {r6('tws / 3.6 * 1.94384')} AS from_kmh, {r6('tws * 1000 / 1852.001')} AS nmi_from_km,
 printf('%.1f', event_id / 3.0) || ' m' AS depth_text FROM {FIX} f""",
    "presentation_rounding": f"SELECT event_id, floor(u + 0.5) AS u0, floor(tws * 10 + 0.5) / 10 AS tws1, floor(wave + 0.5) AS wave0 FROM {FIX} f",
    "file_priority": f"SELECT path, type, rank FROM {RANKED} r",
    "select_file": f"SELECT id AS event_id, path FROM {CHOSEN} c",
    "nearest_frame": f"SELECT id AS event_id, path, frame FROM {NEAR} n",
    "time_axis": f"SELECT valid_ms, row_number() OVER (ORDER BY valid_ms) - 1 AS axis_idx FROM (SELECT DISTINCT valid_ms FROM {VALID} v) d",
    "resample_axis": f"""SELECT path, count(*) AS n, sum(t - {BASE_MS}) AS total_ms FROM (SELECT path, unnest(range(start_ms, start_ms + (n_times - 1) * step_ms, 5400000)) AS t FROM {WIND} w
 UNION ALL SELECT path, start_ms + (n_times - 1) * step_ms FROM {WIND} w) x GROUP BY path""",
    "departure_axis": f"""SELECT path, count(*) AS n, min(t) AS first_ms, sum(t - {BASE_MS}) AS total_ms FROM (SELECT path, start_ms + 9000000 AS t FROM {WIND} w
 UNION ALL SELECT v.path, valid_ms FROM {VALID} v JOIN {WIND} w ON v.path = w.path WHERE valid_ms > w.start_ms + 9000000) x GROUP BY path""",
    "bilinear_wind": f"SELECT c.id AS event_id, path, {r6('coalesce(u, 0)')} AS u, {r6('coalesce(v, 0)')} AS v FROM {CHOSEN} c LEFT JOIN {SAMPLED} s ON c.id = s.id",
    "masked_wave": f"""SELECT k.id AS event_id, {r6('sum(weight * swh) FILTER (WHERE swh >= 0 AND swh < 100) / nullif(sum(weight) FILTER (WHERE swh >= 0 AND swh < 100), 0)')} AS wave_m
 FROM {corners(NEAR)} k LEFT JOIN {CELL} c ON k.path = c.path AND k.frame = c.frame AND k.i = c.i AND k.j = c.j GROUP BY k.id""",
    "grid_bounds": f"""SELECT min(lat_min) AS lat_min, max(lat_max) AS lat_max, min(lon_min) AS lon_min, max(lon_max) AS lon_max, min(lat_step) AS lat_step, min(lon_step) AS lon_step,
 CAST(floor((max(lat_max) - min(lat_min)) / min(lat_step) + 0.5) AS BIGINT) AS n_lat, CAST(floor((max(lon_max) - min(lon_min)) / min(lon_step) + 0.5) AS BIGINT) AS n_lon FROM {WIND} w""",
    "wind_grid": f"""WITH b AS (SELECT min(lat_min) AS y0, min(lon_min) AS x0, min(lat_step) AS dy, min(lon_step) AS dx, max(lat_max) AS y1, max(lon_max) AS x1 FROM {WIND} w),
p AS (SELECT y0 + i * dy AS lat, x0 + j * dx AS lon, {NOW} AS t_ms FROM (SELECT *, unnest(range(0, CAST(round((x1 - x0) / dx) AS BIGINT) + 1)) AS j FROM
 (SELECT *, unnest(range(0, CAST(round((y1 - y0) / dy) AS BIGINT) + 1)) AS i FROM b) b1) b2),
f AS (SELECT p.lat || ',' || p.lon AS id, p.lat, p.lon, t_ms, min_by(path, rank) AS path FROM p JOIN (SELECT * FROM {RANKED} r WHERE type = 'wind') w
 ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max AND t_ms BETWEEN start_ms AND end_ms GROUP BY ALL),
n AS (SELECT id, f.path, lat, lon, min_by(frame, (abs(valid_ms - t_ms), valid_ms)) AS frame FROM f JOIN {VALID} v ON f.path = v.path GROUP BY ALL)
SELECT floor(lat * 10000 + 0.5) / 10000 AS lat, floor(lon * 10000 + 0.5) / 10000 AS lon, floor(sum(weight * u) * 100 + 0.5) / 100 AS u, floor(sum(weight * v) * 100 + 0.5) / 100 AS v
FROM {corners('n')} k JOIN {CELL} c ON k.path = c.path AND k.frame = c.frame AND k.i = c.i AND k.j = c.j JOIN f ON f.id = k.id GROUP BY k.id, lat, lon""",
    "combination_now": combination(f"(end_ms >= {NOW})", f"'ended hours ago: ' || CAST(CAST(floor(({NOW} - end_ms) / 3600000 + 0.5) AS BIGINT) AS VARCHAR)"),
    "combination_departure": combination(f"({DEPARTURE} BETWEEN start_ms AND end_ms)", "'departure outside its period'"),
    "expired_files": f"SELECT path, end_ms FROM {FILE} f WHERE end_ms < {NOW}",
    "freshest_current": f"SELECT path, mtime FROM {FILE} f WHERE type = 'current' ORDER BY mtime DESC, path DESC LIMIT 1",
    "edge_cells": f"""SELECT (r + 900) * 3600 + (c % 3600 + 3600) % 3600 AS cell, count(*) AS edges, count(DISTINCT poly_id) AS polygons FROM
 (SELECT *, unnest(range(CAST(floor((least(xa, xb) - 1e-9) / 0.1) AS BIGINT), CAST(floor((greatest(xa, xb) + 1e-9) / 0.1) AS BIGINT) + 1)) AS c FROM
  (SELECT *, lon1 + (lon2 - lon1) * greatest(0.0, least(1.0, least(p, q))) AS xa, lon1 + (lon2 - lon1) * greatest(0.0, least(1.0, greatest(p, q))) AS xb FROM
   (SELECT *, CASE WHEN lat1 = lat2 THEN 0.0 ELSE (r * 0.1 - 1e-9 - lat1) / (lat2 - lat1) END AS p, CASE WHEN lat1 = lat2 THEN 1.0 ELSE ((r + 1) * 0.1 + 1e-9 - lat1) / (lat2 - lat1) END AS q
    FROM (SELECT *, {CELLS_OF} AS r FROM {EDGE} e) a) b) d) f GROUP BY cell""",
    "segment_crosses_land": f"SELECT id AS event_id FROM {CROSSING} c",
    "legs_clear_of_land": f"SELECT route_id, count(*) AS clear_legs FROM {LEG} g WHERE p_lat IS NOT NULL AND event_id NOT IN (SELECT id FROM {CROSSING} c) GROUP BY route_id",
    "point_on_land": f"SELECT event_id FROM {ON_LAND} o",
    "region_points": f"SELECT event_id, region_id FROM {IN_REGION} o",
    "region_segments": f"SELECT id AS event_id, region_id FROM {REGION_SEGMENT} o",
    "shore_distance": f"SELECT id AS event_id, {r6('shore_nm')} AS shore_nm FROM {shore(SEGMENT, 6.0)} d",
    "shore_clearance": f"SELECT coalesce(shore_nm >= 3, TRUE) AS clear, count(*) AS legs FROM {SEGMENT} s LEFT JOIN {shore(SEGMENT, 3.0)} d ON s.id = d.id GROUP BY ALL",
    "offshore_samples": f"SELECT id AS event_id, count(*) AS samples, {r6('min(limit_nm)')} AS limit_nm, {r6('sum(lat)')} AS lat_sum FROM {samples(10.0)} s GROUP BY id",
    "offshore_limit": f"""WITH s AS (SELECT *, id * 1000 + k AS sid FROM {samples(12.0)} s), p AS (SELECT sid AS id, lat AS lat1, lon AS lon1, lat AS lat2, lon AS lon2 FROM s)
SELECT s.id AS event_id, bool_and(coalesce(limit_nm > 0 AND shore_nm <= limit_nm, FALSE)) AS within FROM s LEFT JOIN {shore('p', 12.0)} d ON s.sid = d.id GROUP BY s.id""",
    "polygons_in_box": f"SELECT poly_id FROM {EDGE} e GROUP BY poly_id HAVING min(lat1) <= 57 AND max(lat1) >= 54.5 AND min(lon1) <= 16 AND max(lon1) >= 11",
    "depth_at": f"SELECT event_id, {r6(M)} AS depth_m FROM {FIX} f LEFT JOIN {DEPTH} d ON floor((lon - 10.0) / 0.1) = d.x AND floor((lat - 54.0) / 0.1) = d.y",
    "depth_min": f"SELECT id AS event_id, {r6('depth_m')} AS depth_m FROM {LEAST_DEPTH} d",
    "day_budget": f"SELECT route_id, day, {r6('hours')} AS hours, first_excess FROM {BUDGET} b",
    "weighted_stats": f"SELECT route_id, {r6('mean')} AS wave_avg, {r6('p95')} AS wave_p95, {r6('top')} AS wave_max FROM {weighted('wave')} w",
    "maneuvers": f"SELECT route_id, seq, {r6('headway_nm')} AS headway_nm FROM {TURNS} t",
    "clearance_state": f"""SELECT route_id, count(*) FILTER (WHERE now_) AS cleared_points FROM (SELECT route_id, last_value(cleared IGNORE NULLS) OVER (PARTITION BY route_id ORDER BY seq) AS now_
 FROM {FIX} f) x GROUP BY route_id""",
    "forecast_lead": f"SELECT route_id, {r6('max(lead_hours)')} AS max_lead_hours, count(*) AS known FROM {LEAD} l GROUP BY route_id",
    "route_metrics": f"""
SELECT g.route_id, point_count, {r6('distance_nm')} AS distance_nm, {r6('max_wind_shift')} AS max_wind_shift, {r6('max_twa_error')} AS max_twa_error, {r6('underway_hours')} AS underway_hours,
 {r6('motor_hours')} AS motor_hours, passage_days, {r6('coalesce(w.mean, 0)')} AS wind_avg, {r6('coalesce(w.p95, 0)')} AS wind_p95, {r6('coalesce(w.top, 0)')} AS wind_max,
 {r6('h.mean')} AS wave_avg, {r6('h.p95')} AS wave_p95, {r6('h.top')} AS wave_max, coalesce(t.n, 0) AS maneuvers, coalesce(t.low, 0) AS low_headway, {r6('max_lead_hours')} AS max_lead_hours
FROM (SELECT route_id, count(*) AS point_count, coalesce(sum(leg_nm), 0) AS distance_nm, coalesce(max({fold('wind_from', 'p_from')}), 0) AS max_wind_shift,
  coalesce(max(CASE WHEN p_lat IS NOT NULL THEN abs({TWA} - {STORED_TWA}) END), 0) AS max_twa_error, sum(CASE WHEN underway THEN elapsed / 3600000.0 ELSE 0 END) AS underway_hours,
  sum(CASE WHEN underway AND propulsion = 'motor' THEN elapsed / 3600000.0 ELSE 0 END) AS motor_hours,
  CAST(greatest(0, floor((max_by(t_ms, seq) - min_by(t_ms, seq)) / 86400000.0)) + 1 AS BIGINT) AS passage_days FROM {LEG} l GROUP BY route_id) g
LEFT JOIN {weighted('tws')} w ON g.route_id = w.route_id LEFT JOIN {weighted('wave')} h ON g.route_id = h.route_id
LEFT JOIN (SELECT route_id, count(*) AS n, count(*) FILTER (WHERE headway_nm < 0.5) AS low FROM {TURNS} t GROUP BY route_id) t ON g.route_id = t.route_id
LEFT JOIN (SELECT route_id, max(lead_hours) AS max_lead_hours FROM {LEAD} d GROUP BY route_id) d ON g.route_id = d.route_id""",
    "route_issues": ISSUES,
    "route_verdicts": f"""SELECT f.route_id, coalesce(errors, 0) = 0 AS valid, coalesce(warnings, 0) AS warning_count, coalesce(errors, 0) = 0 AND coalesce(warnings, 0) = 0 AS offered
FROM (SELECT DISTINCT route_id FROM {FIX} f) f LEFT JOIN (SELECT route_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings
FROM ({ISSUES}) i GROUP BY route_id) n ON f.route_id = n.route_id""",
    "plan_attempts": f"""SELECT request_id, attempt, {r6('attempt * 5.0 / greatest(wanted * 2, 1)')} AS heading_offset, request_id % 4 = 2 AS force_motor, request_id % 4 = 1 AS wait_for_wind FROM
 (SELECT *, unnest(range(0, CASE WHEN wanted = 1 OR request_id % 3 = 0 THEN 1 ELSE least(20, wanted * 2) END)) AS attempt FROM
  (SELECT o_custkey AS request_id, least(count(*), 10) AS wanted FROM orders GROUP BY o_custkey) a) b""",
    "distinct_geometry": f"SELECT request_id, attempt, geometry FROM {DISTINCT} d",
    "rank_fastest": ranked(f"{TIME}, distance_nm"),
    "rank_all_motoring": ranked(f"{TIME}, distance_nm"),
    "rank_least_motoring": ranked(f"motor_hours, {TIME}, distance_nm"),
    "rank_best_weather": ranked(
        "(wave_avg IS NULL), (CASE WHEN wave_avg IS NULL THEN 0 ELSE wave_avg * 100 + coalesce(wave_p95, wave_avg) * 30 END + wind_avg * 2 + wind_p95), "
        f"{PENALTY}, duration_hours, distance_nm"
    ),
    "route_separation": f"""WITH f AS (SELECT route_id, seq, lat, lon FROM {FIX} f), n AS (SELECT route_id, count(*) AS n FROM f GROUP BY route_id),
p AS (SELECT x.route_id AS a, y.route_id AS b, x.n AS na, y.n AS nb, least(12, greatest(2, least(x.n, y.n))) AS s FROM n x JOIN n y ON y.route_id = x.route_id + 1),
k AS (SELECT *, unnest(range(1, s - 1)) AS k FROM p)
SELECT k.a, k.b, {r6('avg(' + hav('fa.lat', 'fa.lon', 'fb.lat', 'fb.lon') + ')')} AS separation_nm FROM k
JOIN f fa ON fa.route_id = k.a AND fa.seq = floor(k.k / (s - 1) * (na - 1) + 0.5) JOIN f fb ON fb.route_id = k.b AND fb.seq = floor(k.k / (s - 1) * (nb - 1) + 0.5) GROUP BY ALL""",
    "step_candidates": f"""SELECT request_id, parent_id, heading_idx, {r6('speed')} AS speed, {r6('lat1')} AS lat, {r6('lon1')} AS lon, {r6('CAST(parent_id % 9 + 1 AS DOUBLE)')} AS used FROM
 (SELECT c.request_id, c.parent_id, c.heading_idx, c.speed, f.t_ms, f.lat AS lat0, f.lon AS lon0, lat_ + f.v / 10 * 3600 / (1852 * 60) AS lat1, lon_ + f.u / 10 * 3600 / (1852 * 60 * cos(radians(f.lat))) AS lon1
  FROM {CANDIDATE} c JOIN {FIX} f ON c.parent_id = f.event_id WHERE (f.wave IS NULL OR f.wave <= 3.9) AND c.parent_id % 9 + 1 <= 8) s
 WHERE {elevation('t_ms', 'lat0', 'lon0')} > 0 AND {elevation('(t_ms + 3600000)', 'lat1', 'lon1')} > 0 AND {elevation('(t_ms + 1800000)', '((lat0 + lat1) / 2)', '((lon0 + lon1) / 2)')} > 0""",
    "look_ahead": f"""SELECT DISTINCT s.id AS event_id FROM (SELECT id, lat AS lat1, lon AS lon1, CASE WHEN nm <= 25 THEN end_lat ELSE degrees(asin(sin(radians(lat)) * cos(25 / {R}) + cos(radians(lat)) * sin(25 / {R}) * cos(radians(b)))) END AS lat2,
 CASE WHEN nm <= 25 THEN end_lon ELSE lon + degrees(atan2(sin(radians(b)) * sin(25 / {R}) * cos(radians(lat)), cos(25 / {R}) - sin(radians(lat)) * (sin(radians(lat)) * cos(25 / {R}) + cos(radians(lat)) * sin(25 / {R}) * cos(radians(b))))) END AS lon2
 FROM (SELECT *, {hav('lat', 'lon', 'end_lat', 'end_lon')} AS nm, {brg('lat', 'lon', 'end_lat', 'end_lon')} AS b FROM
  (SELECT event_id AS id, f.lat, f.lon, end_lat, end_lon FROM {FIX} f JOIN (SELECT route_id, max_by(lat, seq) AS end_lat, max_by(lon, seq) AS end_lon FROM {FIX} g GROUP BY route_id) z ON f.route_id = z.route_id) a) b) s
 JOIN (SELECT lat1, lon1, lat2, lon2 FROM {EDGE} l UNION ALL SELECT lat1, lon1, lat2, lon2 FROM {duck('region_edge')} r) e ON {CROSSES}""",
    "hours_of_day": f"""SELECT event_id, greatest(own, rest, CASE WHEN beyond >= 86400000 THEN 24 ELSE 0 END) <= 8 + 1e-9 AS allowed, CAST((event_id % 40 + event_id % 31) // 24 AS INT) AS day,
 {r6("CASE WHEN beyond = 0 AND ends < 24 THEN own ELSE rest END")} AS used, CAST((event_id % 40 + event_id % 31) // 24 AS INT) AS rest_day, {r6("CASE WHEN event_id % 2 = event_id % 31 // 24 AND ends < 24 THEN CAST(event_id % 9 AS DOUBLE) ELSE 0.0 END")} AS rest_used FROM
 (SELECT *, (CASE WHEN event_id % 2 = event_id % 31 // 24 THEN event_id % 9 ELSE 0 END) + least(ends, 24) - event_id % 31 % 24 AS own, (beyond % 86400000) / 3600000.0 AS rest FROM
  (SELECT event_id, event_id % 31 % 24 + event_id % 40 AS ends, greatest(0, event_id % 31 % 24 + event_id % 40 - 24) * 3600000 AS beyond FROM {FIX} f) a) b""",
    "iso_candidates": f"SELECT request_id, parent_id, heading_idx, {r6('speed')} AS speed, {r6('lat_')} AS lat, {r6('lon_')} AS lon FROM {CANDIDATE} c",
    "iso_frontier": f"""SELECT request_id, sector, parent_id, heading_idx, {r6('lat')} AS lat, {r6('lon')} AS lon FROM
 (SELECT *, row_number() OVER (PARTITION BY request_id, sector, far > 2 ORDER BY left_, parent_id, heading_idx) AS near FROM
  (SELECT *, row_number() OVER (PARTITION BY request_id, sector ORDER BY out_ DESC, parent_id, heading_idx) AS far FROM {PLACED} p) q) r WHERE far <= 2 OR near = 1""",
    "iso_closest": f"""SELECT request_id, parent_id, heading_idx, {r6('gap')} AS gap_nm FROM (SELECT *, {hav('lat_', 'lon_', 'end_lat', 'end_lon')} AS gap,
 row_number() OVER (PARTITION BY request_id ORDER BY {hav('lat_', 'lon_', 'end_lat', 'end_lon')}, parent_id, heading_idx) AS n FROM {CANDIDATE} c) x WHERE n = 1""",
    "shore_allowance": f"SELECT id AS event_id, allowed FROM {ALLOWED} a",
    "constraint_violations": f"""SELECT CASE WHEN NOT allowed THEN 'too-close-to-shore' WHEN NOT within THEN 'too-far-offshore' WHEN depth_m IS NULL THEN 'depth-unavailable' WHEN depth_m < 5 THEN 'too-shallow'
 ELSE 'none' END AS violation, count(*) AS legs FROM {ALLOWED} a JOIN {OFFSHORE} o ON a.id = o.id LEFT JOIN {LEAST_DEPTH} d ON a.id = d.id GROUP BY ALL""",
    "request_validation": f"""SELECT CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 'incomplete: places and departure'
 WHEN o_orderkey % 29 > 24 THEN 'out of range: max_hours_per_day' {' '.join(f"WHEN o_orderkey % {n} = 1 AND NOT ({str(name == 'motor_kn').upper()} AND o_orderkey % 14 = 0) THEN 'out of range: {name}'" for name, most, n in LIMITS)}
 WHEN o_orderkey % 19 = 0 THEN 'unknown: objective' WHEN o_orderkey % 11 = 0 THEN 'out of range: alternative_count'
 WHEN o_orderkey % 14 = 0 THEN 'needed by the objective: motor_kn' ELSE 'ok' END AS answer, count(*) AS n FROM orders GROUP BY ALL""",
    "capability_readiness": """SELECT c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS ready, CASE WHEN NOT (c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0) THEN 'missing: '
 || array_to_string(list_filter([CASE WHEN c_custkey % 2 <> 0 THEN 'polar' END, CASE WHEN c_custkey % 3 = 0 THEN 'forecast' END,
 CASE WHEN c_custkey % 5 = 0 THEN 'shoreline' END], lambda x: x IS NOT NULL), ', ') END AS reason, count(*) AS n FROM customer GROUP BY ALL""",
    "file_names": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '.grib2' WHEN 1 THEN p_name || '.GRB' ELSE NULL END AS name FROM part",
    "stop_reasons": """SELECT CASE WHEN greatest(a, b, c, d) = 0 THEN NULL WHEN a > b AND a > c AND a > d THEN 'safety' WHEN b > c AND b > d THEN 'grib_exhausted' WHEN c > d THEN 'land' ELSE 'wind' END AS reason,
 CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN 'late; shallow' WHEN k % 2 = 0 THEN 'late' WHEN k % 3 <> 0 THEN 'shallow' END AS warning, count(*) AS n FROM
 (SELECT o_orderkey AS k, o_orderkey % 4 AS a, o_orderkey * 3 % 5 AS b, o_orderkey * 7 % 6 AS c, o_orderkey * 5 % 7 AS d FROM orders) x GROUP BY ALL""",
    "download_plan": f"""WITH a AS (SELECT *, start_ms + (seq * 37 % 500 - 40) * 3600000 AS dep, (start_ms + 5000000 - 28800000) // 21600000 * 21600000 AS cycle_ms FROM {FILE} f),
b AS (SELECT *, greatest(0, (dep - cycle_ms) / 3600000.0) AS lead_, CASE WHEN dep < cycle_ms - 10800000 THEN 'before the cycle' WHEN dep > cycle_ms + 384 * 3600000 THEN 'beyond the horizon' END AS rejected FROM a)
SELECT path AS area_id, cycle_ms, CAST(hour_ AS INT) AS hour, strftime(make_timestamp(cycle_ms * 1000), '%Y%m%d%H') || '-' || CAST(CAST(floor(lat_min - 1) AS INT) AS VARCHAR) || '_' || CAST(CAST(ceil(lat_max + 1) AS INT) AS VARCHAR)
 || '_' || CAST(CAST(floor(lon_min - 1) AS INT) AS VARCHAR) || '_' || CAST(CAST(ceil(lon_max + 1) AS INT) AS VARCHAR) || '-' || lpad(CAST(hour_ AS VARCHAR), 3, '0') AS key, rejected FROM
 (SELECT *, unnest(range(CAST(floor(lead_ / 3) * 3 AS BIGINT), 385, 3)) AS hour_ FROM b WHERE rejected IS NULL UNION ALL SELECT *, NULL FROM b WHERE rejected IS NOT NULL) c""",
    "stale_regions": "SELECT DISTINCT o_custkey % 40 AS id FROM orders WHERE o_custkey % 40 NOT IN (SELECT n_nationkey FROM nation)",
    "reusable_files": f"SELECT path, mtime, seq % 3 <> 0 AS reuse FROM {FILE} f",
    "nearest_rank": f"""SELECT event_type, {r6('avg(value)')} AS mean, {r6('max(CASE WHEN n = greatest(1, ceil(m * 0.5)) THEN value END)')} AS p50, {r6('max(CASE WHEN n = greatest(1, ceil(m * 0.95)) THEN value END)')} AS p95,
 {r6('min(value)')} AS least, {r6('max(value)')} AS most FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS m FROM events) x GROUP BY event_type""",
    "corridor_times": f"SELECT route_id, seq, {r6('run_nm')} AS run_nm, {r6(f'(t - {BASE_MS}) / 3.6e6')} AS hours FROM {TIMED} t",
    "corridor_anchors": f"""SELECT route_id, valid_ms, min_by(seq, (abs(t - valid_ms), -seq)) AS seq FROM {TIMED} t CROSS JOIN (SELECT {BASE_MS} + unnest(range(0, 12)) * 3600000 AS valid_ms) a GROUP BY route_id, valid_ms""",
    "hand_offs": f"""WITH RECURSIVE a AS (SELECT t.route_id, t.seq, run_nm, cleared FROM {TIMED} t JOIN {STATE} s ON t.route_id = s.route_id AND t.seq = s.seq),
b AS (SELECT route_id, min(seq) AS seq0, min_by(run_nm, seq) AS run0 FROM a WHERE cleared GROUP BY route_id),
r AS (SELECT a.route_id, seq, run_nm - run0 AS sailed, max(seq) OVER (PARTITION BY a.route_id) AS last_ FROM a JOIN b ON a.route_id = b.route_id WHERE seq > seq0),
walk AS (SELECT route_id, seq0 AS seq, 0 AS k, CAST(NULL AS DOUBLE) AS after_nm FROM b UNION ALL
 SELECT w.route_id, w.nxt, w.k + 1, [5.0, 10.0, 20.0, 40.0][w.k + 1] FROM (SELECT walk.route_id, walk.k, (SELECT min(r.seq) FROM r WHERE r.route_id = walk.route_id AND r.seq > walk.seq AND r.seq < r.last_
   AND r.sailed >= [5.0, 10.0, 20.0, 40.0][walk.k + 1]) AS nxt FROM walk WHERE walk.k < 4) w WHERE nxt IS NOT NULL)
SELECT route_id, seq, after_nm FROM walk WHERE k > 0""",
    "motor_walk": f"""WITH RECURSIVE f AS (SELECT route_id, seq, u, v, lead(leg_nm) OVER w AS nm, lead({brg('p_lat', 'p_lon', 'lat', 'lon')}) OVER w AS course FROM {LEG} g WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
walk AS (SELECT route_id, seq, CAST({BASE_MS} AS DOUBLE) AS t FROM f WHERE seq = 0 UNION ALL
 SELECT route_id, seq + 1, t + nm / greatest(0.3, 6 + ((u / 10 + k / 10) * sin(radians(course)) + (v / 10 - k / 20) * cos(radians(course))) * 1.94384) * 3600000 FROM
  (SELECT w.route_id, w.seq, t, nm, course, u, v, CASE WHEN t - {BASE_MS} <= 0 THEN 0 ELSE least(5, ceil((t - {BASE_MS}) / 21600000 - 0.5)) END AS k FROM walk w JOIN f ON w.route_id = f.route_id AND w.seq = f.seq WHERE nm IS NOT NULL) x)
SELECT route_id, seq, {r6(f'(t - {BASE_MS}) / 3.6e6')} AS hours FROM walk""",
    "usable_files": f"""SELECT CASE WHEN seq % 5 = 0 THEN 'auto-' || path ELSE path END AS path, type, end_ms FROM {FILE} f
WHERE end_ms >= {NOW} AND (seq % 5 = 0 OR (seq % 3 = 0 AND seq < 30))""",
    "lane_candidates": f"""WITH a AS (SELECT route_id, seq % 12 AS step, event_id, lat, lon FROM {FIX} f),
g AS (SELECT a.route_id, a.step, a.event_id, b.event_id AS lane, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS gap FROM a LEFT JOIN a b ON a.route_id = b.route_id AND a.step = b.step AND b.event_id % 3 = 0),
n AS (SELECT route_id, step, event_id, min(gap) AS gap, min_by(lane, (gap, lane)) AS lane FROM g GROUP BY ALL)
SELECT route_id AS request_id, step, event_id, coalesce(lane, 0) AS lane FROM n WHERE event_id % 7 = 0 OR gap IS NULL OR gap <= 3""",
    "motor_limits": f"""WITH m AS (SELECT event_id AS id, route_id, seq, lat, lon, coalesce(sum(leg_nm) OVER (PARTITION BY route_id ORDER BY seq), 0) / 6 + 48 AS hours FROM {LEG} g),
a AS (SELECT *, {BASE_MS} + CAST(floor(hours * 60) AS BIGINT) * 60000 AS t_ms FROM m),
f AS (SELECT a.id, a.lat, a.lon, t_ms, min_by(w.path, rank) AS path FROM a JOIN {RANKED} w ON w.type = 'wind' AND a.lat BETWEEN lat_min AND lat_max AND a.lon BETWEEN lon_min AND lon_max AND t_ms BETWEEN start_ms AND end_ms GROUP BY ALL),
n AS (SELECT f.id, f.path, f.lat, f.lon, min_by(frame, (abs(valid_ms - t_ms), valid_ms)) AS frame FROM f JOIN {VALID} v ON f.path = v.path GROUP BY ALL),
x AS (SELECT id, sqrt(pow(sum(weight * u), 2) + pow(sum(weight * v), 2)) * 1.94384 AS tws,
 sum(weight * swh) FILTER (WHERE swh >= 0 AND swh < 100) / nullif(sum(weight) FILTER (WHERE swh >= 0 AND swh < 100), 0) AS wave
 FROM {corners('n')} k JOIN {CELL} c ON k.path = c.path AND k.frame = c.frame AND k.i = c.i AND k.j = c.j GROUP BY id),
r AS (SELECT m.*, tws, wave, CASE WHEN x.id IS NULL THEN 'grib_exhausted' WHEN tws > 16 OR wave > 3.4 THEN 'wind' END AS fault FROM m LEFT JOIN x ON m.id = x.id)
SELECT route_id, seq, {r6('hours')} AS hours, {r6('tws')} AS tws, {r6('wave')} AS wave,
 min_by(fault, seq) FILTER (WHERE fault IS NOT NULL) OVER (PARTITION BY route_id) AS reason, min(seq) FILTER (WHERE fault IS NOT NULL) OVER (PARTITION BY route_id) AS stopped_seq FROM r""",
    "depth_files": f"SELECT id AS event_id, {r6('depth_m')} AS depth_m FROM {LEAST_DEPTH} d",
    "coast_files": f"""SELECT poly_id, ring_id, round(least(p, q).lat, 6) AS lat_a, round(least(p, q).lon, 6) AS lon_a, round(greatest(p, q).lat, 6) AS lat_b, round(greatest(p, q).lon, 6) AS lon_b
FROM (SELECT poly_id, ring_id, {{'lat': lat1, 'lon': lon1}} AS p, {{'lat': lat2, 'lon': lon2}} AS q FROM {EDGE} e) x""",
    "polar_files": """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 17 AS f, s_name FROM supplier),
r AS (SELECT *, CASE WHEN f = 16 THEN 'settings-unreadable' WHEN f = 12 THEN 'disabled' WHEN f = 13 THEN 'no-configuration' WHEN f = 15 THEN 'no-active-polar' WHEN f = 14 THEN 'invalid-id'
 WHEN f = 4 THEN 'no-resource' WHEN f = 11 THEN 'unreadable' WHEN f = 1 THEN 'kind' WHEN f = 2 THEN 'units' WHEN f = 3 THEN 'symmetry' WHEN f = 8 THEN 'axes' WHEN f IN (5, 6, 7) THEN 'axis-order' WHEN f IN (9, 10) THEN 'matrix' END AS reason FROM s),
g AS (SELECT k, i, j, (CASE i WHEN 0 THEN 2 + k % 3 WHEN 1 THEN 6 ELSE 10 END) * 1.9438444924406e0 AS tws, degrees(CASE j WHEN 0 THEN 0.5e0 ELSE 3.0e0 END) AS twa,
 (k * 3 + i * 5 + j * 7) % 11 / 2.0e0 * 1.9438444924406e0 * CASE WHEN k % 3 = 1 THEN 0.9e0 ELSE 1.0e0 END AS speed FROM s, range(3) a(i), range(2) b(j))
SELECT r.k AS vessel, CASE WHEN reason IS NULL THEN CASE WHEN r.k % 2 = 0 THEN s_name ELSE 'polar-' || r.k END END AS name, reason,
 round(tws, 6) + 0.0 AS tws, round(twa, 6) + 0.0 AS twa, round(speed, 6) + 0.0 AS speed FROM r LEFT JOIN g ON r.k = g.k AND reason IS NULL""",
    "wave_grid": f"""WITH {GRID_NEAR}
SELECT floor(n.lat * 10000 + 0.5) / 10000 AS lat, floor(n.lon * 10000 + 0.5) / 10000 AS lon,
 floor(sum(weight * swh) FILTER (WHERE swh >= 0 AND swh < 100) / nullif(sum(weight) FILTER (WHERE swh >= 0 AND swh < 100), 0) * 1000 + 0.5) / 1000 AS wave
FROM n JOIN {corners('n')} k ON n.id = k.id LEFT JOIN {CELL} c ON k.path = c.path AND k.frame = c.frame AND k.i = c.i AND k.j = c.j GROUP BY n.id, n.lat, n.lon""",
    "current_grid": f"""WITH w AS {FRESH}, t AS (SELECT path, min_by(frame, (abs(start_ms + frame * step_ms - {NOW}), frame)) AS frame FROM (SELECT *, unnest(range(0, n_times)) AS frame FROM w) x GROUP BY path)
SELECT floor((lat_min + i * lat_step) * 10000 + 0.5) / 10000 AS lat, floor((lon_min + j * lon_step) * 10000 + 0.5) / 10000 AS lon, {r6('u')} AS u, {r6('v')} AS v
FROM {FLOW} c JOIN t ON c.path = t.path AND c.frame = t.frame JOIN w ON w.path = c.path WHERE u * u + v * v >= 0.0001""",
    "currents_at": f"""SELECT event_id, {r6('coalesce(s.u, 0)')} AS u, {r6('coalesce(s.v, 0)')} AS v FROM {FIX} f LEFT JOIN
 (SELECT k.id, sum(weight * u) AS u, sum(weight * v) AS v FROM {corners(IN_FLOW).replace("WHERE type = 'wind'", "WHERE type = 'current'")} k JOIN {FLOW} c ON k.path = c.path AND k.frame = c.frame AND k.i = c.i AND k.j = c.j GROUP BY k.id) s ON event_id = s.id""",
    "geometry_keys": f"""SELECT route_id, length(g) AS size, sha256(g) AS geometry_sha256 FROM (SELECT route_id, string_agg(printf('%.5f,%.5f', lat, lon), ';' ORDER BY seq) AS g FROM {FIX} f GROUP BY route_id) x""",
    "route_hours": f"SELECT route_id, {r6('greatest(0, (max_by(t_ms, seq) - min_by(t_ms, seq)) / 3600000.0)')} AS hours FROM {FIX} f GROUP BY route_id",
    "shared_outcomes": """WITH a AS (SELECT o_custkey AS request_id, year(o_orderdate) AS y, o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) - 1 AS n,
 count(*) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS m FROM orders)
SELECT request_id, CASE WHEN m > 1 THEN n ELSE y - 1990 END AS attempt, CASE WHEN m > 1 THEN o_orderkey END AS route_id, CASE WHEN y % 2 = 0 THEN 'late' END AS warning FROM a""",
    "search_progress": f"SELECT o_custkey AS request_id, {r6('avg(greatest(0.0, least(1.0, (o_orderkey % 23 - 3) / 16.0))) * 100')} AS percent FROM orders GROUP BY o_custkey",
    "step_summary": " UNION ALL ".join(
        f"SELECT '{name}' AS field, {r6(f'min({x}) * 1e0')} AS least, {r6(f'max({x}) * 1e0')} AS most, round(sum({x}) * 1e0, 2) AS total FROM events"
        for name, x in (("frontier", "event_id % 97"), ("candidates", "event_id % 1013"), ("total_ms", "value"))
    ),
    "departure_error": f"""WITH s AS (SELECT min(start_ms) AS a, max(end_ms) AS b FROM {WIND} w), o AS (SELECT {BASE_MS} + (o_orderkey % 1200 - 200) * 3600000 AS dep FROM orders)
SELECT CASE WHEN dep > b THEN 'forecast ends before' WHEN dep < a THEN 'forecast starts after' ELSE 'none' END AS answer, count(*) AS n FROM o, s GROUP BY ALL""",
    "vessel_draft": """WITH n AS (SELECT * FROM (VALUES (0, 'design.draft.current'), (1, 'design.draft.maximum'), (2, 'design.draft.minimum'), (3, 'steering.draft')) AS x(n, path)),
v AS (SELECT s_suppkey AS vessel_id, path, n, s_suppkey * 7 + n * 3 AS k FROM supplier, n),
g AS (SELECT vessel_id, path, k % 30 / 10.0 AS draft, CASE WHEN vessel_id % 3 = 1 AND n = 3 OR vessel_id % 3 = 2 AND n = 1 THEN -1 WHEN n = 3 THEN 99 ELSE n END AS place FROM v WHERE k % 4 <> 0 AND k % 5 <> 0 AND k % 30 > 0)
SELECT vessel_id, min_by(path, place) AS path, round(min_by(draft, place), 6) + 0.0 AS draft_m FROM g WHERE place < 99 GROUP BY vessel_id""",
    "segments_on_land": f"""WITH land AS {ON_LAND}, back AS (SELECT event_id, lag(event_id) OVER (PARTITION BY route_id ORDER BY seq) AS prev FROM {FIX} f)
SELECT DISTINCT event_id FROM (SELECT id AS event_id FROM {CROSSING} c UNION ALL SELECT b.event_id FROM back b JOIN land l ON b.event_id = l.event_id OR b.prev = l.event_id WHERE prev IS NOT NULL) x""",
    "bounded_polygons": f"""SELECT poly_id, count(*) AS edges, {r6('sum(lat1)')} AS lat_sum, {r6('max(lon2)')} AS lon_max FROM (SELECT poly_id, lat1, lon2 FROM {EDGE} e
 UNION ALL SELECT * FROM (VALUES (-1, 54.0, 22.0), (-1, 54.0, 22.0), (-1, 60.0, 9.0), (-1, 60.0, 9.0)) AS b(poly_id, lat1, lon2)) x GROUP BY poly_id""",
    "route_boxes": f"""SELECT route_id, {r6('greatest(-85, min(lat) - 0.5)')} AS lat_min, {r6('least(85, max(lat) + 0.5)')} AS lat_max, {r6('greatest(-180, min(lon) - 0.5)')} AS lon_min, {r6('least(180, max(lon) + 0.5)')} AS lon_max
FROM {FIX} f GROUP BY route_id""",
    "region_index": f"""SELECT 'area-' || poly_id || CASE WHEN ring_id > 0 THEN '__' || ring_id ELSE '' END AS key, 'area-' || poly_id AS region, count(*) AS points, {r6('sum(lon)')} AS lon_sum, {r6('sum(lat)')} AS lat_sum
FROM {duck('ring')} r GROUP BY ALL""",
}
