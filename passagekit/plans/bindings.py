"""Domain tables derived from the driver's tables by arithmetic on their keys.

Each is one SQL text that Spark and DuckDB read alike; ``{name}`` stands for a
source table or another view.  Times are UTC milliseconds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from passagekit.functions.polar import Polar

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "events")
#: 2024-01-01 00:00 UTC.
BASE_MS = 1704067200000

#: The polar table that all queries sail by.
POLAR = Polar(
    (6.0, 10.0, 16.0, 20.0),
    (40.0, 60.0, 90.0, 120.0, 150.0, 180.0),
    ((3.0, 4.5, 5.2, 5.4), (4.2, 5.8, 6.6, 6.9), (4.8, 6.4, 7.3, 7.8), (4.4, 6.2, 7.5, 8.3), (3.4, 5.1, 6.7, 7.6), (2.8, 4.3, 6.0, 6.9)),
)

VIEWS = {
    # route points of events: a route is a user's events in order of time
    "fix": """
SELECT route_id, seq, event_id, t_ms, lat, lon, heading, u, v, wave, propulsion, speed, cleared, path,
       sqrt(u * u + v * v) * 1.94384 AS tws,
       (degrees(atan2(-u, -v)) + 360.0) % 360.0 AS wind_from
FROM (SELECT user_id AS route_id, event_id, {ms} AS t_ms,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  54.0 + (user_id * 37 % 100) / 25.0 + (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 0.012
       + (event_id * 7919 % 100) / 2500.0 AS lat,
  10.0 + (user_id * 53 % 100) / 12.5 + (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 0.02
       + (event_id * 104729 % 100) / 1500.0 AS lon,
  CAST(event_id * 47 % 360 AS DOUBLE) AS heading,
  (event_id * 31 % 41 - 20) / 2.0 + 0.25 AS u, (event_id * 17 % 41 - 20) / 2.0 + 0.25 AS v,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id * 13 % 50) / 10.0 END AS wave,
  CASE event_type WHEN 'click' THEN 'sail' WHEN 'error' THEN 'sail' WHEN 'purchase' THEN 'motor' WHEN 'view' THEN 'wait' ELSE NULL END AS propulsion,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN value > 12 THEN 12.0 ELSE value END AS speed,
  CASE WHEN event_id % 17 = 0 THEN TRUE WHEN event_id % 19 = 0 THEN FALSE ELSE NULL END AS cleared,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('file-', CAST(event_id % 60 AS VARCHAR(20))) END AS path
FROM {events}) e""",
    # forecast files of suppliers
    "forecast_file": """
SELECT concat('file-', CAST(s_suppkey AS VARCHAR(20))) AS path, s_suppkey AS seq, CASE WHEN s_suppkey % 9 = 8 THEN 'current' ELSE 'wind' END AS type,
  1704067200000 + s_suppkey % 40 * 6 * 3600000 AS reference_ms,
  1704067200000 + s_suppkey % 40 * 6 * 3600000 AS start_ms,
  1704067200000 + s_suppkey % 40 * 6 * 3600000 + (9 + s_suppkey * 7 % 20) * (1 + s_suppkey % 2 * 2) * 3600000 AS end_ms,
  CAST(10 + s_suppkey * 7 % 20 AS INT) AS n_times,
  CAST((1 + s_suppkey % 2 * 2) * 3600000 AS BIGINT) AS step_ms,
  54.0 + s_suppkey * 7 % 5 AS lat_min, 56.0 + s_suppkey * 7 % 5 + s_suppkey % 3 AS lat_max,
  9.0 + s_suppkey * 11 % 9 AS lon_min, 12.0 + s_suppkey * 11 % 9 + s_suppkey % 4 AS lon_max,
  CASE WHEN s_suppkey % 3 = 0 THEN 0.25 ELSE 0.5 END AS lat_step,
  CASE WHEN s_suppkey % 3 = 0 THEN 0.25 ELSE 0.5 END AS lon_step,
  s_suppkey * 977 % 1000 AS mtime
FROM {supplier}""",
    # rings of nations: an octagon, and inside every third one an octagon of water
    "ring": """
SELECT n_nationkey AS poly_id, ring_id, idx,
  10.6 + n_nationkey * 29 % 40 / 4.0 + r / (1.0 + ring_id) * x AS lon, 54.4 + n_nationkey * 13 % 40 / 8.0 + r / (1.0 + ring_id) * y AS lat
FROM (SELECT n_nationkey, 0 AS ring_id, 0.15 + n_nationkey % 4 * 0.06 AS r FROM {nation}
      UNION ALL SELECT n_nationkey, 1 AS ring_id, 0.15 + n_nationkey % 4 * 0.06 AS r FROM {nation} WHERE n_nationkey % 3 = 0) n
CROSS JOIN (VALUES (0, 1.0, 0.03), (1, 0.71, 0.7), (2, 0.02, 1.0), (3, -0.7, 0.72), (4, -1.0, 0.01), (5, -0.69, -0.7), (6, 0.01, -1.0), (7, 0.7, -0.71)) AS o(idx, x, y)""",
    # edges of the rings; the last one closes the ring
    "edge": """
SELECT a.poly_id, a.ring_id, a.idx, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2
FROM {ring} a JOIN {ring} b ON a.poly_id = b.poly_id AND a.ring_id = b.ring_id AND b.idx = (a.idx + 1) % 8""",
    # avoided regions: a tilted square for each region
    "region_edge": """
SELECT r_regionkey AS region_id, idx, 55.2 + r_regionkey * 0.9 + 0.3 * y1 AS lat1, 12.0 + r_regionkey * 1.7 + 0.5 * x1 AS lon1,
  55.2 + r_regionkey * 0.9 + 0.3 * y2 AS lat2, 12.0 + r_regionkey * 1.7 + 0.5 * x2 AS lon2
FROM {region} CROSS JOIN (VALUES (0, 1.0, 0.1, 0.1, 1.0), (1, 0.1, 1.0, -1.0, 0.1), (2, -1.0, 0.1, 0.1, -1.0), (3, 0.1, -1.0, 1.0, 0.1)) AS s(idx, x1, y1, x2, y2)""",
    # depth raster of parts: a row of 100 pixels of 0.1 degree for each 100 parts
    "depth_cell": """
SELECT CAST(p_partkey % 100 AS INT) AS x, CAST(p_partkey // 100 AS INT) AS y,
  CASE WHEN p_size = 1 THEN -9999.0 ELSE 3.0 - p_retailprice / 40.0 END AS raw
FROM {part}""",
    # alternatives of orders: a request is a customer's
    "alternative": """
SELECT o_custkey AS request_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS attempt,
  concat('g', CAST(o_orderkey % 3 AS VARCHAR(20)), '-', CAST(o_orderkey * 7 % 11 AS VARCHAR(20))) AS geometry,
  o_orderstatus <> 'P' AS complete, o_orderkey % 3 AS warning_count,
  4.0 + o_orderkey * 37 % 200 / 10.0 AS duration_hours, 20.0 + o_orderkey * 13 % 100 / 4.0 AS distance_nm,
  o_orderkey * 11 % 30 / 10.0 AS motor_hours,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 0.5 + o_orderkey * 3 % 20 / 10.0 END AS wave_avg,
  CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 4 = 0 THEN NULL ELSE 0.9 + o_orderkey * 3 % 20 / 8.0 END AS wave_p95,
  5.0 + o_orderkey * 17 % 60 / 4.0 AS wind_avg, 8.0 + o_orderkey * 17 % 60 / 3.0 AS wind_p95,
  o_orderkey * 5 % 7 AS maneuvers, o_orderkey * 3 % 4 AS low_headway
FROM {orders}""",
}

SPARK = {"ms": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000"}
DUCK = {"ms": "epoch_us(ts) // 1000"}


def _doubles(text: str) -> str:
    """Numbers with a point as doubles: both engines would read them as decimals."""
    return re.sub(r"\b(\d+\.\d+)\b", r"\1e0", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a source table by its own name."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _doubles(VIEWS[name]).replace("{ms}", SPARK["ms"]).replace("p_partkey // 100", "p_partkey div 100").replace("VARCHAR(20)", "STRING")
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in used})


def duck(name: str) -> str:
    """The same view as a DuckDB subquery."""
    if name in TABLES:
        return name
    text = _doubles(VIEWS[name]).replace("{ms}", DUCK["ms"])
    return "(" + re.sub(r"\{(\w+)\}", lambda m: duck(m[1]), text) + ")"
