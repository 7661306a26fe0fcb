"""GRIB2 files: a scan of messages, and their values for regular grids with simple and complex packing.

Files are read as binary rows, so they can lie in any store Spark reads; a
task holds one file.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (discipline, category, number) of the fields that are used.
FIELDS = {(0, 2, 2): "wind_u", (0, 2, 3): "wind_v", (10, 0, 3): "wave", (10, 1, 2): "current_u", (10, 1, 3): "current_v"}
#: Ocean values from here on are fill.
FILL = 9000.0
SCHEMA = (
    "path string, mtime long, message int, discipline int, field string, reference_ms long, valid_ms long, n_lat int, n_lon int, "
    "lat_min double, lat_max double, lon_min double, lon_max double, lat_step double, lon_step double, values array<float>, reason string"
)
#: The kind of surface and the height of the wind that is sailed by, metres above ground.
WIND_LEVEL = (103, 10.0)


def _signed(data: bytes) -> int:
    """A sign bit and a magnitude."""
    value = int.from_bytes(data, "big")
    top = 1 << (len(data) * 8 - 1)
    return -(value - top) if value & top else value


def messages(data: bytes) -> Iterator[tuple[int, dict[int, bytes]]]:
    """(discipline, sections by number) of every GRIB2 message, whatever lies between them."""
    at = data.find(b"GRIB")
    while at >= 0:
        if len(data) < at + 16 or data[at + 7] != 2:
            at = data.find(b"GRIB", at + 4)
            continue
        (size,) = struct.unpack_from(">Q", data, at + 8)
        pos, end, sections = at + 16, at + size - 4, {}
        while pos + 5 <= end:
            (length,) = struct.unpack_from(">I", data, pos)
            if length < 5:
                break
            sections[data[pos + 4]] = data[pos : pos + length]
            if data[pos + 4] == 7:
                yield data[at + 6], dict(sections)
            pos += length
        at = data.find(b"GRIB", at + size)


def _numbers(data: bytes, at: int, bits: int, count: int) -> tuple[np.ndarray, int]:
    """``count`` unsigned numbers of ``bits`` each from byte ``at`` on, and the byte after them."""
    if not bits:
        return np.zeros(count, np.int64), at
    end = at + -(-bits * count // 8)
    raw = np.unpackbits(np.frombuffer(data, np.uint8, end - at, at))[: count * bits].reshape(count, bits)
    return raw.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64)), end


def _groups(packing: bytes, body: bytes, differences: bool) -> np.ndarray:
    """Whole numbers of complex packing, NaN for missing ones: groups of a reference, a width and a length; with ``differences``, sums of them."""
    bits, missing = packing[19], packing[22]
    groups, width_base, width_bits, length_base, length_step, last_length, length_bits = struct.unpack_from(">IBBIBIB", packing, 31)
    at, first, least = 5, [], 0
    if differences:
        order, size = packing[47], packing[48]
        parts = [_signed(body[at + k * size : at + (k + 1) * size]) for k in range(order + 1)] if size else [0] * (order + 1)
        first, least, at = parts[:-1], parts[-1], at + (order + 1) * size
    references, at = _numbers(body, at, bits, groups)
    widths, at = _numbers(body, at, width_bits, groups)
    lengths, at = _numbers(body, at, length_bits, groups)
    widths, lengths = widths + width_base, lengths * length_step + length_base
    lengths[-1:] = last_length
    sizes = widths * lengths
    stream = np.unpackbits(np.frombuffer(body, np.uint8, offset=at))
    begins = np.cumsum(sizes) - sizes
    values = np.zeros(int(lengths.sum()))
    group = np.repeat(np.arange(groups), lengths)
    inside = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    for width in np.unique(widths).tolist():  # at most a few dozen widths
        mine = np.flatnonzero(widths[group] == width)
        lost = np.zeros(len(mine), bool)
        if width:
            place = begins[group[mine]] + inside[mine] * width
            raw = stream[place[:, None] + np.arange(width)].astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
            for k in range(missing):
                lost |= raw == (1 << width) - 1 - k
        else:
            raw = np.zeros(len(mine), np.int64)
            for k in range(missing):
                lost |= references[group[mine]] == (1 << bits) - 1 - k
        values[mine] = np.where(lost, np.nan, references[group[mine]] + raw)
    if differences:
        known = ~np.isnan(values)
        steps = values[known] + least
        steps[: len(first)] = first
        if len(first) == 2 and len(steps) > 1:  # the second difference's sum begins with the first step
            steps[1] -= steps[0]
            steps[1:] = np.cumsum(steps[1:])
        values[known] = np.cumsum(steps)
    return values


def decode(discipline: int, sections: dict[int, bytes]) -> dict | None:
    """One message's field, times, grid and values, row 0 in the south; null if its field is not used.

    A message of a used field that cannot be read has a ``reason`` and no
    values: its grid or packing, or a wind of another level.
    """
    one, grid, product, packing, bitmap, body = (sections.get(k) for k in (1, 3, 4, 5, 6, 7))
    if product is None or len(product) < 28:
        return None
    field = FIELDS.get((discipline, product[9], product[10]))
    if field is None:
        return None
    if None in (one, grid, packing, body):
        return dict(field=field, reason="incomplete")
    kind, template = struct.unpack_from(">H", grid, 12)[0], struct.unpack_from(">H", packing, 9)[0]
    if kind != 0:
        return dict(field=field, reason=f"grid {kind}")
    if template not in (0, 2, 3):
        return dict(field=field, reason=f"packing {template}")
    level = product[22], struct.unpack_from(">I", product, 24)[0] / 10.0 ** _signed(product[23:24])
    if field.startswith("wind") and level != WIND_LEVEL:
        return dict(field=field, reason=f"level {level[0]}: {level[1]:g}")
    year, month, day, hour, minute, second = struct.unpack_from(">HBBBBB", one, 12)
    reference = dt.datetime(year, month, day, hour, minute, second, tzinfo=dt.timezone.utc)
    unit = {0: 60, 1: 3600, 2: 86400, 10: 3 * 3600, 11: 6 * 3600, 12: 12 * 3600, 13: 1}.get(product[17], 3600)
    reference_ms = int(reference.timestamp()) * 1000
    n_lon, n_lat = struct.unpack_from(">II", grid, 30)
    lat1, lat2 = _signed(grid[46:50]) / 1e6, _signed(grid[55:59]) / 1e6
    lon1, lon2 = ((x + 180.0) % 360.0 - 180.0 for x in (_signed(grid[50:54]) / 1e6, _signed(grid[59:63]) / 1e6))
    lon_step, lat_step = (struct.unpack_from(">I", grid, at)[0] / 1e6 for at in (63, 67))
    (count,) = struct.unpack_from(">I", packing, 5)
    (base,) = struct.unpack_from(">f", packing, 11)
    binary, decimal, bits = _signed(packing[15:17]), _signed(packing[17:19]), packing[19]
    packed = _numbers(body, 5, bits, count)[0].astype(float) if template == 0 else _groups(packing, body, template == 3)
    values = (base + packed * 2.0**binary) / 10.0**decimal
    if bitmap is not None and bitmap[5] == 0:
        there = np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=6))[: n_lat * n_lon].astype(bool)
        whole = np.full(n_lat * n_lon, np.nan)
        whole[there] = values
        values = whole
    values = values.reshape(n_lat, n_lon)
    if lat1 > lat2:
        values = values[::-1]
    if field.startswith("current"):
        values = np.where(np.isnan(values) | (values >= FILL), 0.0, values)
    return dict(
        field=field, reference_ms=reference_ms, valid_ms=reference_ms + struct.unpack_from(">I", product, 18)[0] * unit * 1000, n_lat=n_lat, n_lon=n_lon,
        lat_min=min(lat1, lat2), lat_max=max(lat1, lat2), lon_min=lon1, lon_max=lon2, lat_step=lat_step, lon_step=lon_step, values=values.astype(np.float32).ravel(), reason=None,
    )


def _decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for frame in frames:
        for path, mtime, content in zip(frame["path"], frame["mtime"], frame["content"], strict=True):
            for i, (discipline, sections) in enumerate(messages(content)):
                found = decode(discipline, sections)
                if found:
                    yield pd.DataFrame([dict.fromkeys(names) | dict(path=path, mtime=mtime, message=i, discipline=discipline) | found])[names]


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    """One row a message of a used field in the GRIB files in ``folder``, not below it; ``reason`` says why one has no values."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[gG][rR]{[iI],}[bB]{2,}").load(folder)
    return files.select("path", F.unix_millis("modificationTime").alias("mtime"), "content").mapInPandas(_decoded, SCHEMA)


def file_table(messages_: DataFrame) -> DataFrame:
    """Forecast files from their messages: wind if there is any, else current; files with neither are left out."""
    messages_ = messages_.filter("reason is null")
    kinds = messages_.groupBy("path").agg(F.max(F.col("field") == "wind_u").alias("wind"), F.max(F.col("field") == "current_u").alias("current"), F.max(F.col("field") == "wave").alias("has_wave"))
    first = messages_.join(kinds, "path").filter(F.col("field") == F.when(F.col("wind"), "wind_u").when(F.col("current"), "current_u"))
    same = [F.first(c).alias(c) for c in ("mtime", "lat_min", "lat_max", "lon_min", "lon_max", "lat_step", "lon_step")]
    return first.groupBy("path").agg(
        F.first(F.when(F.col("wind"), "wind").otherwise("current")).alias("type"), F.min_by("reference_ms", "message").alias("reference_ms"), F.min("valid_ms").alias("start_ms"),
        F.max("valid_ms").alias("end_ms"), F.count_distinct("valid_ms").cast("int").alias("n_times"), F.first("has_wave").alias("has_wave"), *same,
    )


def frames(messages_: DataFrame, kind: str = "wind") -> DataFrame:
    """(path, frame, valid_ms, u, v) of complete pairs of components, in order of time; of ``wave`` (path, frame, valid_ms, wave)."""
    from pyspark.sql import Window as W

    messages_ = messages_.filter("reason is null")
    number = F.row_number().over(W.partitionBy("path").orderBy("valid_ms")) - 1
    if kind == "wave":
        rows = messages_.filter("field = 'wave'").groupBy("path", "valid_ms").agg(F.max_by("values", "message").alias("wave"))
        return rows.withColumn("frame", number).select("path", "frame", "valid_ms", "wave")
    u = messages_.filter(F.col("field") == f"{kind}_u").select("path", "valid_ms", F.col("values").alias("u"))
    v = messages_.filter(F.col("field") == f"{kind}_v").select("path", "valid_ms", F.col("values").alias("v"))
    both = u.join(v, ["path", "valid_ms"])
    return both.withColumn("frame", number).select("path", "frame", "valid_ms", "u", "v")


def wave_table(messages_: DataFrame) -> DataFrame:
    """(path, lat_min, lat_max, lon_min, lon_max, lat_step, lon_step) of the grid of each file's waves, which may be another than its wind's."""
    same = [F.first(c).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max", "lat_step", "lon_step")]
    return messages_.filter("field = 'wave' and reason is null").groupBy("path").agg(*same)


def cells(frames_: DataFrame, files: DataFrame) -> DataFrame:
    """(path, frame, i, j, and the values) of frames on the grids of ``files``."""
    wide = files.select("path", (F.round((F.col("lon_max") - F.col("lon_min")) / F.col("lon_step")) + 1).cast("int").alias("n_lon"))
    values = [c for c in ("u", "v", "wave") if c in frames_.columns]
    rows = frames_.join(wide, "path").select("path", "frame", "n_lon", F.posexplode(F.arrays_zip(*values)).alias("k", "x"))
    return rows.select("path", "frame", F.floor(F.col("k") / F.col("n_lon")).cast("int").alias("i"), (F.col("k") % F.col("n_lon")).cast("int").alias("j"), *[F.col(f"x.{v}").cast("double").alias(v) for v in values])
