"""Live fixes: windowed conditions with late data, and hours underway kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_MS, HOUR_MS = 86_400_000, 3_600_000.0


def conditions(fixes: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(start, end, route_id, n, wind_avg, wind_max) of fixes (route_id, ts, tws); fixes later than ``late`` are left out."""
    rows = fixes.withWatermark("ts", late).groupBy(F.window("ts", window, slide or window), "route_id")
    out = rows.agg(F.count("*").alias("n"), F.avg("tws").alias("wind_avg"), F.max("tws").alias("wind_max"))
    return out.select("window.start", "window.end", "route_id", "n", "wind_avg", "wind_max")


def passages(fixes: DataFrame, gap: str = "6 hours", late: str = "12 hours") -> DataFrame:
    """(start, end, route_id, n) of sessions: fixes of a route without a gap."""
    rows = fixes.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "route_id").agg(F.count("*").alias("n"))
    return rows.select("session_window.start", "session_window.end", "route_id", "n")


STATE = "departure long, last long, day long, hours double, late long"
OUT = "route_id long, t_ms long, day long, hours_today double, allowed boolean, closed boolean, late long"


def _budget(max_hours: float, quiet_ms: int | None):
    within = lambda hours: not 0 < max_hours < hours - 1e-9

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        departure, last, day, hours, late = state.get if state.exists else (None, None, 0, 0.0, 0)
        out = []
        if state.hasTimedOut:
            out.append((key[0], last, day, hours, within(hours), True, late))
            state.remove()
        else:
            for frame in frames:
                for t, speed in frame.sort_values("t_ms")[["t_ms", "speed"]].itertuples(index=False):
                    if departure is None:
                        departure = last = int(t)
                    if t < last:
                        late += 1
                        continue
                    while last < t:
                        edge = min(int(t), departure + (day + 1) * DAY_MS)
                        hours += (edge - last) / HOUR_MS if speed and speed > 0 else 0.0
                        last = edge
                        if last == departure + (day + 1) * DAY_MS:
                            done, day, hours = hours, day + 1, 0.0
                            if not within(done):
                                out.append((key[0], last, day - 1, done, False, False, late))
                    out.append((key[0], int(t), day, hours, within(hours), False, late))
            if departure is not None:
                state.update((departure, last, day, hours, late))
                if quiet_ms is not None:
                    state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[part.split()[0] for part in OUT.split(", ")])

    return run


def day_budget(fixes: DataFrame, max_hours: float, quiet_hours: float | None = None, late: str = "2 hours") -> DataFrame:
    """Hours underway of each passage day as fixes (route_id, t_ms, speed) arrive; the state of a route is five numbers.

    With ``quiet_hours``, a route without a fix for so long gets a last row, ``closed``, for the day that it was
    in, and its state goes: a later fix is the departure of a new passage.  That goes by event time: fixes that
    come more than ``late`` behind the newest ones are left out.  Fixes older than a route's last one change
    nothing and are counted in ``late``.  Fixes without a time are left out.
    """
    fixes = fixes.filter("t_ms is not null")
    timeout = GroupStateTimeout.NoTimeout
    if quiet_hours is not None:
        fixes = fixes.select("route_id", "t_ms", "speed", F.timestamp_millis("t_ms").alias("_at")).withWatermark("_at", late)
        timeout = GroupStateTimeout.EventTimeTimeout
    run = _budget(max_hours, None if quiet_hours is None else round(quiet_hours * HOUR_MS))
    return fixes.groupBy("route_id").applyInPandasWithState(run, OUT, STATE, "append", timeout)
