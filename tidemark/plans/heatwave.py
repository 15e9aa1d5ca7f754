"""From readings to heatwave events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators import heatwave as hw
from tidemark.operators.ordered import as_list
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class Heatwaves:
    daily: DataFrame
    climatology: DataFrame
    flagged: DataFrame
    events: DataFrame


def smoothed_daily(readings: DataFrame, site, ts: str, c: str, days: int = 1) -> DataFrame:
    """Daily means, optionally as a trailing mean over ``days`` daily rows, on a complete calendar.

    The readings are scanned once: every later step uses the daily table, which is cut here.
    """
    site = as_list(site)
    daily = hw.daily_series(readings, site, ts, c)
    if days > 1:
        trailing = Window.partitionBy(*site).orderBy("t").rowsBetween(1 - days, 0)
        full = F.count("temp").over(trailing) == days
        daily = daily.withColumn("temp", F.when(full, F.avg("temp").over(trailing))).filter("temp is not null")
    return hw.complete_days(cut_lineage(daily), site)


def detect(
    daily: DataFrame,
    site,
    half_width: int = 5,
    pctile: float = 0.9,
    smooth: int = 31,
    min_days: int = 5,
    max_gap: int = 2,
    period: tuple[str, str] | None = None,
) -> Heatwaves:
    """Climatology, threshold exceedance and events with metrics and rates of a complete daily series.

    The flagged days (one row per site and day) are cut, as the events and their measures both read them.
    """
    clim = hw.climatology(daily, site, half_width, pctile, period)
    if smooth:
        clim = hw.smooth_circular(clim, site, smooth)
    flagged = cut_lineage(hw.exceedance(daily, clim, site))
    events = hw.join_gaps(hw.runs(flagged, site, min_days), site, max_gap)
    return Heatwaves(daily, clim, flagged, hw.event_rates(flagged, events, site))
