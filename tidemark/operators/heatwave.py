"""Heatwave detection on daily series: climatology, threshold, event runs, event metrics.

Definition: Hobday et al. 2016, Progress in Oceanography 141. After the daily mean a site holds at most one row
per calendar day, so per-site windows and per-slot percentiles below work on bounded groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import round_half_even
from tidemark.operators.aggregate import metric_table, quantiles
from tidemark.operators.ordered import as_list
from tidemark.operators.windows import null_repeats, shift_to_baseline

SLOTS = 366


def daily_series(df: DataFrame, site, ts: str, c: str, t: str = "t", out: str = "temp") -> DataFrame:
    """Daily mean per site."""
    return df.groupBy(*as_list(site), F.to_date(ts).alias(t)).agg(F.avg(c).alias(out))


def complete_days(daily: DataFrame, site, t: str = "t") -> DataFrame:
    """Every calendar day between the site's first and last one; missing days hold NULL."""
    site = as_list(site)
    ends = daily.groupBy(*site).agg(F.min(t).alias("__a"), F.max(t).alias("__b"))
    days = ends.select(*site, F.explode(F.sequence("__a", "__b", F.expr("INTERVAL 1 DAY"))).alias(t))
    return days.join(daily, [*site, t], "left")


def doy366(d: Column) -> Column:
    """Day of year in 366 slots: Feb 29 is 60, and later days of other years are shifted by one."""
    year = F.year(d)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.dayofyear(d) + F.when(~leap & (F.month(d) >= 3), 1).otherwise(0)


def _near_days(df: DataFrame, t: str, slot: str, half: int) -> DataFrame:
    """Copy each day to the slots of the calendar days within ``half`` of it: of common years, none to slot 60."""
    day = F.explode(F.array(*[F.date_add(F.col(t), k) for k in range(-half, half + 1)])).alias("__day")
    return df.select("*", day).withColumn(slot, doy366(F.col("__day"))).drop("__day")


def _spread(df: DataFrame, slot: str, half: int) -> DataFrame:
    """Copy each row to the slots within ``half`` of its own, around the year's end."""
    near = F.array(*[F.pmod(F.col(slot) - 1 + k, F.lit(SLOTS)) + 1 for k in range(-half, half + 1)])
    return df.withColumn(slot, F.explode(near))


def climatology(
    daily: DataFrame,
    site,
    half_width: int = 5,
    pctile: float = 0.9,
    period: tuple[str, str] | None = None,
    t: str = "t",
    c: str = "temp",
) -> DataFrame:
    """Mean ``seas`` and percentile ``thresh`` per day-of-year slot from the days within ``half_width`` days.

    Slot 60 (Feb 29) is the mean of its neighbours. Days are exploded to their slots, so the rest is one equi-key
    aggregation; a slot holds (2 half_width + 1) values per year, in common and in leap years.
    """
    site = as_list(site)
    base = daily.filter(F.col(c).isNotNull())
    if period is not None:
        base = base.filter(F.col(t).between(F.lit(period[0]).cast("date"), F.lit(period[1]).cast("date")))
    slots = _near_days(base.select(*site, F.col(t).alias("__t"), F.col(c).alias("__v")), "__t", "doy", half_width)
    clim = slots.groupBy(*site, "doy").agg(
        F.avg("__v").alias("seas"), F.percentile("__v", F.lit(float(pctile))).alias("thresh")
    )
    leap = clim.filter(F.col("doy").isin(59, 61)).groupBy(*site).agg(
        F.lit(60).alias("doy"), F.avg("seas").alias("seas"), F.avg("thresh").alias("thresh")
    )
    return clim.filter("doy <> 60").unionByName(leap)


def smooth_circular(clim: DataFrame, site, width: int = 31) -> DataFrame:
    """Moving average of both curves over ``width`` slots around the year."""
    wide = _spread(clim, "doy", width // 2)
    return wide.groupBy(*as_list(site), "doy").agg(F.avg("seas").alias("seas"), F.avg("thresh").alias("thresh"))


def exceedance(daily: DataFrame, clim: DataFrame, site, t: str = "t", c: str = "temp") -> DataFrame:
    """Daily rows with ``seas``, ``thresh`` and whether the value is above the threshold (a missing value is not)."""
    keyed = daily.withColumn("doy", doy366(F.col(t)))
    joined = keyed.join(clim, [*as_list(site), "doy"], "left")
    return joined.withColumn("exceeds", F.coalesce(F.col(c) > F.col("thresh"), F.lit(False)))


def runs(flagged: DataFrame, site, min_days: int = 5, t: str = "t") -> DataFrame:
    """Stretches of consecutive exceeding days, ``min_days`` or longer: (date_start, date_end, duration)."""
    site = as_list(site)
    hot = flagged.filter("exceeds").select(*site, t)
    island = F.date_sub(F.col(t), F.row_number().over(Window.partitionBy(*site).orderBy(t)))
    found = hot.withColumn("__island", island).groupBy(*site, "__island")
    stretch = found.agg(F.min(t).alias("date_start"), F.max(t).alias("date_end"))
    stretch = stretch.withColumn("duration", F.datediff("date_end", "date_start") + 1).drop("__island")
    return stretch.filter(F.col("duration") >= min_days)


def join_gaps(stretches: DataFrame, site, max_gap: int = 2) -> DataFrame:
    """Merge stretches at most ``max_gap`` days apart and number the events of each site from 1."""
    site = as_list(site)
    w = Window.partitionBy(*site).orderBy("date_start")
    gap = F.datediff("date_start", F.lag("date_end").over(w)) - 1
    numbered = stretches.withColumn("__new", F.coalesce((gap > max_gap).cast("int"), F.lit(1)))
    numbered = numbered.withColumn("event_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    events = numbered.groupBy(*site, "event_no").agg(
        F.min("date_start").alias("date_start"), F.max("date_end").alias("date_end")
    )
    return events.withColumn("duration", F.datediff("date_end", "date_start") + 1)


EVENT = ["event_no", "date_start", "date_end", "duration"]


def event_days(flagged: DataFrame, events: DataFrame, site, t: str = "t") -> DataFrame:
    """Daily rows of each event (including merged gap days)."""
    days = F.explode(F.sequence("date_start", "date_end", F.expr("INTERVAL 1 DAY"))).alias(t)
    return events.select(*as_list(site), *EVENT, days).join(flagged, [*as_list(site), t])


def _measures(t: str, c: str) -> dict[str, Column]:
    anomaly = F.col("__i")
    return {
        "date_peak": F.min_by(t, F.struct(-anomaly, F.col(t))),
        "intensity_max": F.max(anomaly),
        "intensity_mean": F.avg(anomaly),
        "intensity_cumulative": F.sum(anomaly),
        "intensity_max_relThresh": F.max(F.col(c) - F.col("thresh")),
        "intensity_max_abs": F.max(c),
    }


def event_metrics(flagged: DataFrame, events: DataFrame, site, t: str = "t", c: str = "temp") -> DataFrame:
    """Duration, start, peak and end dates, and intensities above the seasonal mean (peak = earliest maximum)."""
    days = event_days(flagged, events, site, t).withColumn("__i", F.col(c) - F.col("seas"))
    return days.groupBy(*as_list(site), *EVENT).agg(*[m.alias(n) for n, m in _measures(t, c).items()])


def event_rates(flagged: DataFrame, events: DataFrame, site, t: str = "t", c: str = "temp") -> DataFrame:
    """The metrics of :func:`event_metrics` with ``rate_onset`` and ``rate_decline`` per day.

    The edge anomaly is the mean of the event's edge day and the day outside it; an event touching the end of the
    series has no rate there. ``flagged`` must hold every calendar day.
    """
    site = as_list(site)
    w = Window.partitionBy(*site).orderBy(t)
    sided = flagged.withColumn("__i", F.col(c) - F.col("seas"))
    sided = sided.withColumns(
        {"__onset": (F.lag("__i").over(w) + F.col("__i")) / 2, "__decline": (F.col("__i") + F.lead("__i").over(w)) / 2}
    )
    edges = {"__from": F.min_by("__onset", t), "__to": F.max_by("__decline", t)}
    out = event_days(sided, events, site, t).groupBy(*site, *EVENT)
    out = out.agg(*[m.alias(n) for n, m in {**_measures(t, c), **edges}.items()])
    top = F.col("intensity_max")
    return out.withColumns(
        {
            "rate_onset": (top - F.col("__from")) / (F.datediff("date_peak", "date_start") + 0.5),
            "rate_decline": (top - F.col("__to")) / (F.datediff("date_end", "date_peak") + 0.5),
        }
    ).drop(*edges)


def event_table(events: DataFrame, since: str | None = None, months: Sequence[int] | None = None) -> DataFrame:
    """Events after a date with start and end months, longest first; optionally only those starting in ``months``."""
    out = events if since is None else events.filter(F.col("date_start") > F.lit(since).cast("date"))
    out = out.withColumns({"month_start": F.month("date_start"), "month_end": F.month("date_end")})
    if months is not None:
        out = out.filter(F.col("month_start").isin(*months))
    return out.orderBy(F.col("duration").desc(), "date_start")


def pool_sites(events: Sequence[DataFrame]) -> DataFrame:
    """One list of the events of several sites."""
    out = events[0]
    for e in events[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    return out


def mean_across_sites(daily: DataFrame, t: str = "t", c: str = "temp") -> DataFrame:
    return daily.groupBy(t).agg(F.avg(c).alias(c))


# Labels of the event metrics in the summary table.
METRICS = {
    "Duration": "duration",
    "Max intensity": "intensity_max",
    "Mean intensity": "intensity_mean",
    "Onset rate": "rate_onset",
    "Decline rate": "rate_decline",
}


def event_summary(events: DataFrame) -> DataFrame:
    """95th percentile and mean of each event metric."""
    return metric_table(events, METRICS).toDF("metric", "percentile_95", "mean")


def duration_summary(events: DataFrame) -> DataFrame:
    """p90, p95, quartiles (inverse distribution), mean, sd, se and extremes of the duration."""
    d = events.select(F.lit(1).alias("__g"), F.col("duration").cast("double").alias("d"))
    moments = d.groupBy("__g").agg(
        F.count("d").alias("n"),
        F.avg("d").alias("mean"),
        F.stddev_samp("d").alias("sd"),
        F.min("d").alias("min"),
        F.max("d").alias("max"),
    )
    ranked = quantiles(d, "__g", "d", [0.9, 0.95], inverse={"q25": 0.25, "q50": 0.5, "q75": 0.75})
    joined = moments.join(ranked, "__g").drop("__g")
    return joined.withColumn("se", F.col("sd") / F.sqrt(F.col("n").cast("double")))


def daily_status(flagged: DataFrame, events: DataFrame, site, t: str = "t") -> DataFrame:
    """Daily rows with their event number (NULL outside events) and ``event`` flag."""
    inside = event_days(flagged, events, site, t).select(*as_list(site), t, "event_no")
    return flagged.join(inside, [*as_list(site), t], "left").withColumn("event", F.col("event_no").isNotNull())


def label_subdaily(sub: DataFrame, daily: DataFrame, site, ts: str, cols: Sequence[str], t: str = "t") -> DataFrame:
    """Attach the day's status to each sub-daily reading."""
    site = as_list(site)
    keyed = sub.withColumn(t, F.to_date(ts))
    return keyed.join(daily.select(*site, t, *cols), [*site, t], "left").select(*sub.columns, *cols)


def monthly_stat(daily: DataFrame, months: Sequence[int], fn: str, t: str = "t", c: str = "temp", site=None) -> DataFrame:
    """Mean or max per year and month for a set of months, ordered as the months are listed."""
    place = F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(months) for x in (m, i + 1)]), F.month(t))
    chosen = daily.filter(F.month(t).isin(*months)).groupBy(
        *as_list(site), F.year(t).alias("year"), F.month(t).alias("month"), place.alias("season_index")
    )
    stat = {"mean": F.avg, "max": F.max, "min": F.min}[fn](c)
    return chosen.agg(stat.alias("value")).orderBy("season_index", "year")


def threshold_band(clim_daily: DataFrame, a: str, b: str, offsets: dict[str, float], t: str = "t", c: str = "temp"):
    """Daily ribbon of a slice: shifted seasonal curves and the upper edge ``max(thresh, temp)`` (NULL if temp is)."""
    piece = clim_daily.filter(F.col(t).between(F.lit(a).cast("date"), F.lit(b).cast("date")))
    top = F.when(F.col(c).isNotNull() & F.col("thresh").isNotNull(), F.greatest("thresh", c))
    return piece.withColumns({n: F.col("seas") + F.lit(float(o)) for n, o in offsets.items()}).withColumn("ribbon", top)


def compare_profile(sub: DataFrame, daily: DataFrame, ts: str, c: str = "temp", t: str = "t") -> DataFrame:
    """Per day: the sub-daily mean and extremes against the daily value and the seasonal mean."""
    per = sub.groupBy(F.to_date(ts).alias(t)).agg(
        F.avg(c).alias("sub_mean"), F.min(c).alias("sub_min"), F.max(c).alias("sub_max")
    )
    joined = per.join(daily.select(t, F.col(c).alias("daily"), "seas"), t, "left")
    return joined.withColumns(
        {"diff_daily": F.col("sub_mean") - F.col("daily"), "anomaly": F.col("sub_mean") - F.col("seas")}
    )


def overlay_daily(sub: DataFrame, daily: DataFrame, ts: str, order, cols: Sequence[str], t: str = "t") -> DataFrame:
    """Sub-daily rows with the day's values shown once per day (the first occurrence of each value)."""
    joined = label_subdaily(sub, daily, [], ts, cols, t).withColumn(t, F.to_date(ts))
    return null_repeats(joined, t, order, cols)


def build_profile(
    df: DataFrame, clim_daily: DataFrame, a: str, b: str, offsets: dict[str, float], ts: str, c: str = "temp", t: str = "t"
) -> DataFrame:
    """Set-point profile: readings of [a, b), averaged per time, moved onto the seasonal curve, rounded to 2 digits."""
    d = F.to_date(ts)
    piece = df.filter((d >= F.lit(a).cast("date")) & (d < F.lit(b).cast("date")))
    per = piece.groupBy(ts).agg(F.avg(c).alias(c)).withColumn(t, F.to_date(ts))
    moved = shift_to_baseline(per, clim_daily, t, c, "seas", offsets)
    return moved.select(ts, t, *[round_half_even(F.col(n), 2).alias(n) for n in offsets])
