"""From wide controller logs to labelled long telemetry and its weekly and three-day summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.numeric import choose_by_label
from tidemark.functions.time import WEEKDAYS, next_weekday_in, override_before, sat_fri_week
from tidemark.operators.aggregate import summarise
from tidemark.operators.scalar import lookup
from tidemark.operators.shape import to_long
from tidemark.operators.windows import rolling


def telemetry_long(
    wide: DataFrame, probes: Sequence[str], sensors: DataFrame, cutover: str, since: str, ts: str = "timestamp"
) -> DataFrame:
    """One row per reading with treatment, tank, set point, week (its Friday), and the measuring days around it.

    Before ``cutover`` all treatments had the chill set point. ``sensors`` maps sensor to (tank, treatment); a probe it
    does not list is ``unknown``. The filter on ``since`` comes first, so it reaches the scan.
    """
    t = F.col(ts)
    kept = wide.filter(t > F.lit(since).cast("timestamp_ntz"))
    for c in ("severe_set", "extreme_set"):
        kept = kept.withColumn(c, override_before(t, cutover, F.col(c), F.col("chill_set")))
    sets = ["chill_set", "severe_set", "extreme_set"]
    long = lookup(to_long(kept, [ts, *sets], list(probes)), sensors, "sensor", {"treatment": "unknown"})
    nearest = next_weekday_in(t, ["Monday", "Wednesday", "Friday"])
    named = {s.split("_")[0]: F.col(s) for s in sets}
    return long.select(
        ts,
        "treatment",
        "tank",
        "sensor",
        choose_by_label(F.col("treatment"), named).alias("temp_set"),
        "temperature",
        sat_fri_week(t).alias("week"),
        nearest.alias("next_mwf"),
        F.date_sub(nearest, 1).alias("last_sutth"),
    )


def weekly_temperature(long: DataFrame, by: Sequence[str], ts: str = "timestamp", c: str = "temperature") -> DataFrame:
    """Mean and extremes per group and Saturday-Friday week."""
    weeks = long.withColumn("friday", sat_fri_week(F.col(ts)))
    return summarise(weeks, [*by, "friday"], c, ("mean", "min", "max")).withColumnsRenamed(
        {"mean": "avg_temp", "min": "min_temp", "max": "max_temp"}
    )


def three_day_temperature(
    long: DataFrame, by: Sequence[str], series: str, days: Sequence[str], ts: str = "timestamp", c: str = "temperature"
) -> DataFrame:
    """Daily summary with the trailing three daily means of each series, kept on the named weekdays.

    The three-day minimum and maximum are those of the daily means.
    """
    daily = summarise(long.withColumn("date", F.to_date(ts)), [*by, "date"], c, ("mean", "min", "max"))
    daily = daily.withColumnsRenamed({"mean": "avg_temp", "min": "min_temp", "max": "max_temp"})
    names = {f"{fn}_last_3_days": fn for fn in ("mean", "min", "max")}
    rolled = rolling(daily, series, "date", "avg_temp", 3, names)
    short = [WEEKDAYS[d].title() for d in days]
    return rolled.filter(F.date_format("date", "EEE").isin(*short))
