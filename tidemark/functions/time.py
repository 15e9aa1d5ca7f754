"""Time expressions: parsing, calendar buckets, weekday rules, elapsed time, set-point ramps.

Naive local time is kept as ``timestamp_ntz``; arithmetic goes through whole microseconds, so results
do not depend on the session time zone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Spark's short day names, Monday first.
WEEKDAYS = {
    "Monday": "MON",
    "Tuesday": "TUE",
    "Wednesday": "WED",
    "Thursday": "THU",
    "Friday": "FRI",
    "Saturday": "SAT",
    "Sunday": "SUN",
}

# Layouts accepted by parse_time, by name.
LAYOUTS = {
    "ymd": ["yyyy-M-d", "yyyy/M/d", "yyyyMMdd"],
    "mdy": ["M/d/yyyy", "M-d-yyyy"],
    "ymd_hms": ["yyyy-M-d H:m:s[.SSSSSS]", "yyyy-M-d'T'H:m:s[.SSSSSS]['Z']", "yyyy/M/d H:m:s"],
    "mdy_hms": ["M/d/yyyy H:m:s", "M-d-yyyy H:m:s"],
}

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of the wall-clock reading."""
    gap = ts.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def part(name: str, size: int) -> Column:
        return F.extract(F.lit(name), gap).cast("long") * F.lit(size).cast("long")

    whole = part("DAY", 86_400_000_000) + part("HOUR", 3_600_000_000) + part("MINUTE", 60_000_000)
    return whole + (F.extract(F.lit("SECOND"), gap) * 1_000_000).cast("long")


def parse_time(c: Column, layout: str) -> Column:
    """Text to date (``ymd``, ``mdy``) or naive timestamp (``ymd_hms``, ``mdy_hms``); NULL if no layout fits."""
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in LAYOUTS[layout]])
    return parsed.cast("timestamp_ntz") if layout.endswith("hms") else parsed.cast("date")


def date_from_parts(y: Column, m: Column, d: Column) -> Column:
    return F.make_date(y, m, d)


def decimal_day_to_ts(date: Column, fraction: Column) -> Column:
    """Date plus a fraction of a day, to the whole second."""
    seconds = F.bround(fraction * 86400, 0).cast("long")
    return shift_time(date.cast("timestamp_ntz"), seconds=seconds)


def shift_time(ts: Column, days: float = 0, hours: float = 0, seconds=0) -> Column:
    """Move a time by (possibly fractional) days and hours; 365.25-day years come in as days."""
    total = F.lit(days * 86400.0 + hours * 3600.0).cast("double") + seconds
    return ts + F.make_dt_interval(secs=total.cast("decimal(18,6)"))


def bucket(ts: Column, unit: str, week_start: int = 7) -> Column:
    """Floor to minute/hour/day/week/month/year. Weeks start on Sunday (7) or Monday (1)."""
    if unit == "week":
        return F.date_sub(F.next_day(ts.cast("date"), "SUN" if week_start == 7 else "MON"), 7)
    floored = F.date_trunc(unit, ts)
    return floored.cast("date") if unit in ("day", "month", "year") else floored.cast("timestamp_ntz")


def bucket_ceiling(ts: Column, unit: str, week_start: int = 7) -> Column:
    """Next boundary at or after ``ts``; a time on the boundary stays."""
    low = bucket(ts, unit, week_start)
    step = {"minute": "INTERVAL '1' MINUTE", "hour": "INTERVAL '1' HOUR"}
    if unit in step:
        up = low + F.expr(step[unit])
    elif unit in ("day", "week"):
        up = F.date_add(low, 1 if unit == "day" else 7)
    else:
        up = F.add_months(low, 1 if unit == "month" else 12)
    return F.when(ts.cast("timestamp_ntz") == low.cast("timestamp_ntz"), low).otherwise(up)


def sat_fri_week(ts: Column) -> Column:
    """The Friday closing the Saturday-Friday week of ``ts``."""
    return F.next_day(F.date_sub(ts.cast("date"), 1), "FRI")


def next_weekday_in(ts: Column, days: Sequence[str]) -> Column:
    """First date on or after ``ts`` that falls on one of the named weekdays."""
    nexts = [F.next_day(F.date_sub(ts.cast("date"), 1), WEEKDAYS[d]) for d in days]
    return nexts[0] if len(nexts) == 1 else F.least(*nexts)


def elapsed(ts: Column, anchor: Column, unit: str) -> Column:
    """Time from ``anchor`` to ``ts`` as a double in the unit."""
    return elapsed_seconds(ts, anchor) / F.lit(float(SECONDS[unit]))


def elapsed_seconds(ts: Column, anchor: Column) -> Column:
    """Seconds between two wall-clock times, with microseconds."""
    gap = ts.cast("timestamp_ntz") - anchor.cast("timestamp_ntz")
    return F.extract(F.lit("DAY"), gap) * 86400.0 + F.extract(F.lit("HOUR"), gap) * 3600.0 + F.extract(
        F.lit("MINUTE"), gap
    ) * 60.0 + F.extract(F.lit("SECOND"), gap).cast("double")


def correct_dates(c: Column, fixes: dict[str, str]) -> Column:
    """Replace known wrong dates (ISO text to ISO text)."""
    out = c
    for wrong, right in fixes.items():
        out = F.when(c == F.lit(wrong).cast("date"), F.lit(right).cast("date")).otherwise(out)
    return out


def override_before(ts: Column, cutover: str, target: Column, source: Column) -> Column:
    """``source`` for rows before the cut-over time, ``target`` from then on."""
    return F.when(ts < F.lit(cutover).cast("timestamp_ntz"), source).otherwise(target)


def ramp_setpoint(base: Column, ts: Column, start: Column, rate_per_day: float, cap: float, direction: str) -> Column:
    """Set point during a ramp: ``base`` plus a change that grows to ``cap``, or shrinks from it to 0."""
    moved = elapsed(ts, start, "day") * F.lit(float(rate_per_day))
    if direction == "up":
        return base + F.least(moved, F.lit(float(cap)))
    return base + F.greatest(F.lit(float(cap)) - moved, F.lit(0.0))


def splice(ts: Column, moves: Sequence[tuple[Column, float]]) -> Column:
    """Close gaps in a timeline: the first predicate that holds shifts the row by its offset in seconds."""
    out = None
    for when, seconds in moves:
        shifted = shift_time(ts, seconds=F.lit(float(seconds)))
        out = F.when(when, shifted) if out is None else out.when(when, shifted)
    return ts if out is None else out.otherwise(ts)
