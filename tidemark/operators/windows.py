"""Window features over ordered series (differences, cumulative sums, rolling statistics, runs, peaks).

All of them are built on :mod:`tidemark.operators.ordered`, so a single very long series is spread over
tasks. ``order`` must identify rows uniquely within a series; pass ``chunk`` to set the chunk size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.time import elapsed
from tidemark.operators.ordered import (
    SERIES,
    as_list,
    chunked,
    lagged,
    neighbourhood,
    running,
    value_chunk,
    with_group_stats,
)
from tidemark.session import cut_lineage


def diff_prev(df: DataFrame, by, order, c: str, out: str, chunk=None) -> DataFrame:
    """Difference to the previous row; the first row of a series is compared with itself."""
    return neighbourhood(
        df,
        by,
        order,
        lambda w: {
            out: F.when(F.lag(F.lit(1)).over(w).isNull(), F.col(c) - F.col(c)).otherwise(
                F.col(c) - F.lag(c).over(w)
            )
        },
        before=1,
        chunk=chunk,
    )


def diff_n(df: DataFrame, by, order, c: str, n: int, prefix: str = "diff", chunk=None) -> DataFrame:
    """Differences of order 1..n (NULL until enough rows precede), as ``prefix1``..``prefixn``."""

    def exprs(w):
        level = {0: [F.col(c)] + [F.lag(c, k).over(w) for k in range(1, n + 1)]}
        for d in range(1, n + 1):
            prev = level[d - 1]
            level[d] = [prev[i] - prev[i + 1] for i in range(len(prev) - 1)]
        return {f"{prefix}{d}": level[d][0] for d in range(1, n + 1)}

    return neighbourhood(df, by, order, exprs, before=n, chunk=chunk)


def cumsum(df: DataFrame, by, order, c: str, out: str, na: str = "skip", fill=None, chunk=None) -> DataFrame:
    """Running sum per series (add the phase to ``by`` to restart it).

    ``na="poison"``: from the first NULL on the sum is undefined and becomes ``fill``.
    ``na="skip"``: NULLs add nothing.
    """
    if na == "skip":
        return running(df, by, order, {out: ("sum", c)}, chunk)
    missing = F.col(c).isNull().cast("int")
    both = running(df, by, order, {out: ("sum", c), "__missing": ("max", missing)}, chunk)
    return both.withColumn(out, F.when(F.col("__missing") == 1, F.lit(fill)).otherwise(F.col(out))).drop("__missing")


def rel_first(df: DataFrame, by, order, c: str, out: str) -> DataFrame:
    """Value relative to the first one of its series (NULL when that is 0 or missing)."""
    first = F.min_by(F.col(c), F.struct(*as_list(order)))
    return with_group_stats(df, by, {"__first": first}).withColumn(out, F.try_divide(F.col(c), F.col("__first"))).drop(
        "__first"
    )


_ROLL = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}


def rolling(df: DataFrame, by, order, c: str, k: int, named: dict[str, str], chunk=None) -> DataFrame:
    """Trailing statistics over ``k`` rows: ``{new: mean|min|max|sum}``; NULL until ``k`` values are present."""

    def exprs(w):
        frame = w.rowsBetween(-(k - 1), 0)
        full = F.count(c).over(frame) == k
        return {n: F.when(full, _ROLL[fn](c).over(frame)) for n, fn in named.items()}

    return neighbourhood(df, by, order, exprs, before=k - 1, chunk=chunk)


def fill_down(df: DataFrame, by, order, cols, chunk=None) -> DataFrame:
    """Carry the last non-missing value forward in each of ``cols``."""
    cols = as_list(cols)
    filled = running(df, by, order, {f"__f_{c}": ("last", c) for c in cols}, chunk)
    return filled.withColumns({c: F.col(f"__f_{c}") for c in cols}).select(*df.columns)


def change_flag(df: DataFrame, by, order, c: str, out: str, chunk=None) -> DataFrame:
    """1 where the value differs from the previous row (NULLs compare equal), 0 otherwise and on first rows."""
    return neighbourhood(
        df,
        by,
        order,
        lambda w: {
            out: (F.lag(F.lit(1)).over(w).isNotNull() & ~F.col(c).eqNullSafe(F.lag(c).over(w))).cast("int")
        },
        before=1,
        chunk=chunk,
    )


def run_id(df: DataFrame, by, order, c: str, out: str, chunk=None) -> DataFrame:
    """Number of the run of equal values a row belongs to, from 1."""
    cut, at = chunked(df, by, order, chunk)
    flagged = change_flag(cut, by, order, c, "__change", at)
    numbered = running(flagged, by, order, {out: ("sum", F.col("__change"))}, at)
    return numbered.withColumn(out, F.col(out) + 1).select(*df.columns, out)


def change_points(df: DataFrame, by, order, c: str, chunk=None) -> DataFrame:
    """Rows whose value differs from the one before."""
    return change_flag(df, by, order, c, "__change", chunk).filter("__change = 1").drop("__change")


def null_repeats(df: DataFrame, by, order, cols) -> DataFrame:
    """Keep the first occurrence of a value within its group and blank the later ones."""
    by, order = as_list(by), as_list(order)
    out = df
    for c in as_list(cols):
        firsts = with_group_stats(out.withColumn("__v", F.col(c)), by + ["__v"], {"__at": F.min(F.struct(*order))})
        out = firsts.withColumn(c, F.when(F.struct(*order) == F.col("__at"), F.col(c))).select(*df.columns)
    return out


def zscore(df: DataFrame, by, named: dict[str, str]) -> DataFrame:
    """Standard scores ``{new: column}`` per group, or over the whole table without ``by``."""
    stats = {}
    for n, c in named.items():
        stats[f"__m_{n}"], stats[f"__s_{n}"] = F.avg(c), F.stddev_samp(c)
    out = with_group_stats(df, by, stats)
    out = out.withColumns(
        {n: F.try_divide(F.col(c) - F.col(f"__m_{n}"), F.col(f"__s_{n}")) for n, c in named.items()}
    )
    return out.select(*df.columns, *named)


def lag_features(df: DataFrame, by, order, c: str, ks, chunk=None) -> DataFrame:
    """Columns ``<c>_lag<k>``, NULL where the current value is NULL."""
    return neighbourhood(
        df,
        by,
        order,
        lambda w: {f"{c}_lag{k}": F.when(F.col(c).isNotNull(), F.lag(c, k).over(w)) for k in ks},
        before=max(ks),
        chunk=chunk,
    )


def relative_time(df: DataFrame, by, ts: str, out: str, unit: str = "day") -> DataFrame:
    """Time since the first row of the group."""
    return (
        with_group_stats(df, by, {"__start": F.min(ts)})
        .withColumn(out, elapsed(F.col(ts), F.col("__start"), unit))
        .drop("__start")
    )


def row_index(df: DataFrame, by, order, out: str, chunk=None) -> DataFrame:
    """Position of the row in its ordered series, from 1."""
    return running(df, by, order, {out: ("count", F.lit(1))}, chunk)


def find_peaks(df: DataFrame, by, order, c: str, m: int, out: str = "is_peak", chunk=None) -> DataFrame:
    """Flag local maxima: the slope falls at the row and no row within ``m`` on either side is higher.

    Ties are allowed, so both ends of a plateau qualify; the first and last row of a series never do.
    """

    def exprs(w):
        x, prev, nxt = F.col(c), F.lag(c).over(w), F.lead(c).over(w)
        left = F.max(c).over(w.rowsBetween(-m, -1))
        right = F.max(c).over(w.rowsBetween(1, m))
        falls = F.signum(x - prev) > F.signum(nxt - x)
        return {out: F.coalesce(falls & (left <= x) & (right <= x), F.lit(False))}

    return neighbourhood(df, by, order, exprs, before=m, after=m, chunk=chunk)


def peak_period(df: DataFrame, by, order, c: str, m: int, lag: int = 2, chunk=None) -> DataFrame:
    """Peaks with their row index and its difference to the peak ``lag`` peaks earlier."""
    cut, at = chunked(df, by, order, chunk)
    peaks = row_index(find_peaks(cut, by, order, c, m, "__peak", at), by, order, "peak_index", at)
    peaks = cut_lineage(peaks.filter("__peak").select(*df.columns, "peak_index"))
    out = lagged(peaks, by, ["peak_index"], {"__prev": ("peak_index", lag)})
    return out.withColumn("period", F.col("peak_index") - F.col("__prev")).drop("__prev")


def p_adjust(df: DataFrame, p: str, method: str, out: str, by=None) -> DataFrame:
    """Adjusted p-values over all rows of a family: ``bonferroni`` or ``bh``; NULLs are not counted.

    Equal p-values are counted first, so the ranking works on distinct values in value buckets.
    """
    by = as_list(by)
    known = df.filter(F.col(p).isNotNull())
    if method == "bonferroni":
        counted = with_group_stats(df, by, {"__n": F.count(p)})
        return counted.withColumn(out, F.least(F.lit(1.0), F.col(p) * F.col("__n"))).drop("__n")
    if method != "bh":
        raise ValueError(method)
    counts = cut_lineage(known.groupBy(*by, p).agg(F.count(F.lit(1)).alias("__m")))
    bucket = F.col("__bucket")
    ranks = {"__rank": ("sum", "__m"), "__n": ("total", "__m")}
    ranked = running(value_chunk(counts, by, p), by, [p], ranks, bucket)
    ranked = cut_lineage(ranked.withColumn("__raw", F.col(p) * F.col("__n") / F.col("__rank")))
    adjusted = running(ranked, by, [p], {"__adj": ("min", "__raw")}, bucket, descending=True)
    table = adjusted.select(F.struct(*by, p).alias(SERIES), F.least(F.lit(1.0), F.col("__adj")).alias(out))
    return df.withColumn(SERIES, F.struct(*by, p)).join(table, SERIES, "left").select(*df.columns, out)


def shift_to_baseline(df: DataFrame, daily: DataFrame, day: str, c: str, base: str, offsets: dict[str, float], by=None):
    """Move a sub-daily series onto a daily baseline: ``c - (daily mean - baseline - offset)`` per named offset.

    ``daily`` holds one row per (``by``, ``day``). Also adds the day's ``mean_daily`` and ``sd_daily``.
    """
    keys = as_list(by) + [day]
    stats = with_group_stats(df, keys, {"mean_daily": F.avg(c), "sd_daily": F.stddev_samp(c)})
    joined = stats.join(daily.select(*keys, base), keys, "left")
    return joined.withColumns(
        {n: F.col(c) - (F.col("mean_daily") - F.col(base) - F.lit(float(o))) for n, o in offsets.items()}
    )


def cohort(df: DataFrame, ts: str, out: str = "weeks", first: str = "first_date", by=None) -> DataFrame:
    """Two-week cohorts of whole elapsed weeks, cut at 1, 3, 5, ... and closed on the right (1 included).

    Week 0 and weeks beyond the last cut have no cohort. ``first`` is the earliest date of the row's
    cohort, the rows without one being a group of their own.
    """
    by = as_list(by)
    week: Column = F.floor(elapsed(F.col(ts), F.col("__start"), "day") / 7)
    weeks = with_group_stats(df, by, {"__start": F.min(ts), "__end": F.max(ts)}).withColumn("week", week)
    last_week = F.floor(elapsed(F.col("__end"), F.col("__start"), "day") / 7)
    last_cut = last_week - F.pmod(last_week - 1, F.lit(2))
    label = F.greatest(F.lit(1), F.ceil((F.col("week") - 1) / 2))
    labelled = weeks.withColumn(out, F.when(F.col("week").between(F.lit(1), last_cut), label))
    return with_group_stats(labelled, by + [out], {first: F.min(ts)}).drop("__start", "__end")
