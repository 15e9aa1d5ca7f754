"""Window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import (
    PANEL,
    TELEMETRY,
    TELEMETRY_GAPS,
    panel,
    query,
    rounded,
    table,
    telemetry,
    telemetry_gaps,
)
from tidemark.operators import windows as win

ORDER = ["timestamp", "event_id"]
WIN = "(PARTITION BY tank ORDER BY timestamp, event_id)"
PWIN = "(PARTITION BY unit ORDER BY date, obs)"


@query(
    "e01_diff_prev",
    f"""SELECT unit, obs, round(size - coalesce(lag(size) OVER {PWIN}, size), 4) + 0.0 AS d FROM {PANEL}""",
)
def _e01(spark, sf):
    out = win.diff_prev(panel(spark, sf), "unit", ["date", "obs"], "size", "d", chunk="year")
    return rounded(out.select("unit", "obs", "d"), 4, "d")


@query(
    "e02_diff_n",
    f"""WITH a AS (SELECT *, temperature - lag(temperature) OVER {WIN} AS diff1 FROM {TELEMETRY})
    SELECT event_id, round(diff1, 4) + 0.0 AS diff1, round(diff1 - lag(diff1) OVER {WIN}, 4) + 0.0 AS diff2 FROM a""",
)
def _e02(spark, sf):
    out = win.diff_n(telemetry(spark, sf), "tank", ORDER, "temperature", 2)
    return rounded(out.select("event_id", "diff1", "diff2"), 4, "diff1", "diff2")


@query(
    "e03_cumsum_phase",
    f"""SELECT obs, round(sum(size) OVER (PARTITION BY unit, phase ORDER BY date, obs), 2) AS growth FROM {PANEL}""",
)
def _e03(spark, sf):
    out = win.cumsum(panel(spark, sf), ["unit", "phase"], ["date", "obs"], "size", "growth", chunk="year")
    return rounded(out.select("obs", "growth"), 2, "growth")


@query(
    "e03_cumsum_tank",
    f"""SELECT event_id, round(sum(temperature) OVER {WIN}, 2) AS total FROM {TELEMETRY}""",
)
def _e03b(spark, sf):
    out = win.cumsum(telemetry(spark, sf), "tank", ORDER, "temperature", "total")
    return rounded(out.select("event_id", "total"), 2, "total")


@query(
    "e04_cumsum_poison",
    f"""WITH a AS (SELECT obs, unit, date, CASE WHEN obs % 11 <> 0 THEN size END AS size FROM {PANEL})
    SELECT obs, round(CASE WHEN max(CASE WHEN size IS NULL THEN 1 ELSE 0 END) OVER {PWIN} = 1 THEN 0
      ELSE sum(size) OVER {PWIN} END, 2) AS removed_cum FROM a""",
)
def _e04(spark, sf):
    holes = panel(spark, sf).withColumn("size", F.when(F.col("obs") % 11 != 0, F.col("size")))
    out = win.cumsum(holes, "unit", ["date", "obs"], "size", "removed_cum", na="poison", fill=0.0, chunk="year")
    return rounded(out.select("obs", "removed_cum"), 2, "removed_cum")


@query(
    "e05_rel_first",
    f"""SELECT obs, round(size / first_value(size) OVER {PWIN}, 5) AS rel FROM {PANEL}""",
)
def _e05(spark, sf):
    out = win.rel_first(panel(spark, sf), "unit", ["date", "obs"], "size", "rel")
    return rounded(out.select("obs", "rel"), 5, "rel")


@query(
    "e06_rolling",
    f"""WITH a AS (SELECT *, count(temperature) OVER w AS n, avg(temperature) OVER w AS m, min(temperature) OVER w AS lo,
      max(temperature) OVER w AS hi FROM {TELEMETRY}
      WINDOW w AS (PARTITION BY tank ORDER BY timestamp, event_id ROWS 2 PRECEDING))
    SELECT event_id, round(CASE WHEN n = 3 THEN m END, 5) AS roll_mean, CASE WHEN n = 3 THEN lo END AS roll_min,
      CASE WHEN n = 3 THEN hi END AS roll_max FROM a""",
)
def _e06(spark, sf):
    out = win.rolling(
        telemetry(spark, sf),
        "tank",
        ORDER,
        "temperature",
        3,
        {"roll_mean": "mean", "roll_min": "min", "roll_max": "max"},
    )
    return rounded(out.select("event_id", "roll_mean", "roll_min", "roll_max"), 5, "roll_mean")


@query(
    "e07_fill_down",
    f"""SELECT event_id, last_value(temperature IGNORE NULLS) OVER (PARTITION BY tank ORDER BY timestamp, event_id
      ROWS UNBOUNDED PRECEDING) AS temperature FROM {TELEMETRY_GAPS}""",
)
def _e07(spark, sf):
    return win.fill_down(telemetry_gaps(spark, sf), "tank", ORDER, "temperature").select("event_id", "temperature")


@query(
    "e08_run_id",
    f"""WITH a AS (SELECT *, CASE WHEN genet <> lag(genet) OVER {WIN} THEN 1 ELSE 0 END AS ch FROM {TELEMETRY})
    SELECT event_id, CAST(1 + sum(ch) OVER {WIN} AS BIGINT) AS run FROM a""",
)
def _e08(spark, sf):
    return win.run_id(telemetry(spark, sf), "tank", ORDER, "genet", "run").select("event_id", "run")


@query(
    "e09_null_repeats",
    f"""SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY tank, CAST(timestamp AS DATE), genet
      ORDER BY timestamp, event_id) = 1 THEN genet END AS genet FROM {TELEMETRY}""",
)
def _e09(spark, sf):
    t = telemetry(spark, sf).withColumn("day", F.to_date("timestamp"))
    return win.null_repeats(t, ["tank", "day"], ORDER, "genet").select("event_id", "genet")


@query(
    "e10_zscore_group",
    f"""SELECT obs, round((size - avg(size) OVER g) / stddev_samp(size) OVER g, 5) + 0.0 AS z FROM {PANEL}
      WINDOW g AS (PARTITION BY phase, factor)""",
)
def _e10(spark, sf):
    out = win.zscore(panel(spark, sf), ["phase", "factor"], {"z": "size"})
    return rounded(out.select("obs", "z"), 5, "z")


@query(
    "e10_zscore_global",
    f"""SELECT obs, round((size - (SELECT avg(size) FROM {PANEL})) / (SELECT stddev_samp(size) FROM {PANEL}), 5) + 0.0
      AS z FROM {PANEL}""",
)
def _e10b(spark, sf):
    return rounded(win.zscore(panel(spark, sf), None, {"z": "size"}).select("obs", "z"), 5, "z")


@query(
    "e11_lag_features",
    f"""SELECT event_id, CASE WHEN temperature IS NOT NULL THEN lag(temperature, 1) OVER {WIN} END AS temperature_lag1,
      CASE WHEN temperature IS NOT NULL THEN lag(temperature, 3) OVER {WIN} END AS temperature_lag3
      FROM {TELEMETRY_GAPS}""",
)
def _e11(spark, sf):
    out = win.lag_features(telemetry_gaps(spark, sf), "tank", ORDER, "temperature", [1, 3])
    return out.select("event_id", "temperature_lag1", "temperature_lag3")


@query(
    "e12_relative_time",
    f"""SELECT event_id, round(epoch_us(timestamp - min(timestamp) OVER (PARTITION BY tank, genet)) / 3.6e9, 5) AS hours
      FROM {TELEMETRY}""",
)
def _e12(spark, sf):
    out = win.relative_time(telemetry(spark, sf), ["tank", "genet"], "timestamp", "hours", "hour")
    return rounded(out.select("event_id", "hours"), 5, "hours")


@query("e13_row_index", f"""SELECT event_id, row_number() OVER {WIN} AS i FROM {TELEMETRY}""")
def _e13(spark, sf):
    return win.row_index(telemetry(spark, sf), "tank", ORDER, "i").select("event_id", "i")


PEAKS = f"""a AS (SELECT *, row_number() OVER {WIN} AS i, lag(temperature) OVER {WIN} AS p, lead(temperature) OVER {WIN} AS n,
      max(temperature) OVER (PARTITION BY tank ORDER BY timestamp, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l,
      max(temperature) OVER (PARTITION BY tank ORDER BY timestamp, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS r
      FROM {TELEMETRY}),
    b AS (SELECT *, coalesce(sign(temperature - p) > sign(n - temperature) AND l <= temperature AND r <= temperature, false)
      AS is_peak FROM a)"""


@query("e14_find_peaks", f"WITH {PEAKS} SELECT event_id, is_peak FROM b")
def _e14(spark, sf):
    return win.find_peaks(telemetry(spark, sf), "tank", ORDER, "temperature", 3).select("event_id", "is_peak")


@query(
    "e14_peak_period",
    f"""WITH {PEAKS} SELECT event_id, i AS peak_index, i - lag(i, 2) OVER (PARTITION BY tank ORDER BY i) AS period
      FROM b WHERE is_peak""",
)
def _e14b(spark, sf):
    out = win.peak_period(telemetry(spark, sf), "tank", ORDER, "temperature", 3)
    return out.select("event_id", "peak_index", "period")


@query(
    "e15_change_points",
    f"""SELECT event_id, tank, genet FROM {TELEMETRY} QUALIFY genet <> lag(genet) OVER {WIN}""",
)
def _e15(spark, sf):
    return win.change_points(telemetry(spark, sf), "tank", ORDER, "genet").select("event_id", "tank", "genet")


PVALS = "(SELECT event_id, event_type AS family, least(1.0, value / 250.0) AS p FROM events)"


def _pvals(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("family"), F.least(F.lit(1.0), F.col("value") / 250.0).alias("p")
    )


@query(
    "e16_p_adjust_bh",
    f"""WITH a AS (SELECT *, p * count(*) OVER (PARTITION BY family) / rank_max AS raw FROM (
      SELECT *, count(*) OVER (PARTITION BY family ORDER BY p RANGE UNBOUNDED PRECEDING) AS rank_max FROM {PVALS}))
    SELECT event_id, round(least(1.0, min(raw) OVER (PARTITION BY family ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6)
      AS p_bh FROM a""",
)
def _e16(spark, sf):
    return rounded(win.p_adjust(_pvals(spark, sf), "p", "bh", "p_bh", by="family").select("event_id", "p_bh"), 6, "p_bh")


@query(
    "e16_p_adjust_bonferroni",
    f"""SELECT event_id, round(least(1.0, p * count(*) OVER ()), 6) AS p_bonf FROM {PVALS}""",
)
def _e16b(spark, sf):
    out = win.p_adjust(_pvals(spark, sf), "p", "bonferroni", "p_bonf")
    return rounded(out.select("event_id", "p_bonf"), 6, "p_bonf")


@query(
    "e17_shift_to_baseline",
    f"""WITH base AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(sqrt(o_totalprice)) AS seas FROM orders GROUP BY 1),
      s AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS day, sqrt(l_extendedprice) AS temp FROM lineitem),
      d AS (SELECT day, avg(temp) AS m, stddev_samp(temp) AS sd FROM s GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, temp, round(m, 3) AS mean_daily, round(sd, 3) AS sd_daily,
      round(temp - (m - seas), 3) + 0.0 AS adjusted, round(temp - (m - seas - 4), 3) + 0.0 AS thresh,
      round(temp - (m - seas - 8), 3) + 0.0 AS extreme FROM s JOIN d USING (day) LEFT JOIN base USING (day)""",
)
def _e17(spark, sf):
    base = (
        table(spark, sf, "orders")
        .groupBy(F.to_date("o_orderdate").alias("day"))
        .agg(F.avg(F.sqrt("o_totalprice")).alias("seas"))
    )
    sub = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.to_date("l_shipdate").alias("day"),
        F.sqrt("l_extendedprice").alias("temp"),
    )
    out = win.shift_to_baseline(sub, base, "day", "temp", "seas", {"adjusted": 0, "thresh": 4, "extreme": 8})
    cols = ["mean_daily", "sd_daily", "adjusted", "thresh", "extreme"]
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "temp", *cols), 3, *cols)


@query(
    "e18_cohort",
    f"""WITH a AS (SELECT event_id, timestamp, CAST(floor(epoch_us(timestamp - (SELECT min(timestamp) FROM {TELEMETRY}))
        / 1e6 / 86400 / 7) AS BIGINT) AS week FROM {TELEMETRY}),
      b AS (SELECT *, (SELECT max(week) FROM a) AS mx FROM a),
      c AS (SELECT *, CASE WHEN week >= 1 AND week <= mx - ((mx - 1) % 2)
        THEN greatest(1, CAST(ceil((week - 1) / 2.0) AS BIGINT)) END AS weeks FROM b)
    SELECT event_id, week, weeks, min(timestamp) OVER (PARTITION BY weeks) AS first_date FROM c""",
)
def _e18(spark, sf):
    return win.cohort(telemetry(spark, sf), "timestamp").select("event_id", "week", "weeks", "first_date")
