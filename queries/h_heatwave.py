"""Heatwave analytics on the daily mean of item prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import query, rounded, table
from tidemark.operators import heatwave as hw
from tidemark.plans.heatwave import detect, smoothed_daily

EVENT_COLS = [
    "intensity_max",
    "intensity_mean",
    "intensity_cumulative",
    "intensity_max_relThresh",
    "intensity_max_abs",
    "rate_onset",
    "rate_decline",
]


def readings(spark, sf, site=None):
    return table(spark, sf, "lineitem").select(
        (F.lit("all") if site is None else F.col(site)).alias("site"),
        F.col("l_shipdate").alias("ts"),
        F.sqrt("l_extendedprice").alias("temp"),
    )


def found(spark, sf, site=None, **kw):
    return detect(smoothed_daily(readings(spark, sf, site), "site", "ts", "temp", days=7), "site", **kw)


def ctes(site: str = "'all'", smooth: bool = True) -> str:
    """The detection in SQL: daily -> calendar -> climatology -> flags -> events with metrics."""
    half = 15 if smooth else 0
    return f"""raw AS (SELECT {site} AS site, CAST(l_shipdate AS DATE) AS t, sqrt(l_extendedprice) AS x FROM lineitem),
    d AS (SELECT site, t, avg(x) AS temp FROM raw GROUP BY ALL),
    r AS (SELECT site, t, avg(temp) OVER w AS temp FROM d
      WINDOW w AS (PARTITION BY site ORDER BY t ROWS 6 PRECEDING) QUALIFY count(*) OVER w = 7),
    cal AS (SELECT site, CAST(unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS DATE) AS t FROM r GROUP BY site),
    daily AS (SELECT cal.site, cal.t, r.temp, dayofyear(cal.t) + CASE WHEN month(cal.t) >= 3 AND NOT (year(cal.t) % 4 = 0
      AND (year(cal.t) % 100 <> 0 OR year(cal.t) % 400 = 0)) THEN 1 ELSE 0 END AS doy
      FROM cal LEFT JOIN r ON cal.site = r.site AND cal.t = r.t),
    c0 AS (SELECT site, CAST(strftime(make_date(2000, month(u), day(u)), '%j') AS INTEGER) AS doy, avg(temp) AS seas,
      quantile_cont(temp, 0.9) AS thresh FROM (SELECT site, temp, t + CAST(k AS INTEGER) AS u FROM daily,
        (SELECT unnest(range(-5, 6)) AS k) WHERE temp IS NOT NULL) GROUP BY ALL),
    c1 AS (SELECT * FROM c0 WHERE doy <> 60 UNION ALL SELECT site, 60, avg(seas), avg(thresh) FROM c0
      WHERE doy IN (59, 61) GROUP BY site),
    clim AS (SELECT site, (doy - 1 + k + 366) % 366 + 1 AS doy, avg(seas) AS seas, avg(thresh) AS thresh
      FROM c1, (SELECT unnest(range(-{half}, {half + 1})) AS k) GROUP BY ALL),
    fl AS (SELECT daily.site, t, temp, daily.doy, seas, thresh, coalesce(temp > thresh, false) AS exceeds, temp - seas AS i
      FROM daily LEFT JOIN clim ON daily.site = clim.site AND daily.doy = clim.doy),
    isl AS (SELECT site, t, t - CAST(row_number() OVER (PARTITION BY site ORDER BY t) AS INTEGER) AS g FROM fl WHERE exceeds),
    runs AS (SELECT site, min(t) AS date_start, max(t) AS date_end, CAST(count(*) AS INTEGER) AS duration FROM isl
      GROUP BY site, g HAVING count(*) >= 5),
    n0 AS (SELECT *, CASE WHEN date_start - lag(date_end) OVER w - 1 <= 2 THEN 0 ELSE 1 END AS nw FROM runs
      WINDOW w AS (PARTITION BY site ORDER BY date_start)),
    n1 AS (SELECT *, sum(nw) OVER (PARTITION BY site ORDER BY date_start) AS event_no FROM n0),
    ev AS (SELECT site, CAST(event_no AS BIGINT) AS event_no, min(date_start) AS date_start, max(date_end) AS date_end,
      CAST(max(date_end) - min(date_start) + 1 AS INTEGER) AS duration FROM n1 GROUP BY ALL),
    met AS (SELECT ev.site, event_no, date_start, date_end, duration, arg_min(t, (-i, t)) AS date_peak, max(i) AS intensity_max,
      avg(i) AS intensity_mean, sum(i) AS intensity_cumulative, max(temp - thresh) AS "intensity_max_relThresh",
      max(temp) AS intensity_max_abs FROM ev JOIN fl ON ev.site = fl.site AND t BETWEEN date_start AND date_end GROUP BY ALL),
    rates AS (SELECT met.*, (intensity_max - (b.i + s.i) / 2) / (date_peak - date_start + 0.5) AS rate_onset,
      (intensity_max - (e.i + a.i) / 2) / (date_end - date_peak + 0.5) AS rate_decline FROM met
      LEFT JOIN fl b ON b.site = met.site AND b.t = date_start - 1 LEFT JOIN fl s ON s.site = met.site AND s.t = date_start
      LEFT JOIN fl e ON e.site = met.site AND e.t = date_end LEFT JOIN fl a ON a.site = met.site AND a.t = date_end + 1)"""


def r5(*cols: str) -> str:
    return ", ".join(f'round("{c}", 5) + 0.0 AS "{c}"' for c in cols)


@query("h01_daily_series", f"WITH {ctes('l_returnflag')} SELECT site, t, round(temp, 5) AS temp FROM d")
def _h01(spark, sf):
    return rounded(hw.daily_series(readings(spark, sf, "l_returnflag"), "site", "ts", "temp"), 5, "temp")


@query(
    "h02_complete_days",
    """WITH d AS (SELECT l_returnflag AS site, CAST(l_shipdate AS DATE) AS t, avg(CASE WHEN l_tax > 0.06 THEN sqrt(l_extendedprice) END) AS temp
      FROM lineitem GROUP BY ALL),
      cal AS (SELECT site, CAST(unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS DATE) AS t FROM d GROUP BY site)
    SELECT site, t, round(temp, 5) AS temp FROM cal LEFT JOIN d USING (site, t)""",
)
def _h02(spark, sf):
    kept = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("site"),
        F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_tax") > 0.06, F.sqrt("l_extendedprice")).alias("temp"),
    )
    return rounded(hw.complete_days(hw.daily_series(kept, "site", "ts", "temp"), "site"), 5, "temp")


@query(
    "h03_doy366",
    """SELECT o_orderkey, CAST(dayofyear(o_orderdate) + CASE WHEN month(o_orderdate) >= 3 AND
      dayofyear(make_date(year(o_orderdate), 12, 31)) = 365 THEN 1 ELSE 0 END AS INTEGER) AS doy FROM orders""",
)
def _h03(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", hw.doy366(F.to_date("o_orderdate")).alias("doy"))


@query("h04_climatology", f"WITH {ctes()} SELECT site, doy, {r5('seas', 'thresh')} FROM c1")
def _h04(spark, sf):
    daily = smoothed_daily(readings(spark, sf), "site", "ts", "temp", days=7)
    return rounded(hw.climatology(daily, "site"), 5, "seas", "thresh")


@query("h05_smooth_circular", f"WITH {ctes('l_returnflag')} SELECT site, doy, {r5('seas', 'thresh')} FROM clim")
def _h05(spark, sf):
    return rounded(found(spark, sf, "l_returnflag").climatology, 5, "seas", "thresh")


@query("h06_exceedance", f"WITH {ctes()} SELECT site, t, doy, {r5('temp', 'seas', 'thresh')}, exceeds FROM fl")
def _h06(spark, sf):
    return rounded(found(spark, sf).flagged, 5, "temp", "seas", "thresh")


@query("h07_runs", f"WITH {ctes('l_returnflag')} SELECT * FROM runs")
def _h07(spark, sf):
    return hw.runs(found(spark, sf, "l_returnflag").flagged, "site")


@query("h08_join_gaps", f"WITH {ctes('l_returnflag')} SELECT * FROM ev")
def _h08(spark, sf):
    return hw.join_gaps(hw.runs(found(spark, sf, "l_returnflag").flagged, "site"), "site")


@query(
    "h09_event_metrics",
    f"WITH {ctes()} SELECT site, event_no, date_start, date_peak, date_end, duration, {r5(*EVENT_COLS[:5])} FROM met",
)
def _h09(spark, sf):
    f = found(spark, sf)
    return rounded(f.events.drop("rate_onset", "rate_decline"), 5, *EVENT_COLS[:5])


@query(
    "h10_event_rates",
    f"""WITH {ctes('l_returnflag')} SELECT site, event_no, date_start, date_peak, date_end, duration, {r5(*EVENT_COLS)}
      FROM rates""",
)
def _h10(spark, sf):
    return rounded(found(spark, sf, "l_returnflag").events, 5, *EVENT_COLS)


@query(
    "h11_event_table",
    f"""WITH {ctes('l_returnflag')} SELECT site, event_no, date_start, date_end, duration, month(date_start) AS month_start,
      month(date_end) AS month_end FROM ev WHERE date_start > DATE '1996-06-01'
      AND month(date_start) IN (1, 2, 8, 9, 10, 11, 12) ORDER BY duration DESC, date_start""",
)
def _h11(spark, sf):
    out = hw.event_table(found(spark, sf, "l_returnflag").events, "1996-06-01", [1, 2, 8, 9, 10, 11, 12])
    cols = ["site", "event_no", "date_start", "date_end", "duration", "month_start", "month_end"]
    return out.select(*cols)


@query(
    "h12_pool_sites",
    f"""WITH a AS (WITH {ctes('l_returnflag')} SELECT site, event_no, date_start, date_end, duration FROM ev),
      b AS (WITH {ctes('l_linestatus')} SELECT site, event_no, date_start, date_end, duration FROM ev)
    SELECT * FROM a UNION ALL SELECT * FROM b""",
)
def _h12(spark, sf):
    parts = [found(spark, sf, s).events for s in ("l_returnflag", "l_linestatus")]
    cols = ["site", "event_no", "date_start", "date_end", "duration"]
    return hw.pool_sites([p.select(*cols) for p in parts])


@query("h12_mean_across_sites", f"WITH {ctes('l_returnflag')} SELECT t, round(avg(temp), 5) AS temp FROM d GROUP BY t")
def _h12b(spark, sf):
    daily = hw.daily_series(readings(spark, sf, "l_returnflag"), "site", "ts", "temp")
    return rounded(hw.mean_across_sites(daily), 5, "temp")


@query(
    "h13_event_summary",
    f"WITH {ctes('l_returnflag')} "
    + " UNION ALL ".join(
        f"SELECT '{label}' AS metric, round(quantile_cont({c}, 0.95), 5) AS percentile_95, round(avg({c}), 5) AS mean FROM rates"
        for label, c in hw.METRICS.items()
    ),
)
def _h13(spark, sf):
    return rounded(hw.event_summary(found(spark, sf, "l_returnflag").events), 5, "percentile_95", "mean")


@query(
    "h13_duration_summary",
    f"""WITH {ctes('l_returnflag')} SELECT count(*) AS n, round(avg(duration), 5) AS mean, round(stddev_samp(duration), 5) AS sd,
      round(stddev_samp(duration) / sqrt(count(*)), 5) AS se, CAST(min(duration) AS DOUBLE) AS min,
      CAST(max(duration) AS DOUBLE) AS max, round(quantile_cont(duration, 0.9), 5) AS q90,
      round(quantile_cont(duration, 0.95), 5) AS q95, CAST(quantile_disc(duration, 0.25) AS DOUBLE) AS q25,
      CAST(quantile_disc(duration, 0.5) AS DOUBLE) AS q50, CAST(quantile_disc(duration, 0.75) AS DOUBLE) AS q75 FROM ev""",
)
def _h13b(spark, sf):
    return rounded(hw.duration_summary(found(spark, sf, "l_returnflag").events), 5, "mean", "sd", "se", "q90", "q95")


@query(
    "h14_label_subdaily",
    f"""WITH {ctes()} SELECT l_orderkey, l_linenumber, l_partkey, event_no, exceeds FROM lineitem
      LEFT JOIN fl ON CAST(l_shipdate AS DATE) = fl.t LEFT JOIN ev ON fl.t BETWEEN date_start AND date_end""",
)
def _h14(spark, sf):
    f = found(spark, sf)
    status = hw.daily_status(f.flagged, f.events, "site")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    out = hw.label_subdaily(li.withColumn("site", F.lit("all")), status, "site", "l_shipdate", ["event_no", "exceeds"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "event_no", "exceeds")


@query(
    "h15_monthly_stat",
    f"""WITH {ctes('l_returnflag')} SELECT site, CAST(year(t) AS INTEGER) AS year, CAST(month(t) AS INTEGER) AS month,
      CAST((month(t) + 4) % 12 + 1 AS INTEGER) AS season_index, round(max(temp), 5) AS value FROM d
      WHERE month(t) NOT IN (3, 4, 5, 6, 7) GROUP BY ALL""",
)
def _h15(spark, sf):
    daily = hw.daily_series(readings(spark, sf, "l_returnflag"), "site", "ts", "temp")
    return rounded(hw.monthly_stat(daily, [8, 9, 10, 11, 12, 1, 2], "max", site="site"), 5, "value")


@query(
    "h16_threshold_band",
    f"""WITH {ctes()} SELECT t, {r5('temp', 'seas', 'thresh')}, round(seas + 5, 5) AS thresh2, round(seas + 8, 5) AS thresh3,
      round(CASE WHEN temp IS NOT NULL THEN greatest(thresh, temp) END, 5) AS ribbon FROM fl
      WHERE t BETWEEN DATE '1997-09-01' AND DATE '1998-02-28'""",
)
def _h16(spark, sf):
    out = hw.threshold_band(found(spark, sf).flagged, "1997-09-01", "1998-02-28", {"thresh2": 5, "thresh3": 8})
    cols = ["temp", "seas", "thresh", "thresh2", "thresh3", "ribbon"]
    return rounded(out.select("t", *cols), 5, *cols)


@query(
    "h17_compare_profile",
    f"""WITH {ctes()}, s AS (SELECT CAST(l_shipdate AS DATE) AS t, avg(sqrt(l_extendedprice)) AS sub_mean,
      min(sqrt(l_extendedprice)) AS sub_min, max(sqrt(l_extendedprice)) AS sub_max FROM lineitem GROUP BY 1)
    SELECT s.t, {r5('sub_mean', 'sub_min', 'sub_max')}, round(temp, 5) AS daily, {r5('seas')},
      round(sub_mean - temp, 5) + 0.0 AS diff_daily, round(sub_mean - seas, 5) + 0.0 AS anomaly FROM s LEFT JOIN fl USING (t)""",
)
def _h17(spark, sf):
    out = hw.compare_profile(readings(spark, sf), found(spark, sf).flagged, "ts")
    return rounded(out, 5, "sub_mean", "sub_min", "sub_max", "daily", "seas", "diff_daily", "anomaly")


@query(
    "h17_overlay_daily",
    f"""WITH {ctes()}, s AS (SELECT event_id, ts, TIMESTAMP '1998-01-01' + (ts - TIMESTAMP '2024-01-01') AS at FROM events)
    SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY CAST(s.at AS DATE) ORDER BY s.at, event_id) = 1
      THEN round(temp, 5) END AS temp FROM s LEFT JOIN fl ON CAST(s.at AS DATE) = fl.t""",
)
def _h17b(spark, sf):
    shift = F.lit("1998-01-01").cast("timestamp_ntz") - F.lit("2024-01-01").cast("timestamp_ntz")
    sub = table(spark, sf, "events").select("event_id", (F.col("ts") + shift).alias("at"))
    out = hw.overlay_daily(sub, found(spark, sf).flagged, "at", ["at", "event_id"], ["temp"])
    return rounded(out.select("event_id", "temp"), 5, "temp")


@query(
    "h18_build_profile",
    f"""WITH {ctes()}, s AS (SELECT TIMESTAMP '1998-01-01' + (date_trunc('hour', ts) - TIMESTAMP '2024-01-01') AS hh,
        avg(sqrt(value)) AS temp FROM events GROUP BY 1),
      m AS (SELECT CAST(hh AS DATE) AS t, avg(temp) AS m FROM s GROUP BY 1)
    SELECT s.hh AS ts, m.t, round_even(s.temp - (m - seas), 2) AS chill, round_even(s.temp - (m - seas - 4), 2) AS temp,
      round_even(s.temp - (m - seas - 8), 2) AS extreme FROM s JOIN m ON CAST(s.hh AS DATE) = m.t JOIN fl ON fl.t = m.t
      WHERE m.t >= DATE '1998-01-03' AND m.t < DATE '1998-01-20'""",
)
def _h18(spark, sf):
    shift = F.lit("1998-01-01").cast("timestamp_ntz") - F.lit("2024-01-01").cast("timestamp_ntz")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    sub = table(spark, sf, "events").select((hour + shift).alias("ts"), F.sqrt("value").alias("level"))
    offsets = {"chill": 0, "temp": 4, "extreme": 8}
    return hw.build_profile(sub, found(spark, sf).flagged, "1998-01-03", "1998-01-20", offsets, "ts", "level")


