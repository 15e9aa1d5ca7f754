"""Whole flows of SURVEY 3: labelled telemetry, its summaries, and the biology panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.a_sources import KINDS, hourly_wide
from queries.d_aggregates import WIDE
from queries.registry import TELEMETRY, query, rounded, table, telemetry
from tidemark.plans import panel as pn, telemetry as tl

SETS = "14.75 + day(timestamp) % 3 AS chill_set, 18.0 + day(timestamp) % 4 AS severe_set, 21.0 + day(timestamp) % 5 AS extreme_set"


@query(
    "s01_telemetry_long",
    f"""WITH w AS (SELECT *, {SETS} FROM {WIDE}),
      o AS (SELECT * REPLACE (CASE WHEN timestamp < TIMESTAMP '2024-01-04 12:15:00' THEN chill_set ELSE severe_set END AS severe_set,
        CASE WHEN timestamp < TIMESTAMP '2024-01-04 12:15:00' THEN chill_set ELSE extreme_set END AS extreme_set) FROM w
        WHERE timestamp > TIMESTAMP '2024-01-02 12:00:00'),
      l AS ({" UNION ALL ".join(f"SELECT timestamp, chill_set, severe_set, extreme_set, '{k}' AS sensor, {k} AS temperature FROM o" for k in KINDS)}),
      s AS (SELECT event_type AS sensor, CAST(length(event_type) AS INTEGER) AS tank, CASE WHEN event_type < 'd' THEN 'chill' WHEN event_type < 'q'
        THEN 'severe' ELSE 'extreme' END AS treatment FROM events WHERE event_type <> 'view' GROUP BY ALL),
      j AS (SELECT l.*, tank, coalesce(treatment, 'unknown') AS treatment, dayofweek(timestamp) AS w, CAST(timestamp AS DATE) AS d
        FROM l LEFT JOIN s USING (sensor))
    SELECT timestamp, treatment, tank, sensor, CAST(CASE treatment WHEN 'chill' THEN chill_set WHEN 'severe' THEN severe_set
      WHEN 'extreme' THEN extreme_set END AS DOUBLE) AS temp_set, round(temperature, 6) AS temperature,
      d + CAST((12 - w) % 7 AS INTEGER) AS week, d + CAST(least((8 - w) % 7, (10 - w) % 7, (12 - w) % 7) AS INTEGER) AS next_mwf,
      d + CAST(least((8 - w) % 7, (10 - w) % 7, (12 - w) % 7) AS INTEGER) - 1 AS last_sutth FROM j""",
)
def _s01(spark, sf):
    day = F.dayofmonth("timestamp")
    wide = hourly_wide(spark, sf).withColumns(
        {"chill_set": 14.75 + day % 3, "severe_set": 18.0 + day % 4, "extreme_set": 21.0 + day % 5}
    )
    kind = F.col("event_type")
    sensors = table(spark, sf, "events").filter(kind != "view").select(
        kind.alias("sensor"),
        F.length(kind).alias("tank"),
        F.when(kind < "d", "chill").when(kind < "q", "severe").otherwise("extreme").alias("treatment"),
    )
    out = tl.telemetry_long(wide, KINDS, sensors.distinct(), "2024-01-04 12:15:00", "2024-01-02 12:00:00")
    return rounded(out, 6, "temperature")


TREAT = "CASE WHEN tank < 6 THEN 'cold' WHEN tank > 10 THEN 'extreme' ELSE 'severe' END AS treatment"


def _treated(spark, sf):
    return telemetry(spark, sf).withColumn(
        "treatment", F.when(F.col("tank") < 6, "cold").when(F.col("tank") > 10, "extreme").otherwise("severe")
    )


@query(
    "s02_weekly_temperature",
    f"""SELECT tank, {TREAT}, CAST(timestamp AS DATE) + CAST((12 - dayofweek(timestamp)) % 7 AS INTEGER) AS friday,
      round(avg(temperature), 6) AS avg_temp, min(temperature) AS min_temp, max(temperature) AS max_temp FROM {TELEMETRY}
      GROUP BY ALL""",
)
def _s02(spark, sf):
    return rounded(tl.weekly_temperature(_treated(spark, sf), ["tank", "treatment"]), 6, "avg_temp")


@query(
    "s03_three_day_temperature",
    f"""WITH d AS (SELECT tank, {TREAT}, CAST(timestamp AS DATE) AS date, avg(temperature) AS avg_temp, min(temperature) AS min_temp,
        max(temperature) AS max_temp FROM {TELEMETRY} GROUP BY ALL),
      r AS (SELECT *, count(*) OVER w AS n, avg(avg_temp) OVER w AS m, min(avg_temp) OVER w AS lo, max(avg_temp) OVER w AS hi FROM d
        WINDOW w AS (PARTITION BY tank ORDER BY date ROWS 2 PRECEDING))
    SELECT tank, treatment, date, round(avg_temp, 6) AS avg_temp, min_temp, max_temp,
      round(CASE WHEN n = 3 THEN m END, 6) AS mean_last_3_days, round(CASE WHEN n = 3 THEN lo END, 6) AS min_last_3_days,
      round(CASE WHEN n = 3 THEN hi END, 6) AS max_last_3_days FROM r WHERE dayofweek(date) IN (2, 5)""",
)
def _s03(spark, sf):
    out = tl.three_day_temperature(_treated(spark, sf), ["tank", "treatment"], "tank", ["Tuesday", "Friday"])
    return rounded(out, 6, "avg_temp", "mean_last_3_days", "min_last_3_days", "max_last_3_days")


SEEN = {"behavior": "temperature < 120", "counts": "temperature > 5", "sizes": "temperature < 60"}


def _cells(part: str, cols: str) -> str:
    return f"""(SELECT CAST(timestamp AS DATE) AS date, tank, genet, {cols} FROM {TELEMETRY} WHERE {SEEN[part]} GROUP BY ALL)"""


PARTS = ", ".join(
    f"nullif(count(*) FILTER (temperature BETWEEN {a} AND {b}), 0) AS {c}"
    for c, a, b in (("open", 0, 20), ("partial_open", 20.001, 50), ("partial_closed", 50.001, 90), ("closed", 90.001, 1000))
)
UNIT = "(PARTITION BY tank, genet ORDER BY date)"
PHASE = "(PARTITION BY tank, genet, mhw ORDER BY date)"


@query(
    "s04_panel_features",
    f"""WITH b AS {_cells('behavior', PARTS)},
      c AS {_cells('counts', '''count(*) + 3 AS n, count(*) AS alive, count(*) FILTER (temperature < 30) AS dying_dead,
        count(*) FILTER (temperature > 80) AS floating, CASE WHEN min(event_id) % 13 <> 0 THEN count(*) FILTER (event_id % 2 = 0) END
        AS removed''')},
      z AS {_cells("sizes", "round(avg(temperature), 6) AS avg_biomass_g")},
      m AS (SELECT *, CASE WHEN date < DATE '2024-01-12' THEN 'during' ELSE 'after' END AS mhw,
        n - coalesce(open, 0) - coalesce(partial_open, 0) - coalesce(partial_closed, 0) - coalesce(closed, 0) AS rest
        FROM b FULL JOIN c USING (date, tank, genet) FULL JOIN z USING (date, tank, genet) WHERE date >= DATE '2024-01-03'),
      f AS (SELECT *, coalesce(open, rest) AS o2,
        coalesce(partial_open, CASE WHEN open IS NULL THEN 0 ELSE rest END) AS p2 FROM m),
      r AS (SELECT *, CASE WHEN max(CASE WHEN removed IS NULL THEN 1 ELSE 0 END) OVER {UNIT} = 1 THEN 0
        ELSE sum(removed) OVER {UNIT} END AS removed_cum FROM f),
      t AS (SELECT *, alive + dying_dead + removed_cum + floating AS n_true FROM r),
      d AS (SELECT *, CASE WHEN row_number() OVER {UNIT} = 1 THEN n_true - n_true ELSE n_true - lag(n_true) OVER {UNIT} END AS d1,
        CASE WHEN row_number() OVER {PHASE} = 1 THEN n_true - n_true ELSE n_true - lag(n_true) OVER {PHASE} END AS d2 FROM t)
    SELECT date, tank, genet, mhw, round((o2 + p2) / n, 6) AS percent_open, CAST(removed_cum AS BIGINT) AS removed_cum,
      CAST(n_true AS BIGINT) AS n_true, CAST(sum(d1) OVER {UNIT} AS BIGINT) AS growth_rate_cont, CAST(d2 AS BIGINT) AS diff_n,
      CAST(sum(d2) OVER {PHASE} AS BIGINT) AS growth_rate, round(avg_biomass_g * n_true, 4) AS total_biomass FROM d""",
)
def _s04(spark, sf):
    t = telemetry(spark, sf).withColumn("date", F.to_date("timestamp"))
    keys = ["date", "tank", "genet"]
    v = F.col("temperature")
    bounds = {"open": (0, 20), "partial_open": (20.001, 50), "partial_closed": (50.001, 90), "closed": (90.001, 1000)}

    def count(cond):
        return F.count(F.when(cond, 1))

    behavior = t.filter(SEEN["behavior"]).groupBy(*keys).agg(
        *[F.nullif(count(v.between(a, b)), F.lit(0)).alias(c) for c, (a, b) in bounds.items()]
    )
    counts = t.filter(SEEN["counts"]).groupBy(*keys).agg(
        (F.count(F.lit(1)) + 3).alias("n"),
        F.count(F.lit(1)).alias("alive"),
        count(v < 30).alias("dying_dead"),
        count(v > 80).alias("floating"),
        F.when(F.min("event_id") % 13 != 0, count(F.col("event_id") % 2 == 0)).alias("removed"),
    )
    sizes = t.filter(SEEN["sizes"]).groupBy(*keys).agg(F.round(F.avg("temperature"), 6).alias("avg_biomass_g"))
    merged = pn.merge_panel(behavior, counts, sizes, keys, "2024-01-03", "2024-01-12")
    out = pn.growth_features(merged, ["tank", "genet"], chunk="week")
    cols = ["mhw", "percent_open", "removed_cum", "n_true", "growth_rate_cont", "diff_n", "growth_rate", "total_biomass"]
    return rounded(rounded(out.select(*keys, *cols), 6, "percent_open"), 4, "total_biomass")
