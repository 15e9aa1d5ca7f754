"""Projections, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import TELEMETRY, query, rounded, table, telemetry
from tidemark.functions import numeric as num, text as txt, time as tm
from tidemark.operators import ordered, scalar, shape


@query(
    "b01_time_filter",
    """SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-03 12:00:00' AND ts <= TIMESTAMP '2024-01-20 01:00:00'
      AND NOT (ts BETWEEN TIMESTAMP '2024-01-07 00:00:00' AND TIMESTAMP '2024-01-08 06:00:00')
      AND NOT (ts BETWEEN TIMESTAMP '2024-01-11 00:00:00' AND TIMESTAMP '2024-01-11 08:00:00')
      AND ts <> TIMESTAMP '2024-01-01 00:00:07.179575'""",
)
def _b01(spark, sf):
    return shape.time_filter(
        table(spark, sf, "events").select("event_id", "ts"),
        "ts",
        "2024-01-03 12:00:00",
        "2024-01-20 01:00:00",
        closed="right",
        exclude=[("2024-01-07 00:00:00", "2024-01-08 06:00:00"), ("2024-01-11 00:00:00", "2024-01-11 08:00:00")],
        exclude_at=["2024-01-01 00:00:07.179575"],
    )


@query(
    "b02_band",
    f"""SELECT event_id, CASE WHEN tank < 6 THEN 'cold' WHEN tank > 10 THEN 'extreme' ELSE 'severe' END AS treatment,
      CASE WHEN timestamp < TIMESTAMP '2024-01-12' THEN 'during' ELSE 'after' END AS mhw FROM {TELEMETRY}""",
)
def _b02(spark, sf):
    cut = F.lit("2024-01-12").cast("timestamp_ntz")
    return telemetry(spark, sf).select(
        "event_id",
        num.band(F.col("tank"), [6, 11], ["cold", "severe", "extreme"]).alias("treatment"),
        num.band(F.col("timestamp"), [cut], ["during", "after"]).alias("mhw"),
    )


@query(
    "b03_override_before",
    """SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-04 12:15:00' THEN user_id ELSE event_id END AS severe_set
      FROM events""",
)
def _b03(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(
        "event_id",
        tm.override_before(F.col("ts"), "2024-01-04 12:15:00", F.col("event_id"), F.col("user_id")).alias("severe_set"),
    )


@query(
    "b04_choose_by_label",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'N' THEN l_tax
      WHEN 'R' THEN l_discount END AS temp_set FROM lineitem""",
)
def _b04(spark, sf):
    pick = num.choose_by_label(
        F.col("l_returnflag"), {"A": F.col("l_quantity"), "N": F.col("l_tax"), "R": F.col("l_discount")}
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", pick.alias("temp_set"))


SENSORS = "(SELECT s_suppkey AS sensor, 90.0 + s_nationkey AS raw_high, s_nationkey * 0.5 AS raw_low FROM supplier)"


@query(
    "b05_calibrate",
    f"""SELECT event_id, round((value - raw_low) * 100.0 / (raw_high - raw_low) + 0.0, 5) + 0.0 AS calibrated
      FROM events LEFT JOIN {SENSORS} s ON user_id % 120 = s.sensor""",
)
def _b05(spark, sf):
    sensors = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("sensor"),
        (F.lit(90.0) + F.col("s_nationkey")).alias("raw_high"),
        (F.col("s_nationkey") * 0.5).alias("raw_low"),
    )
    ev = table(spark, sf, "events").select("event_id", (F.col("user_id") % 120).alias("sensor"), "value")
    out = scalar.calibrate(ev, sensors, "sensor", "value", 0, 100, "calibrated")
    return rounded(out.select("event_id", "calibrated"), 5, "calibrated")


@query(
    "b06_source_priority",
    """WITH a AS (SELECT l_orderkey, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 999 ELSE l_quantity END AS adcp,
      CASE WHEN l_suppkey % 4 = 0 THEN 9999 ELSE l_tax END AS top,
      CASE WHEN l_linenumber = 7 THEN 999 ELSE l_discount END AS mid FROM lineitem)
    SELECT l_orderkey, l_partkey, CASE WHEN adcp < 999 THEN adcp WHEN top < 999 THEN top ELSE mid END AS temp,
      CASE WHEN adcp < 999 THEN 'adcp' WHEN top < 999 THEN 'top' ELSE 'mid' END AS source
      FROM a WHERE adcp < 999 OR top < 999 OR mid < 999""",
)
def _b06(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.when(F.col("l_partkey") % 3 == 0, 999.0).otherwise(F.col("l_quantity")).alias("adcp"),
        F.when(F.col("l_suppkey") % 4 == 0, 9999.0).otherwise(F.col("l_tax")).alias("top"),
        F.when(F.col("l_linenumber") == 7, 999.0).otherwise(F.col("l_discount")).alias("mid"),
    )
    out = shape.source_priority(li, ["adcp", "top", "mid"], 999, "temp", "source")
    return out.select("l_orderkey", "l_partkey", "temp", "source")


@query(
    "b07_unify_units",
    """SELECT event_id, round(CASE WHEN event_type <> 'view' THEN value * 10 ELSE value END, 4) AS diameter_mm FROM events""",
)
def _b07(spark, sf):
    even = F.col("event_id") % 2 == 0
    ev = table(spark, sf, "events").select(
        "event_id",
        "event_type",
        F.when(even, F.col("value")).alias("diameter_mm"),
        F.when(~even, F.col("value")).alias("diameter_cm"),
    )
    out = shape.unify_units(ev, "diameter_mm", ["diameter_mm", "diameter_cm"], 10, F.col("event_type") != "view")
    return rounded(out.select("event_id", "diameter_mm"), 4, "diameter_mm")


@query(
    "b08_poly_expr",
    "SELECT event_id, round(0.0432 - 0.0208 * value + 0.00343 * value * value, 5) + 0.0 AS ww_g FROM events",
)
def _b08(spark, sf):
    # Wet-weight polynomial of polyp diameter.
    ww = num.poly_expr(F.col("value"), [0.0432, -0.0208, 0.00343])
    return table(spark, sf, "events").select("event_id", F.round(ww, 5).alias("ww_g"))


HOUR_COUNTS = """(SELECT CAST(user_id % 15 + 1 AS INTEGER) AS tank, date_trunc('hour', ts) AS hour, count(*) AS n,
  nullif(count(*) FILTER (event_type = 'view'), 0) AS open, nullif(count(*) FILTER (event_type = 'click'), 0) AS partial_open,
  nullif(count(*) FILTER (event_type = 'error'), 0) AS partial_closed,
  nullif(count(*) FILTER (event_type = 'purchase'), 0) AS closed FROM events GROUP BY 1, 2)"""


def _hour_counts(spark, sf):
    """Counts per tank and hour in four categories, NULL where a category was not seen."""
    cats = {"open": "view", "partial_open": "click", "partial_closed": "error", "closed": "purchase"}
    counts = [F.count(F.when(F.col("genet") == v, 1)).alias(k) for k, v in cats.items()]
    t = telemetry(spark, sf).withColumn("hour", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    per = t.groupBy("tank", "hour").agg(F.count(F.lit(1)).alias("n"), *counts)
    return per.withColumns({k: F.nullif(F.col(k), F.lit(0)) for k in cats})


@query(
    "b09_ratio",
    f"""SELECT tank, hour, round((open + partial_open) / n, 5) AS percent_open, round(open / n, 5) AS percent_fully_open,
      CASE WHEN closed = 1 THEN NULL ELSE round(open / (closed - 1), 5) END AS odds FROM {HOUR_COUNTS}""",
)
def _b09(spark, sf):
    c = _hour_counts(spark, sf)
    out = c.select(
        "tank",
        "hour",
        num.ratio([F.col("open"), F.col("partial_open")], F.col("n")).alias("percent_open"),
        num.ratio([F.col("open")], F.col("n")).alias("percent_fully_open"),
        num.ratio([F.col("open")], F.col("closed") - 1).alias("odds"),
    )
    return rounded(out, 5, "percent_open", "percent_fully_open", "odds")


@query(
    "b10_fill_residual",
    f"""WITH a AS (SELECT *, n - coalesce(open, 0) - coalesce(partial_open, 0) - coalesce(partial_closed, 0)
      - coalesce(closed, 0) AS rest FROM {HOUR_COUNTS})
    SELECT tank, hour, n, coalesce(open, rest) AS open,
      coalesce(partial_open, CASE WHEN open IS NULL THEN 0 ELSE rest END) AS partial_open,
      coalesce(partial_closed, CASE WHEN open IS NULL OR partial_open IS NULL THEN 0 ELSE rest END) AS partial_closed,
      coalesce(closed, CASE WHEN open IS NULL OR partial_open IS NULL OR partial_closed IS NULL THEN 0 ELSE rest END)
        AS closed FROM a""",
)
def _b10(spark, sf):
    return shape.fill_residual(_hour_counts(spark, sf), ["open", "partial_open", "partial_closed", "closed"], "n")


@query(
    "b11_row_min_clamp",
    f"""SELECT tank, hour, least(open, partial_open, closed) AS low, greatest(open, closed) AS high,
      CASE WHEN open IS NOT NULL AND closed IS NOT NULL THEN least(open, closed) END AS low_strict,
      CASE WHEN n IS NOT NULL THEN least(greatest(n, 2), 4) END AS clamped FROM {HOUR_COUNTS}""",
)
def _b11(spark, sf):
    return _hour_counts(spark, sf).select(
        "tank",
        "hour",
        num.row_min(F.col("open"), F.col("partial_open"), F.col("closed")).alias("low"),
        num.row_max(F.col("open"), F.col("closed")).alias("high"),
        num.row_min(F.col("open"), F.col("closed"), na="poison").alias("low_strict"),
        num.clamp(F.col("n"), 2, 4).alias("clamped"),
    )


@query(
    "b12_transform_prop",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 10 AS p,
        count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
      b AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q,
        CASE WHEN p <= 0 THEN 0.5 / n WHEN p >= 1 THEN 1 - 0.5 / n ELSE p END AS qn FROM a)
    SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN p > 0 THEN ln(p) END, 4) + 0.0 AS log_p,
      round(asin(sqrt(p)), 4) AS asin_p, round(ln(q / (1 - q)), 4) + 0.0 AS logit_p,
      round(ln(qn / (1 - qn)), 4) + 0.0 AS logit_n, round((p * (n - 1) + 0.5) / n, 6) AS squeezed,
      CASE WHEN p <= 0 THEN 1e-6 WHEN p >= 1 THEN 1 - 1e-6 ELSE p END AS nudged FROM b""",
)
def _b12(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", (F.col("l_discount") * 10).alias("p")
    )
    li = ordered.with_group_stats(li, "l_returnflag", {"n": F.count(F.lit(1))})
    p, n = F.col("p"), F.col("n")
    out = li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(num.transform_prop(p, "log"), 4).alias("log_p"),
        F.round(num.transform_prop(p, "asin_sqrt"), 4).alias("asin_p"),
        F.round(num.transform_prop(p, "logit"), 4).alias("logit_p"),
        F.round(num.transform_prop(p, "logit_n", n), 4).alias("logit_n"),
        F.round(num.transform_prop(p, "squeeze", n), 6).alias("squeezed"),
        num.transform_prop(p, "nudge").alias("nudged"),
    )
    return out


@query(
    "b13_round_half_even",
    """SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 4, 1) AS r1, round_even(l_quantity / 2, 0) AS r0
      FROM lineitem""",
)
def _b13(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        num.round_half_even(q / 4, 1).alias("r1"),
        num.round_half_even(q / 2, 0).alias("r0"),
    )


@query(
    "b14_interaction",
    f"""SELECT event_id, tank || '.' || genet AS tg, genet || '_' || CAST(CAST(timestamp AS DATE) AS VARCHAR) AS gd
      FROM {TELEMETRY}""",
)
def _b14(spark, sf):
    return telemetry(spark, sf).select(
        "event_id",
        txt.interaction("tank", "genet").alias("tg"),
        txt.interaction("genet", F.to_date("timestamp"), sep="_").alias("gd"),
    )


@query(
    "b15_strings",
    """SELECT p_partkey, upper(p_name) AS up, regexp_matches(p_name, 'red|ring') AS hit, split_part(p_brand, '#', 2) AS num,
      regexp_replace(p_name, '[aeiou]', '', 'g') AS bare, trim(replace(p_name, 'bolt', ' ')) AS tidy FROM part""",
)
def _b15(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        txt.str_upper(F.col("p_name")).alias("up"),
        txt.str_flag(F.col("p_name"), "red|ring").alias("hit"),
        txt.str_part(F.col("p_brand"), "#", 2).alias("num"),
        txt.str_strip(F.col("p_name"), "[aeiou]").alias("bare"),
        txt.str_replace_trim(F.col("p_name"), "bolt", " ").alias("tidy"),
    )


@query(
    "b16_decimal_day",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate
      + to_seconds(CAST(round_even(l_discount * 9.7 * 86400, 0) AS BIGINT)) AS ts FROM lineitem""",
)
def _b16(spark, sf):
    ts = tm.decimal_day_to_ts(F.to_date("l_shipdate"), F.col("l_discount") * 9.7)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ts.alias("ts"))


@query(
    "b17_bucket",
    """SELECT event_id, date_trunc('minute', ts) AS minute, CAST(ts AS DATE) AS day,
      CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS week, CAST(date_trunc('month', ts) AS DATE) AS month,
      CAST(date_trunc('year', ts) AS DATE) AS year, CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) + 7 AS week_up,
      CAST(ts AS DATE) + 1 AS day_up FROM events""",
)
def _b17(spark, sf):
    ts = F.col("ts")
    ev = table(spark, sf, "events")
    floors = [tm.bucket(ts, u).alias(u) for u in ("minute", "day", "week", "month", "year")]
    return ev.select(
        "event_id", *floors, tm.bucket_ceiling(ts, "week").alias("week_up"), tm.bucket_ceiling(ts, "day").alias("day_up")
    )


@query(
    "b18_sat_fri_week",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST((12 - dayofweek(o_orderdate)) % 7 AS INTEGER) AS friday FROM orders""",
)
def _b18(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tm.sat_fri_week(F.col("o_orderdate")).alias("friday"))


@query(
    "b19_next_weekday_in",
    """WITH a AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, dayofweek(o_orderdate) AS w FROM orders),
      b AS (SELECT o_orderkey, d + CAST(least((8 - w) % 7, (10 - w) % 7, (12 - w) % 7) AS INTEGER) AS next_mwf FROM a)
    SELECT o_orderkey, next_mwf, next_mwf - 1 AS last_sutth FROM b""",
)
def _b19(spark, sf):
    nxt = tm.next_weekday_in(F.col("o_orderdate"), ["Monday", "Wednesday", "Friday"])
    out = table(spark, sf, "orders").select("o_orderkey", nxt.alias("next_mwf"))
    return out.withColumn("last_sutth", F.date_sub("next_mwf", 1))


@query(
    "b20_elapsed",
    """WITH a AS (SELECT event_id, epoch_us(ts - min(ts) OVER ()) / 1e6 AS s FROM events)
    SELECT event_id, round(s / 86400, 5) AS days, CAST(floor(s / 604800) AS BIGINT) + 1 AS week, round(s / 3600, 5) AS hours
      FROM a""",
)
def _b20(spark, sf):
    ev = ordered.with_group_stats(table(spark, sf, "events").select("event_id", "ts"), None, {"t0": F.min("ts")})
    ts, t0 = F.col("ts"), F.col("t0")
    return ev.select(
        "event_id",
        F.round(tm.elapsed(ts, t0, "day"), 5).alias("days"),
        (F.floor(tm.elapsed(ts, t0, "week")) + 1).alias("week"),
        F.round(tm.elapsed(ts, t0, "hour"), 5).alias("hours"),
    )


@query(
    "b21_correct_and_shift",
    """SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-10' THEN DATE '2024-01-09' ELSE CAST(ts AS DATE) END AS date,
      ts + INTERVAL 252482400 SECOND + INTERVAL 18 HOUR AS shifted FROM events""",
)
def _b21(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(
        "event_id",
        tm.correct_dates(F.to_date("ts"), {"2024-01-10": "2024-01-09"}).alias("date"),
        tm.shift_time(F.col("ts"), days=365.25 * 8 + 0.25, hours=18).alias("shifted"),
    )


@query(
    "b22_splice",
    """WITH a AS (SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-20' THEN ts - INTERVAL 5 DAY
      WHEN ts > TIMESTAMP '2024-01-10' THEN ts - INTERVAL 90 MINUTE ELSE ts END AS ts FROM events)
    SELECT event_id, ts, date_trunc('minute', ts) AS minute FROM a""",
)
def _b22(spark, sf):
    ts = F.col("ts")
    moves = [
        (ts > F.lit("2024-01-20").cast("timestamp_ntz"), -5 * 86400),
        (ts > F.lit("2024-01-10").cast("timestamp_ntz"), -90 * 60),
    ]
    out = table(spark, sf, "events").select("event_id", tm.splice(ts, moves).alias("ts"))
    return out.withColumn("minute", tm.bucket(F.col("ts"), "minute"))


@query(
    "b23_rescale",
    """SELECT event_id, round(14 + (value - lo) / (hi - lo) * 2, 6) AS scaled, round(value + 0.31, 6) AS corrected
      FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)""",
)
def _b23(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    out = shape.bias_correct(shape.rescale(ev, "value", 14, 16, "scaled"), "value", 0.31, "corrected")
    return rounded(out.select("event_id", "scaled", "corrected"), 6, "scaled", "corrected")


@query(
    "b24_ramp_setpoint",
    """WITH a AS (SELECT event_id, epoch_us(ts - TIMESTAMP '2024-01-01') / 8.64e10 AS d FROM events)
    SELECT event_id, round(14.75 + least(0.51 * d, 4.0), 6) AS up, round(14.75 + greatest(4.0 - 0.96 * d, 0.0), 6) AS down
      FROM a""",
)
def _b24(spark, sf):
    start, ts = F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")
    # Onset and decline of the set point in degrees per day.
    up = tm.ramp_setpoint(F.lit(14.75), ts, start, 0.51, 4.0, "up")
    down = tm.ramp_setpoint(F.lit(14.75), ts, start, 0.96, 4.0, "down")
    return table(spark, sf, "events").select("event_id", F.round(up, 6).alias("up"), F.round(down, 6).alias("down"))


@query(
    "b25_require",
    f"""SELECT tank, hour, open, closed, n FROM {HOUR_COUNTS} WHERE open IS NOT NULL AND closed IS NOT NULL
      AND (open > 1 OR closed <> 1)""",
)
def _b25(spark, sf):
    kept = shape.require(_hour_counts(spark, sf), ["open", "closed"])
    return kept.filter((F.col("open") > 1) | (F.col("closed") != 1)).select("tank", "hour", "open", "closed", "n")
