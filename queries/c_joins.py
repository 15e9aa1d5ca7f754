"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import PANEL, TELEMETRY, panel, query, rounded, table, telemetry
from tidemark.operators import joins, scalar


COOL, WARM, HOT = "temperature < 40", "temperature BETWEEN 20 AND 80", "temperature > 50"


def _day(spark, sf, seen: str, n: str):
    t = telemetry(spark, sf).filter(seen)
    return t.groupBy("tank", "genet", F.to_date("timestamp").alias("date")).agg(
        F.count(F.lit(1)).alias(n), F.max("event_id").alias("time")
    )


def _day_sql(seen: str, n: str) -> str:
    return (
        f"(SELECT tank, genet, CAST(timestamp AS DATE) AS date, count(*) AS {n} FROM {TELEMETRY}"
        f" WHERE {seen} GROUP BY ALL)"
    )


@query(
    "c01_full_panel",
    f"""SELECT * FROM {_day_sql(COOL, "open")} FULL JOIN {_day_sql(WARM, "alive")} USING (tank, genet, date)
      FULL JOIN {_day_sql(HOT, "sized")} USING (tank, genet, date)""",
)
def _c01(spark, sf):
    parts = [_day(spark, sf, COOL, "open"), _day(spark, sf, WARM, "alive"), _day(spark, sf, HOT, "sized").drop("time")]
    return joins.full_panel(parts, ["tank", "genet", "date"])


@query(
    "c02_natural_full",
    f"""WITH t AS (SELECT tank, nullif(genet, 'error') AS genet, timestamp, temperature FROM {TELEMETRY}),
      a AS (SELECT tank, genet, count(*) AS n_a FROM t WHERE tank < 9 GROUP BY ALL),
      b AS (SELECT tank, genet, max(temperature) AS top FROM t WHERE tank > 6 GROUP BY ALL),
      c AS (SELECT genet, min(temperature) AS low FROM t GROUP BY ALL),
      ab AS (SELECT coalesce(a.tank, b.tank) AS tank, coalesce(a.genet, b.genet) AS genet, n_a, top
        FROM a FULL JOIN b ON a.tank = b.tank AND a.genet IS NOT DISTINCT FROM b.genet)
    SELECT tank, coalesce(ab.genet, c.genet) AS genet, n_a, top, low
      FROM ab FULL JOIN c ON ab.genet IS NOT DISTINCT FROM c.genet""",
)
def _c02(spark, sf):
    t = telemetry(spark, sf).withColumn("genet", F.nullif(F.col("genet"), F.lit("error")))
    a = t.filter("tank < 9").groupBy("tank", "genet").agg(F.count(F.lit(1)).alias("n_a"))
    b = t.filter("tank > 6").groupBy("tank", "genet").agg(F.max("temperature").alias("top"))
    c = t.groupBy("genet").agg(F.min("temperature").alias("low"))
    return joins.natural_full([a, b, c])


@query(
    "c03_left_on",
    "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0",
)
def _c03(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf, "customer").filter("c_acctbal > 0")
    cust = cust.select(F.col("c_custkey").cast("string").alias("id"), "c_mktsegment")
    return joins.left_on(orders, cust, {"o_custkey": "id"})


@query(
    "c04_inner_on",
    """SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate, o_orderkey % 7 AS week FROM lineitem
      JOIN orders ON l_orderkey = 2 * o_orderkey""",
)
def _c04(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    od = table(spark, sf, "orders").select(
        (F.col("o_orderkey") * 2).alias("key"), "o_orderdate", (F.col("o_orderkey") % 7).alias("week")
    )
    return joins.inner_on(li, od, {"l_orderkey": "key"})


@query(
    "c05_lookup",
    f"""SELECT event_id, tank, coalesce(n_name, 'unknown') AS role FROM {TELEMETRY}
      LEFT JOIN nation ON tank = n_nationkey AND n_regionkey <> 2""",
)
def _c05(spark, sf):
    dim = table(spark, sf, "nation").filter("n_regionkey <> 2")
    dim = dim.select(F.col("n_nationkey").alias("tank"), F.col("n_name").alias("role"))
    return scalar.lookup(telemetry(spark, sf).select("event_id", "tank"), dim, "tank", {"role": "unknown"})


RANGES = """(SELECT n_nationkey, n_name, TIMESTAMP '2024-01-02' + to_hours(n_nationkey * 26) AS lo,
  TIMESTAMP '2024-01-02' + to_hours(n_nationkey * 26 + 60) AS hi FROM nation WHERE n_regionkey <> 2)"""


def _ranges(spark, sf):
    start = F.lit("2024-01-02").cast("timestamp_ntz")
    hours = F.col("n_nationkey") * 26
    return (
        table(spark, sf, "nation")
        .filter("n_regionkey <> 2")
        .select(
            "n_nationkey",
            "n_name",
            (start + F.make_dt_interval(hours=hours)).alias("lo"),
            (start + F.make_dt_interval(hours=hours + 60)).alias("hi"),
        )
    )


@query(
    "c06_interval_label",
    f"""SELECT event_id, arg_max(n_name, n_nationkey) AS week FROM {TELEMETRY} LEFT JOIN {RANGES}
      ON timestamp BETWEEN lo AND hi GROUP BY event_id""",
)
def _c06(spark, sf):
    ranges = _ranges(spark, sf).withColumnRenamed("n_name", "week")
    t = telemetry(spark, sf).select("event_id", "timestamp")
    out = joins.interval_label(t, ranges, "timestamp", "lo", "hi", "week", order="n_nationkey")
    return out.select("event_id", "week")


@query(
    "c06_interval_label_by_tank",
    f"""WITH r AS (SELECT tank, CAST(timestamp AS DATE) AS day, min(timestamp) AS lo, max(timestamp) - INTERVAL 2 HOUR AS hi
        FROM {TELEMETRY} GROUP BY ALL)
    SELECT event_id, day FROM {TELEMETRY} t LEFT JOIN r ON t.tank = r.tank AND timestamp BETWEEN lo AND hi""",
)
def _c06b(spark, sf):
    t = telemetry(spark, sf).select("event_id", "tank", "timestamp")
    r = t.groupBy("tank", F.to_date("timestamp").alias("day")).agg(
        F.min("timestamp").alias("lo"), (F.max("timestamp") - F.expr("INTERVAL '2' HOUR")).alias("hi")
    )
    return joins.interval_label(t, r, "timestamp", "lo", "hi", "day", by="tank").select("event_id", "day")


@query(
    "c07_range_join",
    f"""SELECT tank, n_name, count(*) AS n, round(avg(temperature), 9) AS avg_temp, min(temperature) AS min_temp,
      max(temperature) AS max_temp FROM {TELEMETRY} JOIN {RANGES} ON timestamp BETWEEN lo AND hi GROUP BY ALL""",
)
def _c07(spark, sf):
    t = telemetry(spark, sf).select("tank", "timestamp", "temperature")
    out = joins.range_join(t, _ranges(spark, sf), "timestamp", "lo", "hi").groupBy("tank", "n_name")
    out = out.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("temperature").alias("avg_temp"),
        F.min("temperature").alias("min_temp"),
        F.max("temperature").alias("max_temp"),
    )
    return rounded(out, 9, "avg_temp")


@query(
    "c08_nearest_asof",
    f"""WITH p AS (SELECT tank, timestamp AS at, max(temperature) AS temp_set FROM {TELEMETRY} WHERE genet = 'signup' GROUP BY ALL),
      r AS (SELECT * FROM {TELEMETRY} WHERE genet <> 'signup'),
      b AS (SELECT r.event_id, r.timestamp, p.at, p.temp_set FROM r ASOF LEFT JOIN p ON r.tank = p.tank AND r.timestamp >= p.at),
      f AS (SELECT r.event_id, p.at, p.temp_set FROM r ASOF LEFT JOIN p ON r.tank = p.tank AND r.timestamp <= p.at)
    SELECT event_id, CASE WHEN b.at IS NULL OR f.at - b.timestamp < b.timestamp - b.at THEN f.temp_set
      ELSE b.temp_set END AS temp_set FROM b JOIN f USING (event_id)""",
)
def _c08(spark, sf):
    t = telemetry(spark, sf)
    profile = t.filter("genet = 'signup'").select(
        "tank", F.col("timestamp").alias("at"), F.col("temperature").alias("temp_set")
    )
    readings = t.filter("genet <> 'signup'").select("event_id", "tank", "timestamp")
    out = joins.nearest_asof(readings, profile, "timestamp", "at", "temp_set", by="tank")
    return out.select("event_id", "temp_set")


@query(
    "c08_nearest_asof_global",
    """WITH p AS (SELECT date_trunc('hour', ts) AS at, round(avg(value), 6) AS temp_set FROM events
        WHERE event_type = 'signup' GROUP BY ALL),
      b AS (SELECT event_id, ts, p.at, p.temp_set FROM events ASOF LEFT JOIN p ON ts >= p.at),
      f AS (SELECT event_id, p.at, p.temp_set FROM events ASOF LEFT JOIN p ON ts <= p.at)
    SELECT event_id, CASE WHEN b.at IS NULL OR f.at - ts < ts - b.at THEN f.temp_set ELSE b.temp_set END AS temp_set
      FROM b JOIN f USING (event_id)""",
)
def _c08b(spark, sf):
    ev = table(spark, sf, "events")
    profile = (
        ev.filter("event_type = 'signup'")
        .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("at"))
        .agg(F.round(F.avg("value"), 6).alias("temp_set"))
    )
    out = joins.nearest_asof(ev.select("event_id", "ts"), profile, "ts", "at", "temp_set")
    return out.select("event_id", "temp_set")


@query(
    "c09_time_to_settle",
    f"""WITH t AS (SELECT *, 20.0 + 10 * (day(timestamp) % 4) AS temp_set FROM {TELEMETRY}),
      c AS (SELECT tank, timestamp, temp_set FROM t
        QUALIFY temp_set <> lag(temp_set) OVER (PARTITION BY tank ORDER BY timestamp, event_id))
    SELECT c.tank, c.timestamp, c.temp_set, round(epoch_us(min(t.timestamp) - c.timestamp) / 1e6, 3) AS stabilization_time
      FROM c LEFT JOIN t ON t.tank = c.tank AND t.timestamp > c.timestamp AND abs(t.temperature - c.temp_set) <= 0.5
      GROUP BY c.tank, c.timestamp, c.temp_set""",
)
def _c09(spark, sf):
    t = telemetry(spark, sf).withColumn("temp_set", (F.dayofmonth("timestamp") % 4 * 10 + 20).cast("double"))
    out = joins.time_to_settle(t, "tank", ["timestamp", "event_id"], "timestamp", "temp_set", "temperature", 0.5)
    return rounded(out, 3, "stabilization_time")


@query(
    "c10_attach_params",
    f"""WITH p AS (SELECT phase, factor AS model, round(avg(size), 2) AS slope FROM {PANEL} GROUP BY ALL)
    SELECT obs, phase, model, slope FROM {PANEL} LEFT JOIN p USING (phase)""",
)
def _c10(spark, sf):
    data = panel(spark, sf)
    params = data.groupBy("phase", F.col("factor").alias("model")).agg(F.round(F.avg("size"), 2).alias("slope"))
    return joins.attach_params(data.select("obs", "phase"), params, "phase").select("obs", "phase", "model", "slope")


@query(
    "c11_semi",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer
      WHERE c_mktsegment = 'BUILDING')""",
)
def _c11(spark, sf):
    keys = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.semi(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), keys, "o_custkey")


@query(
    "c12_anti",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier
      WHERE s_suppkey = l_suppkey AND s_nationkey < 8)""",
)
def _c12(spark, sf):
    bad = table(spark, sf, "supplier").filter("s_nationkey < 8").select(F.col("s_suppkey").alias("l_suppkey"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.anti(li, bad, "l_suppkey").drop("l_suppkey")


@query(
    "c13_reconcile",
    """WITH c AS (SELECT l_orderkey AS k, count(*) AS counted, max(l_linenumber) AS n, count(DISTINCT l_linenumber) AS alive
      FROM lineitem GROUP BY 1)
    SELECT k, counted, n, alive, least(abs(counted - n), abs(counted - alive)) AS diff FROM c
      WHERE least(abs(counted - n), abs(counted - alive)) > 1""",
)
def _c13(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    master = li.groupBy("k").agg(F.max("l_linenumber").alias("n"), F.count_distinct("l_linenumber").alias("alive"))
    counted = li.groupBy("k").agg(F.count(F.lit(1)).alias("counted"))
    return joins.reconcile(master, counted, "k", "counted", ["n", "alive"], 1)


def _side(kinds: str) -> str:
    return f"""(SELECT tank, date_trunc('hour', timestamp) AS hh, avg(temperature) AS x FROM {TELEMETRY}
      WHERE genet {kinds} GROUP BY ALL)"""


@query(
    "c14_compare_series",
    f"""SELECT tank, count(*) AS n, round(avg(a.x - b.x), 6) + 0.0 AS mean_diff, round(stddev_samp(a.x - b.x), 5) AS sd_diff,
      round(min(a.x - b.x), 5) + 0.0 AS min_diff, round(max(a.x - b.x), 5) + 0.0 AS max_diff,
      epoch_us(max(hh) - min(hh)) / 3.6e9 AS overlap_hours
      FROM {_side("IN ('view', 'click')")} a JOIN {_side("NOT IN ('view', 'click')")} b USING (tank, hh) GROUP BY tank""",
)
def _c14(spark, sf):
    t = telemetry(spark, sf)
    a, b = t.filter("genet IN ('view', 'click')"), t.filter("genet NOT IN ('view', 'click')")
    out = joins.compare_series(a, b, "timestamp", "temperature", "hour", by="tank")
    return rounded(rounded(out, 6, "mean_diff"), 5, "sd_diff", "min_diff", "max_diff")
