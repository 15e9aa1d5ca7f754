"""Scans, sinks and schema shaping."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from queries.registry import TELEMETRY, query, rounded, table, telemetry
from tidemark.functions.text import clean_names
from tidemark.functions.time import parse_time
from tidemark.operators import shape
from tidemark.session import checkpoint_root
from tidemark.sources import logs, tables

KINDS = ["click", "error", "purchase", "signup", "view"]


def run_folder(spark, name: str) -> str:
    """A fresh folder below the shared one for files a query writes and reads back."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def hourly_wide(spark, sf):
    """Wide telemetry: one row per hour, one mean per probe."""
    t = telemetry(spark, sf).withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    return shape.to_wide(t, "timestamp", "genet", "temperature", KINDS, F.avg)


def _log_files(spark, sf, trailing: bool) -> str:
    """Write the telemetry as log CSVs, optionally with the extra empty field of the controller's lines."""
    path = run_folder(spark, "logs")
    out = telemetry(spark, sf).select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"),
        F.col("tank").cast("double").alias("Chill set"),
        "event_id",
        F.col("temperature").alias("28-0000000001"),
        *([F.lit(None).cast("string").alias("_")] if trailing else []),
    )
    logs.write_table(out.repartition(4), path, "csv")
    return path


LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("chill_set", T.DoubleType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("x28_0000000001", T.DoubleType()),
    ]
)
LOG_SQL = f"""SELECT timestamp, CAST(tank AS DOUBLE) AS chill_set, event_id, temperature AS x28_0000000001 FROM {TELEMETRY}"""


@query("a01_scan_logs", LOG_SQL)
def _a01(spark, sf):
    df = logs.scan_logs(spark, _log_files(spark, sf, trailing=False), LOG)
    return df.drop("run_id").withColumn("timestamp", parse_time(F.col("timestamp"), "ymd_hms"))


@query("a03_scan_ragged", LOG_SQL)
def _a03(spark, sf):
    df = logs.scan_logs(spark, _log_files(spark, sf, trailing=True), LOG, ragged="drop_extra")
    return df.drop("run_id").withColumn("timestamp", parse_time(F.col("timestamp"), "ymd_hms"))


@query(
    "a02_harmonise",
    """SELECT event_id AS id, user_id AS set_point, value, event_type AS heater FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT event_id, user_id, value, 'NA' FROM events WHERE event_id % 3 = 1
    UNION ALL SELECT event_id, 0, value, 'NA' FROM events WHERE event_id % 3 = 2""",
)
def _a02(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("set_point"), "value", F.col("event_type").alias("heater")
    )
    versions = [
        ev.filter("id % 3 = 0"),
        ev.filter("id % 3 = 1").drop("heater"),
        ev.filter("id % 3 = 2").select("value", "id"),
    ]
    return shape.harmonise(versions, ev.schema, {"heater": "NA", "set_point": 0})


@query(
    "a04_clean_names",
    """SELECT l_orderkey AS order_key, l_quantity AS x28_quantity, l_tax AS tax_rate, l_discount AS discount_pct
    FROM lineitem""",
)
def _a04(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("OrderKey"),
        F.col("l_quantity").alias("28-Quantity"),
        F.col("l_tax").alias(" Tax.Rate "),
        F.col("l_discount").alias("discount (pct)"),
    )
    return clean_names(raw)


@query("a05_select_cols", "SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate AS shipped FROM lineitem")
def _a05(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"probe_1": F.lit(0), "sump_a": F.lit(1), "sump_b": F.lit(2)})
    picked = shape.select_cols(li, drop_last=2, drop_matching="[0-9]", rename_contains={"shipdate": "shipped"})
    return shape.select_cols(picked, pos=[1, 2, 4, 11])


@query(
    "a06_null_sentinels",
    "SELECT l_orderkey, CASE WHEN l_linenumber NOT IN (3, 5, 7) THEN l_linenumber END AS l_linenumber, l_tax FROM lineitem",
)
def _a06(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    return shape.null_sentinels(li, [3, 5, 7], "l_linenumber")


@query(
    "a07_parse_time",
    """SELECT event_id, CAST(ts AS DATE) AS ymd, CAST(ts AS DATE) AS mdy, date_trunc('second', ts) AS ymd_hms,
      date_trunc('second', ts) AS mdy_hms, CAST(ts AS DATE) AS parts, CAST(NULL AS DATE) AS bad FROM events""",
)
def _a07(spark, sf):
    ev = table(spark, sf, "events")

    def text(fmt):
        return F.date_format("ts", fmt)

    return ev.select(
        "event_id",
        parse_time(F.when(F.col("event_id") % 2 == 0, text("yyyy-MM-dd")).otherwise(text("yyyy/M/d")), "ymd").alias("ymd"),
        parse_time(text("M/d/yyyy"), "mdy").alias("mdy"),
        parse_time(text("yyyy-MM-dd HH:mm:ss"), "ymd_hms").alias("ymd_hms"),
        parse_time(text("M/d/yyyy H:mm:ss"), "mdy_hms").alias("mdy_hms"),
        F.make_date(F.year("ts"), F.month("ts"), F.dayofmonth("ts")).alias("parts"),
        parse_time(F.col("event_type"), "ymd").alias("bad"),
    )


@query(
    "a08_catalog_lookup",
    """SELECT dsorder, dsname, identifier FROM (SELECT o_orderkey AS dsorder, o_orderpriority AS dsname,
      o_custkey AS identifier FROM orders) WHERE dsname LIKE '%H%'
    QUALIFY row_number() OVER (PARTITION BY dsname ORDER BY dsorder, identifier) = 1""",
)
def _a08(spark, sf):
    catalog = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("dsorder"), F.col("o_orderpriority").alias("dsname"), F.col("o_custkey").alias("identifier")
    )
    return tables.catalog_lookup(catalog, "H")


@query("a09_write_table", f"SELECT event_id, tank, temperature, CAST(timestamp AS DATE) AS date FROM {TELEMETRY}")
def _a09(spark, sf):
    path = run_folder(spark, "telemetry")
    t = telemetry(spark, sf).select("event_id", "tank", "temperature", F.to_date("timestamp").alias("date"))
    logs.write_table(t.repartitionByRange("date", "event_id"), path, "parquet", partition_by="date")
    return logs.read_table(spark, path).withColumn("date", F.col("date").cast("date"))


@query(
    "a10_time_grid",
    """SELECT tank, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM (
      SELECT CAST(user_id % 15 + 1 AS INTEGER) AS tank, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b
      FROM events GROUP BY 1)""",
)
def _a10(spark, sf):
    t = telemetry(spark, sf).withColumn("hour", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    return tables.grid_over(t, "hour", "1 HOUR", by="tank")


@query(
    "a11_ramp_profile",
    """WITH g AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM (
      SELECT date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM events)),
    k AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k, count(*) OVER () AS n FROM g)
    SELECT ts, round(18 + k * 2.0 / n, 6) AS up, round(20 - k * 2.0 / n, 6) AS down,
      round(CASE WHEN k - 1 < 200 THEN 15 + 4 * pow((k - 1) / 200.0, 2) WHEN k - 1 < 300 THEN 19.0
        WHEN k - 1 < 500 THEN 15 + 4 * pow((499 - (k - 1)) / 200.0, 2) ELSE 15.0 END, 6) AS hold FROM k""",
)
def _a11(spark, sf):
    ev = table(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    grid = tables.grid_over(ev, "hour", "1 HOUR")
    up = tables.ramp_profile(grid, "ts", 18, 2, 1, out="up")
    both = tables.ramp_profile(up, "ts", 20, 2, -1, out="down")
    return rounded(tables.ramp_hold_profile(both, "ts", 15, 19, 200, 100, out="hold"), 6, "up", "down", "hold")
