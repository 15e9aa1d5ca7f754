"""Registry of queries and the DuckDB statement each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Long telemetry: ``events`` read as (reading id, time, tank, genet, temperature)."""
    return table(spark, sf, "events").select(
        "event_id",
        F.col("ts").alias("timestamp"),
        (F.col("user_id") % 15 + 1).cast("int").alias("tank"),
        F.col("event_type").alias("genet"),
        F.col("value").alias("temperature"),
    )


TELEMETRY = (
    "(SELECT event_id, ts AS timestamp, CAST(user_id % 15 + 1 AS INTEGER) AS tank,"
    " event_type AS genet, value AS temperature FROM events)"
)


def telemetry_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry whose every seventh reading is missing."""
    t = telemetry(spark, sf)
    return t.withColumn("temperature", F.when(F.col("event_id") % 7 != 0, F.col("temperature")))


TELEMETRY_GAPS = (
    "(SELECT event_id, ts AS timestamp, CAST(user_id % 15 + 1 AS INTEGER) AS tank, event_type AS genet,"
    " CASE WHEN event_id % 7 <> 0 THEN value END AS temperature FROM events)"
)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated measures: ``orders`` read as (unit, date, id, measured size)."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("unit"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderkey").alias("obs"),
        F.col("o_totalprice").alias("size"),
        F.col("o_orderstatus").alias("phase"),
        F.col("o_orderpriority").alias("factor"),
    )


PANEL = (
    "(SELECT o_custkey AS unit, CAST(o_orderdate AS DATE) AS date, o_orderkey AS obs, o_totalprice AS size,"
    " o_orderstatus AS phase, o_orderpriority AS factor FROM orders)"
)


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round the named columns for comparison with the SQL result."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})
