"""Sort, limit, top-k and set operations (2.G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import TELEMETRY, query, table, telemetry
from tidemark.operators import select as sel


@query("f01_order_desc", "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey")
def _f01(spark, sf):
    return sel.order_desc(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_retailprice", "p_partkey")


@query(
    "f02_first_where",
    f"""SELECT event_id, tank, temperature FROM {TELEMETRY} WHERE temperature > 100
      QUALIFY row_number() OVER (PARTITION BY tank ORDER BY timestamp, event_id) = 1""",
)
def _f02(spark, sf):
    t = sel.first_where(telemetry(spark, sf), F.col("temperature") > 100, ["timestamp", "event_id"], "tank")
    return t.select("event_id", "tank", "temperature")


@query(
    "f03_slice_between",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders
      WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-09-01' AND DATE '1997-02-28'""",
)
def _f03(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return sel.slice_between(o, "date", "1996-09-01", "1997-02-28")


@query(
    "f04_top_k",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER
      (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 3""",
)
def _f04(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return sel.top_k(li, "l_suppkey", "l_extendedprice", 3, ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "f04_top_k_global",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
      ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20""",
)
def _f04b(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return sel.top_k(li, None, "l_extendedprice", 20, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("f05_order_by", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey")
def _f05(spark, sf):
    return sel.order_by(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_acctbal", "s_suppkey"])


@query(
    "g01_append",
    f"SELECT event_id, temperature FROM {TELEMETRY} UNION ALL SELECT event_id, -temperature AS temperature FROM {TELEMETRY}",
)
def _g01(spark, sf):
    t = telemetry(spark, sf)
    return sel.append(
        t.select("event_id", "temperature"), t.select((-F.col("temperature")).alias("temperature"), "event_id")
    )


@query("g02_distinct", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def _g02(spark, sf):
    return sel.distinct(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus"])


@query("g03_common_keys", "SELECT l_partkey FROM lineitem INTERSECT SELECT 3 * l_suppkey FROM lineitem")
def _g03(spark, sf):
    li = table(spark, sf, "lineitem")
    return sel.common_keys(li.select("l_partkey"), li.select((F.col("l_suppkey") * 3).alias("l_partkey")))


@query("g04_minus_keys", "SELECT c_custkey FROM customer EXCEPT SELECT 2 * o_custkey FROM orders")
def _g04(spark, sf):
    other = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("c_custkey"))
    return sel.minus_keys(table(spark, sf, "customer").select("c_custkey"), other)
