"""Ordering, slices, top-k and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.ordered import as_list


def order_desc(df: DataFrame, c: str, ties=None) -> DataFrame:
    return df.orderBy(F.col(c).desc(), *as_list(ties))


def order_by(df: DataFrame, cols) -> DataFrame:
    return df.orderBy(*as_list(cols))


def first_where(df: DataFrame, predicate: Column, order, by=None) -> DataFrame:
    """First row (per group) meeting a predicate."""
    row = F.min_by(F.struct(*df.columns), F.struct(*as_list(order)))
    return df.filter(predicate).groupBy(*as_list(by)).agg(row.alias("__row")).filter("__row is not null").select("__row.*")


def slice_between(df: DataFrame, ts: str, a: str, b: str) -> DataFrame:
    """Rows between two dates, both included."""
    return df.filter(F.col(ts).between(F.lit(a).cast("date"), F.lit(b).cast("date")))


def top_k(df: DataFrame, by, c: str, k: int, ties=None) -> DataFrame:
    """The ``k`` largest rows per group; without a group, of the table."""
    order = [F.col(c).desc_nulls_last(), *[F.col(t) for t in as_list(ties)]]
    by = as_list(by)
    if not by:
        return df.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__r", rank).filter(F.col("__r") <= k).drop("__r")


def append(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def distinct(df: DataFrame, cols=None) -> DataFrame:
    return df.select(*as_list(cols)).distinct() if cols else df.distinct()


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def common_columns(names, df: DataFrame) -> list[str]:
    """Names present as columns, in the table's order."""
    wanted = set(names)
    return [c for c in df.columns if c in wanted]


def minus_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
