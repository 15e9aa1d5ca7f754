"""Generated and catalogue tables: time grids, synthetic set-point profiles, dataset lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.ordered import as_list, running


def time_grid(spark: SparkSession, start: str, end: str, step: str, out: str = "ts") -> DataFrame:
    """Rows from start to end (inclusive) by a step such as ``5 minutes``, ``1 hour``, ``7 days``, ``1 year``."""
    grid = F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr(f"INTERVAL {step}"))
    return spark.range(1).select(F.explode(grid).alias(out))


def grid_over(df: DataFrame, ts: str, step: str, by=None, out: str = "ts") -> DataFrame:
    """Time grid between the first and last time of each group."""
    ends = df.groupBy(*as_list(by)).agg(F.min(ts).alias("__a"), F.max(ts).alias("__b"))
    return ends.select(*as_list(by), F.explode(F.sequence("__a", "__b", F.expr(f"INTERVAL {step}"))).alias(out))


def ramp_profile(grid: DataFrame, ts: str, initial: float, rate: float, sign: int = 1, by=None, out: str = "temp"):
    """Straight ramp ``initial + sign * k * rate / n`` over the n grid points of each segment (k from 1)."""
    by = as_list(by)
    indexed = running(grid, by, [ts], {"__k": ("count", F.lit(1))})
    n = grid.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    sized = indexed.join(n, by) if by else indexed.withColumn("__n", n.scalar())
    change = F.lit(float(sign) * float(rate)) / F.col("__n")
    return sized.withColumn(out, F.lit(float(initial)) + F.col("__k") * change).select(*grid.columns, out)


def ramp_hold_profile(grid: DataFrame, ts: str, initial: float, peak: float, up: int, hold: int, out: str = "temp"):
    """Quadratic rise over ``up`` points, ``hold`` points at the peak, then the same rise backwards."""
    k = F.col("__k") - 1
    top = F.lit(float(peak) - float(initial))
    rise = F.pow(F.lit(1.0 / up) * k, F.lit(2.0))
    fall = F.pow(F.lit(1.0 / up) * (F.lit(2 * up + hold - 1) - k), F.lit(2.0))
    share = F.when(k < up, rise).when(k < up + hold, F.lit(1.0)).when(k < 2 * up + hold, fall).otherwise(F.lit(0.0))
    indexed = running(grid, [], [ts], {"__k": ("count", F.lit(1))})
    return indexed.withColumn(out, F.lit(float(initial)) + top * share).select(*grid.columns, out)


def catalog_lookup(catalog: DataFrame, name: str) -> DataFrame:
    """First entry (by ``dsorder``) of each dataset whose name contains ``name``."""
    row = F.struct(*catalog.columns)
    hits = catalog.filter(F.col("dsname").contains(name))
    first = hits.groupBy("dsname").agg(F.min_by(row, F.struct("dsorder", "identifier")).alias("row"))
    return first.select("row.*")
