"""Row-wise operators that bring in a lookup: calibration and sensor dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.numeric import calibrate_expr
from tidemark.operators.ordered import as_list


def calibrate(
    df: DataFrame, sensors: DataFrame, sensor: str, c: str, ref_low: float, ref_high: float, out: str
) -> DataFrame:
    """Two-point calibration with per-sensor ``raw_high``/``raw_low``; an unlisted sensor gives NULL.

    No broadcast hint: Spark broadcasts the sensor table when its measured size allows, and joins by key beyond.
    """
    table = sensors.select(sensor, "raw_high", "raw_low")
    value = calibrate_expr(F.col(c), F.col("raw_high"), F.col("raw_low"), ref_low, ref_high)
    return df.join(table, sensor, "left").withColumn(out, value).drop("raw_high", "raw_low").select(*df.columns, out)


def lookup(df: DataFrame, dim: DataFrame, key, default: dict[str, object] | None = None) -> DataFrame:
    """Left join of a dimension; unmatched attributes take their default."""
    joined = df.join(dim, as_list(key), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (default or {}).items()})
