"""Autocorrelation and stationarity statistics per series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.functions.special import chi2_sf_expr
from tidemark.operators.ordered import as_list, neighbourhood, running, with_group_stats
from tidemark.session import cut_lineage


def _centred(df: DataFrame, by: list[str], order: list[str], c: str) -> DataFrame:
    known = df.filter(F.col(c).isNotNull()).select(*by, *order, F.col(c).cast("double").alias("__x"))
    means = with_group_stats(known, by, {"__m": F.avg("__x")})
    return means.withColumn("__x", F.col("__x") - F.col("__m")).drop("__m")


def _lag_products(df: DataFrame, by: list[str], order: list[str], k: int, chunk) -> DataFrame:
    """Per series: n and the sums of x(t) x(t-j) for j = 0..k, as an array."""
    lags = neighbourhood(
        df, by, order, lambda w: {f"__l{j}": F.lag("__x", j).over(w) for j in range(1, k + 1)}, before=k, chunk=chunk
    )
    sums = [F.sum(F.col("__x") * F.col("__x"))]
    sums += [F.coalesce(F.sum(F.col("__x") * F.col(f"__l{j}")), F.lit(0.0)) for j in range(1, k + 1)]
    return lags.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("products"))


def acf(df: DataFrame, by, order, c: str, k: int, chunk=None) -> DataFrame:
    """Autocorrelation to lag ``k`` per series (mean-centred, divisor n): rows (series, lag, acf, n)."""
    by, order = as_list(by), as_list(order)
    sums = _lag_products(_centred(df, by, order, c), by, order, k, chunk)
    long = sums.select(*by, "n", F.col("products")[0].alias("__v"), F.posexplode("products").alias("lag", "__p"))
    return long.select(*by, "lag", F.try_divide("__p", "__v").alias("acf"), "n")


def acf_arrays(acf_rows: DataFrame, by) -> DataFrame:
    """One array of autocorrelations per series, from lag 0 (its length is fixed by the lags asked for)."""
    ordered = F.array_sort(F.collect_list(F.struct("lag", "acf")))
    return acf_rows.groupBy(*as_list(by)).agg(F.max("n").alias("n"), F.transform(ordered, lambda s: s["acf"]).alias("r"))


def pacf(df: DataFrame, by, order, c: str, k: int, chunk=None) -> DataFrame:
    """Partial autocorrelation to lag ``k`` by the Durbin-Levinson recursion on each series' short array."""
    by = as_list(by)
    arrays = acf_arrays(acf(df, by, order, c, k, chunk), by).select(*by, "r")

    def recurse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                r = np.asarray(row.r, dtype=float)
                phi = np.zeros(0)
                for j in range(1, len(r)):
                    past = r[j - 1 : 0 : -1]
                    den = 1 - phi @ r[1:j]
                    last = (r[j] - phi @ past) / den if den != 0 else np.nan
                    phi = np.append(phi - last * phi[::-1], last)
                    rows.append((*tuple(row)[:-1], j, None if np.isnan(last) else last))
            yield pd.DataFrame(rows, columns=[*by, "lag", "pacf"])

    fields = [df.schema[b] for b in by] + [T.StructField("lag", T.IntegerType()), T.StructField("pacf", T.DoubleType())]
    return arrays.mapInPandas(recurse, T.StructType(fields))


def ljung_box(acf_rows: DataFrame, by, k: int) -> DataFrame:
    """Ljung-Box statistic over lags 1..k and its chi-square tail."""
    inside = acf_rows.filter(F.col("lag").between(1, k))
    term = F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))
    q = inside.groupBy(*as_list(by)).agg((F.max("n") * (F.max("n") + 2) * F.sum(term)).alias("q"))
    return q.withColumn("p", chi2_sf_expr(F.col("q"), k))


def autocorrelated_groups(acf_rows: DataFrame, by) -> DataFrame:
    """Number of series, and of series with any autocorrelation outside +-1.96/sqrt(n)."""
    out = F.abs("acf") > 1.96 / F.sqrt(F.col("n").cast("double"))
    per = acf_rows.filter("lag > 0").groupBy(*as_list(by)).agg(F.max(out).alias("__any"))
    return per.agg(F.count(F.lit(1)).alias("groups"), F.count(F.when(F.col("__any"), 1)).alias("autocorrelated"))


def kpss(df: DataFrame, by, order, c: str, lags: int, chunk=None) -> DataFrame:
    """KPSS level statistic with Bartlett weights over ``lags`` autocovariances."""
    by, order = as_list(by), as_list(order)
    centred = cut_lineage(_centred(df, by, order, c))
    partial = running(centred, by, order, {"__s": ("sum", "__x")}, chunk)
    walk = partial.groupBy(*by).agg(F.sum(F.col("__s") * F.col("__s")).alias("__ss"))
    sums = _lag_products(centred, by, order, lags, chunk)
    n = F.col("n").cast("double")
    long_run = F.col("products")[0]
    for j in range(1, lags + 1):
        long_run = long_run + F.lit(2.0 * (1 - j / (lags + 1))) * F.col("products")[j]
    joined = sums.join(walk, by) if by else sums.withColumn("__ss", walk.scalar())
    return joined.select(*by, "n", F.try_divide(F.col("__ss"), n * n * long_run / n).alias("kpss"))
