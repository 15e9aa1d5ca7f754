"""Group comparisons: ANOVA, variance components, pairwise means, normality, goodness of fit, bootstrap."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.special import chi2_sf_at, log_factorial_expr, normal_cdf_expr, normal_quantile_expr
from tidemark.operators.ordered import as_list, running, value_chunk, with_group_stats
from tidemark.operators.series_stats import acf
from tidemark.operators.windows import p_adjust
from tidemark.session import cut_lineage

# Executors need not have this package installed: the replicate sums travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _group_table(df: DataFrame, group, y: str, by) -> DataFrame:
    """Per group: n, mean, within sum of squares; plus the overall mean of its ``by`` family."""
    by = as_list(by)
    known = df.filter(F.col(y).isNotNull())
    per = known.groupBy(*by, *as_list(group)).agg(
        F.count(y).alias("n"), F.avg(y).alias("m"), (F.var_pop(y) * F.count(y)).alias("ss")
    )
    return with_group_stats(cut_lineage(per), by, {"grand": F.sum(F.col("n") * F.col("m")) / F.sum("n")})


def anova_oneway(df: DataFrame, group, y: str, by=None) -> DataFrame:
    """Between and within sums of squares, degrees of freedom, mean squares and F."""
    d = F.col("m") - F.col("grand")
    sums = _group_table(df, group, y, by).groupBy(*as_list(by)).agg(
        F.sum(F.col("n") * d * d).alias("ss_between"),
        F.sum("ss").alias("ss_within"),
        (F.count(F.lit(1)) - 1).alias("df_between"),
        (F.sum("n") - F.count(F.lit(1))).alias("df_within"),
    )
    ms = {
        "ms_between": F.try_divide("ss_between", "df_between"),
        "ms_within": F.try_divide("ss_within", "df_within"),
    }
    return sums.withColumns(ms).withColumn("f", F.try_divide("ms_between", "ms_within"))


def variance_components(df: DataFrame, group, y: str, by=None) -> DataFrame:
    """Random-intercept variance components by the ANOVA estimators, and the intraclass correlation."""
    by = as_list(by)
    sizes = df.filter(F.col(y).isNotNull()).groupBy(*by, *as_list(group)).agg(F.count(y).cast("double").alias("n"))
    total = F.sum("n")
    n0 = sizes.groupBy(*by).agg(
        F.try_divide(total - F.sum(F.col("n") * F.col("n")) / total, F.count(F.lit(1)) - 1).alias("n0")
    )
    table = anova_oneway(df, group, y, by)
    joined = table.join(n0, by) if by else table.withColumn("n0", n0.scalar())
    between = F.greatest(F.try_divide(F.col("ms_between") - F.col("ms_within"), F.col("n0")), F.lit(0.0))
    out = joined.withColumn("var_between", between).withColumn("var_within", F.col("ms_within"))
    icc = F.try_divide(F.col("var_between"), F.col("var_between") + F.col("var_within"))
    return out.withColumn("icc", icc).select(*by, "n0", "var_between", "var_within", "icc")


def level_pairs(df: DataFrame, factor: str, levels: Sequence[str]) -> DataFrame:
    """Copy each row to every pair of listed levels its own level belongs to, as (level_a, level_b)."""
    lists = {a: [(min(a, b), max(a, b)) for b in levels if b != a] for a in levels}
    cases: Column | None = None
    for level, pairs in lists.items():
        value = F.array(*[F.struct(F.lit(a).alias("level_a"), F.lit(b).alias("level_b")) for a, b in pairs])
        cases = F.when(F.col(factor) == level, value) if cases is None else cases.when(F.col(factor) == level, value)
    return df.withColumn("__pair", F.explode(cases)).select(*df.columns, "__pair.level_a", "__pair.level_b")


def pairwise_means(df: DataFrame, factor: str, levels: Sequence[str], y: str, method: str = "bonferroni") -> DataFrame:
    """Differences of the means of each pair of levels with pooled se, z, two-sided p and adjusted p.

    The group table (one row per level) is read once and spread to the pairs; the data are not joined to themselves.
    """
    per = _group_table(df.filter(F.col(factor).isin(*levels)), factor, y, None)
    mse = F.sum("ss") / (F.sum("n") - F.count(F.lit(1)))
    pairs = level_pairs(with_group_stats(per, None, {"mse": mse}), factor, levels)

    def side(which: str, c: str) -> Column:
        return F.max(F.when(F.col(factor) == F.col(which), F.col(c)))

    table = pairs.groupBy("level_a", "level_b").agg(
        (side("level_a", "m") - side("level_b", "m")).alias("diff"),
        F.sqrt(F.max("mse") * (1 / side("level_a", "n") + 1 / side("level_b", "n"))).alias("se"),
    )
    table = table.withColumn("z", F.try_divide("diff", "se"))
    table = table.withColumn("p", 2 * normal_cdf_expr(-F.abs("z")))
    return p_adjust(cut_lineage(table), "p", method, "p_adj")


def normality(df: DataFrame, by, c: str) -> DataFrame:
    """Skewness, excess kurtosis and the Jarque-Bera statistic with its chi-square(2) tail."""
    s, k = F.col("skewness"), F.col("kurtosis")
    base = df.groupBy(*as_list(by)).agg(F.count(c).alias("n"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"))
    jb = base.withColumn("jb", F.col("n") / 6 * (s * s + k * k / 4))
    return jb.withColumn("p", F.exp(-F.col("jb") / 2))


def poisson_gof(df: DataFrame, c: str) -> DataFrame:
    """Observed and expected frequencies of a count under Poisson(mean), probabilities rescaled to the observed values."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("observed"))
    sized = with_group_stats(
        cut_lineage(counts), None, {"__n": F.sum("observed"), "__lambda": F.sum(F.col("k") * F.col("observed")) / F.sum("observed")}
    )
    log_p = F.col("k") * F.log("__lambda") - F.col("__lambda") - log_factorial_expr(F.col("k"))
    sized = sized.withColumn("__p", F.exp(log_p))
    scaled = with_group_stats(sized, None, {"__total": F.sum("__p")})
    return scaled.withColumn("expected", F.col("__n") * F.col("__p") / F.col("__total")).select("k", "observed", "expected")


def chi_square(gof: DataFrame) -> DataFrame:
    """Statistic, degrees of freedom and upper-tail p of an observed / expected table (one kind only: no test, p is NULL)."""
    d = F.col("observed") - F.col("expected")
    out = gof.agg(F.sum(d * d / F.col("expected")).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))
    return out.withColumn("p", chi2_sf_at(F.col("chi2"), F.col("df")))


# Modulus and generators of the replicate hash.
PRIME, GEN_A, GEN_C = 2147483647, 16807, 48271


def replicate_constants(b: int, seed: int) -> list[tuple[int, int]]:
    """Multiplier and offset of each bootstrap replicate."""
    return [(pow(GEN_A, i + 1 + seed, PRIME), pow(GEN_C, i + 1 + seed, PRIME)) for i in range(b)]


def poisson1() -> list[float]:
    """Cumulative probabilities of Poisson(1) from 0 up, to the last one below 1 in double precision."""
    terms, out = [math.exp(-1)], []
    while (total := math.fsum(terms)) < 1.0:
        out.append(total)
        terms.append(terms[-1] / len(terms))
    return out


POISSON1 = poisson1()


# Rows weighted at a time, and groups whose sums a task holds before it passes them on.
WEIGHTED_ROWS, HELD_GROUPS = 4096, 10_000


def _replicate_sums(batches: Iterator[pa.RecordBatch], by: list[str], constants: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Per group and task: the sums of weighted values and of weights in every replicate, as two arrays."""
    factor, offset = (np.array(c, np.int64) for c in zip(*constants, strict=True))
    steps, held, kinds = np.array(POISSON1), {}, []

    def passed_on() -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
        sums = [pa.array([x[i].tolist() for x in held.values()], pa.list_(pa.float64())) for i in (0, 1)]
        out = pa.RecordBatch.from_arrays([*columns, *sums], [*by, "s", "w"])
        held.clear()
        return out

    for batch in batches:
        kinds = [batch[c].type for c in by]
        keys = list(zip(*[batch[c].to_pylist() for c in by], strict=True)) if by else [()] * batch.num_rows
        h, v = batch["__h"].to_numpy(), batch["__v"].to_numpy()
        for at in range(0, batch.num_rows, WEIGHTED_ROWS):
            part = slice(at, at + WEIGHTED_ROWS)
            u = (h[part, None] * factor + offset) % PRIME / float(PRIME)
            weights = np.searchsorted(steps, u.ravel(), side="right").reshape(u.shape).astype(float)
            number: dict[tuple, int] = {}
            code = np.array([number.setdefault(k, len(number)) for k in keys[part]])
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(number)))
            w = np.add.reduceat(weights[order], starts)
            s = np.add.reduceat((weights * v[part, None])[order], starts)
            for key, i in number.items():
                before = held.get(key)
                held[key] = (s[i], w[i]) if before is None else (before[0] + s[i], before[1] + w[i])
        if by and len(held) > HELD_GROUPS:
            yield passed_on()
    if held and by:
        yield passed_on()
    elif held:
        s, w = held[()]
        yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.float64())) for x in (s, w)], ["s", "w"])


def bootstrap_ci(df: DataFrame, by, row_id: str, c: str, b: int, seed: int = 0, lo: float = 0.025, hi: float = 0.975):
    """Percentile interval of the group mean over ``b`` Poisson bootstrap replicates.

    A row's weight in a replicate comes from a hash of its id, so any partitioning gives the same result. Tasks sum all
    replicates of a group as two vectors, so a group enters the shuffle as one row per task, not once per replicate.
    """
    by = as_list(by)
    digits = F.substring(F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed)))), 1, 8)
    h = F.conv(digits, 16, 10).cast("long") % PRIME
    rows = df.filter(F.col(c).isNotNull()).select(*by, F.col(c).cast("double").alias("__v"), h.alias("__h"))
    constants = replicate_constants(b, seed)
    vector = T.ArrayType(T.DoubleType())
    fields = [df.schema[k] for k in by]
    sums = rows.mapInArrow(
        lambda batches: _replicate_sums(batches, by, constants), T.StructType([*fields, T.StructField("s", vector), T.StructField("w", vector)])
    )

    def interval(parts: pd.DataFrame) -> pd.DataFrame:
        s, w = (np.sum(np.stack(parts[n].to_list()), axis=0) for n in ("s", "w"))
        means = s[w > 0] / w[w > 0]
        found = [means.mean(), *np.quantile(means, [lo, hi])] if len(means) else [None] * 3
        return pd.DataFrame([[*parts[by].iloc[0], *found]], columns=[*by, *names])

    names = ["estimate", "lower", "upper"]
    return sums.groupBy(*by).applyInPandas(interval, T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in names]]))


def _with_normal_scores(df: DataFrame, by: list[str], row_id: str, c: str) -> DataFrame:
    known = with_group_stats(df.filter(F.col(c).isNotNull()), by, {"__n": F.count(F.lit(1))})
    ranked = running(value_chunk(known, by, c, row_id), by, [c, row_id], {"__i": ("count", F.lit(1))}, F.col("__bucket"))
    out = ranked.withColumn("position", (F.col("__i") - 0.5) / F.col("__n"))
    return out.withColumn("theoretical", normal_quantile_expr(F.col("position")))


def qq_points(df: DataFrame, by, row_id: str, c: str) -> DataFrame:
    """Each value with its rank position ``(i - 0.5) / n`` and the normal quantile there."""
    by = as_list(by)
    scored = _with_normal_scores(df, by, row_id, c)
    return scored.select(*by, row_id, F.col(c).alias("sample"), "position", "theoretical")


def residual_table(df: DataFrame, row_id: str, y: str, yhat: str) -> DataFrame:
    """Residual diagnostics per row: fitted, residual, root absolute residual, normal quantile of its rank."""
    base = df.select(row_id, F.col(yhat).alias("fitted"), (F.col(y) - F.col(yhat)).alias("residual"))
    scored = _with_normal_scores(base, [], row_id, "residual")
    return scored.select(row_id, "fitted", "residual", F.sqrt(F.abs("residual")).alias("scale"), "theoretical")


def residual_acf(df: DataFrame, by, order, y: str, yhat: str, k: int, chunk=None) -> DataFrame:
    """Autocorrelation of the residuals in row order."""
    return acf(df.withColumn("__r", F.col(y) - F.col(yhat)), by, order, "__r", k, chunk)
