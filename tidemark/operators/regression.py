"""Regressions as aggregates: one pass of means and covariances per group, then a small dense solve per group.

The covariances come from Spark's mergeable ``covar_pop``, so partial aggregation applies and a hot group costs no
more than any other. The solves run in Arrow batches over one row per group.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions import special
from tidemark.functions.special import log_factorial_expr, t_quantile_expr
from tidemark.operators.ordered import all_of, as_list, chunked, lagged, neighbourhood, with_group_stats
from tidemark.operators.windows import row_index, zscore
from tidemark.session import cut_lineage


# Executors need not have this package installed: the small solvers travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(special)


def ols_line(df: DataFrame, by, y: str, x: str) -> DataFrame:
    """Straight line per group: slope, intercept, R squared, and the equation as text."""
    fit = df.groupBy(*as_list(by)).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )
    return fit.withColumn("equation", F.format_string("y = %.3f + %.3f x", "intercept", "slope"))


def moments(df: DataFrame, by, cols: Sequence[str]) -> DataFrame:
    """Per group: complete rows ``n``, means and the upper triangle of the population covariance matrix."""
    complete = df.filter(all_of([F.col(c).isNotNull() for c in cols]))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return complete.groupBy(*as_list(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in cols]).alias("means"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("covs"),
    )


def _matrix(covs, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = covs
    return m + np.triu(m, 1).T


def _solve(n: int, means, covs, use: Sequence[int]):
    """Coefficients (intercept first), (X'X)^-1 and residual sum of squares; None if singular or too few rows."""
    k = len(means)
    c = _matrix(np.asarray(covs, dtype=float), k)
    cxx, cxy, cyy = c[np.ix_(use, use)], c[use, 0], c[0, 0]
    xbar = np.asarray(means, dtype=float)[list(use)]
    if n <= len(use) + 1:
        return None
    scale = np.sqrt(np.diag(cxx))
    if len(use) and (np.any(scale == 0) or np.linalg.cond(cxx / np.outer(scale, scale)) > 1e12):
        return None
    inv = np.linalg.inv(cxx) if len(use) else np.zeros((0, 0))
    slopes = inv @ cxy
    beta = np.concatenate([[means[0] - xbar @ slopes], slopes])
    full = np.empty((len(use) + 1, len(use) + 1))
    full[0, 0] = (1 + xbar @ inv @ xbar) / n
    full[0, 1:] = full[1:, 0] = -(inv @ xbar) / n
    full[1:, 1:] = inv / n
    return beta, full, max(n * (cyy - slopes @ cxy), 0.0), n * cyy


def _fields(df: DataFrame, by: list[str]) -> list[T.StructField]:
    return [df.schema[c] for c in by]


def ols(df: DataFrame, by, y: str, xs: Sequence[str]) -> DataFrame:
    """Multiple regression per group: one row per term with estimate, se, t, and the fit's n, rss, r2.

    Groups whose design is singular or has too few complete rows give no rows.
    """
    by, terms = as_list(by), ["(intercept)", *xs]
    fit = moments(df, by, [y, *xs])
    use = list(range(1, len(xs) + 1))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                got = _solve(row.n, row.means, row.covs, use)
                if got is None:
                    continue
                beta, inv, rss, tss = got
                se = np.sqrt(np.diag(inv) * rss / (row.n - len(beta)))
                key = tuple(row)[: len(by)]
                for term, b, s in zip(terms, beta, se):
                    t = b / s if s > 0 else None
                    rows.append((*key, term, b, s, t, row.n, rss, 1 - rss / tss if tss > 0 else None))
            yield pd.DataFrame(rows, columns=[*by, "term", "estimate", "se", "t", "n", "rss", "r2"])

    out = T.StructType(
        _fields(df, by)
        + [T.StructField("term", T.StringType())]
        + [T.StructField(c, T.DoubleType()) for c in ("estimate", "se", "t")]
        + [T.StructField("n", T.LongType()), T.StructField("rss", T.DoubleType()), T.StructField("r2", T.DoubleType())]
    )
    return fit.select(*by, "n", "means", "covs").mapInPandas(solve, out)


def compare_nested(df: DataFrame, by, y: str, reduced: Sequence[str], full: Sequence[str]) -> DataFrame:
    """F test per group of a model against one that holds its predictors and more, over the rows complete in both.

    Both residual sums come from one pass of covariances. A singular fit, too few rows or an exact full fit leave the
    statistic NULL.
    """
    if not set(reduced) < set(full):
        raise ValueError("the reduced model's predictors are a proper part of the full model's")
    by = as_list(by)
    place = {x: i for i, x in enumerate(full, start=1)}
    df1 = len(full) - len(reduced)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                small, large = (_solve(row.n, row.means, row.covs, [place[x] for x in xs]) for xs in (reduced, full))
                key, df2 = tuple(row)[: len(by)], row.n - len(full) - 1
                rss = [None if m is None else m[2] for m in (small, large)]
                if None in rss or rss[1] <= 0:
                    rows.append((*key, row.n, df1, df2, *rss, None, None))
                    continue
                f = (rss[0] - rss[1]) / df1 / (rss[1] / df2)
                rows.append((*key, row.n, df1, df2, *rss, f, special.f_sf(f, df1, df2)))
            yield pd.DataFrame(rows, columns=[*by, *names])

    kinds = {"n": T.LongType(), "df1": T.LongType(), "df2": T.LongType()}
    names = [*kinds, "rss_reduced", "rss_full", "f", "p"]
    out = T.StructType(_fields(df, by) + [T.StructField(c, kinds.get(c, T.DoubleType())) for c in names])
    return moments(df, by, [y, *full]).select(*by, "n", "means", "covs").mapInPandas(solve, out)


def variance_inflation(df: DataFrame, by, xs: Sequence[str]) -> DataFrame:
    """Variance inflation factor of each predictor per group: the diagonal of the inverse correlation matrix.

    A group with a constant predictor or an exact dependence has NULL factors.
    """
    by = as_list(by)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                cov = _matrix(np.asarray(row.covs, dtype=float), len(xs))
                scale = np.sqrt(np.diag(cov))
                known = np.all(scale > 0) and np.linalg.cond(cov / np.outer(scale, scale)) <= 1e12
                vif = np.diag(np.linalg.inv(cov / np.outer(scale, scale))).tolist() if known else [None] * len(xs)
                rows += [(*tuple(row)[: len(by)], x, row.n, v) for x, v in zip(xs, vif, strict=True)]
            yield pd.DataFrame(rows, columns=[*by, "term", "n", "vif"])

    kinds = {"term": T.StringType(), "n": T.LongType(), "vif": T.DoubleType()}
    out = T.StructType(_fields(df, by) + [T.StructField(c, k) for c, k in kinds.items()])
    return moments(df, by, xs).select(*by, "n", "means", "covs").mapInPandas(solve, out)


def fitted_band(df: DataFrame, by, y: str, x: str, level: float = 0.95) -> DataFrame:
    """Rows with their group's straight line and the confidence band of its mean: ``fitted``, ``fit_se``, ``lower``, ``upper``.

    The line uses rows where both are known; a row without ``x`` has no fit, one without ``y`` has. Groups of fewer than
    three such rows have no band.
    """
    by, known = as_list(by), F.col(x).isNotNull() & F.col(y).isNotNull()
    own = F.when(known, F.col(x).cast("double"))
    stats = {
        "__n": F.count(own),
        "__mx": F.avg(own),
        "__sxx": F.regr_sxx(y, x),
        "__syy": F.regr_syy(y, x),
        "__slope": F.regr_slope(y, x),
        "__my": F.avg(F.when(known, F.col(y).cast("double"))),
    }
    out = with_group_stats(df, by, stats)
    free, away = F.col("__n") - 2, F.col(x) - F.col("__mx")
    rest = F.greatest(F.col("__syy") - F.col("__slope") * F.col("__slope") * F.col("__sxx"), F.lit(0.0))
    spread = F.try_divide(rest, free) * (1 / F.col("__n") + F.try_divide(away * away, "__sxx"))
    reach = t_quantile_expr((1 + level) / 2, free) * F.col("fit_se")
    out = out.withColumn("fitted", F.col("__my") + F.col("__slope") * away).withColumn("fit_se", F.sqrt(spread))
    return out.withColumns({"lower": F.col("fitted") - reach, "upper": F.col("fitted") + reach}).drop(*stats)


def path_model(df: DataFrame, by_time: tuple, equations: dict[str, Sequence[str]], cluster: str, lags=(1,), chunk=None):
    """Recursive path model: each equation is a regression on z-scored and lagged variables, complete rows only.

    ``by_time`` is (series columns, order columns). ``equations`` maps a response to predictors; ``<c>_lag<k>`` names a
    lagged one. Standard errors are robust to correlation within ``cluster``: scores are summed per cluster, and only
    their small cross-product matrix reaches the solve.
    """
    by, order = by_time
    names = {p.rsplit("_lag", 1)[0] for ps in equations.values() for p in ps} | set(equations)
    z = zscore(df, None, {f"__z_{c}": c for c in sorted(names)}).withColumns({c: F.col(f"__z_{c}") for c in names})
    lagging = sorted({p.rsplit("_lag", 1)[0] for ps in equations.values() for p in ps if "_lag" in p})
    z = neighbourhood(
        z,
        by,
        order,
        lambda w: {f"{c}_lag{k}": F.when(F.col(c).isNotNull(), F.lag(c, k).over(w)) for c in lagging for k in lags},
        before=max(lags),
        chunk=chunk,
    )
    z = cut_lineage(z.select(cluster, *{c for c in z.columns if not c.startswith("__") and c != cluster}))
    out = None
    for response, predictors in equations.items():
        part = _robust(z, response, list(predictors), cluster).withColumn("response", F.lit(response))
        out = part if out is None else out.unionByName(part)
    return out


def _robust(df: DataFrame, y: str, xs: list[str], cluster: str) -> DataFrame:
    k = len(xs) + 1
    complete = df.filter(all_of([F.col(c).isNotNull() for c in [y, *xs]]))
    fit = ols(complete, None, y, xs)
    beta = fit.agg(F.map_from_entries(F.collect_list(F.struct("term", "estimate"))).alias("b")).select("b").scalar()
    x = {"(intercept)": F.lit(1.0), **{c: F.col(c) for c in xs}}
    scored = complete.withColumn("__b", beta)
    fitted = sum((F.element_at("__b", F.lit(t)) * v for t, v in x.items()), F.lit(0.0))
    scored = scored.withColumn("__e", F.col(y) - fitted)
    scores = scored.groupBy(cluster).agg(*[F.sum(v * F.col("__e")).alias(f"s{i}") for i, v in enumerate(x.values())])
    meat = scores.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.array(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(k)]).alias("meat"),
    )
    bread = moments(complete, None, [y, *xs])
    one = meat.withColumn("m", bread.select(F.struct("n", "means", "covs")).scalar())
    terms = list(x)
    one = one.select("clusters", "meat", F.col("m.n").alias("n"), F.col("m.means").alias("means"), F.col("m.covs").alias("covs"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                got = _solve(row.n, row.means, row.covs, list(range(1, k)))
                if got is None:
                    continue
                b, inv, rss, tss = got
                g = row.clusters
                adjust = g / max(g - 1, 1) * (row.n - 1) / (row.n - k)
                v = inv @ np.asarray(row.meat, dtype=float).reshape(k, k) @ inv * adjust
                se = np.sqrt(np.diag(v))
                rows += [(t, e, s, e / s if s > 0 else None, row.n, 1 - rss / tss) for t, e, s in zip(terms, b, se)]
            yield pd.DataFrame(rows, columns=["term", "estimate", "se", "z", "n", "r2"])

    return one.mapInPandas(solve, "term string, estimate double, se double, z double, n long, r2 double")


def design(df: DataFrame, factors: dict[str, Sequence], interactions: Sequence[tuple[str, str]] = ()):
    """Dummy columns in treatment contrasts: the first listed level of a factor is its reference.

    Returns the table and the names of the new columns (``factor_level``, and ``a_l:b_m`` for interactions).
    """
    dummies = {f: {f"{f}_{lv}": (F.col(f) == F.lit(lv)).cast("double") for lv in lvs[1:]} for f, lvs in factors.items()}
    columns: dict[str, Column] = {n: c for part in dummies.values() for n, c in part.items()}
    for a, b in interactions:
        for na, ca in dummies[a].items():
            for nb, cb in dummies[b].items():
                columns[f"{na}:{nb}"] = ca * cb
    return df.withColumns(columns), list(columns)


def _inverse_link(link: str, eta: Column) -> tuple[Column, Column]:
    """Mean and its slope at a linear predictor."""
    if link == "identity":
        return eta, F.lit(1.0)
    if link == "log":
        return F.exp(eta), F.exp(eta)
    if link == "logit":
        mu = 1 / (1 + F.exp(-eta))
        return mu, mu * (1 - mu)
    raise ValueError(f"unknown link {link}")


def _link(link: str, mu: Column) -> Column:
    return {"identity": mu, "log": F.log(mu), "logit": F.log(mu / (1 - mu))}[link]


def _family(family: str, y: Column, mu: Column, w: Column) -> tuple[Column, Column, Column]:
    """Variance at a mean, a mean to start from, and a row's log likelihood (of the binomial up to its coefficients)."""
    if family == "gaussian":
        return F.lit(1.0), y, -w * (y - mu) * (y - mu) / 2
    if family == "poisson":
        return mu, y + 0.1, w * (y * F.log(mu) - mu - log_factorial_expr(y))
    if family == "binomial":
        sure = F.when(y > 0, y * F.log(mu)).otherwise(0) + F.when(y < 1, (1 - y) * F.log(1 - mu)).otherwise(0)
        return mu * (1 - mu), (w * y + 0.5) / (w + 1), w * sure
    raise ValueError(f"unknown family {family}")


class Fit:
    """A candidate model while it is fitted."""

    def __init__(self, use: Sequence[int]):
        self.use, self.beta, self.inverse, self.loglik, self.pearson, self.n = list(use), None, None, None, None, 0
        self.converged = self.failed = False

    def sums(self, family: str, link: str, at: str) -> tuple[Column, list[Column]]:
        """The working response and weight of a row, to be named ``at``, and the sums that one step needs."""
        y, w, x = F.col("v0"), F.col("w"), [F.lit(1.0), *[F.col(f"v{i}") for i in self.use]]
        if self.beta is None:
            mu = _family(family, y, y, w)[1]
            eta = _link(link, mu)
        else:
            eta = sum((F.lit(float(b)) * c for b, c in zip(self.beta, x)), F.lit(0.0))
            mu = _inverse_link(link, eta)[0]
        slope = _inverse_link(link, eta)[1]
        variance, _, loglik = _family(family, y, mu, w)
        weight, response = F.col(f"{at}.weight"), F.col(f"{at}.response")
        row = F.struct(
            (w * slope * slope / variance).alias("weight"),
            (eta + (y - mu) / slope).alias("response"),
            loglik.alias("loglik"),
            (w * (y - mu) * (y - mu) / variance).alias("pearson"),
        )
        pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
        found = [F.sum(f"{at}.loglik"), F.sum(f"{at}.pearson"), *[F.sum(weight * x[i] * x[j]) for i, j in pairs]]
        return row, [*found, *[F.sum(weight * response * c) for c in x]]

    def step(self, values: Sequence[float], n: int, tol: float) -> None:
        k = len(self.use) + 1
        values = [float("nan") if v is None else float(v) for v in values]
        self.n, self.loglik, self.pearson = n, values[0], values[1]
        square, right = _matrix(values[2 : 2 + k * (k + 1) // 2], k), np.array(values[-k:])
        scale = np.sqrt(np.abs(np.diag(square)))
        if n < k or not np.all(np.isfinite(square)) or np.any(scale == 0) or np.linalg.cond(square / np.outer(scale, scale)) > 1e12:
            self.failed = True
            return
        self.inverse = np.linalg.inv(square)
        beta = self.inverse @ right
        if self.beta is not None:
            self.converged = bool(np.max(np.abs(beta - self.beta)) <= tol * (1 + np.max(np.abs(beta))))
        self.beta = self.beta if self.converged else beta


def _irls(df: DataFrame, y: str, fits: dict[str, Fit], xs: Sequence[str], family: str, link: str, weight: str | None, tol: float, most: int = 50) -> None:
    """Iteratively reweighted least squares of all candidates at once: one scan of a stored narrow table per step.

    A step reads one row of sums; the solves are as small as the candidates.
    """
    cols = [y, *xs]
    rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)], (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    rows = cut_lineage(rows.dropna())
    for _ in range(most):
        live = {k: f for k, f in fits.items() if not f.converged and not f.failed}
        if not live:
            return
        parts, sums = rows, []
        for i, fit in enumerate(live.values()):
            row, found = fit.sums(family, link, f"s{i}")
            parts = parts.withColumn(f"s{i}", row)
            sums.append(found)
        values = parts.agg(F.count(F.lit(1)), *[c for found in sums for c in found]).first()
        at = 1
        for fit, found in zip(live.values(), sums):
            fit.step(values[at : at + len(found)], values[0], tol)
            at += len(found)


def glm(
    df: DataFrame, y: str, xs: Sequence[str], family: str, link: str, weight: str | None = None, tol: float = 1e-10
) -> DataFrame:
    """Fixed-effects GLM over complete rows: one row per term with estimate, se, n and whether the fit converged.

    Families: gaussian, poisson, binomial; links: identity, log, logit. A singular design gives NULL estimates.
    """
    fit = Fit(range(1, len(xs) + 1))
    _irls(df, y, {"": fit}, xs, family, link, weight, tol)
    terms, k = ["(intercept)", *xs], len(xs) + 1
    if fit.failed or fit.beta is None:
        rows = [(t, None, None, fit.n, False) for t in terms]
    else:
        dispersion = fit.pearson / (fit.n - k) if family == "gaussian" and fit.n > k else 1.0
        se = np.sqrt(np.diag(fit.inverse) * dispersion)
        rows = [(t, float(b), float(s), fit.n, fit.converged) for t, b, s in zip(terms, fit.beta, se)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, n long, converged boolean")


def model_grid(df: DataFrame, y: str, formulas: dict[str, Sequence[str]], family: str = "gaussian", link: str = "log"):
    """Compare candidate formulas: n, k, logLik, AIC, AICc, BIC, best AIC first; a failed fit is a row of NULLs.

    All candidates are fitted to the rows that are complete in the union of their predictors: for the gaussian family from
    one covariance aggregate, for poisson and binomial in shared steps (with ``converged``).
    """
    schema = "model string, n long, k long, loglik double, aic double, aicc double, bic double"
    if family != "gaussian":
        xs = list(dict.fromkeys(x for xs in formulas.values() for x in xs))
        fits = {name: Fit([xs.index(x) + 1 for x in use]) for name, use in formulas.items()}
        _irls(df, y, fits, xs, family, link, None, 1e-8)
        rows = [
            (name, f.n, *[None] * 5, False) if f.failed else (name, *_criteria(f.loglik, f.n, len(f.use) + 1), f.converged)
            for name, f in fits.items()
        ]
        out = df.sparkSession.createDataFrame(rows, f"{schema}, converged boolean")
        return out.orderBy(F.col("aic").asc_nulls_last(), "model")
    columns = [y, *dict.fromkeys(x for xs in formulas.values() for x in xs)]
    place = {name: [columns.index(x) for x in xs] for name, xs in formulas.items()}

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                for name, use in place.items():
                    got = _solve(row.n, row.means, row.covs, use)
                    if got is None or got[2] <= 0:
                        rows.append((name, row.n, None, None, None, None, None))
                        continue
                    k, n = len(use) + 2, row.n
                    rows.append((name, *_criteria(-n / 2 * (np.log(2 * np.pi * got[2] / n) + 1), n, k)))
            yield pd.DataFrame(rows, columns=["model", "n", "k", "loglik", "aic", "aicc", "bic"]).astype({"k": "Int64"})

    return moments(df, None, columns).mapInPandas(fit, schema).orderBy(F.col("aic").asc_nulls_last(), "model")


def _criteria(loglik: float, n: int, k: int):
    aic = 2 * k - 2 * loglik
    aicc = aic + 2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else None
    return n, k, float(loglik), float(aic), aicc, float(k * np.log(n) - 2 * loglik)


def fit_exp_decay(df: DataFrame, by, t: str, y: str, iters: int = 30, tol: float = 1e-9) -> DataFrame:
    """``y = y0 exp(-lambda t)`` per group by Gauss-Newton from a log-linear start.

    Every group has a row; ``converged`` tells whether its last step was at most ``tol``. A group without a start (no
    positive value, or one time only) or without a next step keeps what it has.

    Least squares needs only n, sum y and sum y^2 per distinct ``t``: the data are read once, and the steps (one
    aggregation for all groups each) run on that table.
    """
    by = as_list(by)
    cells = df.filter(F.col(t).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(t).cast("double").alias("t"))
    cells = cut_lineage(
        cells.agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.sum(y).alias("sy"),
            F.sum(F.when(F.col(y) > 0, F.log(y))).alias("sl"),
            F.count(F.when(F.col(y) > 0, 1)).cast("double").alias("m"),
        )
    )
    m, tt = F.col("m"), F.col("t")
    det = F.sum(m) * F.sum(m * tt * tt) - F.sum(m * tt) * F.sum(m * tt)
    slope = F.try_divide(F.sum(m) * F.sum(tt * F.col("sl")) - F.sum(m * tt) * F.sum("sl"), det)
    start = cells.groupBy(*by).agg(
        slope.alias("b"), F.sum("sl").alias("l"), F.sum(m).alias("c"), F.sum(m * tt).alias("ct"), F.sum("n").alias("rows")
    )
    params = start.select(
        *by,
        F.exp(F.try_divide(F.col("l") - F.col("b") * F.col("ct"), F.col("c"))).alias("y0"),
        (-F.col("b")).alias("lambda"),
        F.lit(float("inf")).alias("step"),
    )
    e = F.exp(-F.col("lambda") * tt)
    g = -F.col("y0") * tt * e
    rest = F.col("sy") - F.col("n") * F.col("y0") * e
    for _ in range(iters):
        sums = _join(cells, params, by).groupBy(*by, "y0", "lambda").agg(
            F.sum(F.col("n") * e * e).alias("a"),
            F.sum(F.col("n") * e * g).alias("b"),
            F.sum(F.col("n") * g * g).alias("d"),
            F.sum(e * rest).alias("u"),
            F.sum(g * rest).alias("v"),
        )
        det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
        dy = F.try_divide(F.col("d") * F.col("u") - F.col("b") * F.col("v"), det)
        dl = F.try_divide(F.col("a") * F.col("v") - F.col("b") * F.col("u"), det)
        known = (dy + dl).isNotNull() & ~F.isnan(dy + dl)
        moved = sums.select(
            *by,
            F.when(known, F.col("y0") + dy).otherwise(F.col("y0")).alias("y0"),
            F.when(known, F.col("lambda") + dl).otherwise(F.col("lambda")).alias("lambda"),
            F.when(known, F.greatest(F.abs(F.try_divide(dy, "y0")), F.abs(dl))).alias("step"),
        )
        params = cut_lineage(moved)
        if params.filter(F.col("step") > tol).isEmpty():
            break
    return params.withColumn("converged", F.coalesce(F.col("step") <= tol, F.lit(False))).drop("step")


def _join(df: DataFrame, params: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return df.join(params, by)
    one = params.select(F.struct("y0", "lambda")).scalar()
    return df.withColumn("__p", one).select("*", "__p.*").drop("__p")


def adf(df: DataFrame, by, order, c: str, k: int, chunk=None) -> DataFrame:
    """Augmented Dickey-Fuller t statistic per series (constant and trend, ``k`` lagged differences)."""
    by, order = as_list(by), as_list(order)
    known = df.filter(F.col(c).isNotNull()).select(*by, *order, F.col(c).cast("double").alias("__y"))

    def exprs(w):
        y = [F.col("__y")] + [F.lag("__y", i).over(w) for i in range(1, k + 2)]
        return {"__y1": y[1], "__d1": y[0] - y[1], **{f"__d1_{i}": y[i] - y[i + 1] for i in range(1, k + 1)}}

    cut, at = chunked(known, by, order, chunk)
    made = row_index(neighbourhood(cut, by, order, exprs, before=k + 1, chunk=at), by, order, "__t", at)
    made = made.withColumn("__t", F.col("__t").cast("double"))
    fit = ols(made, by, "__d1", ["__y1", "__t", *[f"__d1_{i}" for i in range(1, k + 1)]])
    return fit.filter(F.col("term") == "__y1").select(*by, "n", F.col("estimate").alias("gamma"), F.col("t").alias("adf"))


def ar1_forecast(df: DataFrame, by, order, c: str, h: int, chunk=None) -> DataFrame:
    """Least-squares AR(1) per series and forecasts for steps 1..h from the last value."""
    by, order = as_list(by), as_list(order)
    known = df.filter(F.col(c).isNotNull())
    pairs = lagged(known, by, order, {"__x": (c, 1)}, chunk)
    fit = pairs.groupBy(*by).agg(
        F.regr_slope(c, "__x").alias("phi"),
        F.regr_intercept(c, "__x").alias("const"),
        F.max_by(c, F.struct(*order)).alias("__last"),
    )
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    mean = F.try_divide(F.col("const"), 1 - F.col("phi"))
    drift = F.col("__last") + F.col("const") * F.col("step")
    value = F.coalesce(mean + F.pow(F.col("phi"), F.col("step").cast("double")) * (F.col("__last") - mean), drift)
    return steps.withColumn("forecast", value).select(*by, "phi", "const", "step", "forecast")
