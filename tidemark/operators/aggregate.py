"""Aggregations: group summaries, exact distributed quantiles, histograms, tables of metrics, reshaped series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.special import t_quantile_expr
from tidemark.operators.ordered import as_list, chunk_of, running, value_chunk
from tidemark.session import cut_lineage

_STATS = {
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "sd": F.stddev_samp,
    "var": F.var_samp,
}


def stat(c: str, fn: str, na: str = "skip") -> Column:
    """One statistic; with ``na="poison"`` a missing value makes it NULL."""
    if fn == "n":
        return F.count(F.lit(1))
    value = _STATS[fn](c)
    return value if na == "skip" else F.when(F.count(c) == F.count(F.lit(1)), value)


def summarise(df: DataFrame, by, c: str, fns: Sequence[str] = ("n", *_STATS), na: str = "skip", prefix: str = "") -> DataFrame:
    """Group summary: row number, mean, sum, extremes, sample sd and variance."""
    return df.groupBy(*as_list(by)).agg(*[stat(c, f, na).alias(f"{prefix}{f}") for f in fns])


def pooled_stats(df: DataFrame, by, cols: Sequence[str], fns: Sequence[str] = ("mean", "sd")) -> DataFrame:
    """Statistics over several columns taken as one sample."""
    pooled = df.select(*as_list(by), F.explode(F.array(*cols)).alias("__v"))
    return summarise(pooled, by, "__v", fns)


def mean_of_means(df: DataFrame, outer, inner, c: str, out: str = "mean") -> DataFrame:
    """Mean over the inner groups' means (not the pooled mean)."""
    per = df.groupBy(*as_list(outer), *as_list(inner)).agg(F.avg(c).alias("__m"))
    return per.groupBy(*as_list(outer)).agg(F.avg("__m").alias(out))


def n_distinct(df: DataFrame, by, c: str, out: str = "n_distinct", approx: bool = False) -> DataFrame:
    """Distinct values per group, exact or by sketch."""
    count = F.approx_count_distinct(c) if approx else F.count_distinct(c)
    return df.groupBy(*as_list(by)).agg(count.alias(out))


def n_per_distinct(df: DataFrame, by, c: str, out: str = "n_per_distinct") -> DataFrame:
    """Rows per distinct value of ``c`` in each group."""
    ratio = F.try_divide(F.count(F.lit(1)).cast("double"), F.count_distinct(c))
    return df.groupBy(*as_list(by)).agg(ratio.alias(out))


def summarise_grains(df: DataFrame, cols: Sequence[str], grains: Sequence[Sequence[str]], c: str, fns) -> DataFrame:
    """The same summary at several grains in one pass; ``grain`` is the grouping id (bit set = column rolled up)."""
    sets = [[F.col(x) for x in g] for g in grains]
    grouped = df.groupingSets(sets, *[F.col(x) for x in cols])
    return grouped.agg(F.grouping_id().alias("grain"), *[stat(c, f).alias(f) for f in fns])


def mean_ci(df: DataFrame, by, c: str, p: float = 0.95) -> DataFrame:
    """Mean with the band ``mean -/+ t(p, n-1) * sd / sqrt(n)``."""
    n = F.count(c)
    base = df.groupBy(*as_list(by)).agg(n.alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"))
    se = F.try_divide(F.col("sd"), F.sqrt(F.col("n").cast("double")))
    ci = t_quantile_expr(p, F.col("n") - 1) * F.col("se")
    return base.withColumn("se", se).withColumn("ci", ci).withColumns(
        {"lower": F.col("mean") - F.col("ci"), "upper": F.col("mean") + F.col("ci")}
    )


def nested_summary(df: DataFrame, levels: Sequence[Sequence[str]], c: str, fns=("mean", "sd", "min", "max")) -> DataFrame:
    """Summary of summaries: the mean of each level is summarised by the next."""
    per, value = df, c
    for level in levels[:-1]:
        per, value = per.groupBy(*level).agg(F.avg(value).alias("__m")), "__m"
    return summarise(per, levels[-1], value, fns)


def quantiles(
    df: DataFrame, by, c: str, ps: Sequence[float], kind: int = 7, prefix: str = "q", inverse: dict[str, float] | None = None
) -> DataFrame:
    """Exact quantiles per group, one column per probability (``q25`` for 0.25).

    Type 7 interpolates, type 1 is the inverse of the distribution function; ``inverse`` names further columns of type 1
    that share the ranking. Equal values are counted, ranks come from running counts over value buckets, so no group is
    held by one task.
    """
    by = as_list(by)
    counts = cut_lineage(df.filter(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count(F.lit(1)).alias("__m")))
    ranks = {"__to": ("sum", "__m"), "__n": ("total", "__m")}
    ranked = running(value_chunk(counts, by, c), by, [c], ranks, F.col("__bucket"))
    after = F.col("__to") - F.col("__m")

    def at(rank: Column) -> Column:
        return F.max(F.when((after < rank) & (rank <= F.col("__to")), F.col(c)))

    aggs = []
    wanted = [(f"{prefix}{p * 100:g}".replace(".", "_"), p, kind) for p in ps]
    for name, p, kind_ in wanted + [(name, p, 1) for name, p in (inverse or {}).items()]:
        if kind_ == 7:
            h = (F.col("__n") - 1) * F.lit(float(p))
            low, share = F.floor(h), F.max(h - F.floor(h))
            x, y = at(low + 1), at(F.least(low + 2, F.col("__n")))
            aggs.append((x + share * (y - x)).alias(name))
        else:
            rank = F.greatest(F.ceil(F.col("__n") * F.lit(float(p)) - 1e-9), F.lit(1))
            aggs.append(at(rank).alias(name))
    return ranked.groupBy(*by).agg(*aggs)


def metric_table(df: DataFrame, metrics: dict[str, str], p: float = 0.95) -> DataFrame:
    """One row per metric column: its label, type-7 quantile and mean."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(label).alias("metric"), F.col(c).cast("double").alias("__v")) for label, c in metrics.items()
    ])).alias("m")).select("m.*")
    q = quantiles(long, "metric", "__v", [p], prefix="__q").toDF("metric", "percentile")
    return q.join(long.groupBy("metric").agg(F.avg("__v").alias("mean")), "metric")


def freq_table(df: DataFrame, c, out: str = "n") -> DataFrame:
    return df.groupBy(*as_list(c)).agg(F.count(F.lit(1)).alias(out))


def hist_bins(df: DataFrame, c: str, width: float | None = None, n: int | None = None, lo: float = 0.0, by=None) -> DataFrame:
    """Counts per bin: fixed width from ``lo``, or ``n`` equal bins between the extremes (the top value closes the last)."""
    by = as_list(by)
    if width is not None:
        binned = df.withColumn("bin", F.floor((F.col(c) - F.lit(float(lo))) / F.lit(float(width))))
    else:
        ends = df.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias("e"))
        wide = df.withColumn("__e", ends.scalar())
        step = (F.col("__e.hi") - F.col("__e.lo")) / F.lit(n)
        bin_ = F.floor(F.try_divide(F.col(c) - F.col("__e.lo"), step))
        binned = wide.withColumn("bin", F.least(F.coalesce(bin_, F.lit(0)), F.lit(n - 1)))
    return binned.filter(F.col(c).isNotNull()).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, by, c: str, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (extreme values within ``k`` times the quartile range) and number of outliers."""
    by = as_list(by)
    q = quantiles(df, by, c, [0.25, 0.5, 0.75])
    joined = df.join(q, by) if by else df.withColumn("__q", q.select(F.struct("q25", "q50", "q75")).scalar()).select(
        *df.columns, "__q.*"
    )
    reach = (F.col("q75") - F.col("q25")) * k
    inside = F.col(c).between(F.col("q25") - reach, F.col("q75") + reach)
    return joined.groupBy(*by, "q25", "q50", "q75").agg(
        F.min(F.when(inside, F.col(c))).alias("low"),
        F.max(F.when(inside, F.col(c))).alias("high"),
        F.count(F.when(~inside, 1)).alias("outliers"),
    )


def first_by(df: DataFrame, by, order, cols: Sequence[str]) -> DataFrame:
    """Values of the first row of each group (``order`` must be unique in the group)."""
    first = F.min_by(F.struct(*cols), F.struct(*as_list(order)))
    return df.groupBy(*as_list(by)).agg(first.alias("__f")).select(*as_list(by), "__f.*")


def tracking_error(df: DataFrame, setpoint: str, obs: str, by=None) -> DataFrame:
    """Set point minus observed: number, mean, sd, extremes, range."""
    e = df.withColumn("__e", F.col(setpoint) - F.col(obs))
    return summarise(e, by, "__e", ("n", "mean", "sd", "min", "max")).withColumn("range", F.col("max") - F.col("min"))


def dispersion(df: DataFrame, by, c: str) -> DataFrame:
    """Variance-to-mean ratio and whether it exceeds 1."""
    base = df.groupBy(*as_list(by)).agg(F.avg(c).alias("mean"), F.var_samp(c).alias("var"))
    return base.withColumn("ratio", F.try_divide(F.col("var"), F.col("mean"))).withColumn(
        "overdispersed", F.col("ratio") > 1
    )


def collect_series(df: DataFrame, by, order, c: str, chunk=None, out: str = "series") -> DataFrame:
    """Ordered array of values per series and chunk (a day or month by default): one row each, however many values.

    The rows depend on ``chunk`` alone; a shorter one bounds the arrays of a dense series.
    """
    by, order = as_list(by), as_list(order)
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(c).alias("__c"))))
    grouped = df.groupBy(*by, chunk_of(df, order, chunk).alias("chunk"))
    return grouped.agg(F.transform(pairs, lambda s: s["__c"]).alias(out))


def coverage(df: DataFrame, by) -> DataFrame:
    """Rows per combination of the given columns."""
    return freq_table(df, by)


def cov_to_cor(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation matrix in long form (i, j, r), all pairs from one aggregation, each over the rows that have both."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    cells = []
    for a, b in pairs:
        r = F.corr(a, b)
        for i, j in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), r.alias("r")))
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("m")).select("m.*")


def treatment_mean(df: DataFrame, at, sets: Sequence[str], treatment: str, c: str) -> DataFrame:
    """Mean per treatment at each tick, with the tick's set points kept."""
    return df.groupBy(*as_list(at), *sets, treatment).agg(F.avg(c).alias("avg_temp"))


