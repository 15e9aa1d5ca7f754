"""Aggregations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.a_sources import KINDS, hourly_wide
from queries.registry import PANEL, TELEMETRY, TELEMETRY_GAPS, panel, query, rounded, table, telemetry, telemetry_gaps
from tidemark.operators import aggregate as agg, shape


def _summary_sql(poison: bool) -> str:
    def f(e: str) -> str:
        return f"CASE WHEN count(temperature) = count(*) THEN {e} END" if poison else e

    return f"""SELECT tank, CAST(timestamp AS DATE) AS date, count(*) AS n, round({f("avg(temperature)")}, 6) AS mean,
      round({f("sum(temperature)")}, 3) AS sum, {f("min(temperature)")} AS min, {f("max(temperature)")} AS max,
      round({f("stddev_samp(temperature)")}, 6) AS sd, round({f("var_samp(temperature)")}, 6) AS var
      FROM {TELEMETRY_GAPS} GROUP BY ALL"""


def _summary(spark, sf, na):
    t = telemetry_gaps(spark, sf).withColumn("date", F.to_date("timestamp"))
    out = agg.summarise(t, ["tank", "date"], "temperature", na=na)
    return rounded(rounded(out, 6, "mean", "sd", "var"), 3, "sum")


@query("d01_summarise", _summary_sql(False))
def _d01(spark, sf):
    return _summary(spark, sf, "skip")


@query("d01_summarise_poison", _summary_sql(True))
def _d01b(spark, sf):
    return _summary(spark, sf, "poison")


@query(
    "d02_pooled_stats",
    """WITH p AS (SELECT l_returnflag, l_linestatus, unnest([l_quantity, l_discount * 100, l_tax * 100]) AS v FROM lineitem)
    SELECT l_returnflag, l_linestatus, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS sd FROM p GROUP BY ALL""",
)
def _d02(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"a": F.col("l_discount") * 100, "b": F.col("l_tax") * 100})
    return rounded(agg.pooled_stats(li, ["l_returnflag", "l_linestatus"], ["l_quantity", "a", "b"]), 5, "mean", "sd")


@query(
    "d03_mean_of_means",
    f"""SELECT tank, round(avg(m), 6) AS mean FROM (SELECT tank, genet, avg(temperature) AS m FROM {TELEMETRY} GROUP BY ALL)
      GROUP BY tank""",
)
def _d03(spark, sf):
    return rounded(agg.mean_of_means(telemetry(spark, sf), "tank", "genet", "temperature"), 6, "mean")


@query(
    "d04_distinct_counts",
    """SELECT user_id, count(DISTINCT event_type) AS n_distinct, round(count(*) / count(DISTINCT event_type), 6)
      AS n_per_distinct FROM events GROUP BY user_id""",
)
def _d04(spark, sf):
    ev = table(spark, sf, "events")
    both = agg.n_distinct(ev, "user_id", "event_type").join(agg.n_per_distinct(ev, "user_id", "event_type"), "user_id")
    return rounded(both, 6, "n_per_distinct")


@query(
    "d05_summarise_grains",
    f"""SELECT tank, genet, CAST(grouping(tank, genet) AS BIGINT) AS grain, count(*) AS n, round(avg(temperature), 6) AS mean,
      round(stddev_samp(temperature), 6) AS sd FROM {TELEMETRY} GROUP BY GROUPING SETS ((tank, genet), (tank), (genet))""",
)
def _d05(spark, sf):
    grains = [["tank", "genet"], ["tank"], ["genet"]]
    out = agg.summarise_grains(telemetry(spark, sf), ["tank", "genet"], grains, "temperature", ("n", "mean", "sd"))
    return rounded(out.withColumn("grain", F.col("grain").cast("long")), 6, "mean", "sd")


def t_cdf_sql() -> str:
    """P(|T| < t) for whole degrees of freedom, by the finite sums over cos(theta) with tan(theta) = t / sqrt(df)."""
    cos, sin = "cos(atan(t / sqrt(df)))", "sin(atan(t / sqrt(df)))"
    even = f"exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow({cos}, 2 * j)"
    odd = f"sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow({cos}, 2 * j + 1)"
    return f"""CASE WHEN df % 2 = 0 THEN {sin} * list_sum([{even} for j in range(0, df // 2)])
      ELSE 2 / pi() * (atan(t / sqrt(df)) + {sin} * coalesce(list_sum([{odd} for j in range(0, (df - 1) // 2)]), 0)) END"""


def t_steps(p: float, rounds: int = 12) -> str:
    """CTEs t0.. from ``a`` (n): the ``p`` quantile of Student's t per df = n - 1, by Newton's method from below."""
    density = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + t * t / df, -(df + 1) / 2)"
    steps = ["t0 AS (SELECT DISTINCT n - 1 AS df, CAST(1 AS DOUBLE) AS t FROM a WHERE n > 1)"]
    for i in range(rounds):
        step = f"t - ({t_cdf_sql()} - {2 * p - 1!r}) / (2 * {density})"
        steps.append(f"t{i + 1} AS MATERIALIZED (SELECT df, {step} AS t FROM t{i})")
    return ", ".join(steps)


@query(
    "d06_mean_ci",
    f"""WITH a AS (SELECT user_id, count(*) AS n, avg(value) AS mean,
      stddev_samp(value) AS sd FROM events GROUP BY 1), {t_steps(0.95)}
    SELECT user_id, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS se,
      round(t * sd / sqrt(n), 5) AS ci, round(mean - t * sd / sqrt(n), 5) AS lower,
      round(mean + t * sd / sqrt(n), 5) AS upper FROM a LEFT JOIN t12 ON df = n - 1""",
)
def _d06(spark, sf):
    out = agg.mean_ci(table(spark, sf, "events"), "user_id", "value")
    return rounded(rounded(out, 6, "mean", "sd", "se"), 5, "ci", "lower", "upper")


@query(
    "d07_nested_summary",
    f"""WITH a AS (SELECT tank, genet, CAST(timestamp AS DATE) AS d, avg(temperature) AS m FROM {TELEMETRY} GROUP BY ALL),
      b AS (SELECT tank, genet, avg(m) AS m FROM a GROUP BY ALL)
    SELECT genet, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(min(m), 6) AS min, round(max(m), 6) AS max
      FROM b GROUP BY genet""",
)
def _d07(spark, sf):
    t = telemetry(spark, sf).withColumn("date", F.to_date("timestamp"))
    out = agg.nested_summary(t, [["tank", "genet", "date"], ["tank", "genet"], ["genet"]], "temperature")
    return rounded(out, 6, "mean", "sd", "min", "max")


@query(
    "d08_quantiles",
    f"""SELECT tank, round(quantile_cont(temperature, 0.05), 5) AS q5, round(quantile_cont(temperature, 0.5), 5) AS q50,
      round(quantile_cont(temperature, 0.95), 5) AS q95, quantile_disc(temperature, 0.25) AS d25,
      quantile_disc(temperature, 0.9) AS d90 FROM {TELEMETRY_GAPS} GROUP BY tank""",
)
def _d08(spark, sf):
    t = telemetry_gaps(spark, sf)
    both = agg.quantiles(t, "tank", "temperature", [0.05, 0.5, 0.95], inverse={"d25": 0.25, "d90": 0.9})
    return rounded(both, 5, "q5", "q50", "q95")


@query(
    "d08_quantiles_global",
    """SELECT round(quantile_cont(sqrt(l_extendedprice), 0.9), 4) AS q90, round(quantile_cont(sqrt(l_extendedprice), 0.5), 4)
      AS q50 FROM lineitem""",
)
def _d08b(spark, sf):
    li = table(spark, sf, "lineitem").select(F.sqrt("l_extendedprice").alias("x"))
    return rounded(agg.quantiles(li, None, "x", [0.9, 0.5]), 4, "q90", "q50")


@query(
    "d09_metric_table",
    """SELECT 'quantity' AS metric, round(quantile_cont(l_quantity, 0.95), 5) AS percentile, round(avg(l_quantity), 5) AS mean
      FROM lineitem UNION ALL SELECT 'tax', round(quantile_cont(l_tax, 0.95), 5), round(avg(l_tax), 5) FROM lineitem
      UNION ALL SELECT 'price', round(quantile_cont(sqrt(l_extendedprice), 0.95), 5), round(avg(sqrt(l_extendedprice)), 5)
      FROM lineitem""",
)
def _d09(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("root_price", F.sqrt("l_extendedprice"))
    metrics = {"quantity": "l_quantity", "tax": "l_tax", "price": "root_price"}
    return rounded(agg.metric_table(li, metrics), 5, "percentile", "mean")


@query("d10_freq_table", "SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1")
def _d10(spark, sf):
    return agg.freq_table(table(spark, sf, "lineitem"), "l_linenumber")


@query(
    "d11_hist_width",
    "SELECT p_size, CAST(floor((p_retailprice - 900) / 25) AS BIGINT) AS bin, count(*) AS n FROM part GROUP BY ALL",
)
def _d11(spark, sf):
    return agg.hist_bins(table(spark, sf, "part"), "p_retailprice", width=25, lo=900, by="p_size")


@query(
    "d11_hist_bins",
    """SELECT least(CAST(floor((value - lo) / ((hi - lo) / 30)) AS BIGINT), 29) AS bin, count(*) AS n
      FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1""",
)
def _d11b(spark, sf):
    return agg.hist_bins(table(spark, sf, "events"), "value", n=30)


@query(
    "d12_box_stats",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
      quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
      j AS (SELECT *, value BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS ok FROM events JOIN q USING (event_type))
    SELECT event_type, round(q1, 5) AS q25, round(q2, 5) AS q50, round(q3, 5) AS q75, min(value) FILTER (ok) AS low,
      max(value) FILTER (ok) AS high, count(*) FILTER (NOT ok) AS outliers FROM j GROUP BY event_type, q1, q2, q3""",
)
def _d12(spark, sf):
    return rounded(agg.box_stats(table(spark, sf, "events"), "event_type", "value"), 5, "q25", "q50", "q75")


WIDE = f"""(SELECT date_trunc('hour', timestamp) AS timestamp, {", ".join(f"avg(temperature) FILTER (genet = '{k}') AS {k}" for k in KINDS)}
  FROM {TELEMETRY} GROUP BY 1)"""


@query(
    "d13_to_long",
    " UNION ALL ".join(f"SELECT timestamp, '{k}' AS sensor, round({k}, 6) AS temperature FROM {WIDE}" for k in KINDS),
)
def _d13(spark, sf):
    return rounded(shape.to_long(hourly_wide(spark, sf), "timestamp", KINDS), 6, "temperature")


@query("d14_to_wide", f"SELECT timestamp, {', '.join(f'round({k}, 6) AS {k}' for k in KINDS)} FROM {WIDE}")
def _d14(spark, sf):
    return rounded(hourly_wide(spark, sf), 6, *KINDS)


@query(
    "d15_first_by",
    f"SELECT unit, date, size, phase FROM {PANEL} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY date, obs) = 1",
)
def _d15(spark, sf):
    return agg.first_by(panel(spark, sf), "unit", ["date", "obs"], ["date", "size", "phase"])


@query(
    "d16_tracking_error",
    f"""WITH e AS (SELECT tank, 50 - temperature AS e FROM {TELEMETRY})
    SELECT tank, count(*) AS n, round(avg(e), 6) + 0.0 AS mean, round(stddev_samp(e), 6) AS sd, round(min(e), 6) AS min,
      round(max(e), 6) AS max, round(max(e) - min(e), 6) AS range FROM e GROUP BY tank""",
)
def _d16(spark, sf):
    t = telemetry(spark, sf).withColumn("temp_set", F.lit(50.0))
    out = agg.tracking_error(t, "temp_set", "temperature", "tank")
    return rounded(out, 6, "mean", "sd", "min", "max", "range")


@query(
    "d17_dispersion",
    """WITH c AS (SELECT l_orderkey % 10 AS g, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL),
      d AS (SELECT g, avg(n) AS mean, var_samp(n) AS var FROM c GROUP BY g)
    SELECT g, round(mean, 6) AS mean, round(var, 6) AS var, round(var / mean, 6) AS ratio, var / mean > 1 AS overdispersed
      FROM d""",
)
def _d17(spark, sf):
    li = table(spark, sf, "lineitem")
    counts = li.groupBy((F.col("l_orderkey") % 10).alias("g"), "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return rounded(agg.dispersion(counts, "g", "n"), 6, "mean", "var", "ratio")


@query(
    "d18_collect_series",
    f"""SELECT tank, CAST(timestamp AS DATE) AS day, array_to_string(list(event_id ORDER BY timestamp, event_id), ',') AS series
      FROM {TELEMETRY} GROUP BY ALL""",
)
def _d18(spark, sf):
    out = agg.collect_series(telemetry(spark, sf), "tank", ["timestamp", "event_id"], "event_id")
    text = F.array_join(F.transform("series", lambda x: x.cast("string")), ",")
    return out.select("tank", F.col("chunk").cast("date").alias("day"), text.alias("series"))


@query(
    "d19_coverage",
    f"SELECT tank, CAST(timestamp AS DATE) AS date, genet, count(*) AS n FROM {TELEMETRY} GROUP BY ALL",
)
def _d19(spark, sf):
    return agg.coverage(telemetry(spark, sf).withColumn("date", F.to_date("timestamp")), ["tank", "date", "genet"])


COR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "d20_cov_to_cor",
    " UNION ALL ".join(
        f"SELECT '{a}' AS i, '{b}' AS j, round(corr({a}, {b}), 6) + 0.0 AS r FROM (SELECT l_quantity, l_extendedprice,"
        " CASE WHEN l_orderkey % 7 <> 0 THEN l_discount END AS l_discount,"
        " CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END AS l_tax FROM lineitem)"
        for a in COR
        for b in COR
    ),
)
def _d20(spark, sf):
    li = table(spark, sf, "lineitem").withColumns(
        {
            "l_discount": F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")),
            "l_tax": F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax")),
        }
    )
    return rounded(agg.cov_to_cor(li, COR), 6, "r")


@query(
    "d21_treatment_mean",
    f"""SELECT date_trunc('hour', timestamp) AS timestamp, day(timestamp) % 3 AS chill_set, day(timestamp) % 4 AS severe_set,
      CASE WHEN tank < 6 THEN 'cold' WHEN tank > 10 THEN 'extreme' ELSE 'severe' END AS treatment,
      round(avg(temperature), 6) AS avg_temp FROM {TELEMETRY} GROUP BY ALL""",
)
def _d21(spark, sf):
    treatment = F.when(F.col("tank") < 6, "cold").when(F.col("tank") > 10, "extreme").otherwise("severe")
    t = telemetry(spark, sf).select(
        F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp"),
        (F.dayofmonth("timestamp") % 3).alias("chill_set"),
        (F.dayofmonth("timestamp") % 4).alias("severe_set"),
        treatment.alias("treatment"),
        "temperature",
    )
    out = agg.treatment_mean(t, "timestamp", ["chill_set", "severe_set"], "treatment", "temperature")
    return rounded(out, 6, "avg_temp")
