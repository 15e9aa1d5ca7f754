"""Statistics as distributed jobs and the user functions of 2.K."""

from __future__ import annotations


from pyspark.sql import functions as F

from queries.registry import TELEMETRY, query, rounded, table, telemetry
from tidemark.operators import distance as dist, group_tests as gt, regression as reg, series_stats as ss

ORDER = ["timestamp", "event_id"]
WIN = "(PARTITION BY tank ORDER BY timestamp, event_id)"
LI = "(SELECT l_returnflag AS g, l_quantity AS q, l_discount AS d, l_tax AS x, sqrt(l_extendedprice) AS y FROM lineitem)"


def items(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("g"),
        F.col("l_quantity").alias("q"),
        F.col("l_discount").alias("d"),
        F.col("l_tax").alias("x"),
        F.sqrt("l_extendedprice").alias("y"),
    )


@query(
    "i01_ols_line",
    f"""SELECT g, round(regr_slope(y, q), 6) AS slope, round(regr_intercept(y, q), 5) AS intercept, round(regr_r2(y, q), 6) AS r2,
      printf('y = %.3f + %.3f x', regr_intercept(y, q), regr_slope(y, q)) AS equation FROM {LI} GROUP BY g""",
)
def _i01(spark, sf):
    return rounded(rounded(reg.ols_line(items(spark, sf), "g", "y", "q"), 6, "slope", "r2"), 5, "intercept")


OLS2 = f"""m AS (SELECT g, count(*) AS n, avg(y) AS my, avg(q) AS mq, avg(d) AS md, var_pop(y) AS vy, var_pop(q) AS vq,
    var_pop(d) AS vd, covar_pop(y, q) AS yq, covar_pop(y, d) AS yd, covar_pop(q, d) AS qd FROM {LI} GROUP BY g),
  b AS (SELECT *, vq * vd - qd * qd AS det, (yq * vd - yd * qd) / (vq * vd - qd * qd) AS bq,
    (yd * vq - yq * qd) / (vq * vd - qd * qd) AS bd FROM m),
  s AS (SELECT *, n * (vy - bq * yq - bd * yd) AS rss, my - bq * mq - bd * md AS b0 FROM b),
  t AS (SELECT *, rss / (n - 3) AS s2 FROM s)"""


@query(
    "i02_ols",
    f"""WITH {OLS2}, r AS (
      SELECT g, '(intercept)' AS term, b0 AS estimate,
        sqrt(s2 * (1 + (mq * mq * vd - 2 * mq * md * qd + md * md * vq) / det) / n) AS se, n, rss, 1 - rss / (n * vy) AS r2 FROM t
      UNION ALL SELECT g, 'q', bq, sqrt(s2 * vd / det / n), n, rss, 1 - rss / (n * vy) FROM t
      UNION ALL SELECT g, 'd', bd, sqrt(s2 * vq / det / n), n, rss, 1 - rss / (n * vy) FROM t)
    SELECT g, term, round(estimate, 5) + 0.0 AS estimate, round(se, 6) AS se, round(estimate / se, 4) + 0.0 AS t, n,
      round(rss, 2) AS rss, round(r2, 7) AS r2 FROM r""",
)
def _i02(spark, sf):
    out = reg.ols(items(spark, sf), "g", "y", ["q", "d"])
    out = out.withColumns({"estimate": F.round("estimate", 5), "se": F.round("se", 6), "t": F.round("t", 4)})
    return out.withColumns({"rss": F.round("rss", 2), "r2": F.round("r2", 7)})


# With two predictors dropped, the upper tail of F is (1 + 2 F / df2) ^ (-df2 / 2).
@query(
    "i02_compare_nested",
    f"""WITH {OLS2}, f AS (SELECT *, (n * vy - rss) / 2 / (rss / (n - 3)) AS f FROM t)
    SELECT g, n, CAST(2 AS BIGINT) AS df1, n - 3 AS df2, round(n * vy, 2) AS rss_reduced, round(rss, 2) AS rss_full, round(f, 4) AS f,
      round(pow(1 + 2 * f / (n - 3), -(n - 3) / 2.0), 7) AS p FROM f""",
)
def _i02b(spark, sf):
    out = reg.compare_nested(items(spark, sf), "g", "y", [], ["q", "d"])
    return rounded(rounded(rounded(out, 2, "rss_reduced", "rss_full"), 4, "f"), 7, "p")


@query(
    "i02_variance_inflation",
    f"""WITH c AS (SELECT g, count(*) AS n, corr(q, d) AS a, corr(q, y) AS b, corr(d, y) AS c FROM {LI} GROUP BY g),
      e AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c)
    SELECT g, 'q' AS term, n, round((1 - c * c) / det, 6) AS vif FROM e UNION ALL SELECT g, 'd', n, round((1 - b * b) / det, 6) FROM e
    UNION ALL SELECT g, 'y', n, round((1 - a * a) / det, 6) FROM e""",
)
def _i02c(spark, sf):
    return rounded(reg.variance_inflation(items(spark, sf), "g", ["q", "d", "y"]), 6, "vif")


# The t quantile of the band, expanded around the normal one as its groups are large.
Z = 1.959963984540054
T_SQL = f"({Z} + ({Z**3 + Z}) / 4 / (n - 2) + ({5 * Z**5 + 16 * Z**3 + 3 * Z}) / 96 / (n - 2) ** 2)"


@query(
    "i01_fitted_band",
    f"""WITH m AS (SELECT g, count(*) AS n, avg(q) AS mx, avg(y) AS my, regr_sxx(y, q) AS sxx, regr_syy(y, q) AS syy, regr_slope(y, q) AS b
        FROM {LI} GROUP BY g),
      r AS (SELECT g, q, y, n, my + b * (q - mx) AS fitted,
        sqrt((syy - b * b * sxx) / (n - 2) * (1.0 / n + (q - mx) ** 2 / sxx)) AS se FROM {LI} JOIN m USING (g))
    SELECT g, q, y, round(fitted, 6) AS fitted, round(se, 6) AS fit_se, round(fitted - {T_SQL} * se, 5) AS lower,
      round(fitted + {T_SQL} * se, 5) AS upper FROM r""",
)
def _i01b(spark, sf):
    out = reg.fitted_band(items(spark, sf).drop("d", "x"), "g", "y", "q")
    return rounded(rounded(out, 6, "fitted", "fit_se"), 5, "lower", "upper")


@query("i03_path_model")
def _i03(spark, sf):
    t = telemetry(spark, sf).withColumn("load", F.col("event_id") % 17).withColumn("hour", F.hour("timestamp"))
    equations = {"temperature": ["temperature_lag1", "load"], "load": ["temperature", "hour"]}
    return reg.path_model(t, ("tank", ORDER), equations, "tank")


@query(
    "i04_design",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_returnflag = 'N' AS DOUBLE) AS "l_returnflag_N",
      CAST(l_returnflag = 'R' AS DOUBLE) AS "l_returnflag_R", CAST(l_linestatus = 'O' AS DOUBLE) AS "l_linestatus_O",
      CAST(l_returnflag = 'N' AND l_linestatus = 'O' AS DOUBLE) AS n_o,
      CAST(l_returnflag = 'R' AND l_linestatus = 'O' AS DOUBLE) AS r_o FROM lineitem""",
)
def _i04(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    levels = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}
    out, _ = reg.design(li, levels, [("l_returnflag", "l_linestatus")])
    out = out.withColumnRenamed("l_returnflag_N:l_linestatus_O", "n_o").withColumnRenamed(
        "l_returnflag_R:l_linestatus_O", "r_o"
    )
    return out.drop("l_returnflag", "l_linestatus")


@query(
    "i05_glm_poisson",
    """WITH m AS (SELECT ln(avg(l_linenumber) FILTER (l_returnflag = 'A')) AS a, ln(avg(l_linenumber) FILTER (l_returnflag = 'N')) AS n,
      ln(avg(l_linenumber) FILTER (l_returnflag = 'R')) AS r, sum(l_linenumber) FILTER (l_returnflag = 'A') AS sa,
      sum(l_linenumber) FILTER (l_returnflag = 'N') AS sn, sum(l_linenumber) FILTER (l_returnflag = 'R') AS sr FROM lineitem)
    SELECT '(intercept)' AS term, round(a, 5) AS estimate, round(sqrt(1 / sa), 6) AS se FROM m
    UNION ALL SELECT 'l_returnflag_N', round(n - a, 5) + 0.0, round(sqrt(1 / sa + 1 / sn), 6) FROM m
    UNION ALL SELECT 'l_returnflag_R', round(r - a, 5) + 0.0, round(sqrt(1 / sa + 1 / sr), 6) FROM m""",
)
def _i05(spark, sf):
    made, xs = reg.design(table(spark, sf, "lineitem"), {"l_returnflag": ["A", "N", "R"]})
    out = reg.glm(made, "l_linenumber", xs, "poisson", "log").select("term", "estimate", "se")
    return rounded(rounded(out, 5, "estimate"), 6, "se")


@query(
    "i05_glm_binomial",
    """WITH m AS (SELECT event_type = 'click' AS k, count(*) AS n, count(*) FILTER (value > 50) AS s FROM events GROUP BY 1),
      p AS (SELECT max(ln(s / (n - s))) FILTER (NOT k) AS a, max(ln(s / (n - s))) FILTER (k) AS b,
        max(1 / s + 1 / (n - s)) FILTER (NOT k) AS va, max(1 / s + 1 / (n - s)) FILTER (k) AS vb FROM m)
    SELECT '(intercept)' AS term, round(a, 5) AS estimate, round(sqrt(va), 6) AS se FROM p
    UNION ALL SELECT 'click', round(b - a, 5) + 0.0, round(sqrt(va + vb), 6) FROM p""",
)
def _i05b(spark, sf):
    ev = table(spark, sf, "events").groupBy("user_id", (F.col("event_type") == "click").cast("double").alias("click"))
    cells = ev.agg(F.avg((F.col("value") > 50).cast("double")).alias("share"), F.count(F.lit(1)).alias("trials"))
    out = reg.glm(cells, "share", ["click"], "binomial", "logit", weight="trials").select("term", "estimate", "se")
    return rounded(rounded(out, 5, "estimate"), 6, "se")


@query(
    "i06_model_grid",
    f"""WITH {OLS2.replace("GROUP BY g", "").replace("SELECT g,", "SELECT")},
      f AS (SELECT 'null' AS model, n, 2 AS k, n * vy AS rss FROM t UNION ALL SELECT 'q', n, 3, n * (vy - yq * yq / vq) FROM t
        UNION ALL SELECT 'd', n, 3, n * (vy - yd * yd / vd) FROM t UNION ALL SELECT 'q+d', n, 4, rss FROM t),
      l AS (SELECT *, -n / 2.0 * (ln(2 * pi() * rss / n) + 1) AS ll FROM f)
    SELECT model, n, k, round(ll, 3) AS loglik, round(2 * k - 2 * ll, 3) AS aic,
      round(2 * k - 2 * ll + 2.0 * k * (k + 1) / (n - k - 1), 3) AS aicc, round(k * ln(n) - 2 * ll, 3) AS bic FROM l
    UNION ALL SELECT 'twice', n, NULL, NULL, NULL, NULL, NULL FROM t""",
)
def _i06(spark, sf):
    li = items(spark, sf).withColumn("q2", F.col("q") * 2)
    grid = {"null": [], "q": ["q"], "d": ["d"], "q+d": ["q", "d"], "twice": ["q", "q2"]}
    return rounded(reg.model_grid(li, "y", grid), 3, "loglik", "aic", "aicc", "bic")


def _grid_sql(y, table_sql, loglik):
    """Criteria of the models over two factors whose fitted means are plain means."""
    parts = {"null": ("1", 1), "n": ("l_returnflag = 'N'", 2), "n+r": ("l_returnflag", 3)}
    fits = " UNION ALL ".join(
        f"SELECT '{name}' AS model, {k} AS k, {y} AS y, avg({y}) OVER (PARTITION BY {by}) AS mu FROM {table_sql}"
        for name, (by, k) in parts.items()
    )
    return f"""WITH f AS ({fits}), l AS (SELECT model, count(*) AS n, k, sum({loglik}) AS ll FROM f GROUP BY model, k)
    SELECT model, n, k, round(ll, 3) AS loglik, round(2 * k - 2 * ll, 3) AS aic,
      round(2 * k - 2 * ll + 2.0 * k * (k + 1) / (n - k - 1), 3) AS aicc, round(k * ln(n) - 2 * ll, 3) AS bic, true AS converged FROM l
    UNION ALL SELECT 'twice', count(*), NULL, NULL, NULL, NULL, NULL, false FROM {table_sql}"""


def _factor_grid(spark, sf, y, family, link):
    made, (n, r) = reg.design(table(spark, sf, "lineitem").withColumn("y", y), {"l_returnflag": ["A", "N", "R"]})
    made = made.withColumn("n2", F.col(n) * 2)
    grid = {"null": [], "n": [n], "n+r": [n, r], "twice": [n, "n2"]}
    return rounded(reg.model_grid(made, "y", grid, family, link), 3, "loglik", "aic", "aicc", "bic")


@query("i06_model_grid_poisson", _grid_sql("l_linenumber", "lineitem", "y * ln(mu) - mu - lgamma(y + 1)"))
def _i06b(spark, sf):
    return _factor_grid(spark, sf, F.col("l_linenumber"), "poisson", "log")


@query(
    "i06_model_grid_binomial",
    _grid_sql("CAST(l_quantity > 20 AS INTEGER)", "lineitem", "CASE WHEN y = 1 THEN ln(mu) ELSE ln(1 - mu) END"),
)
def _i06c(spark, sf):
    return _factor_grid(spark, sf, (F.col("l_quantity") > 20).cast("int"), "binomial", "logit")


ANOVA = f"""g AS (SELECT tank, count(*) AS n, avg(temperature) AS m, var_pop(temperature) * count(*) AS ss FROM {TELEMETRY}
    GROUP BY tank), w AS (SELECT *, (SELECT avg(temperature) FROM {TELEMETRY}) AS gm FROM g),
  a AS (SELECT sum(n * (m - gm) * (m - gm)) AS sb, sum(ss) AS sw, count(*) - 1 AS db, CAST(sum(n) AS BIGINT) - count(*) AS dw,
    (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS n0 FROM w)"""


@query(
    "i07_variance_components",
    f"""WITH {ANOVA}, v AS (SELECT n0, greatest((sb / db - sw / dw) / n0, 0) AS vb, sw / dw AS vw FROM a)
    SELECT round(n0, 5) AS n0, round(vb, 6) AS var_between, round(vw, 5) AS var_within, round(vb / (vb + vw), 7) AS icc FROM v""",
)
def _i07(spark, sf):
    out = gt.variance_components(telemetry(spark, sf), "tank", "temperature")
    return rounded(rounded(rounded(out, 5, "n0", "var_within"), 6, "var_between"), 7, "icc")


@query("i08_fit_exp_decay")
def _i08(spark, sf):
    decay = F.round(20 * F.exp(-0.02 * F.dayofmonth("timestamp")) + F.col("temperature") / 100, 4)
    t = telemetry(spark, sf).select("tank", F.dayofmonth("timestamp").alias("day"), decay.alias("size"))
    return rounded(reg.fit_exp_decay(t, "tank", "day", "size"), 5, "y0", "lambda")


ACF = f"""c AS (SELECT *, temperature - avg(temperature) OVER (PARTITION BY tank) AS x, count(*) OVER (PARTITION BY tank) AS n
    FROM {TELEMETRY}),
  l AS (SELECT c.*, k, CASE k {" ".join(f"WHEN {k} THEN lag(x, {k}) OVER (PARTITION BY tank, k ORDER BY timestamp, event_id)" for k in range(1, 5))}
    ELSE x END AS xl FROM c, (SELECT unnest(range(0, 5)) AS k)),
  acf AS (SELECT tank, CAST(k AS INTEGER) AS lag, coalesce(sum(x * xl), 0) / sum(x * x) AS r, max(n) AS n FROM l GROUP BY ALL)"""


def _acf(spark, sf):
    return ss.acf(telemetry(spark, sf), "tank", ORDER, "temperature", 4)


@query("i09_acf", f"WITH {ACF} SELECT tank, lag, round(r, 6) + 0.0 AS acf, n FROM acf")
def _i09(spark, sf):
    return rounded(_acf(spark, sf), 6, "acf")


@query(
    "i10_pacf",
    f"""WITH {ACF}, p AS (SELECT tank, max(r) FILTER (lag = 1) AS r1, max(r) FILTER (lag = 2) AS r2, max(r) FILTER (lag = 3) AS r3
        FROM acf GROUP BY tank),
      q AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS f22, r1 * (1 - r2) / (1 - r1 * r1) AS f21 FROM p)
    SELECT tank, 1 AS lag, round(r1, 6) + 0.0 AS pacf FROM q UNION ALL SELECT tank, 2, round(f22, 6) + 0.0 FROM q
    UNION ALL SELECT tank, 3, round((r3 - f21 * r2 - f22 * r1) / (1 - f21 * r1 - f22 * r2), 6) + 0.0 FROM q""",
)
def _i10(spark, sf):
    return rounded(ss.pacf(telemetry(spark, sf), "tank", ORDER, "temperature", 3), 6, "pacf")


@query(
    "i11_ljung_box",
    f"""WITH {ACF}, q AS (SELECT tank, max(n) * (max(n) + 2) * sum(r * r / (n - lag)) AS q FROM acf WHERE lag BETWEEN 1 AND 4
      GROUP BY tank) SELECT tank, round(q, 5) AS q, round(exp(-q / 2) * (1 + q / 2), 6) AS p FROM q""",
)
def _i11(spark, sf):
    return rounded(rounded(ss.ljung_box(_acf(spark, sf), "tank", 4), 5, "q"), 6, "p")


@query(
    "i12_autocorrelated_groups",
    f"""WITH {ACF}, g AS (SELECT tank, bool_or(abs(r) > 1.96 / sqrt(n)) AS a FROM acf WHERE lag > 0 GROUP BY tank)
    SELECT count(*) AS groups, count(*) FILTER (a) AS autocorrelated FROM g""",
)
def _i12(spark, sf):
    return ss.autocorrelated_groups(_acf(spark, sf), "tank")


@query(
    "i13_kpss",
    f"""WITH {ACF}, s AS (SELECT tank, n, sum(x) OVER (PARTITION BY tank ORDER BY timestamp, event_id) AS s FROM c),
      w AS (SELECT tank, max(n) AS n, sum(s * s) AS ss FROM s GROUP BY tank),
      v AS (SELECT tank, sum(x * xl * CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / 5.0) END) / max(n) AS v FROM l GROUP BY tank)
    SELECT tank, n, round(ss / (n * n * v), 5) AS kpss FROM w JOIN v USING (tank)""",
)
def _i13(spark, sf):
    return rounded(ss.kpss(telemetry(spark, sf), "tank", ORDER, "temperature", 4), 5, "kpss")


@query("i14_adf")
def _i14(spark, sf):
    return rounded(reg.adf(telemetry(spark, sf), "tank", ORDER, "temperature", 2), 5, "gamma", "adf")


@query(
    "i15_ar1_forecast",
    f"""WITH l AS (SELECT *, lag(temperature) OVER {WIN} AS p FROM {TELEMETRY}),
      f AS (SELECT tank, regr_slope(temperature, p) AS phi, regr_intercept(temperature, p) AS c,
        arg_max(temperature, (timestamp, event_id)) AS last FROM l GROUP BY tank)
    SELECT tank, round(phi, 6) + 0.0 AS phi, round(c, 5) AS const, CAST(step AS INTEGER) AS step,
      round(c / (1 - phi) + pow(phi, step) * (last - c / (1 - phi)), 5) AS forecast FROM f, (SELECT unnest(range(1, 6)) AS step)""",
)
def _i15(spark, sf):
    out = reg.ar1_forecast(telemetry(spark, sf), "tank", ORDER, "temperature", 5)
    return rounded(rounded(out, 6, "phi"), 5, "const", "forecast")


@query(
    "i16_poisson_gof",
    """WITH c AS (SELECT n AS k, count(*) AS observed FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1),
      s AS (SELECT *, sum(observed) OVER () AS n, sum(k * observed) OVER () / sum(observed) OVER () AS lam FROM c),
      p AS (SELECT *, exp(k * ln(lam) - lam - lgamma(k + 1)) AS p FROM s)
    SELECT k, observed, round(n * p / sum(p) OVER (), 4) AS expected FROM p""",
)
def _i16(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return rounded(gt.poisson_gof(counts, "n"), 4, "expected")


@query(
    "i16_chi_square",
    """WITH c AS (SELECT n AS k, count(*) AS observed FROM (SELECT count(*) AS n FROM (SELECT DISTINCT ps.user_id, ps.event_type,
        CAST(ps.ts AS DATE) AS day FROM events ps) GROUP BY day) GROUP BY 1),
      s AS (SELECT *, sum(observed) OVER () AS n, sum(k * observed) OVER () / sum(observed) OVER () AS lam FROM c),
      p AS (SELECT *, exp(k * ln(lam) - lam - lgamma(k + 1)) AS p FROM s),
      x AS (SELECT observed, n * p / sum(p) OVER () AS e FROM p),
      t AS (SELECT sum((observed - e) ** 2 / e) AS x, count(*) - 1 AS df FROM x)
    SELECT round(x, 4) AS chi2, df, round(1 - list_sum([exp((df / 2.0 + j) * ln(x / 2) - x / 2 - lgamma(df / 2.0 + j + 1))
      for j in range(0, 2000)]), 7) + 0.0 AS p FROM t""",
)
def _i16b(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("day")).distinct()
    counts = ev.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    out = gt.chi_square(gt.poisson_gof(counts, "n"))
    return rounded(rounded(out, 4, "chi2"), 7, "p")


@query(
    "i17_normality",
    """WITH m AS (SELECT event_type, avg(value) AS m, count(*) AS n FROM events GROUP BY 1),
      c AS (SELECT event_type, max(n) AS n, avg((value - m) ** 2) AS m2, avg((value - m) ** 3) AS m3, avg((value - m) ** 4) AS m4
        FROM events JOIN m USING (event_type) GROUP BY 1),
      k AS (SELECT event_type, n, m3 / m2 ** 1.5 AS s, m4 / (m2 * m2) - 3 AS k FROM c)
    SELECT event_type, n, round(s, 6) AS skewness, round(k, 6) AS kurtosis, round(n / 6 * (s * s + k * k / 4), 4) AS jb,
      round(exp(-n / 12 * (s * s + k * k / 4)), 6) AS p FROM k""",
)
def _i17(spark, sf):
    out = gt.normality(table(spark, sf, "events"), "event_type", "value")
    return rounded(rounded(out, 6, "skewness", "kurtosis", "p"), 4, "jb")


CUST = """(SELECT c_custkey AS id, c_mktsegment AS g, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer)"""
GOWER = f"""s AS (SELECT id, g, a / (SELECT max(a) - min(a) FROM {CUST}) AS a, b / (SELECT max(b) - min(b) FROM {CUST}) AS b
  FROM {CUST})"""
D = "((abs(x.a - y.a) + abs(x.b - y.b)) / 2)"


def customers(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("g"),
        F.col("c_acctbal").alias("a"),
        F.col("c_nationkey").cast("double").alias("b"),
    )


@query(
    "i18_gower_row_stats",
    f"""WITH {GOWER} SELECT x.id, count(*) AS n, round(avg({D}), 7) AS mean_d, round(avg({D} * {D}), 7) AS mean_d2
      FROM s x, s y GROUP BY x.id""",
)
def _i18(spark, sf):
    return rounded(dist.gower_row_stats(customers(spark, sf), None, "id", ["a", "b"]), 7, "mean_d", "mean_d2")


SLACK = "1.4901161193847656e-08"


def phi_sql(z: str) -> str:
    """Normal distribution function in SQL: the density times the sum of z^(2k+1) / (2k+1)!!, by logarithms."""
    size = f"greatest(abs({z}), 1e-300)"
    term = f"exp((2 * k + 1) * ln({size}) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))"
    return f"(0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum([{term} for k in range(0, 120)]))"


def quantile_steps(source: str, p: str) -> str:
    """CTEs z0..z4 over ``source``: a rough normal quantile of ``p``, improved by Newton's method; the last has it as z."""
    start = f"sign({p} - 0.5) * 5.5556 * (1 - pow(least({p}, 1 - {p}) / greatest({p}, 1 - {p}), 0.1186))"
    steps = [f"z0 AS (SELECT *, {start} AS z FROM {source})"]
    slope = "(exp(-z * z / 2) / sqrt(2 * pi()))"
    for i in range(4):
        steps.append(f"z{i + 1} AS (SELECT * REPLACE (z - ({phi_sql('z')} - {p}) / {slope} AS z) FROM z{i})")
    return ", ".join(steps)


def _permanova_sql(perms: int, seed: int) -> str:
    return f"""{GOWER}, n AS (SELECT id, g, row_number() OVER (ORDER BY id) AS k FROM s),
      h AS (SELECT id, p, row_number() OVER (PARTITION BY p ORDER BY md5(id || ':' || p || ':{seed}'), id) AS k
        FROM s, (SELECT unnest(range(1, {perms + 1})) AS p)),
      lab AS (SELECT id, 0 AS p, g FROM s UNION ALL SELECT h.id, h.p, n.g FROM h JOIN n USING (k)),
      sz AS (SELECT p, g, count(*) AS n FROM lab GROUP BY ALL),
      d AS (SELECT x.id AS i, y.id AS j, {D} * {D} AS d2 FROM s x JOIN s y ON x.id < y.id),
      w AS (SELECT a.p, sum(d2 / n) AS ssw FROM d JOIN lab a ON a.id = i JOIN lab b ON b.id = j AND b.p = a.p AND b.g = a.g
        JOIN sz ON sz.p = a.p AND sz.g = a.g GROUP BY a.p),
      t AS (SELECT (SELECT sum(d2) FROM d) / (SELECT count(*) FROM s) AS sst, (SELECT count(*) FROM s) AS n,
        (SELECT count(DISTINCT g) FROM s) AS a),
      f AS (SELECT p, ssw, sst, n, a, ((sst - ssw) / (a - 1)) / (ssw / (n - a)) AS f FROM w, t),
      o AS (SELECT n, a AS groups, sst AS ss_total, ssw AS ss_within, f, 1 - ssw / sst AS r2,
        (1.0 + (SELECT count(*) FROM f b WHERE b.p > 0 AND b.f >= f.f - {SLACK})) / {perms + 1} AS p FROM f WHERE p = 0)"""


@query(
    "i19_permanova",
    f"""WITH {_permanova_sql(9, 42)} SELECT n, groups, round(ss_total, 5) AS ss_total, round(ss_within, 5) AS ss_within,
      round(f, 5) AS f, round(r2, 7) AS r2, round(p, 6) AS p FROM o""",
)
def _i19(spark, sf):
    out = dist.permanova(customers(spark, sf), "id", "g", ["a", "b"], perms=9, seed=42)
    return rounded(rounded(out, 5, "ss_total", "ss_within", "f"), 7, "r2", "p").withColumn("p", F.round("p", 6))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "i20_pairwise_permanova",
    f"""WITH {GOWER}, pr AS (SELECT a.g AS level_a, b.g AS level_b FROM (SELECT DISTINCT g FROM s) a JOIN (SELECT DISTINCT g FROM s) b
        ON a.g < b.g),
      r AS (SELECT pr.*, id, g, s.a, s.b FROM pr JOIN s ON g IN (level_a, level_b)),
      d AS (SELECT x.level_a, x.level_b, x.g = y.g AS same, x.g AS g, {D} * {D} AS d2 FROM r x JOIN r y
        ON x.level_a = y.level_a AND x.level_b = y.level_b AND x.id < y.id),
      sz AS (SELECT level_a, level_b, count(*) AS n, count(*) FILTER (g = level_a) AS na, count(*) FILTER (g = level_b) AS nb
        FROM r GROUP BY ALL),
      q AS (SELECT level_a, level_b, n, sum(d2) / max(n) AS sst, sum(CASE WHEN same THEN d2 / CASE WHEN g = level_a THEN na ELSE nb END END)
        AS ssw FROM d JOIN sz USING (level_a, level_b) GROUP BY level_a, level_b, n)
    SELECT level_a, level_b, n, 2 AS groups, round(sst, 5) AS ss_total, round(ssw, 5) AS ss_within,
      round((sst - ssw) / (ssw / (n - 2)), 5) AS f, round(1 - ssw / sst, 7) AS r2 FROM q""",
)
def _i20(spark, sf):
    out = dist.pairwise_permanova(customers(spark, sf), "id", "g", SEGMENTS, ["a", "b"], perms=3, seed=1)
    return rounded(rounded(out, 5, "ss_total", "ss_within", "f"), 7, "r2").drop("p", "p_adj")


@query(
    "i22_betadisper",
    f"""WITH {GOWER}, r AS (SELECT x.id, x.g, avg({D} * {D}) AS d2 FROM s x JOIN s y ON x.g = y.g GROUP BY ALL),
      z AS (SELECT id, g, sqrt(greatest(d2 - avg(d2) OVER (PARTITION BY g) / 2, 0)) AS z FROM r),
      gr AS (SELECT g, count(*) AS n, avg(z) AS m, var_pop(z) * count(*) AS ss FROM z GROUP BY g),
      a AS (SELECT sum(n * (m - gm) * (m - gm)) AS sb, sum(ss) AS sw, count(*) - 1 AS db, CAST(sum(n) AS BIGINT) - count(*) AS dw
        FROM gr, (SELECT avg(z) AS gm FROM z))
    SELECT round(sb, 6) AS ss_between, round(sw, 6) AS ss_within, db AS df_between, dw AS df_within,
      round(sb / db, 6) AS ms_between, round(sw / dw, 6) AS ms_within, round((sb / db) / (sw / dw), 5) AS f FROM a""",
)
def _i22(spark, sf):
    out = dist.betadisper(customers(spark, sf), "id", "g", ["a", "b"])
    return rounded(rounded(out, 6, "ss_between", "ss_within", "ms_between", "ms_within"), 5, "f")


@query(
    "i23_permanova_ic",
    f"""WITH {_permanova_sql(0, 0)} SELECT round(1 - (1 - r2) * (n - 1) / (n - groups), 6) + 0.0 AS adj_r2,
      round(2 * groups + n * ln(ss_within / n), 4) AS aic,
      round(2 * groups + n * (1 + ln(2 * pi() * ss_within / n)), 4) AS aic_g,
      round(2 * groups + n * ln(ss_within / (n - groups)), 4) AS aic_mse,
      round(groups + n * (1 + ln(2 * pi() * ss_within / (n - groups))), 4) AS aic_pi,
      round(2 * groups + n * ln(ss_within / n) + 2.0 * groups * (groups + 1) / (n - groups - 1), 4) AS aicc,
      round(2 * groups + n * ln(ss_within / (n - groups)) + 2.0 * groups * (groups + 1) / (n - groups - 1), 4) AS aicc_mse,
      round(groups + n * (1 + ln(2 * pi() * ss_within / (n - groups))) + 2.0 * groups * (groups + 1) / (n - groups - 1), 4)
        AS aicc_pi FROM o""",
)
def _i23(spark, sf):
    out = dist.permanova_ic(dist.permanova(customers(spark, sf), "id", "g", ["a", "b"]))
    cols = ["aic", "aic_g", "aic_mse", "aic_pi", "aicc", "aicc_mse", "aicc_pi"]
    return rounded(rounded(out.select("adj_r2", *cols), 4, *cols), 6, "adj_r2")


def _boot_sql(b: int, seed: int) -> str:
    const = gt.replicate_constants(b, seed)
    reps = ", ".join(f"({i}, {m}, {o})" for i, (m, o) in enumerate(const))
    weight = " + ".join(f"CAST(u >= {t!r} AS INTEGER)" for t in gt.POISSON1)
    return f"""WITH r(rep, m, o) AS (VALUES {reps}), h AS (SELECT event_type, value,
        CAST(('0x' || substr(md5(event_id || ':{seed}'), 1, 8)) AS BIGINT) % {gt.PRIME} AS h FROM events),
      u AS (SELECT event_type, rep, value, ((h * m + o) % {gt.PRIME}) / {float(gt.PRIME)!r} AS u FROM h, r),
      w AS (SELECT event_type, rep, value, {weight} AS w FROM u),
      m AS (SELECT event_type, rep, sum(w * value) / sum(w) AS m FROM w GROUP BY ALL)
    SELECT event_type, round(avg(m), 5) AS estimate, round(quantile_cont(m, 0.025), 5) AS lower,
      round(quantile_cont(m, 0.975), 5) AS upper FROM m GROUP BY event_type"""


@query("i24_bootstrap_ci", _boot_sql(100, 7))
def _i24(spark, sf):
    out = gt.bootstrap_ci(table(spark, sf, "events"), "event_type", "event_id", "value", 100, seed=7)
    return rounded(out, 5, "estimate", "lower", "upper")


@query(
    "i25_pairwise_means",
    f"""WITH g AS (SELECT event_type AS f, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM events GROUP BY 1),
      e AS (SELECT sum(ss) / (sum(n) - count(*)) AS mse FROM g),
      t AS (SELECT a.f AS level_a, b.f AS level_b, a.m - b.m AS diff, sqrt(mse * (1 / a.n + 1 / b.n)) AS se, diff / se AS z
        FROM g a JOIN g b ON a.f < b.f, e),
      p AS (SELECT *, 2 * (1 - {phi_sql('abs(z)')}) AS p FROM t)
    SELECT level_a, level_b, round(diff, 6) + 0.0 AS diff, round(se, 6) AS se, round(z, 5) + 0.0 AS z, round(p, 6) + 0.0 AS p,
      round(least(1.0, p * count(*) OVER ()), 6) + 0.0 AS p_adj FROM p""",
)
def _i25(spark, sf):
    ev = table(spark, sf, "events")
    out = gt.pairwise_means(ev, "event_type", ["click", "error", "purchase", "signup", "view"], "value")
    return rounded(rounded(out, 6, "diff", "se", "p", "p_adj"), 5, "z")


@query(
    "i26_anova_oneway",
    f"""WITH {ANOVA} SELECT round(sb, 4) AS ss_between, round(sw, 3) AS ss_within, db AS df_between, dw AS df_within,
      round(sb / db, 4) AS ms_between, round(sw / dw, 4) AS ms_within, round((sb / db) / (sw / dw), 6) AS f FROM a""",
)
def _i26(spark, sf):
    out = gt.anova_oneway(telemetry(spark, sf), "tank", "temperature")
    out = rounded(rounded(out, 4, "ss_between", "ms_between", "ms_within"), 6, "f")
    return rounded(out, 3, "ss_within")


@query(
    "i27_qq_points",
    f"""WITH q AS (SELECT event_type, event_id, value AS sample, (row_number() OVER (PARTITION BY event_type ORDER BY value, event_id)
      - 0.5) / count(*) OVER (PARTITION BY event_type) AS position FROM events), {quantile_steps('q', 'position')}
    SELECT event_type, event_id, sample, round(position, 7) AS position, round(z, 3) + 0.0 AS theoretical FROM z4""",
)
def _i27(spark, sf):
    out = gt.qq_points(table(spark, sf, "events"), "event_type", "event_id", "value")
    return rounded(rounded(out, 7, "position"), 3, "theoretical")


@query(
    "k06_residual_table",
    f"""WITH f AS (SELECT regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a FROM orders),
      r AS (SELECT o_orderkey, a + b * o_custkey AS fitted, o_totalprice - (a + b * o_custkey) AS residual FROM orders, f),
      q AS (SELECT *, (row_number() OVER (ORDER BY residual, o_orderkey) - 0.5) / count(*) OVER () AS position FROM r),
      {quantile_steps('q', 'position')}
    SELECT o_orderkey, round(fitted, 3) AS fitted, round(residual, 3) + 0.0 AS residual, round(sqrt(abs(residual)), 4) AS scale,
      round(z, 3) + 0.0 AS theoretical FROM z4""",
)
def _k06(spark, sf):
    o = table(spark, sf, "orders")
    line = o.agg(
        F.struct(
            F.regr_slope("o_totalprice", "o_custkey").alias("b"), F.regr_intercept("o_totalprice", "o_custkey").alias("a")
        )
    )
    fitted = o.withColumn("l", line.scalar()).withColumn("yhat", F.col("l.a") + F.col("l.b") * F.col("o_custkey"))
    out = gt.residual_table(fitted, "o_orderkey", "o_totalprice", "yhat")
    return rounded(rounded(out, 3, "fitted", "residual", "theoretical"), 4, "scale")


