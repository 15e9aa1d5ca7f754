import datetime as dt
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tidemark.functions import special
from tidemark.operators import (
    aggregate as agg,
    control as ctl,
    distance as dist,
    group_tests as gt,
    heatwave as hw,
    joins,
    regression as reg,
    series_stats as ss,
    shape,
    windows as win,
)
from tidemark.sources import logs, tables

T0 = dt.datetime(2024, 1, 1)


def minutes(spark, rows, schema):
    """Rows whose first field is minutes after T0."""
    made = [(T0 + dt.timedelta(minutes=r[0]), *r[1:]) for r in rows]
    return spark.createDataFrame(made, schema)


def test_nearest_asof_ties_go_to_the_earlier(spark):
    profile = minutes(spark, [(600, "a"), (620, "b")], "at timestamp_ntz, p string")
    reads = minutes(spark, [(610, 1), (611, 2), (0, 3), (5000, 4)], "ts timestamp_ntz, i int")
    got = {r.i: r.p for r in joins.nearest_asof(reads, profile, "ts", "at", "p").collect()}
    assert got == {1: "a", 2: "b", 3: "a", 4: "b"}


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_label_last_wins(spark, seed):
    rng = random.Random(seed)
    spans = [(i, *sorted((rng.randint(0, 6000), rng.randint(0, 6000)))) for i in range(25)]
    reads = sorted(rng.sample(range(6000), 200)) + [s[1] for s in spans] + [s[2] for s in spans]
    ranges = spark.createDataFrame(
        [(o, f"r{o}", T0 + dt.timedelta(minutes=a), T0 + dt.timedelta(minutes=b)) for o, a, b in spans],
        "o int, label string, lo timestamp_ntz, hi timestamp_ntz",
    )
    df = minutes(spark, [(m, i) for i, m in enumerate(reads)], "ts timestamp_ntz, i int")
    got = {r.i: r.label for r in joins.interval_label(df, ranges, "ts", "lo", "hi", "label", order="o").collect()}
    for i, m in enumerate(reads):
        covering = [o for o, a, b in spans if a <= m <= b]
        assert got[i] == (f"r{max(covering)}" if covering else None)
    assert len(got) == len(reads)


def test_time_to_settle_uses_strictly_later_readings(spark):
    rows = [(0, 1, 10.0, 10.0), (1, 2, 20.0, 20.0), (2, 3, 20.0, 25.0), (4, 4, 20.0, 20.3), (5, 5, 30.0, 20.0)]
    df = minutes(spark, rows, "ts timestamp_ntz, i int, s double, y double").withColumn("k", F.lit("t"))
    got = joins.time_to_settle(df, "k", ["ts", "i"], "ts", "s", "y", 0.5).orderBy("ts").collect()
    assert [r.stabilization_time for r in got] == [180.0, None]


def test_full_panel_matches_missing_keys(spark):
    a = spark.createDataFrame([(1, None, 5), (2, "x", 6)], "t int, g string, a int")
    b = spark.createDataFrame([(1, None, 7), (3, "x", 8)], "t int, g string, b int")
    got = {(r.t, r.g): (r.a, r.b) for r in joins.full_panel([a, b], ["t", "g"]).collect()}
    assert got == {(1, None): (5, 7), (2, "x"): (6, None), (3, "x"): (None, 8)}


def test_mean_of_means_and_quantiles(spark):
    df = spark.createDataFrame([("s1", 10.0), ("s1", 12.0), ("s2", 20.0)], "s string, v double").withColumn("r", F.lit(1))
    assert agg.mean_of_means(df, "r", "s", "v").first()["mean"] == 15.5
    q = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")
    assert agg.quantiles(q, None, "v", [0.25]).first().q25 == 1.75
    assert agg.quantiles(q, None, "v", [0.25], kind=1).first().q25 == 1.0


@pytest.mark.parametrize("seed", [3, 4])
def test_quantiles_with_ties_and_outliers(spark, seed):
    rng = random.Random(seed)
    values = [float(rng.choice([0, 0, 0, 1, 5, 1e9, -1e7, rng.random()])) for _ in range(101)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = agg.quantiles(df, None, "v", [0.0, 0.1, 0.5, 0.77, 1.0]).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0.0, 0.1, 0.5, 0.77, 1.0])))


def test_fill_residual(spark):
    df = spark.createDataFrame([(1, None, 2, 10), (None, None, 3, 10)], "a int, b int, c int, n int")
    got = [tuple(r)[:3] for r in shape.fill_residual(df, ["a", "b", "c"], "n").collect()]
    assert got == [(1, 7, 2), (7, 0, 3)]


def test_pid_reference_mode(spark):
    rows = [("t", i, 15.0, y) for i, y in enumerate((14.0, 14.5, 15.0))]
    df = spark.createDataFrame(rows, "k string, i int, s double, y double")
    got = ctl.pid_replay(df, "k", "i", "s", "y", 0.5, 0, 0.00625, chunk=2).orderBy("i").collect()
    assert [r.pid for r in got] == pytest.approx([0.5, 0.1625, -0.084375])


@pytest.mark.parametrize("chunk", [1, 4, 100])
def test_hysteresis_equals_a_loop(spark, chunk):
    rng = random.Random(chunk)
    rows = [("t", i, rng.random() < 0.2, rng.random() < 0.6) for i in range(80)] + [("u", i, False, True) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, i int, a boolean, b boolean")
    got = {(r.k, r.i): r.on for r in ctl.hysteresis_replay(df, "k", "i", F.col("a"), F.col("b"), chunk=chunk).collect()}
    state = {"t": 0, "u": 0}
    for k, i, a, b in rows:
        state[k] = int(a or (not state[k] and b))
        assert got[(k, i)] == state[k]


def test_hysteresis_small_case(spark):
    a, b = [0, 0, 1, 0, 0], [1, 1, 0, 0, 1]
    df = spark.createDataFrame([("t", i, bool(x), bool(y)) for i, (x, y) in enumerate(zip(a, b))], "k string, i int, a boolean, b boolean")
    got = ctl.hysteresis_replay(df, "k", "i", F.col("a"), F.col("b"), chunk=2).orderBy("i").collect()
    assert [r.on for r in got] == [1, 0, 1, 0, 1]


def flags(spark, pattern, temps=None):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(len(pattern))]
    temps = temps or [1.0 if f else 0.0 for f in pattern]
    rows = [("s", d, float(x), 0.0, 0.5, bool(f)) for d, x, f in zip(days, temps, pattern)]
    return spark.createDataFrame(rows, "site string, t date, temp double, seas double, thresh double, exceeds boolean")


def test_runs_and_gaps(spark):
    df = flags(spark, [1] * 5 + [0] * 2 + [1] * 5 + [0] * 3 + [1] * 5)
    events = hw.join_gaps(hw.runs(df, "site"), "site").orderBy("event_no").collect()
    assert [(r.event_no, r.duration) for r in events] == [(1, 12), (2, 5)]


def test_event_rates(spark):
    df = flags(spark, [0, 1, 1, 1, 1, 1, 0], [0.2, 1, 3, 2, 1, 1, 0.4])
    events = hw.join_gaps(hw.runs(df, "site"), "site")
    got = hw.event_rates(df, events, "site").first()
    assert got.rate_onset == pytest.approx(1.6) and got.rate_decline == pytest.approx(2.3 / 3.5)
    assert got.intensity_max == 3 and got.date_peak == dt.date(2024, 1, 3) and got.intensity_cumulative == 8


def test_event_at_the_end_of_the_series_has_no_rate(spark):
    df = flags(spark, [1] * 5, [1.0, 2.0, 2.0, 1.0, 1.0])
    got = hw.event_rates(df, hw.join_gaps(hw.runs(df, "site"), "site"), "site").first()
    assert got.rate_onset is None and got.rate_decline is None
    assert got.date_peak == dt.date(2024, 1, 2)


def test_doy_slots_around_leap_day(spark):
    days = ["2023-02-28", "2023-03-01", "2024-02-29", "2024-03-01", "2023-12-31", "2024-12-31", "2024-01-01"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d string")
    got = df.select("i", hw.doy366(F.to_date("d")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [59, 61, 60, 61, 366, 366, 1]


def test_climatology_wraps_the_year(spark):
    days = [dt.date(2021, 1, 1) + dt.timedelta(days=i) for i in range(3 * 365)]
    rows = [("s", d, float(d.month == 1 and d.day == 1) * 11) for d in days]
    clim = hw.climatology(spark.createDataFrame(rows, "site string, t date, temp double"), "site").collect()
    seas = {r.doy: r.seas for r in clim}
    assert len(seas) == 366 and seas[366] == pytest.approx(1.0) and seas[6] == pytest.approx(1.0) and seas[7] == 0
    assert seas[361] == 0 or seas[361] == pytest.approx(0.0)
    assert hw.smooth_circular(hw.climatology(spark.createDataFrame(rows, "site string, t date, temp double"), "site"), "site").count() == 366


def test_climatology_window_is_eleven_days_around_the_leap_day_slot(spark):
    days = [dt.date(2021, 1, 1) + dt.timedelta(days=i) for i in range(365)]
    rows = [("s", d, float(d == dt.date(2021, 2, 24))) for d in days]
    clim = hw.climatology(spark.createDataFrame(rows, "site string, t date, temp double"), "site").collect()
    seas = {r.doy: r.seas for r in clim}
    assert len(seas) == 366
    assert all(seas[k] == pytest.approx(1 / 11) for k in range(50, 60)) and seas[61] == pytest.approx(1 / 11) and seas[62] == 0


def test_acf_small_case(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in (1, 2, 3, 4)], "k string, i int, v double")
    got = {r.lag: r.acf for r in ss.acf(df, "k", "i", "v", 2, chunk=1).collect()}
    assert got[0] == 1 and got[1] == pytest.approx(0.25) and got[2] == pytest.approx(-0.3)


def test_ols_adf_and_path_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 120
    x, y = rng.normal(size=n), np.cumsum(rng.normal(size=n))
    rows = [("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k string, i int, x double, y double")
    design = np.column_stack([np.ones(n), x])
    beta, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
    got = {r.term: r for r in reg.ols(df, "k", "y", ["x"]).collect()}
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / (n - 2))
    assert [got["(intercept)"].estimate, got["x"].estimate] == pytest.approx(list(beta))
    assert [got["(intercept)"].se, got["x"].se] == pytest.approx(list(se))
    d = np.diff(y)
    t = np.arange(1, n + 1)
    m = np.column_stack([np.ones(n - 2), y[1:-1], t[2:], d[:-1]])
    b = np.linalg.lstsq(m, d[1:], rcond=None)[0]
    e = d[1:] - m @ b
    tstat = b[1] / np.sqrt(np.linalg.inv(m.T @ m)[1, 1] * (e @ e) / (len(e) - 4))
    assert reg.adf(df, "k", "i", "y", 1, chunk=7).first().adf == pytest.approx(tstat)


def test_path_model_robust_errors(spark):
    rng = np.random.default_rng(8)
    n = 90
    g = np.repeat(np.arange(9), 10)
    x = rng.normal(size=n)
    y = 0.5 * x + rng.normal(size=n) + g * 0.1
    rows = [(int(c), int(i), float(a), float(b)) for i, (c, a, b) in enumerate(zip(g, x, y))]
    df = spark.createDataFrame(rows, "g int, i int, x double, y double")
    got = {r.term: r for r in reg.path_model(df, ("g", ["i"]), {"y": ["x"]}, "g", chunk=4).collect()}
    zx, zy = (x - x.mean()) / x.std(ddof=1), (y - y.mean()) / y.std(ddof=1)
    m = np.column_stack([np.ones(n), zx])
    b = np.linalg.lstsq(m, zy, rcond=None)[0]
    e = zy - m @ b
    s = np.array([(m[g == c] * e[g == c, None]).sum(0) for c in range(9)])
    inv = np.linalg.inv(m.T @ m)
    v = inv @ (s.T @ s) @ inv * 9 / 8 * (n - 1) / (n - 2)
    assert got["x"].estimate == pytest.approx(b[1]) and got["x"].se == pytest.approx(np.sqrt(v[1, 1]))


def test_exp_decay_recovers_parameters(spark):
    rows = [("a", float(t), 12 * np.exp(-0.3 * t) + 0.01 * (-1) ** t) for t in range(12)] + [("b", 1.0, 5.0)]
    df = spark.createDataFrame([(k, t, float(v)) for k, t, v in rows], "k string, t double, v double")
    got = reg.fit_exp_decay(df, "k", "t", "v").orderBy("k").collect()
    assert [(r.k, r.converged) for r in got] == [("a", True), ("b", False)]
    assert got[0].y0 == pytest.approx(12, abs=0.02) and got[0]["lambda"] == pytest.approx(0.3, abs=0.002)
    short = reg.fit_exp_decay(df, "k", "t", "v", iters=1).orderBy("k").collect()
    assert [(r.k, r.converged) for r in short] == [("a", False), ("b", False)] and short[0].y0 == pytest.approx(12, abs=1)


def pairs(values, cols):
    span = {c: max(v[c] for v in values) - min(v[c] for v in values) for c in cols}
    for p, q in itertools.combinations(values, 2):
        yield p, q, sum(abs(p[c] - q[c]) / span[c] for c in cols) / len(cols)


def sample(seed, n=41):
    rng = random.Random(seed)
    return [
        {"id": i, "g": rng.choice("aab"), "x": float(rng.randint(0, 9)), "y": rng.random(), "z": float(rng.randint(0, 2))}
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_permanova_equals_all_pairs(spark, seed):
    values, cols = sample(seed), ["x", "y", "z"]
    df = spark.createDataFrame([(v["id"], v["g"], v["x"], v["y"], v["z"]) for v in values], "id int, g string, x double, y double, z double")
    got = dist.permanova(df, "id", "g", cols).first()
    n = {g: sum(v["g"] == g for v in values) for g in "ab"}
    total = sum(d * d for _, _, d in pairs(values, cols)) / len(values)
    within = sum(d * d / n[p["g"]] for p, q, d in pairs(values, cols) if p["g"] == q["g"])
    assert got.ss_total == pytest.approx(total) and got.ss_within == pytest.approx(within)
    assert got.f == pytest.approx((total - within) / (within / (len(values) - 2)))


def test_gower_row_stats_equal_all_pairs(spark):
    values, cols = sample(9), ["x", "y"]
    df = spark.createDataFrame([(v["id"], v["x"], v["y"]) for v in values], "id int, x double, y double")
    d1, d2 = dict.fromkeys(range(len(values)), 0.0), dict.fromkeys(range(len(values)), 0.0)
    for p, q, d in pairs(values, cols):
        for v in (p, q):
            d1[v["id"]] += d
            d2[v["id"]] += d * d
    for r in dist.gower_row_stats(df, None, "id", cols).collect():
        assert r.mean_d == pytest.approx(d1[r.id] / len(values)) and r.mean_d2 == pytest.approx(d2[r.id] / len(values))


def test_shuffled_labels_keep_the_sizes(spark):
    df = spark.createDataFrame([(v["id"], v["g"]) for v in sample(4)], "id int, g string")
    out = dist.shuffled_labels(df, None, "id", "g", 4, 7)
    sizes = {(r.perm, r.g): r["count"] for r in out.groupBy("perm", "g").count().collect()}
    assert len({sizes[(p, "a")] for p in range(5)}) == 1
    moved = out.filter("perm = 1").join(df.withColumnRenamed("g", "old"), "id").filter("g <> old").count()
    assert moved > 0


def test_bootstrap_interval_covers_the_mean(spark):
    df = spark.range(2000).select("id", (F.col("id") % 100).cast("double").alias("v"), F.lit("g").alias("g"))
    got = gt.bootstrap_ci(df, "g", "id", "v", 200).first()
    assert got.lower < 49.5 < got.upper and got.upper - got.lower == pytest.approx(2 * 1.96 * 28.87 / 2000**0.5, rel=0.3)


def test_ramps_and_grid(spark):
    grid = tables.time_grid(spark, "2024-01-01 00:00:00", "2024-01-01 03:00:00", "1 HOUR")
    got = tables.ramp_profile(grid, "ts", 18, 2, 1).orderBy("ts").collect()
    assert [r.temp for r in got] == [18.5, 19.0, 19.5, 20.0]
    hold = tables.ramp_hold_profile(grid, "ts", 0, 4, 1, 2).orderBy("ts").collect()
    assert [r.temp for r in hold] == [0.0, 4.0, 4.0, 0.0]


def test_scan_logs_tolerates_ragged_rows_and_skips_folders(spark, tmp_path):
    (tmp_path / "type1").mkdir()
    (tmp_path / "type1" / "old.csv").write_text("Timestamp,Chill set\n2023-01-01 00:00:00,1\n")
    (tmp_path / "a.csv").write_text("Timestamp,Temp,\n2024-03-12 13:53:52.618110,18.5,\n2024-03-12 13:54:52.1,18.6,9,9\n")
    (tmp_path / "b.csv").write_text("Timestamp,Temp\n2024-03-13 00:00:00\n")
    schema = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("temp", T.DoubleType())])
    rows = logs.scan_logs(spark, str(tmp_path), schema).orderBy("timestamp").collect()
    assert [(r.temp, r.run_id) for r in rows] == [(18.5, "a.csv"), (18.6, "a.csv"), (None, "b.csv")]


def test_tracking_and_box(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double")
    box = agg.box_stats(df, None, "v").first()
    assert (box.q50, box.low, box.high, box.outliers) == (3.0, 1.0, 4.0, 1)


def test_hot_series_is_spread_over_tasks(spark):
    """One series holds nearly all rows; its rows still go through many shuffle partitions."""
    df = spark.range(20000).select(
        F.when(F.col("id") % 100 == 0, "cold").otherwise("hot").alias("k"), F.col("id").alias("i"), F.lit(1.0).alias("v")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = win.cumsum(df, "k", "i", "v", "c", chunk=500).withColumn("p", F.spark_partition_id())
        hot = out.filter("k = 'hot'").groupBy("p").count().collect()
        assert len(hot) == 4
        assert max(r["count"] for r in hot) < 0.5 * 20000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("by", ["g", None])
def test_bootstrap_equals_plain_sums(spark, by):
    rows = [(i, None if i % 9 == 0 else "ab"[i % 2], float(i * 7 % 13) if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    got = {r["g"] if by else None: r for r in gt.bootstrap_ci(df, by, "id", "v", 20, seed=3).collect()}
    constants = gt.replicate_constants(20, 3)
    for key in {r[1] if by else None for r in rows}:
        means = []
        for m, o in constants:
            s = w = 0.0
            for i, g, v in rows:
                if v is not None and (not by or g == key):
                    h = int(hashlib.md5(f"{i}:3".encode()).hexdigest()[:8], 16) % gt.PRIME
                    k = sum((h * m + o) % gt.PRIME / gt.PRIME >= t for t in gt.POISSON1)
                    s, w = s + k * v, w + k
            means.append(s / w)
        want = [np.mean(means), *np.quantile(means, [0.025, 0.975])]
        assert [got[key].estimate, got[key].lower, got[key].upper] == pytest.approx(want)


def test_glm_steps(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    counts = rng.poisson(np.exp(0.3 + x @ [0.5, -0.2]))
    rows = [(int(c), float(a), float(b), 2.0 * a, float(a > 0)) for c, (a, b) in zip(counts, x)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, 2.0, 0.0)], "y int, a double, b double, a2 double, s double")
    fit = {r.term: r for r in reg.glm(df, "y", ["a", "b"], "poisson", "log").collect()}
    beta = np.zeros(3)
    design = np.column_stack([np.ones(400), x])
    for _ in range(50):
        mu = np.exp(design @ beta)
        beta = beta + np.linalg.solve(design.T @ (mu[:, None] * design), design.T @ (counts - mu))
    assert [fit[t].estimate for t in ("(intercept)", "a", "b")] == pytest.approx(beta.tolist(), abs=1e-8)
    assert all(r.converged and r.n == 400 for r in fit.values())
    # A singular design has no estimates; separated answers never settle; the others are fitted beside them.
    assert reg.glm(df, "y", ["a", "a2"], "poisson", "log").filter("estimate is null").count() == 3
    grid = {r.model: r for r in reg.model_grid(df, "s", {"null": [], "b": ["b"], "sep": ["a"], "twice": ["a", "a2"]}, "binomial", "logit").collect()}
    assert grid["null"].converged and grid["b"].converged and not grid["sep"].converged and grid["twice"].loglik is None
    share = np.mean([r[4] for r in rows] + [0.0])
    assert grid["null"].loglik == pytest.approx(401 * (share * np.log(share) + (1 - share) * np.log(1 - share)), rel=1e-6)


def test_tails_agree_with_closed_forms(spark):
    for df2, f in [(5, 0.3), (40, 2.5), (300, 8.0)]:
        assert special.f_sf(f, 2, df2) == pytest.approx((1 + 2 * f / df2) ** (-df2 / 2), rel=1e-9)
    rows = [(x, d) for x in (0.0, 0.7, 3.84, 25.0) for d in (1, 2, 3, 4, 9, 10)]
    found = spark.createDataFrame(rows, "x double, df int")
    for d in (1, 2, 3, 4, 9, 10):
        part = found.filter(F.col("df") == d).select(special.chi2_sf_at(F.col("x"), F.col("df")), special.chi2_sf_expr(F.col("x"), d))
        for at, fixed in part.collect():
            assert at == pytest.approx(fixed, abs=1e-10)


def test_nested_models_inflation_and_band(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=60), rng.normal(size=60)
    y = 1 + 2 * a + rng.normal(size=60)
    rows = [("g", *map(float, v)) for v in zip(a, b, y)] + [("few", 1.0, 2.0, 3.0), ("g", None, 1.0, 1.0), ("g", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double")

    def rss(*cols):
        x = np.column_stack([np.ones(60), *cols])
        return float(np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2))

    got = {r.g: r for r in reg.compare_nested(df, "g", "y", ["a"], ["a", "b"]).collect()}
    want = (rss(a) - rss(a, b)) / (rss(a, b) / 57)
    assert got["g"].f == pytest.approx(want) and 0 < got["g"].p < 1 and got["few"].f is None
    vif = {(r.g, r.term): r.vif for r in reg.variance_inflation(df.dropna(), "g", ["a", "b"]).collect()}
    assert vif["g", "a"] == pytest.approx(1 / (1 - np.corrcoef(a, b)[0, 1] ** 2)) and vif["few", "a"] is None
    band = reg.fitted_band(df, "g", "y", "a").collect()
    line = np.polyfit(a, y, 1)
    for r in band:
        if r.g == "g" and r.a is not None:
            assert r.fitted == pytest.approx(np.polyval(line, r.a)) and r.lower < r.fitted < r.upper
        elif r.g == "few" or r.a is None:
            assert r.lower is None


def test_cross_sums_on_both_sides_of_a_block(spark, monkeypatch):
    values = sample(5, 300)
    rows = [(v["id"], v["g"], v["x"], v["y"]) for v in values] + [(300 + k, f"few{k % 4}", 1.0, 2.0) for k in range(6)]
    df = spark.createDataFrame(rows, "id int, g string, x double, y double")
    seen = []

    def counted(df, *args, **kwargs):
        seen.append(df.count())
        return running(df, *args, **kwargs)

    running = dist.running
    monkeypatch.setattr(dist, "running", counted)
    for small in (dist.SMALL_LEVEL, 3):
        monkeypatch.setattr(dist, "SMALL_LEVEL", small)
        got = {r.id: r.s for r in dist.cross_sums(df, "g", "id", "x", "y").groupBy("id").agg(F.sum("part").alias("s")).collect()}
        for i, g, x, y in rows:
            assert got[i] == pytest.approx(sum(abs(x - p[2]) * abs(y - p[3]) for p in rows if p[1] == g), abs=1e-9)
    # Blocks above the limit alone are copied, once for each of their high bits: none of these rows under the usual limit.
    assert seen[:2] == [len(rows), 0] and 0 < seen[3] < 6 * len(rows)


def test_permutations_are_not_broadcast(spark):
    df = spark.range(50_000).selectExpr("id", "CAST(id % 3 AS string) AS g")
    plan = dist.shuffled_labels(df, None, "id", "g", 9, 7)._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "[__k" not in "".join(x for x in plan.split("\n") if "BroadcastHashJoin" in x)
