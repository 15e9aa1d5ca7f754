import datetime as dt
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numeric as num, special as sp, text as txt, time as tm


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def test_sat_fri_week(spark):
    assert one(spark, tm.sat_fri_week(at("2023-10-06 23:59:59"))) == dt.date(2023, 10, 6)
    assert one(spark, tm.sat_fri_week(at("2023-10-07 00:00:00"))) == dt.date(2023, 10, 13)


def test_next_weekday_in(spark):
    got = one(spark, tm.next_weekday_in(at("2023-10-07 12:00:00"), ["Monday", "Wednesday", "Friday"]))
    assert got == dt.date(2023, 10, 9)
    assert one(spark, tm.next_weekday_in(at("2023-10-09 12:00:00"), ["Monday"])) == dt.date(2023, 10, 9)


def test_sunday_weeks_and_ceilings(spark):
    assert one(spark, tm.bucket(at("2023-10-08 10:00:00"), "week")) == dt.date(2023, 10, 8)
    assert one(spark, tm.bucket(at("2023-10-07 10:00:00"), "week")) == dt.date(2023, 10, 1)
    assert one(spark, tm.bucket(at("2023-10-08 10:00:00"), "week", week_start=1)) == dt.date(2023, 10, 2)
    assert one(spark, tm.bucket_ceiling(at("2023-10-08 00:00:00"), "day")) == dt.date(2023, 10, 8)
    assert one(spark, tm.bucket_ceiling(at("2023-12-31 00:00:01"), "month")) == dt.date(2024, 1, 1)


def test_ramp(spark):
    start, base = at("2024-01-01"), F.lit(0.0)
    for day, up in ((5, 2.55), (10, 4.0)):
        ts = at(f"2024-01-{day + 1:02d}")
        assert one(spark, tm.ramp_setpoint(base, ts, start, 0.51, 4, "up")) == pytest.approx(up)
    for day, down in ((2, 2.08), (5, 0.0)):
        ts = at(f"2024-01-{day + 1:02d}")
        assert one(spark, tm.ramp_setpoint(base, ts, start, 0.96, 4, "down")) == pytest.approx(down)


def test_micros_is_exact(spark):
    got = one(spark, tm.micros(at("2024-02-29 23:59:59.999999")))
    want = (dt.datetime(2024, 2, 29, 23, 59, 59, 999999) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    assert got == want


def test_parse_time(spark):
    assert one(spark, tm.parse_time(F.lit("1/31/2024"), "mdy")) == dt.date(2024, 1, 31)
    assert one(spark, tm.parse_time(F.lit("2023-10-04 11:47:19.738574"), "ymd_hms")) == dt.datetime(
        2023, 10, 4, 11, 47, 19, 738574
    )
    assert one(spark, tm.parse_time(F.lit("2015-08-01T07:00:00Z"), "ymd_hms")) == dt.datetime(2015, 8, 1, 7)
    assert one(spark, tm.parse_time(F.lit("soon"), "ymd")) is None


def test_decimal_day_and_shift(spark):
    assert one(spark, tm.decimal_day_to_ts(F.lit("2015-03-16").cast("date"), F.lit(0.5))) == dt.datetime(2015, 3, 16, 12)
    assert one(spark, tm.shift_time(at("2015-03-16"), days=365.25)) == dt.datetime(2016, 3, 15, 6)


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Timestamp", "28-0000000001", "Chill set", "chill.set"])
    assert txt.clean_names(df).columns == ["timestamp", "x28_0000000001", "chill_set", "chill_set_2"]


def test_numeric(spark):
    lit = F.lit
    assert one(spark, num.calibrate_expr(lit(50.0), lit(100.0), lit(0.0), 0, 10)) == 5.0
    assert one(spark, num.calibrate_expr(lit(50.0), lit(1.0), lit(1.0), 0, 10)) is None
    assert one(spark, num.round_half_even(lit(2.5), 0)) == 2.0
    assert one(spark, num.clamp(lit(None).cast("double"), 0, 1)) is None
    assert one(spark, num.band(lit(6), [6, 11], ["cold", "severe", "extreme"])) == "severe"
    assert one(spark, num.band(lit(6), [6, 11], ["cold", "severe", "extreme"], closed="right")) == "cold"
    assert one(spark, num.row_min(lit(2), lit(None).cast("int"), na="poison")) is None
    assert one(spark, num.poly_expr(lit(2.0), [1, 2, 3])) == 17.0
    assert one(spark, num.transform_prop(lit(0.0), "logit_n", lit(10))) == pytest.approx(math.log(0.05 / 0.95))


def test_t_quantiles():
    # Published table values.
    assert sp.t_quantile(0.95, 10) == pytest.approx(1.812461, abs=1e-6)
    assert sp.t_quantile(0.975, 1) == pytest.approx(12.706205, abs=1e-5)
    assert sp.t_quantile(0.95, 120) == pytest.approx(1.657651, abs=1e-6)


def test_t_quantile_expansion_meets_exact(spark):
    for k in (50, 101, 500):
        got = one(spark, sp.t_quantile_expr(0.95, F.lit(k), exact_to=20))
        assert got == pytest.approx(sp.t_quantile(0.95, k), abs=2e-7)


@pytest.mark.parametrize("p", [0.005, 0.95, 0.975, 0.995])
def test_t_quantiles_agree_on_both_sides_of_the_change_of_method(spark, p):
    for k in (99, 100, 101, 102, 1000):
        exact = sp.t_quantile(p, k)
        assert one(spark, sp.t_quantile_expr(p, F.lit(k))) == pytest.approx(exact, abs=1e-8)
        if k >= 100:
            assert one(spark, sp.t_quantile_expr(p, F.lit(k), exact_to=10)) == pytest.approx(exact, abs=1e-8)


@pytest.mark.parametrize("x", [-8.0, -3.2, -1.0, 0.0, 0.3, 2.9, 3.1, 6.0])
def test_normal_cdf(spark, x):
    assert one(spark, sp.normal_cdf_expr(F.lit(x))) == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-9)


@pytest.mark.parametrize("p", [1e-6, 0.02, 0.3, 0.5, 0.9, 0.999])
def test_normal_quantile(spark, p):
    assert one(spark, sp.normal_quantile_expr(F.lit(p))) == pytest.approx(NormalDist().inv_cdf(p), rel=2e-9, abs=1e-9)


@pytest.mark.parametrize("x,df,p", [(3.841459, 1, 0.05), (9.487729, 4, 0.05), (16.749602, 5, 0.005), (18.307038, 10, 0.05)])
def test_chi_square_tail(spark, x, df, p):
    assert one(spark, sp.chi2_sf_expr(F.lit(x), df)) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("k", [0, 5, 20, 21, 300])
def test_log_factorial(spark, k):
    assert one(spark, sp.log_factorial_expr(F.lit(k).cast("long"))) == pytest.approx(math.lgamma(k + 1), abs=1e-9)
