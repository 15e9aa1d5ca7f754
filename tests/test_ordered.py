"""The chunked operators against plain loops, with chunks far smaller than the series."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate, ordered, windows as win


def series(n=60, seed=1, keys=("a", "b", None)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = keys[0] if rng.random() < 0.6 else rng.choice(keys)
        value = None if rng.random() < 0.2 else float(rng.randint(0, 6))
        rows.append((key, i, value))
    return rows


def groups(rows):
    out = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((i, v))
    return out


@pytest.fixture(params=[1, 2, 3])
def frame(spark, request):
    rows = series(seed=request.param)
    return spark.createDataFrame(rows, "k string, i int, v double"), rows


@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_neighbourhood_equals_shifting_a_list(frame, chunk):
    df, rows = frame
    got = ordered.lagged(df, "k", "i", {"back": ("v", 3), "ahead": ("v", -2)}, chunk=chunk).collect()
    want = {}
    for values in groups(rows).values():
        for p, (i, _) in enumerate(values):
            want[i] = (
                values[p - 3][1] if p >= 3 else None,
                values[p + 2][1] if p + 2 < len(values) else None,
            )
    assert {r.i: (r.back, r.ahead) for r in got} == want


@pytest.mark.parametrize("chunk", [1, 5, 1000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_equals_a_loop(frame, chunk, descending):
    df, rows = frame
    specs = {
        "total": ("sum", "v"),
        "n": ("count", "v"),
        "top": ("max", "v"),
        "low": ("min", "v"),
        "last": ("last", "v"),
        "first": ("first", "v"),
        "earlier": ("sum", "v", "before"),
        "whole": ("total", "v"),
    }
    got = ordered.running(df, "k", "i", specs, chunk=chunk, descending=descending).collect()
    want = {}
    for values in groups(rows).values():
        seen, known_all = [], [v for _, v in values if v is not None]
        for i, v in reversed(values) if descending else values:
            earlier = sum(seen) if seen else None
            if v is not None:
                seen.append(v)
            want[i] = (
                sum(seen) if seen else None,
                len(seen),
                max(seen, default=None),
                min(seen, default=None),
                seen[-1] if seen else None,
                seen[0] if seen else None,
                earlier,
                sum(known_all) if known_all else None,
            )
    assert {r.i: tuple(r[c] for c in specs) for r in got} == want


def test_null_series_is_a_series(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 3.0)], "k string, i int, v double")
    got = ordered.with_group_stats(df, "k", {"m": F.avg("v")}).collect()
    assert [r.m for r in got] == [2.0, 2.0]


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_peaks_on_plateaus_and_ends(spark, chunk):
    values = [1, 3, 3, 2, 5, 1]
    df = spark.createDataFrame([("s", i + 1, float(v)) for i, v in enumerate(values)], "k string, i int, v double")
    got = win.find_peaks(df, "k", "i", "v", 1, chunk=chunk).filter("is_peak").collect()
    assert sorted(r.i for r in got) == [2, 3, 5]


def test_small_cases(spark):
    df = spark.createDataFrame([("s", 1, 5.0), ("s", 2, 7.0), ("s", 3, 6.0)], "k string, i int, v double")
    d = win.diff_prev(df, "k", "i", "v", "d", chunk=1)
    assert [r.d for r in d.orderBy("i").collect()] == [0.0, 2.0, -1.0]
    c = win.cumsum(d, "k", "i", "d", "c", chunk=2)
    assert [r.c for r in c.orderBy("i").collect()] == [0.0, 2.0, 1.0]


def test_poisoned_cumsum(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, None), (4, 2.0)], "i int, v double").withColumn("k", F.lit("x"))
    poison = win.cumsum(df, "k", "i", "v", "c", na="poison", fill=0.0, chunk=2).orderBy("i").collect()
    assert [r.c for r in poison] == [1.0, 1.0, 0.0, 0.0]
    skip = win.cumsum(df, "k", "i", "v", "c", chunk=2).orderBy("i").collect()
    assert [r.c for r in skip] == [1.0, 1.0, 1.0, 3.0]


def test_rolling_needs_a_full_window(spark):
    df = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 2.0), ("s", 3, 6.0)], "k string, i int, v double")
    got = win.rolling(df, "k", "i", "v", 3, {"m": "mean"}, chunk=1).orderBy("i").collect()
    assert [r.m for r in got] == [None, None, 3.0]


def test_p_adjust(spark):
    ps = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)] + [(9, None)], "i int, p double")
    bh = {r.i: r.q for r in win.p_adjust(df, "p", "bh", "q").collect()}
    assert bh[0] == pytest.approx(0.04) and bh[1] == pytest.approx(0.16 / 3)
    assert bh[2] == pytest.approx(0.16 / 3) and bh[3] == pytest.approx(0.5) and bh[9] is None
    bonf = {r.i: r.q for r in win.p_adjust(df, "p", "bonferroni", "q").collect()}
    assert [bonf[i] for i in range(4)] == pytest.approx([0.04, 0.16, 0.12, 1.0])


def test_run_id_and_changes_with_nulls(spark):
    values = ["a", "a", None, None, "b", "a"]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "k string, i int, v string")
    got = win.run_id(df, "k", "i", "v", "run", chunk=2).orderBy("i").collect()
    assert [r.run for r in got] == [1, 1, 2, 2, 3, 4]
    assert [r.i for r in win.change_points(df, "k", "i", "v", chunk=2).orderBy("i").collect()] == [2, 4, 5]


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, i int, v double")
    assert win.find_peaks(df, "k", "i", "v", 2, chunk=5).count() == 0
    assert win.cumsum(df, "k", "i", "v", "c", chunk=5).count() == 0
    assert win.zscore(df, None, {"z": "v"}).count() == 0


def test_null_repeats_and_zscore(spark):
    df = spark.createDataFrame([("d", 1, 2.0), ("d", 2, 2.0), ("d", 3, 4.0)], "k string, i int, v double")
    assert [r.v for r in win.null_repeats(df, "k", "i", "v").orderBy("i").collect()] == [2.0, None, 4.0]
    sd = statistics.stdev([2.0, 2.0, 4.0])
    z = win.zscore(df, "k", {"z": "v"}).orderBy("i").collect()
    assert z[2].z == pytest.approx((4 - 8 / 3) / sd)


def test_cohort_labels(spark):
    days = [0, 6, 7, 21, 22, 28, 35, 42, 49]
    rows = [(i, d) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "i int, d int").withColumn("t", F.expr("date_add(date'2023-10-01', d)"))
    got = {r.d: (r.week, r.weeks) for r in win.cohort(df, "t").collect()}
    assert got[0] == (0, None) and got[7] == (1, 1) and got[21] == (3, 1) and got[28] == (4, 2)
    assert got[35] == (5, 2) and got[49] == (7, 3)


@pytest.mark.parametrize("unit", ["day", "hour"])
def test_hot_chunks_are_split_without_changing_results(spark, monkeypatch, unit):
    monkeypatch.setattr(ordered, "HOT_ROWS", 5)
    monkeypatch.setattr(ordered, "PARTS_PER_HOT_CHUNK", 2)
    df = spark.range(120).select(
        F.lit("hot").alias("k"),
        F.col("id").alias("i"),
        F.expr("timestamp_ntz'2024-02-28 22:00:00' + make_dt_interval(0, 0, 0, id * id)").alias("t"),
    )
    keyed = ordered.keyed(df, ["k"], ["t", "i"], unit)
    assert keyed.select(ordered.CHUNK).distinct().count() > df.select(F.date_trunc(unit, "t")).distinct().count()
    got = ordered.running(df, "k", ["t", "i"], {"n": ("count", F.lit(1))}, chunk=unit).collect()
    assert all(r.n == r.i + 1 for r in got) and len(got) == 120
    lags = ordered.lagged(df, "k", ["t", "i"], {"p": ("i", 2), "f": ("i", -1)}, chunk=unit).collect()
    assert all(r.p == (r.i - 2 if r.i > 1 else None) and r.f == (r.i + 1 if r.i < 119 else None) for r in lags)


def test_hot_numeric_chunks_are_split(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 3)
    df = spark.range(-40, 40).select(F.lit("k").alias("k"), F.col("id").alias("i"))
    got = win.row_index(df, "k", "i", "n", chunk=16).collect()
    assert all(r.n == r.i + 41 for r in got)
    assert ordered.keyed(df, ["k"], ["i"], 16).select(ordered.CHUNK).distinct().count() > 5


def test_collected_series_do_not_depend_on_how_many_rows_a_chunk_holds(spark, monkeypatch):
    df = spark.range(40).select(F.lit("k").alias("k"), F.col("id").alias("i"), (F.col("id") * 2).alias("v"))
    for hot in (3, 10_000_000):
        monkeypatch.setattr(ordered, "HOT_ROWS", hot)
        got = aggregate.collect_series(df, "k", "i", "v", chunk=25).orderBy("chunk").collect()
        assert [(r.chunk, r.series) for r in got] == [(0, list(range(0, 50, 2))), (1, list(range(50, 80, 2)))]


def test_quantiles_of_both_kinds_share_one_ranking(spark):
    rng = random.Random(4)
    values = [math.exp(rng.gauss(0, 4)) for _ in range(101)]
    got = aggregate.quantiles(spark.createDataFrame([(v,) for v in values], "v double"), None, "v", [0.9], inverse={"low": 0.25}).first()
    ranked = sorted(values)
    assert got.q90 == pytest.approx(ranked[90]) and got.low == ranked[25]


def test_value_spans_of_a_skewed_column_are_even(spark):
    df = spark.range(20_000).select("id", F.exp(-F.col("id") / 100.0).alias("v"))
    spans = ordered.value_chunk(df, None, "v").groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"))
    rows = spans.orderBy("__bucket").collect()
    assert len(rows) == ordered.LEAST_SPANS
    assert max(r.n for r in rows) < 2 * 20_000 / len(rows)
    assert [r.a for r in rows] == sorted(r.a for r in rows)


def test_value_spans_cut_a_hot_value_by_the_tie_column(spark):
    value = F.when(F.col("id") % 10 < 8, 5.0).otherwise(F.col("id") % 97)
    df = spark.range(20_000).select("id", value.alias("v"))
    spans = ordered.value_chunk(df, None, "v", "id")
    assert max(r["count"] for r in spans.groupBy("__bucket").count().collect()) < 3 * 20_000 / ordered.LEAST_SPANS
    ranked = ordered.running(spans, None, ["v", "id"], {"i": ("count", F.lit(1))}, F.col("__bucket"))
    got = [r.i for r in ranked.orderBy("v", "id").select("i").collect()]
    assert got == list(range(1, 20_001))


def test_value_spans_of_empty_null_and_equal_values(spark):
    assert ordered.value_chunk(spark.createDataFrame([], "id long, v double"), None, "v", "id").count() == 0
    rows = [("a", i, None if i % 3 else 1.0) for i in range(9)] + [(None, 9, 2.0)]
    out = ordered.value_chunk(spark.createDataFrame(rows, "k string, id long, v double"), "k", "v").collect()
    assert len(out) == 10 and {r["__bucket"] for r in out if r.v is None} == {0}


@pytest.mark.parametrize(("k", "block"), [(50, 16), (7, 16), (400, 1 << 16)])
def test_windows_wider_than_a_chunk(spark, monkeypatch, k, block):
    """Chunks of eight rows: every row is an edge row, and the blocks of edge rows are shorter than the series."""
    monkeypatch.setattr(ordered, "EDGE_ROWS", block)
    rows = [(s, i, float((i * 7919 + len(s)) % 101)) for s, n in (("a", 300), ("bb", 70), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, t long, v double")

    def exprs(w):
        return {
            "total": F.sum("v").over(w.rowsBetween(-k, 3)),
            "high": F.max("v").over(w.rowsBetween(-k, 0)),
            "back": F.lag("v", k).over(w),
            "ahead": F.lead("v", 3).over(w),
        }

    got = {(r.s, r.t): r for r in ordered.neighbourhood(df, "s", "t", exprs, before=k, after=3, chunk=8).collect()}
    assert len(got) == len(rows)
    series = {s: [v for x, _, v in rows if x == s] for s in ("a", "bb", "c")}
    for s, i, _ in rows:
        v, r = series[s], got[s, i]
        assert r.total == sum(v[max(0, i - k) : i + 4]) and r.high == max(v[max(0, i - k) : i + 1])
        assert r.back == (v[i - k] if i >= k else None) and r.ahead == (v[i + 3] if i + 3 < len(v) else None)


def test_wide_windows_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "EDGE_ROWS", 64)
    df = spark.range(5000).select(F.lit("a").alias("s"), F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("v"))
    wide = ordered.neighbourhood(df, "s", "t", lambda w: {"m": F.avg("v").over(w.rowsBetween(-60, 0))}, before=60, chunk=8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in wide.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 5000 and len(sizes) > 1 and max(sizes) < 4000
