"""Merges and sweeps in time order against plain loops, over gaps, open ends, stray times and dense sides."""

import datetime as dt
import random
from itertools import pairwise

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.operators import joins

T0 = dt.datetime(2024, 1, 1)
MINUTE = 60_000_000
FAR = [-8 * 365 * 1440, 0, 500, 3 * 365 * 1440, 3 * 365 * 1440 + 30]


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def times(rng, n):
    """Minutes in bursts that lie years apart."""
    return [rng.choice(FAR) + rng.randint(0, 120) for _ in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 60), st.booleans()), max_size=30))
def test_open_ranges_keep_the_winner(events):
    held, every = joins.Open(), []
    for t, (order, more, ask) in enumerate(events):
        held.add((order, t), t + more, (order, t))
        every.append((order, t, t + more))
        if ask:
            held.expire(t)
            live = [(o, s) for o, s, e in every if e > t]
            assert held.label() == ((max(live),) if live else (None,))


@pytest.mark.parametrize("bits", [2, 3, 6])
def test_nodes_cover_a_span_once(spark, bits):
    rng = random.Random(bits)
    spans = [(a, a + rng.choice([-1, 0, 1, 5, 63, 64, 65, 4000, 10**7])) for a in [rng.randint(-(10**6), 10**6) for _ in range(40)]]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)], "i int, a long, b long")
    got = df.select("i", F.explode(joins._cover("a", "b", bits)).alias("n")).select("i", "n.*").collect()
    for i, (a, b) in enumerate(spans):
        nodes = sorted((r.node << bits * r.level, (r.node + 1) << bits * r.level) for r in got if r.i == i)
        assert sum(hi - lo for lo, hi in nodes) == max(0, b - a + 1)
        assert all(x[1] == y[0] for x, y in pairwise(nodes))
        assert not nodes or (nodes[0][0], nodes[-1][1]) == (a, b + 1)
        assert len(nodes) <= 2 * (2**bits) * (27 // bits + 1)


@pytest.mark.parametrize("width", [20 * MINUTE, joins.DAY_US])
def test_nearest_asof_over_gaps(spark, width):
    rng = random.Random(2)
    points = [(rng.choice(["a", "b", None]), t, rng.randint(0, 9)) for t in times(rng, 120)] + [("a", 100 * 365 * 1440, 1)]
    reads = [(i, rng.choice(["a", "b", "c", None]), t) for i, t in enumerate(times(rng, 200))]
    right = spark.createDataFrame([(k, at(t), p) for k, t, p in points] + [("a", None, 5)], "k string, at timestamp_ntz, p int")
    left = spark.createDataFrame([(i, k, at(t)) for i, k, t in reads] + [(900, "a", None)], "i int, k string, ts timestamp_ntz")
    got = {r.i: r.p for r in joins.nearest_asof(left, right, "ts", "at", "p", by="k", width_us=width).collect()}
    assert len(got) == 201 and got[900] is None
    for i, k, t in reads:
        near = [(abs(u - t), u, -p) for j, u, p in points if j == k and k is not None]
        assert got[i] == (-min(near)[2] if near else None)


def test_merge_is_linear(spark):
    """A gap of ten years and a stray time cost one row each: nothing is exploded, and no side is cut into buckets."""
    left = spark.createDataFrame([(i, at(i)) for i in range(50)] + [(99, at(5_256_000))], "i int, ts timestamp_ntz")
    right = spark.createDataFrame([(at(0), 1), (at(-5_256_000), 2)], "at timestamp_ntz, p int")
    plan = joins.nearest_asof(left, right, "ts", "at", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize("width", [30 * MINUTE, joins.DAY_US])
@pytest.mark.parametrize("order", [True, False])
def test_interval_label_with_open_ends(spark, width, order):
    rng = random.Random(5)
    spans = [(i, rng.choice("ab"), t, t + rng.choice([0, 1, 40, 90, 3000])) for i, t in enumerate(times(rng, 60))]
    if order:
        spans += [(200 + i, "a", t, None) for i, t in enumerate((100, -500))]
    else:
        spans = [(i, "a", 100 * i, 100 * i + rng.choice([0, 50, 98])) for i in range(30)]
    end = dt.datetime(9999, 12, 31)
    ranges = spark.createDataFrame(
        [(o % 50 if order else o, f"r{o}", k, at(a), end if b is None else at(b)) for o, k, a, b in spans],
        "o int, label string, k string, lo timestamp_ntz, hi timestamp_ntz",
    )
    reads = [(i, rng.choice("abc"), t) for i, t in enumerate(times(rng, 150) + list(range(0, 3000, 37)))]
    edges = [(k, t) for _, k, a, b in spans for t in (a, a if b is None else b)]
    reads += [(1000 + i, k, t) for i, (k, t) in enumerate(edges)]
    df = spark.createDataFrame([(i, k, at(t)) for i, k, t in reads] + [(5000, "a", None)], "i int, k string, ts timestamp_ntz")
    got = joins.interval_label(df, ranges, "ts", "lo", "hi", "label", by="k", order="o" if order else None, width_us=width)
    got = {r.i: r.label for r in got.collect()}
    assert len(got) == len(reads) + 1 and got[5000] is None
    for i, k, t in reads:
        live = [((o % 50, a) if order else 0, f"r{o}") for o, j, a, b in spans if j == k and a <= t and (b is None or t <= b)]
        best = {x for key, x in live if key == max(live)[0]}
        assert got[i] in best if live else got[i] is None


@pytest.mark.parametrize("width", [30 * MINUTE, joins.DAY_US])
def test_range_join_with_open_ends(spark, width):
    rng = random.Random(6)
    spans = [(i, t, t + rng.choice([-5, 0, 1, 40, 90, 3000, 9_000_000])) for i, t in enumerate(times(rng, 50))] + [(90, 0, None)]
    end = dt.datetime(9999, 12, 31)
    ranges = spark.createDataFrame(
        [(o, at(a), end if b is None else at(b)) for o, a, b in spans], "o int, lo timestamp_ntz, hi timestamp_ntz"
    )
    reads = list(enumerate(times(rng, 150)))
    df = spark.createDataFrame([(i, at(t)) for i, t in reads], "i int, ts timestamp_ntz")
    got = sorted((r.i, r.o) for r in joins.range_join(df, ranges, "ts", "lo", "hi", width_us=width).collect())
    assert got == sorted((i, o) for i, t in reads for o, a, b in spans if a <= t and (b is None or t <= b))
    spans = ranges.select("o", joins.micros(F.col("lo")).alias("__lo"), joins.micros(F.col("hi")).alias("__hi"))
    assert joins._pieces(spans.filter("o = 90"), joins.DAY_US, 3).count() <= 2 + 2 * 8 * 10


@pytest.mark.parametrize("shape", ["hot", "ramp", "mixed"])
@pytest.mark.parametrize("width", [7 * MINUTE, joins.DAY_US])
def test_time_to_settle(spark, shape, width):
    rng = random.Random(7)
    rows = []
    for i, t in enumerate(sorted(times(rng, 400))):
        if shape == "hot":
            s, y = rng.choice([20.0, 20.0, 20.1]), 20 + rng.uniform(-0.6, 0.6)
        elif shape == "ramp":
            s, y = 15 + i * 0.01, 15 + i * 0.01 - rng.uniform(0, 3)
        else:
            s, y = rng.choice([10.0, 12.5, -3.0]), rng.choice([None, rng.uniform(-5, 15), 10.5, 9.5, 12.0])
        rows.append((i, rng.choice(["a", "b"]), t, s, y))
    df = spark.createDataFrame([(i, k, at(t), s, y) for i, k, t, s, y in rows], "i int, k string, ts timestamp_ntz, s double, y double")
    got = joins.time_to_settle(df, "k", ["ts", "i"], "ts", "s", "y", 0.5, width_us=width).collect()
    want = []
    for k in "ab":
        own = sorted((t, i, s, y) for i, j, t, s, y in rows if j == k)
        for (_, _, s0, _), (t, _, s, _) in pairwise(own):
            if s != s0:
                near = [u for u, _, _, y in own if u > t and y is not None and abs(y - s) <= 0.5]
                want.append((k, at(t), s, 60.0 * (min(near) - t) if near else None))
    key = lambda r: (r[0], r[1], r[2], r[3] is None, r[3] or 0)
    assert len(want) > 50
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
