"""Plans of a few heavy lengths against their known optimum."""

from collections import defaultdict

import pytest

from tidemark.llm import packing


@pytest.mark.parametrize(
    ("counts", "optimum"),
    [
        ({1638: 6000, 1229: 12000}, 6000),
        ({1638: 60, 1229: 120}, 60),
        ({2048: 500, 1366: 500, 682: 500}, 500),
        ({1500: 1000, 1300: 1000, 1296: 1000}, 1000),
        ({700: 3000, 650: 3000}, 1000),
    ],
)
def test_heavy_lengths_reach_the_optimum(counts, optimum):
    plan = packing.fewest(counts)
    placed, used = defaultdict(int), defaultdict(int)
    for length, first, last, sequence, per, _ in plan.runs:
        placed[length] += last - first
        for k in range(last - first):
            used[sequence + k // per] += length
    assert placed == counts and max(used.values()) <= packing.CAPACITY
    assert plan.sequences == len(used) == optimum


def test_the_rows_follow_the_best_plan(spark):
    rows = [(k, 0, 1638 if k < 300 else 1229, k) for k in range(900)]
    out = packing.pack(spark.createDataFrame(rows, "id long, piece int, length int, ids_crc32 long"))
    assert out.select("sequence_id").distinct().count() == 300


def test_never_worse_than_the_plan_of_long_lengths_alone():
    counts = {n: 1 + (n * 7919) % 40 for n in range(1, 4097, 3)}
    assert packing.fewest(counts).sequences <= packing.Plan(counts).sequences
