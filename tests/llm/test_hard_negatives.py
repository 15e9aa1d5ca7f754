"""Hard negatives against a plain search over all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.hard_negatives import hard_negatives
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, score string, anchor string, rid string"


def slow_negatives(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    rows = [
        (i, [math.floor(256 * x) for x in v], y)
        for i, v, y in rows
        if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for k, (i, v, y) in enumerate(rows):
        if i is None or not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j, z) for n, (j, w, z) in enumerate(rows) if n != k]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4] == y][:positives]:
            window = [s for s in scored if s[4] != y and low * -p[0] <= 100 * -s[0] <= high * -p[0]][:negatives]
            out += [(i, p[3], r, s[3], -p[0], -s[0]) for r, s in enumerate(window, 1)]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "s", "a", "r") for r in rows], SCHEMA).repartition(3)


def cases():
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.randrange(4)) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.5] + [0.0] * 6, i % 3) for i in range(150)]  # one very common vector
    rows += [(50, [0.3] * 8, 1), (50, [0.3] * 8, 1), (50, [0.3] * 8, 2)]  # repeated ids
    rows += [(None, [0.9] * 8, 1), (2000, None, 1), (2001, [0.1] * 8, None), (2050, [0.5, None], 1), (2100, [math.nan] * 8, 1)]
    rows += [(2150, [math.inf, 0.0], 1), (2200, [], 1), (2250, [0.7, 0.2], 2), (2300, [0.0] * 8, 3), (2301, [0.0] * 8, 3)]
    rows += [(2350, [float(1 << 22)] * 3, 1), (2351, [float(1 << 21)] * 3, 2), (2352, [float(1 << 22)] * 3, 1)]
    return rows


@pytest.mark.parametrize(("anchors", "group"), [(1024, 1 << 14), (5, 40)])
def test_all_rows(spark, anchors, group):
    rows = cases()
    rounded = [(i, None if v is None else [None if x is None else float(F32(x)) for x in v], y) for i, v, y in rows]
    df = vectors(spark, rounded)
    got = hard_negatives(df, F.col("vec_id") % 50 == 0, block_anchors=anchors, group_rows=group).collect()
    assert sorted(map(tuple, got), key=str) == slow_negatives(rounded, lambda i: i % 50 == 0)


def F32(x):
    import numpy as np

    return np.float32(x)


def test_beyond_a_long(spark):
    rows = [(0, [1e18, 1e18], 1), (1, [1e18, 1e18], 1), (2, [1e18, 1e17], 2), (3, [1.0, 1.0], 2)]
    got = hard_negatives(vectors(spark, rows), F.col("vec_id") == 0).collect()
    assert all(r["positive_score"] == (1 << 63) - 2 for r in got)


def test_empty_and_no_anchor(spark):
    assert hard_negatives(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives(vectors(spark, [(1, [1.0], 1)]), F.col("vec_id") % 50 == 0).count() == 0


def test_query(spark):
    rows = [
        (r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"])
        for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ]
    got = queries.QUERIES["op11_hard_negatives"](spark, SF)
    want = slow_negatives(rows, lambda i: i % 50 == 0)
    assert len(want) > 50
    assert sorted(map(tuple, got.collect()), key=str) == want
