"""Fingerprints, BK-trees and components against plain computations."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows
from tidemark.llm import simhash as S


def slow_fingerprint(text, width=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(points, radius=4):
    label = {p: p for p in points}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    for a, b in combinations(points, 2):
        if (a ^ b).bit_count() <= radius:
            label[find(a)] = find(b)
    groups = defaultdict(set)
    for p in points:
        groups[find(p)].add(p)
    return {frozenset(g) for g in groups.values()}


def clustered(n, seed):
    """Fingerprints in chains and crowds around a few centres, and alone."""
    rng = random.Random(seed)
    points = set()
    while len(points) < n:
        p = rng.getrandbits(64)
        for _ in range(rng.choice((1, 1, 1, 30))):
            points.add(p)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                p ^= 1 << b
    return sorted(points)


def as_signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**12])
def test_masks_lose_no_link(n):
    every = S.masks(n)
    rng = random.Random(1)
    for _ in range(300):
        bits = rng.sample(range(64), 4)
        assert any(not any(m >> b & 1 for b in bits) for m in every)
    assert all(m % (1 << 64) for m in every)


def test_forest_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    points = np.array(clustered(700, 3), np.uint64)
    rng.shuffle(points)
    unit = rng.integers(0, 3, len(points))
    forest = S.Forest(points, unit)
    got = {(int(q), int(p)) for a, b in forest.near(points, unit, 4) for q, p in zip(a, b, strict=True)}
    want = {
        (i, j) for i in range(len(points)) for j in range(len(points)) if unit[i] == unit[j] and int(points[i] ^ points[j]).bit_count() <= 4
    }
    assert got == want


@pytest.mark.parametrize("part_rows", [4096, 5])
def test_links_connect_what_all_pairs_connect(spark, part_rows):
    points = clustered(600, 4)
    distinct = spark.createDataFrame([(as_signed(p),) for p in points], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in S.components(S.links(distinct, part_rows=part_rows)).collect()}
    groups = defaultdict(set)
    for p in points:
        groups[roots.get(p, as_signed(p))].add(p)
    assert {frozenset(g) for g in groups.values()} == slow_components(points)


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(1, 61), 0) | dict.fromkeys(range(1001, 1050), 1000)


def test_documents(odd, small):
    for docs in (odd, small):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = S.near_duplicates(docs).collect()
        prints = {t: slow_fingerprint(t) for _, t in rows}
        root = {p: g for g in slow_components(sorted(set(prints.values()))) for p in g}
        least = {g: min((i for i, t in rows if prints[t] in g and i is not None), default=None) for g in set(root.values())}
        assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == sorted(
            (str(i), f"{prints[t]:016x}", least[root[prints[t]]]) for i, t in rows
        )
        kept = [r for r in got if r["kept"]]
        assert len(kept) == len(least) and all(r["doc_id"] == r["component_id"] for r in kept)


def test_copies_join_and_strangers_stay_apart(odd):
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(odd).collect()}
    assert got[1] == got[2] == 1 and {got[100 + k] for k in range(200)} == {100}
    assert got[4] == got[5] == 4
    assert len({got[400 + k] for k in range(60)}) > 50
    assert [text for i, text, _ in odd_rows() if i == 9] == ["a"]


def test_empty(none):
    assert S.near_duplicates(none).count() == 0
    assert none.select(F.lit(1)).count() == 0
