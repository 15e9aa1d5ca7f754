"""Mixing, sharding and exact dedup against plain computations."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows
from tidemark.llm.exact_dedup import exact_groups
from tidemark.llm.mixing import emitted, mix, targets
from tidemark.llm.sharding import shard, slot_loads, slot_map

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reshared(sizes, cap=3):
    """Targets by handing on, round by round, what is above a cap."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in sizes if s not in capped)
        target = {s: cap * sizes[s] if s in capped else rest * weight[s] / open_ for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_targets_and_totals(odd):
    out = mix(odd).collect()
    want = defaultdict(int)
    for _, text, source in odd_rows():
        want[source] += len(WORD.findall(text or ""))
    target = reshared(want)
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in odd_rows())
    taken, largest = Counter(), Counter()
    for r in out:
        assert r["source_size"] == want[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= max(largest[source], 1)


def test_mix_reruns_agree_and_cells_can_be_cut(odd):
    runs = [
        sorted((str(r["doc_id"]), r["size"], r["copies"]) for r in mix(odd.repartition(n), cell_rows=cell, reread=again).collect())
        for n, cell, again in ((3, 100_000, False), (7, 10, True))
    ]
    assert runs[0] == runs[1]
    assert mix(odd).columns[:4] == ["doc_id", "text", "source", "kept"]


def test_mix_comes_near_the_target_with_large_documents(spark):
    rows = [(k, "w " * (20_000 if k % 97 == 0 else k % 50 + 1), f"s{k % 3}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mix(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect():
        assert abs(r["k"] - r["t"]) < 0.02 * r["t"]


def test_targets_of_one_source_and_of_none(spark):
    kind = "source string, source_size long"
    assert targets(spark.createDataFrame([("a", 10)], kind)).collect()[0]["target"] == 10
    assert targets(spark.createDataFrame([("a", 0), (None, 0)], kind)).agg(F.sum("target")).first()[0] == 0


def test_emitted_repeats_documents(odd):
    mixed = mix(odd, carry=["doc_id"]).cache()
    assert emitted(mixed, ["doc_id"]).count() == mixed.agg(F.sum("copies")).first()[0]


def test_shards_hold_near_equal_bytes(odd, small):
    for docs, slots in ((odd, 8192), (small, 64)):
        rows, _ = shard(docs, 8, slots)
        got = rows.collect()
        assert len(got) == docs.count()
        load, place = Counter(), defaultdict(list)
        for r in got:
            raw = (r["text"] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
            load[r["shard"]] += r["size"]
            place[r["shard"]].append(r["slot"])
        assert set(load) <= set(range(8))
        assert all(sorted(p) == list(range(len(p))) for p in place.values())
        heaviest = max(Counter(r["virtual_slot"] for r in got))
        by_slot = Counter()
        for r in got:
            by_slot[r["virtual_slot"]] += r["size"]
        assert heaviest < slots
        assert max(load.values()) - min(load.get(s, 0) for s in range(8)) <= max(by_slot.values())


def test_slot_map_is_greedy_and_edits_move_little(spark):
    loads = spark.createDataFrame([(k, (k * 7919) % 1000 + 1, 1) for k in range(500)], "virtual_slot int, bytes long, rows long")
    first = {r["virtual_slot"]: r for r in slot_map(loads, 8).collect()}
    want, light = {}, [0] * 8
    for r in sorted(loads.collect(), key=lambda r: (-r["bytes"], r["virtual_slot"])):
        want[r["virtual_slot"]] = light.index(min(light))
        light[want[r["virtual_slot"]]] += r["bytes"]
    assert {k: r["shard"] for k, r in first.items()} == want
    assert {r["version"] for r in first.values()} == {1}
    old = spark.createDataFrame(list(first.values()))
    second = {r["virtual_slot"]: r for r in slot_map(loads, 9, old).collect()}
    bytes_ = {r["virtual_slot"]: r["bytes"] for r in loads.collect()}
    moved = sum(bytes_[k] for k in second if second[k]["shard"] != first[k]["shard"])
    assert {r["version"] for r in second.values()} == {2}
    assert moved < 0.15 * sum(bytes_.values())
    light = Counter()
    for k, r in second.items():
        light[r["shard"]] += bytes_[k]
    assert max(light.values()) - min(light.values()) <= max(bytes_.values()) and len(light) == 9
    gone = {r["shard"] for r in slot_map(loads, 7, old).collect()}
    assert gone == set(range(7))


def test_slot_loads(spark):
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "virtual_slot int, size long")
    assert {tuple(r) for r in slot_loads(rows).collect()} == {(1, 11, 2), (2, 7, 1)}


def brute_groups(rows):
    fold = {i: (t or "").translate({c: c + 32 for c in range(65, 91)}) for i, (_, t, _) in enumerate(rows)}
    groups = defaultdict(list)
    for i, t in fold.items():
        groups[t].append(i)
    return groups


def test_exact_groups(odd, small):
    plain = [(r["doc_id"], r["text"], r["source"]) for r in small.collect()]
    deep = [(k, "p" * 70_000 + tail, "d") for k, tail in enumerate(("x" * 9000, "x" * 8999 + "y", "x" * 9000, "z"))]
    frames = ((odd, odd_rows()), (small, plain), (small.sparkSession.createDataFrame(deep, "doc_id long, text string, source string"), deep))
    for docs, rows in frames:
        got = exact_groups(docs).collect()
        assert len(got) == len(rows)
        want = []
        for text, members in brute_groups(rows).items():
            ids = [rows[i][0] for i in members]
            keep = max((i for i in ids if i is not None), default=None)
            want += [(rows[i][0], keep, len(members), sha256(text.encode()).hexdigest()) for i in members]
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter(want)
        kept = Counter(r["text_sha256"] for r in got if r["kept"])
        assert set(kept.values()) == {1} and len(kept) == len(brute_groups(rows))
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_empty_tables(none):
    assert mix(none).count() == 0
    assert shard(none)[0].count() == 0
    assert exact_groups(none).count() == 0
