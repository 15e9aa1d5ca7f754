"""Token ids, packing and training order against the tokenizer itself and plain checks of the output."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.conftest import SF
from tidemark.llm import packing, queries, tokens, training_order as O


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.vocabulary_path())


@pytest.fixture(scope="module")
def known():
    return tokens.Pieces(tokens.vocabulary_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


CASES = [
    "", " ", "a\x1cb c", "x\x85y\xa0z", "é̈ é ẞ İSTANBUL ŒUVRE ﬁ ①", "<|endoftext|>a b<|startoftext|>", "don't WE'LL ''s 's_'t 'RE",
    "日本語 テスト 안녕 hi​there z", "αΣ ΑΣ.", "²³¹ ½ x² _a_1 µ ª", "́abc ̈x", "🙂🙂a 🙂", "a.b, c... d.\" e.\n", "word. Word, WORD;",
    "end.", "1234 5,6 7.", "a b　c", "ÀÖØÞßÿ÷×",
]


def test_ids_are_the_tokenizers(tokenizer, known):
    got = list(known.of_block(CASES))
    for text, ids in zip(CASES, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(tokenizer, text), repr(text)
        assert known.ids(text) == ids


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="aBé'sdl.,!19 \n\t\xa0\x1c<|œÉ", max_size=30))
def test_ids_of_any_text(text):
    known = tokens.known_pieces(tokens.VOCABULARY)
    assert np.frombuffer(next(known.of_block([text])), "<u4").tolist() == known.whole.encode(text, add_special_tokens=False).ids


def check_packed(rows, expected, capacity):
    """Every piece of every document once, in sequences laid without gaps."""
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for doc_id, ids in expected:
        ids = [*ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[doc_id].append((k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for laid in places.values():
        at = 0
        for offset, length in sorted(laid):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_query(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = queries.op5_packing(spark, SF).collect()
    used = check_packed(rows, [(r["doc_id"], ids_of(tokenizer, r["text"])) for r in docs], 4096)
    assert used <= -(-sum(r["length"] for r in rows) // 4096) * 1.02 + 1


def test_packing_odd_rows(odd, none, tokenizer):
    rows = packing.packed_documents(odd, capacity=64).collect()
    check_packed(rows, [(r["doc_id"], ids_of(tokenizer, r["text"])) for r in odd.collect()], 64)
    assert rows[0].__fields__[:5] == ["doc_id", "text", "source", "size", "kept"]
    assert packing.packed_documents(none).count() == 0


def test_packing_cut_cells_and_sequences(odd, tokenizer):
    placed = packing.packed_documents(odd, capacity=128, carry=["doc_id"], with_ids=True)
    found = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert found[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    rows = odd.sparkSession.createDataFrame(
        [(k, 0, 100 if k % 3 else 7, k) for k in range(3000)], "id long, piece int, length int, ids_crc32 long"
    )
    out = packing.pack(rows, 256, cell_rows=50).collect()
    ends = defaultdict(list)
    for r in out:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(out) == 3000
    for laid in ends.values():
        laid.sort()
        assert laid[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(laid, laid[1:], strict=False)) and sum(laid[-1]) <= 256


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30), st.sampled_from([2, 4, 8]), st.sampled_from([3, 8]))
def test_plan_places_all_within_capacity(counts, long, groups):
    plan = packing.Plan(counts, 64, long, groups)
    cells = defaultdict(list)
    for length, first, last, sequence, per, at in plan.runs:
        for rank in range(first, last):
            k = rank - first
            cells[sequence + k // per].append((at + k % per * length, length, rank))
    seen = defaultdict(set)
    for laid in cells.values():
        at = 0
        for offset, length, rank in sorted(laid):
            assert offset == at and rank not in seen[length]
            seen[length].add(rank)
            at += length
        assert at <= 64
    assert {k: len(v) for k, v in seen.items()} == counts
    assert set(cells) == set(range(plan.sequences))
    total = sum(n * c for n, c in counts.items())
    assert plan.sequences <= 2 * -(-total // 64) + 1


def test_knapsack_and_configurations():
    value, config = packing.best_knapsack(np.array([7, 5, 3]), np.array([0.7, 0.52, 0.29]), 11)
    best = max(a * 0.7 + b * 0.52 + c * 0.29 for a in range(2) for b in range(3) for c in range(4) if 7 * a + 5 * b + 3 * c <= 11)
    assert value == pytest.approx(best) and 7 * config[0] + 5 * config[1] + 3 * config[2] <= 11
    found = packing.configurations([6, 5, 4], [100, 60, 140], 10)
    assert [sum(t * c[k] for t, c in found) for k in range(3)] == [100, 60, 140]
    assert sum(t for t, _ in found) == 150


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    there = O.permuted(np.arange(n), n, 17)
    assert sorted(there.tolist()) == list(range(n))
    assert O.permuted(there, n, 17, back=True).tolist() == list(range(n))
    if n > 60:
        assert there.tolist() != O.permuted(np.arange(n), n, 18).tolist()
        assert abs(np.corrcoef(np.arange(n), there)[0, 1]) < 0.4


def test_training_order_files(spark, odd, tokenizer):
    manifest = O.write_training_order(odd, key=3, length=32, shard_rows=100).cache()
    got = O.read_training_order(manifest, 32, 100).collect()
    want = []
    for r in odd.collect():
        ids = [*ids_of(tokenizer, r["text"]), 1]
        for k in range(0, len(ids), 32):
            part = ids[k : k + 32]
            want.append((str(r["doc_id"]), k // 32, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert sorted(r["slot"] for r in got) == list(range(len(want)))
    assert all(r["shard"] == r["slot"] // 100 for r in got)
    for m in manifest.collect():
        whole = np.concatenate(list(O.read_records(m["file"], 32)))
        assert len(whole) == m["rows"] and whole.nbytes == m["bytes"] and zlib.crc32(whole.tobytes()) == m["crc32"]
        rest = np.concatenate(list(O.read_records(m["file"], 32, first=m["rows"] // 2, block=7)))
        assert rest.tobytes() == whole[m["rows"] // 2 :].tobytes()


def test_training_order_of_nothing(none):
    manifest = O.write_training_order(none)
    assert manifest.count() == 0 and O.read_training_order(manifest).count() == 0


def test_training_order_query(spark):
    rows = queries.op9_training_order(spark, SF).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))


def test_training_order_of_a_shuffled_input(spark, odd):
    """Adaptive execution may coalesce a shuffled input as it likes, and the table may be split anew between passes."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        mixed = odd.unionByName(odd).repartition("source").filter("doc_id IS NULL OR doc_id >= 0")
        got = O.read_training_order(O.write_training_order(mixed, length=32, shard_rows=100), 32, 100)
        want = O.read_training_order(O.write_training_order(odd, length=32, shard_rows=100, width=4), 32, 100, width=4)
        slots = sorted(r["slot"] for r in got.select("slot").collect())
        assert slots == list(range(2 * want.count())) and len(slots) > 0
        own = ["doc_id", "piece", "length", "ids_crc32"]
        assert got.select(own).exceptAll(want.select(own).unionAll(want.select(own))).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_training_order_bundles_are_small():
    """What is shuffled takes little more than half of the ids of sequences that share words."""
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 49_000, 12, "<u2") for _ in range(300)]
    ids = [np.concatenate([words[w] for w in rng.integers(0, 300, 40)]).tobytes() for _ in range(500)]
    columns = [np.arange(500), np.arange(500), np.zeros(500, np.int32), np.full(500, 480, np.int32), O.pa.array(ids, O.pa.binary())]
    batch = O.pa.record_batch([O.pa.array(c) for c in columns], ["number", "id", "piece", "length", "ids"])
    (out,) = O._bundled(500, 3, 128, 2)(iter([batch]))
    assert out["shard"].to_pylist() == [0, 1, 2, 3] and out["n"].to_pylist() == [128, 128, 128, 116]
    assert sum(map(len, out["data"].to_pylist())) < 0.55 * sum(map(len, ids))
