"""Language models: words against plain counts, the attention model against its definition, and held-out texts."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.conftest import odd_rows
from tidemark.llm import attention as A, language_model as L, queries

WORD = re.compile("[^\x20\x09-\x0d]+")
TOKENS = 300


def model(seed=0):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, TOKENS)
    of, slot = A.classes(counts)
    pairs = np.bincount(slot[rng.integers(0, TOKENS, 9000)] * A.SLOTS + slot[rng.integers(0, TOKENS, 9000)], minlength=A.SLOTS**2)
    prior = A.Prior(counts, of, slot, pairs.reshape(A.SLOTS, -1))
    weights = A.shaped(A.flat(A.start()) + rng.normal(0, 0.3, A.flat(A.start()).size))
    return weights, of, slot, prior


def slow_token(weights, of, slot, prior, before, token):
    """By the definition, from the ids before the token (the end that opens the text first)."""
    at = len(before) - 1
    seen = range(max(0, at // A.STRIDE * A.STRIDE - A.STRIDE), at + 1)
    x = {j: weights["embedding"][slot[before[j]]].astype(float) for j in seen}
    e = {
        j: math.exp((x[at] @ weights["query"]) @ (x[j] @ weights["key"]) / math.sqrt(A.WIDTH) + weights["distance"][at - j])
        for j in seen
    }
    read = sum(e[j] * (x[j] @ weights["value"]) for j in seen) / sum(e.values())
    logits = prior.classes[slot[before[at]]] + read @ weights["out"]
    return logits[of[token]] - math.log(np.exp(logits).sum()) + prior.slots[slot[before[at]], slot[token]] + prior.tokens[token]


@pytest.mark.parametrize("bounded", [True, False])
def test_scores_by_definition(bounded):
    rng = np.random.default_rng(1)
    weights, of, slot, prior = model()
    texts = [rng.integers(0, TOKENS, n) for n in (0, 1, 15, 16, 17, 31, 32, 33, 200, 0, 5000)]
    scorer = A.Scorer(weights, of, slot, prior)
    scorer.bounded = bounded
    got = scorer.scores(texts, 1)
    for text, score in zip(texts[:-1], got, strict=False):
        ids = [1, *text.tolist(), 1]
        want = sum(slow_token(weights, of, slot, prior, ids[:k], ids[k]) for k in range(1, len(ids)))
        assert score == pytest.approx(want, rel=1e-4, abs=1e-4)
    alone = A.Scorer(weights, of, slot, prior).scores(texts[-1:], 1)[0]
    assert got[-1] == pytest.approx(alone, rel=1e-6)


def test_probabilities_of_the_next_token_sum_to_one():
    rest = model()
    before = [1, *range(40)]
    assert sum(math.exp(slow_token(*rest, before, t)) for t in range(TOKENS)) == pytest.approx(1, abs=1e-4)


def test_gradients():
    rng = np.random.default_rng(2)
    weights, of, slot, prior = model()
    weights = {n: w.astype(float) for n, w in weights.items()}
    ids = rng.integers(0, TOKENS, (3, A.WINDOW + 1))
    mask = rng.random((3, A.WINDOW)) < 0.8
    given = (slot[ids[:, :-1]], prior.classes[slot[ids[:, :-1]]].astype(float), of[ids[:, 1:]], mask)
    _, grads = A.loss_and_gradients(weights, *given)
    for name, g in grads.items():
        for at in rng.choice(g.size, 6, replace=False):
            place, h = np.unravel_index(at, g.shape), 1e-5
            up, down = ({n: w.copy() for n, w in weights.items()} for _ in range(2))
            up[name][place] += h
            down[name][place] -= h
            slope = (A.loss_and_gradients(up, *given)[0] - A.loss_and_gradients(down, *given)[0]) / (2 * h)
            assert g[place] == pytest.approx(slope, rel=1e-3, abs=1e-7)


def train_doc(i):
    return crc32(("" if i is None else str(i)).encode()) % 5 != 1


def slow_base(rows):
    tokens = [[*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for _, t in rows]
    seen = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if train_doc(i) for w in ws)
    n, v = sum(seen.values()), len(seen)
    return [
        (i, not train_doc(i), len(ws), sum(seen[w] > 0 for w in ws), n, sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        for (i, _), ws in zip(rows, tokens, strict=True)
    ]


def check(got, rows):
    key = lambda r: (str(r[0]), r[2], r[3], r[5])
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    got = sorted((tuple(r[n] for n in names) for r in got), key=key)
    want = sorted(slow_base(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)


def test_query_and_held_out_texts(spark, small):
    got = queries.QUERIES["op13_language_model"](spark, SF).collect()
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    check(got, rows)
    # The model beats the subwords' frequencies on texts that it has not seen.
    pieces = L.known_pieces(L.VOCABULARY)
    ids = {i: [*np.frombuffer(pieces.ids(t or ""), "<u4").tolist(), 1] for i, t in rows}
    seen = Counter(x for i, xs in ids.items() if train_doc(i) for x in xs)
    total = sum(seen.values()) + 0.5 * 49_408
    held = [r for r in got if r["held_out"]]
    plain = sum(math.log10((seen[x] + 0.5) / total) for r in held for x in ids[r["doc_id"]])
    assert sum(r["score"] for r in held) > 0.9 * plain
    assert all(r["score"] < 0 for r in got)


@pytest.mark.parametrize("frequent", [1 << 18, 40])
def test_odd_rows(spark, odd, none, frequent):
    part = L.F.crc32(L.F.coalesce(L.F.col("doc_id").cast("string"), L.F.lit("")).cast("binary")) % 5 != 1
    got = L.scored(odd, part, frequent=frequent)
    assert set(odd.columns) < set(got.columns)
    got = got.collect()
    check(got, [(r[0], r[1]) for r in odd_rows()])
    scores = {}
    for r in got:
        assert scores.setdefault(r["text"] or "", r["score"]) == pytest.approx(r["score"], rel=1e-5)
    assert L.scored(none, part).count() == 0


def test_without_training_texts(spark, odd):
    got = L.scored(odd, L.F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["held_out"] and r["score"] < 0 for r in got)


def test_stride_gradients_are_those_of_overlapping_windows():
    rng = np.random.default_rng(3)
    weights, of, slot, prior = model()
    weights = {n: w.astype(float) for n, w in weights.items()}
    texts = [rng.integers(0, TOKENS, n) for n in (0, 15, 16, 70)]
    inputs, target, counts, opening, _ = A.laid(texts, 1)
    slots = slot[np.concatenate([np.full(A.STRIDE, 1), inputs])]
    got = A.stride_gradients(weights, slots, prior.classes[slots[A.STRIDE :]].astype(float), of[target], counts.astype(float), opening)
    want = {n: 0 for n in weights}
    for text in texts:
        ids = np.array([1, *text.tolist(), 1])
        for at in range(0, len(ids) - 1, A.STRIDE):
            first, last = max(0, at - A.STRIDE), min(at + A.STRIDE, len(ids) - 1)
            window = np.full(A.WINDOW + 1, 1)
            window[: last + 1 - first] = ids[first : last + 1]
            mask = np.zeros((1, A.WINDOW))
            mask[0, at - first : last - first] = 1
            given = (slot[window[None, :-1]], prior.classes[slot[window[None, :-1]]].astype(float), of[window[None, 1:]], mask)
            for name, g in A.loss_and_gradients(weights, *given)[1].items():
                want[name] = want[name] + g * mask.sum() / sum(len(t) + 1 for t in texts)
    for name, g in got.items():
        assert g == pytest.approx(want[name], rel=1e-6, abs=1e-12)


def test_training_looks_at_every_token_of_every_text():
    _, of, slot, prior = model()
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, TOKENS, n).astype(L.ID) for n in (9000, 0, 40)]

    class Model:
        value = (of, slot, prior)

    def weights(texts):
        batch = L.pa.record_batch([L.pa.array([t.tobytes() for t in texts], L.pa.binary())], ["ids"])
        (out,) = L._trained(iter([batch]), A.flat(A.start()), Model, 1)
        return out["n"][0].as_py(), out["total"].to_numpy()

    n, plain = weights(texts)
    assert n == sum(len(t) + 1 for t in texts)
    for text, place in [(0, 0), (0, 1234), (0, 4095), (0, 7777), (0, 8999), (2, 0), (2, 39)]:
        other = [t.copy() for t in texts]
        other[text][place] = (other[text][place] + 150) % TOKENS
        assert (weights(other)[1] != plain).any()


def test_gradients_where_exponents_are_large():
    rng = np.random.default_rng(5)
    weights, of, slot, prior = model()
    weights = {n: 4 * w.astype(float) for n, w in weights.items()}
    ids = rng.integers(0, TOKENS, A.STRIDE + 1)
    slots = np.concatenate([np.zeros(A.STRIDE, int), slot[ids[:-1]]])
    given = (prior.classes[slots[A.STRIDE :]].astype(float), of[ids[1:]], np.ones(A.STRIDE), np.array([True]))
    got = A.stride_gradients(weights, slots, *given)
    window = np.concatenate([slots[A.STRIDE :], np.zeros(A.STRIDE, int)])[None]
    target = np.concatenate([of[ids[1:]], np.zeros(A.STRIDE, int)])[None]
    mask = np.repeat([1.0, 0.0], A.STRIDE)[None]
    want = A.loss_and_gradients(weights, window, prior.classes[window].astype(float), target, mask)[1]
    for name, g in got.items():
        assert g == pytest.approx(want[name], rel=1e-6, abs=1e-12)


def test_frequent_words_are_not_hashed_anew_for_each_block(monkeypatch):
    def hashed(*_):
        raise AssertionError("all frequent words are hashed for a block")

    monkeypatch.setattr(L.pc, "index_in", hashed)

    class Frequent:
        value = L.pa.table({"word": ["a", "é"], "n": [3, 0]})

    texts = L.pa.array(["a A é b", None, ""])
    (out,) = L._read(iter([texts]), Frequent, 2, L.VOCABULARY)
    got = out.to_pylist()
    assert [(r["n_tokens"], r["n_known"], r["rare"]) for r in got] == [(5, 3, ["b"]), (1, 1, []), (1, 1, [])]
    assert got[0]["base"] == pytest.approx(2 * math.log10(3.5) + math.log10(0.5) + math.log10(2.5))
