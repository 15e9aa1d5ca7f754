"""A small causal self-attention model over token ids, in numpy: training on whole texts, and scoring them.

The probability of a token is that of its class, given the tokens before it, times that of the token in its class, given
the last token. The most frequent tokens are classes of their own; the others share classes of about equal weight. A
class's logits are the logarithm of its smoothed frequency behind the last token plus what one head of causal
self-attention reads from the last ``WINDOW`` tokens, with a learned bias per distance. Frequencies are counted over the
whole corpus. Tokens are told apart by slots: the most frequent have one of their own, the others share one per class.

Training and scoring cut a text into strides of ``STRIDE`` tokens. Each stride is one row of a batch and sees the tokens of the
stride before as context; a mask hides later tokens and everything before the text. So windows overlap by half, each token
is a target once, and it sees at least ``STRIDE`` tokens before it where the text has them. Projections depend on a token
alone and are looked up.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLASSES, OWN = 64, 32
WIDTH, WINDOW, STRIDE = 16, 32, 16
#: Embeddings and rows of frequencies.
SLOTS = 2048
HIDDEN = -1e9
#: Strides that are taken at once; rows of a part of a long product, which stays in the processor's cache.
AT_ONCE = 256
PART = 128
#: Weight of the wider distribution in a smoothed one, in tokens.
SMOOTHING = 5.0
#: Bytes of a block that stays with the process when it is freed.
KEPT = 24 << 20
#: Training: strides a step, step size.
STEP_STRIDES, RATE = 256, 0.02


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and embedding slot of each token, by the tokens' counts."""
    order = np.argsort(-counts, kind="stable")
    of, slot = np.empty(len(counts), np.int64), np.empty(len(counts), np.int64)
    of[order[:OWN]] = np.arange(OWN)
    rest = order[OWN:]
    weight = np.cumsum(counts[rest] + 0.5)
    of[rest] = OWN + np.minimum((weight * (CLASSES - OWN) / weight[-1]).astype(np.int64), CLASSES - OWN - 1)
    own = SLOTS - CLASSES
    slot[order[:own]] = np.arange(min(own, len(order)))
    slot[order[own:]] = own + of[order[own:]]
    return of, slot


class Prior:
    """Smoothed logarithms of the corpus's counts: class behind a slot, slot in its class behind a slot, token in its slot."""

    def __init__(self, counts: np.ndarray, of: np.ndarray, slot: np.ndarray, pairs: np.ndarray):
        """``pairs`` (slots x slots) counts which slot comes behind which."""
        share = counts + 0.5
        of_slot, of_class = np.bincount(slot, share, SLOTS), np.bincount(of, share, CLASSES)
        home = np.zeros(SLOTS, np.int64)
        home[slot] = of
        behind = np.stack([np.bincount(home, row, CLASSES) for row in pairs])
        wide = of_class / of_class.sum()
        self.classes = np.log((behind + SMOOTHING * wide) / (behind.sum(axis=1, keepdims=True) + SMOOTHING)).astype(np.float32)
        inside = np.maximum(of_slot, 1e-9) / of_class[home]
        self.slots = np.log((pairs + SMOOTHING * inside) / (behind[:, home] + SMOOTHING)).astype(np.float32)
        self.tokens = np.log(share / of_slot[slot]).astype(np.float32)


def start(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return {
        "embedding": small(SLOTS, WIDTH),
        "query": small(WIDTH, WIDTH),
        "key": small(WIDTH, WIDTH),
        "value": small(WIDTH, WIDTH),
        "distance": np.zeros(WINDOW, np.float32),
        "out": np.zeros((WIDTH, CLASSES), np.float32),
    }


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights.values()])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, w in start().items():
        out[name] = values[at : at + w.size].reshape(w.shape).astype(np.float32)
        at += w.size
    return out


BEFORE = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]


def loss_and_gradients(weights: dict, slots: np.ndarray, prior: np.ndarray, target: np.ndarray, mask: np.ndarray):
    """Mean negative log likelihood of the target classes of windows (batch x WINDOW), and its gradients."""
    x = weights["embedding"][slots]
    q, k, v = (x @ weights[n] for n in ("query", "key", "value"))
    scale = np.float32(WIDTH**-0.5)
    a = q @ k.transpose(0, 2, 1) * scale + weights["distance"][np.maximum(BEFORE, 0)]
    a = np.where(BEFORE >= 0, a, np.float32(HIDDEN))
    a = np.exp(a - a.max(axis=2, keepdims=True))
    a /= a.sum(axis=2, keepdims=True)
    seen = a @ v
    logits = prior + seen @ weights["out"]
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    n = max(mask.sum(), 1)
    b, t = np.nonzero(mask)
    loss = -np.log(p[b, t, target[b, t]]).sum() / n
    g = p
    g[b, t, target[b, t]] -= 1
    g *= (mask / np.float32(n))[:, :, None]
    flat_of = lambda m: m.reshape(-1, m.shape[-1])
    g_seen = g @ weights["out"].T
    g_v = a.transpose(0, 2, 1) @ g_seen
    g_a = g_seen @ v.transpose(0, 2, 1)
    g_s = a * (g_a - (g_a * a).sum(axis=2, keepdims=True))
    g_q, g_k = g_s @ k * scale, g_s.transpose(0, 2, 1) @ q * scale
    g_x = g_q @ weights["query"].T + g_k @ weights["key"].T + g_v @ weights["value"].T
    g_e = np.zeros_like(weights["embedding"])
    np.add.at(g_e, slots.ravel(), flat_of(g_x))
    by_distance = np.bincount(np.maximum(BEFORE, 0).ravel(), np.where(BEFORE >= 0, g_s.sum(axis=0), 0).ravel(), WINDOW)
    return loss, {
        "embedding": g_e,
        "query": flat_of(x).T @ flat_of(g_q),
        "key": flat_of(x).T @ flat_of(g_k),
        "value": flat_of(x).T @ flat_of(g_v),
        "distance": by_distance.astype(x.dtype),
        "out": flat_of(seen).T @ flat_of(g),
    }


def laid(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts in whole strides, one behind another: input ids, target ids, which places count, which strides open a text,
    and each text's first place. An end stands before each text and behind it."""
    sizes = np.array([len(t) + 1 for t in texts])
    strides = -(-sizes // STRIDE)
    first = np.cumsum(strides) - strides
    total = int(strides.sum())
    ids = np.full(total * STRIDE + 1, end, np.int64)
    for text, at in zip(texts, (first * STRIDE).tolist(), strict=True):
        ids[at + 1 : at + 1 + len(text)] = text
    # A text's first input is an end: the place behind it may hold the end of the text before.
    inputs = ids[:-1].copy()
    inputs[first * STRIDE] = end
    target = ids[1:].copy()
    target[first * STRIDE + sizes - 1] = end
    place = np.arange(total * STRIDE) - np.repeat(first * STRIDE, strides * STRIDE)
    counts = place < np.repeat(sizes, strides * STRIDE)
    opening = np.zeros(total, bool)
    opening[first] = True
    return inputs, target, counts, opening, first * STRIDE


#: Rows are the queries of a stride, columns its keys: the stride before, then its own.
STRIDE_BEFORE = STRIDE + np.arange(STRIDE)[:, None] - np.arange(2 * STRIDE)[None, :]


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of each stride's rows with the rows of the stride before and of its own."""
    return left @ np.ascontiguousarray(_windows(right).transpose(0, 2, 1))


def _crossed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left.T @ right`` in parts that stay in the processor's cache."""
    whole = len(left) // PART * PART
    parts = left[:whole].reshape(-1, PART, left.shape[1]).transpose(0, 2, 1) @ right[:whole].reshape(-1, PART, right.shape[1])
    return parts.sum(axis=0) + left[whole:].T @ right[whole:]


def _longest(rows: np.ndarray) -> float:
    return np.sqrt(((rows * rows) @ np.ones(rows.shape[1], rows.dtype)).max())


def _spread(weight: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Adds what the queries' ``rows`` give to the keys of the stride before and of their own."""
    part = weight.transpose(0, 2, 1) @ rows
    out[:-1] += part[:, :STRIDE]
    out[1:] += part[:, STRIDE:]


def _windows(rows: np.ndarray) -> np.ndarray:
    """Each stride but the first behind the one before, without a copy."""
    step = rows.strides[1]
    return np.lib.stride_tricks.as_strided(rows, (len(rows) - 1, 2 * STRIDE, WIDTH), (STRIDE * step, step, rows.strides[2]))


#: Places of the embeddings' numbers by slot.
CELLS = np.arange(SLOTS * WIDTH).reshape(SLOTS, WIDTH)


def stride_gradients(weights: dict, slots: np.ndarray, prior: np.ndarray, target: np.ndarray, mask: np.ndarray, opening: np.ndarray) -> dict:
    """Gradients as of :func:`loss_and_gradients`, each place seen as in scoring: strides that follow one another, the
    stride before the first of them ahead in ``slots``. Rows are divided by their sums where they are narrowest."""
    n, to_query = len(opening), weights["query"] * np.float32(WIDTH**-0.5)
    x = weights["embedding"].take(slots, axis=0)
    every = x[STRIDE:] @ to_query, x @ weights["key"], x @ weights["value"]
    longest = [_longest(m) for m in every]
    q, k, v = (m.reshape(-1, STRIDE, WIDTH) for m in every)
    reach = longest[0] * longest[1] + np.abs(weights["distance"]).max()
    reach_out = longest[2] * np.sqrt((weights["out"] ** 2).sum(axis=0).max())
    bias = np.where(STRIDE_BEFORE >= 0, weights["distance"][np.maximum(STRIDE_BEFORE, 0)], np.float32(HIDDEN))
    share = mask / max(mask.sum(), 1)
    g_q, g_k, g_v, g_out, by_distance = np.empty_like(q), np.zeros_like(k), np.zeros_like(v), 0, 0
    for at in range(0, n, AT_ONCE):
        own, around = slice(at, min(at + AT_ONCE, n)), slice(at, min(at + AT_ONCE, n) + 1)
        places = slice(at * STRIDE, own.stop * STRIDE)
        a = _joined(q[own], k[around])
        a += bias
        a[opening[own], :, :STRIDE] = HIDDEN
        total = _exponents(a.reshape(-1, 2 * STRIDE), reach).reshape(-1, STRIDE, 1)
        seen = a @ _windows(v[around])
        seen /= total
        g = (seen @ weights["out"]).reshape(-1, CLASSES)
        g += prior[places]
        total_out = _exponents(g, reach_out)
        g.reshape(-1)[np.arange(0, g.size, CLASSES) + target[places]] -= total_out
        part = (share[places] / total_out)[:, None]
        g_seen = g @ weights["out"].T
        g_seen *= part
        g_seen = g_seen.reshape(seen.shape)
        g_seen /= total
        g_s = _joined(g_seen, v[around])
        g_s -= np.einsum("ijk,ijk->ij", g_seen, seen)[:, :, None]
        g_s *= a
        np.matmul(g_s, _windows(k[around]), out=g_q[own])
        _spread(g_s, q[own], g_k[around])
        _spread(a, g_seen, g_v[around])
        g_out = g_out + _crossed(seen.reshape(-1, WIDTH) * part, g)
        by_distance = by_distance + g_s.sum(axis=0)
    g_q, g_k, g_v = (m.reshape(-1, WIDTH) for m in (g_q, g_k, g_v))
    g_x = g_k @ weights["key"].T
    g_x += g_v @ weights["value"].T
    g_x[STRIDE:] += g_q @ to_query.T
    embedding = np.bincount(CELLS.take(slots, axis=0).ravel(), g_x.ravel(), CELLS.size)
    by_distance = np.where(STRIDE_BEFORE >= 0, by_distance, 0)
    return {
        "embedding": embedding.astype(x.dtype).reshape(SLOTS, WIDTH),
        "query": _crossed(x[STRIDE:], g_q) * np.float32(WIDTH**-0.5),
        "key": _crossed(x, g_k),
        "value": _crossed(x, g_v),
        "distance": np.bincount(np.maximum(STRIDE_BEFORE, 0).ravel(), by_distance.ravel(), WINDOW).astype(x.dtype),
        "out": g_out,
    }


def keep_memory() -> None:
    """The C library hands blocks as large as one freed before, and twice that, back to the system only when more is free;
    else each step's arrays would be mapped and cleared anew."""
    np.empty(KEPT, np.uint8)


def _exponents(x: np.ndarray, reach: float) -> np.ndarray:
    """Rows of logits become exponents; their sums are returned. Exponents that cannot leave the range of floats
    (``reach``) need no maximum taken off."""
    if not reach < 40:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


class Trainer:
    """Weights that learn from whole texts: every token, and the end behind each text, is a target once."""

    def __init__(self, weights: dict, of: np.ndarray, slot: np.ndarray, prior: Prior, rate: float = RATE):
        keep_memory()
        self.of, self.slot, self.prior, self.rate = of.astype(np.int16), slot.astype(np.int16), prior, rate
        self.weights = {n: w.copy() for n, w in weights.items()}
        self.mean = {n: np.zeros_like(w) for n, w in weights.items()}
        self.square = {n: np.zeros_like(w) for n, w in weights.items()}
        self.steps = self.targets = 0

    def learn(self, texts: list[np.ndarray], end: int) -> None:
        if not len(texts):
            return
        inputs, target, counts, opening, _ = laid(texts, end)
        slots = self.slot[np.concatenate([np.full(STRIDE, end), inputs])]
        target, mask = self.of[target], counts.astype(np.float32)
        for at in range(0, len(opening), STEP_STRIDES):
            n = min(STEP_STRIDES, len(opening) - at)
            own = slice(at * STRIDE, (at + n) * STRIDE)
            seen = slots[own.start : own.stop + STRIDE].astype(np.intp)
            prior = self.prior.classes.take(seen[STRIDE:], axis=0)
            self.step(stride_gradients(self.weights, seen, prior, target[own], mask[own], opening[at : at + n]))
        self.targets += int(counts.sum())

    def step(self, grads: dict) -> None:
        self.steps += 1
        square = np.float32(1 / (1 - 0.99**self.steps))
        rate = np.float32(self.rate / (1 - 0.9**self.steps))
        for n, g in grads.items():
            self.mean[n] += np.float32(0.1) * (g - self.mean[n])
            self.square[n] += np.float32(0.01) * (g * g - self.square[n])
            self.weights[n] -= rate * self.mean[n] / (np.sqrt(square * self.square[n]) + np.float32(1e-8))


class Scorer:
    """Log probabilities of texts under trained weights."""

    def __init__(self, weights: dict, of: np.ndarray, slot: np.ndarray, prior: Prior):
        keep_memory()
        self.of, self.slot, self.prior, self.out = of.astype(np.int16), slot.astype(np.int32), prior, weights["out"]
        e = weights["embedding"]
        self.query = e @ weights["query"] * np.float32(WIDTH**-0.5)
        self.key, self.value = e @ weights["key"], e @ weights["value"]
        bias = weights["distance"][np.maximum(STRIDE_BEFORE, 0)]
        self.bias = np.where(STRIDE_BEFORE >= 0, bias, np.float32(HIDDEN)).astype(np.float32)
        # Exponents that cannot leave the range of floats need no maximum taken off.
        most = np.linalg.norm(self.query, axis=1).max() * np.linalg.norm(self.key, axis=1).max() + np.abs(bias).max()
        read = np.linalg.norm(self.value, axis=1).max() * np.linalg.norm(self.out, axis=0).max()
        self.bounded = bool(max(most, read) < 40)

    def scores(self, texts: list[np.ndarray], end: int) -> np.ndarray:
        """Natural log probability of each text's ids and the end behind them; each text starts behind an end."""
        if not len(texts):
            return np.zeros(0)
        inputs, target, counts, opening, first = laid(texts, end)
        total = len(opening)
        found = np.zeros(total * STRIDE)
        for at in range(0, total, AT_ONCE):
            n = min(AT_ONCE, total - at)
            own = slice(at * STRIDE, (at + n) * STRIDE)
            found[own] = self.strides(inputs, target[own], at, n, opening[at : at + n])
        return np.add.reduceat(np.where(counts, found, 0.0), first)

    def strides(self, inputs: np.ndarray, target: np.ndarray, at: int, n: int, opening: np.ndarray) -> np.ndarray:
        ids = inputs[at * STRIDE : (at + n) * STRIDE]
        back = inputs[(at - 1) * STRIDE : at * STRIDE] if at else np.zeros(STRIDE, np.int64)
        slots = self.slot.take(np.concatenate([back, ids])).astype(np.intp)
        own = slots[STRIDE:]
        q = self.query.take(own, axis=0).reshape(n, STRIDE, WIDTH)
        k, v = (t.take(slots, axis=0).reshape(n + 1, STRIDE, WIDTH) for t in (self.key, self.value))
        a = _joined(q, k)
        a += self.bias
        a[opening, :, :STRIDE] = HIDDEN
        if not self.bounded:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        seen = (a @ _windows(v)).reshape(-1, WIDTH)
        seen /= a.reshape(-1, 2 * STRIDE) @ np.ones((2 * STRIDE, 1), np.float32)
        logits = self.prior.classes.take(own, axis=0)
        logits += seen @ self.out
        if not self.bounded:
            logits -= logits.max(axis=1, keepdims=True)
        right = self.of[target]
        chosen = logits[np.arange(len(ids)), right]
        np.exp(logits, out=logits)
        behind = self.prior.slots[own, self.slot[target]] + self.prior.tokens[target]
        return chosen - np.log(logits @ np.ones(CLASSES, np.float32)) + behind
