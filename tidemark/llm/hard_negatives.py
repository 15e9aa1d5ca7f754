"""Hard negatives: for each anchor and each of its best positives, the best rows of other labels inside a score window.

A score is the integer inner product of two quantised vectors, so equal scores are ties everywhere. Higher scores come
first, ties by smaller id. An anchor's positives are its first rows of the same label; a positive with score p opens the
window of scores n with ``low * p <= 100 * n <= high * p``.

The anchors are a stated query set, scored against all rows in blocks: rows are packed into blocks of vectors, anchors into
blocks of their own, and a unit of work is one block of anchors against one group of row blocks, which stream past it. A
unit passes on only each anchor's first rows of its group, so few of the scores are shuffled. Both scoring passes end in a
secondary sort: pairs are keyed (anchor, descending score, id), dealt by anchor and sorted within partitions (the DataFrame
form of ``repartitionAndSortWithinPartitions``), and an iterator reads the sorted stream: the first pass emits the first
positives, the second opens a window where a positive comes by and emits negatives until the window is full or passed. It
holds the open windows of one anchor and never an anchor's rows.

Cost: all rows against all anchors is what an exact search needs. Rows are shipped once per block of ``ANCHORS`` anchors.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part; a vector shorter than another
counts as filled with zeros; rows of equal id are rows of their own, so an anchor's twin is one of its positives; a null id
comes after all others among ties; fewer positives or negatives than asked for give fewer rows; an empty table or one
without anchors gives no rows; scores outside a long are given as the nearest long. Other input columns are not carried.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block (their place in it takes so many bits of a row's number), anchors of a block, rows of a group.
PLACE_BITS = 13
BLOCK, ANCHORS, GROUP = 1 << PLACE_BITS, 1024, 1 << 14
#: Anchors scored at a time against one block.
AT_ONCE = 128
#: Scores are kept within a long with room for its negative.
MOST = (1 << 63) - 2

VECTORS = "ids binary, known binary, labels array<string>, codes binary, kind string, width int, vectors binary"
BLOCKS = f"block long, n int, n_anchors int, anchors binary, {VECTORS}"
ANCHOR_BLOCKS = f"unit int, rids binary, {VECTORS}"
PAIRS = "anchor long, anchor_id long, score long, other_id long, rid long"


def quantised(values: pa.Array, scale: float) -> np.ndarray:
    """``floor(scale * x)`` of a list array as a matrix of doubles, short vectors filled with zeros."""
    lengths = np.diff(values.offsets.to_numpy())
    flat = np.floor(scale * values.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(lengths), max(lengths.max(initial=0), 1)))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def stored(ids: np.ndarray, known: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict:
    """Rows of a block as columns of its table; vectors in two bytes a component where they fit."""
    kind = "<i2" if np.abs(vectors).max(initial=0) < 1 << 15 else "<f8"
    names, codes = np.unique(labels.astype(str), return_inverse=True)
    return {
        "ids": ids.astype("<i8").tobytes(),
        "known": known.astype(bool).tobytes(),
        "labels": names.tolist(),
        "codes": codes.astype("<i4").tobytes(),
        "kind": kind,
        "width": vectors.shape[1],
        "vectors": vectors.astype(kind).tobytes(),
    }


class Rows:
    """A block read back."""

    def __init__(self, x: dict):
        self.ids = np.frombuffer(x["ids"], "<i8")
        self.known = np.frombuffer(x["known"], bool)
        self.labels = np.array(x["labels"], dtype=object)[np.frombuffer(x["codes"], "<i4")]
        self.vectors = np.frombuffer(x["vectors"], x["kind"]).reshape(len(self.ids), x["width"]).astype(float)


def _blocks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 31
    schema = pa.schema(
        [("block", pa.int64()), ("n", pa.int32()), ("n_anchors", pa.int32()), ("anchors", pa.binary())] + VECTOR_FIELDS
    )
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            ids = part["id"].fill_null(0).to_numpy()
            known = part["id"].is_valid().to_numpy(zero_copy_only=False)
            anchors = part["anchor"].to_numpy(zero_copy_only=False).astype(bool)
            labels = np.array(part["label"].to_pylist(), dtype=object)
            rows = stored(ids, known, labels, quantised(part["vector"], scale))
            row = {"block": number, "n": part.num_rows, "n_anchors": int(anchors.sum()), "anchors": anchors.tobytes(), **rows}
            number += 1
            yield pa.RecordBatch.from_pylist([row], schema)


VECTOR_FIELDS = [
    ("ids", pa.binary()),
    ("known", pa.binary()),
    ("labels", pa.list_(pa.string())),
    ("codes", pa.binary()),
    ("kind", pa.string()),
    ("width", pa.int32()),
    ("vectors", pa.binary()),
]
ANCHOR = "rid long, id long, known boolean, label string, vector binary"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of row blocks, one row each."""
    for batch in batches:
        for block in batch.to_pylist():
            rows, at = Rows(block), np.flatnonzero(np.frombuffer(block["anchors"], bool))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((block["block"] << PLACE_BITS) + at, pa.int64()),
                    pa.array(rows.ids[at], pa.int64()),
                    pa.array(rows.known[at], pa.bool_()),
                    pa.array(rows.labels[at].tolist(), pa.string()),
                    pa.array([rows.vectors[i].tobytes() for i in at], pa.binary()),
                ],
                ["rid", "id", "known", "label", "vector"],
            )


def _anchor_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("rid")
    found = [np.frombuffer(v, float) for v in rows["vector"]]
    vectors = np.zeros((len(found), max(map(len, found))))
    for at, v in zip(vectors, found, strict=True):
        at[: len(v)] = v
    out = stored(rows["id"].to_numpy(np.int64), rows["known"].to_numpy(bool), rows["label"].to_numpy(object), vectors)
    return pd.DataFrame([{"unit": int(rows["unit"].iloc[0]), "rids": rows["rid"].to_numpy("<i8").tobytes(), **out}])


def scores_of(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no sum can leave their whole numbers, else in Python's integers."""
    width = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :width], rows[:, :width]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width < 1 << 52:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


def first(scores: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the ``k`` highest scores of each row under the mask, of equal ones the first columns."""
    if scores.shape[1] > k:
        none = -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min
        masked = np.where(mask, scores, none)
        least = np.partition(masked, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        mask = mask & (masked >= least[:, None])
    i, j = np.nonzero(mask)
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k]


class Unit:
    """One block of anchors; row blocks stream past it, and the first rows of each anchor and window stay."""

    def __init__(self, block: dict, positives: int, negatives: int, low: int, high: int):
        self.rows, self.rids = Rows(block), np.frombuffer(block["rids"], "<i8")
        self.code = {name: k for k, name in enumerate(block["labels"])}
        self.codes = np.array([self.code[x] for x in self.rows.labels])
        self.windows = None
        self.k = positives
        if (given := block.get("positives")) is not None:
            self.k = negatives
            # A window by its least and greatest whole score; one that is missing holds none.
            self.windows = np.full((len(self.rids), positives, 2), (1, 0))
            at = {r: i for i, r in enumerate(self.rids.tolist())}
            for x in given:
                p = x["score"]
                self.windows[at[x["anchor"]], x["place"]] = -(-low * p // 100), high * p // 100
        self.waiting, self.held, self.found = [], 0, []

    def add(self, block: dict) -> None:
        self.waiting.append(block)
        self.held += block["n"]
        if self.held >= BLOCK:
            self.settle()

    def settle(self) -> None:
        """Score the waiting blocks."""
        if not self.waiting:
            return
        parts = [Rows(x) for x in self.waiting]
        rids = np.concatenate([(x["block"] << PLACE_BITS) + np.arange(x["n"]) for x in self.waiting])
        ids, known = (np.concatenate([getattr(p, n) for p in parts]) for n in ("ids", "known"))
        codes = np.array([self.code.get(x, -1) for p in parts for x in p.labels])
        width = max(p.vectors.shape[1] for p in parts)
        vectors = np.concatenate([np.pad(p.vectors, ((0, 0), (0, width - p.vectors.shape[1]))) for p in parts])
        order = np.lexsort((ids, ~known))
        rids, ids, known, codes, vectors = (x[order] for x in (rids, ids, known, codes, vectors))
        by_rid = np.argsort(rids)
        for at in range(0, len(self.rids), AT_ONCE):
            own = slice(at, at + AT_ONCE)
            scores = scores_of(self.rows.vectors[own], vectors)
            same = self.codes[own, None] == codes[None, :]
            if self.windows is None:
                place = by_rid[np.minimum(np.searchsorted(rids, self.rids[own], sorter=by_rid), len(rids) - 1)]
                here = np.flatnonzero(rids[place] == self.rids[own])
                same[here, place[here]] = False
                masks = [same]
            else:
                bounds = self.windows[own].astype(scores.dtype)
                masks = [
                    ~same & (scores >= w[:, 0, None]) & (scores <= w[:, 1, None]) for w in bounds.transpose(1, 0, 2)
                ]
            for window, mask in enumerate(masks):
                i, j = first(scores, mask, self.k)
                self.found.append((i + at, np.full(len(i), window), scores[i, j].astype(np.int64), known[j], ids[j], rids[j]))
        self.waiting, self.held = [], 0
        if len(self.found) > 256:
            self.reduce()

    def reduce(self) -> None:
        """Of all found so far, the first of each anchor and window."""
        i, window, score, known, ids, rids = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, ~known, -score, window, i))
        group = (i * (window.max(initial=0) + 1) + window)[order]
        rank = np.arange(len(order)) - np.searchsorted(group, group)
        keep = order[rank < self.k]
        self.found = [tuple(x[keep] for x in (i, window, score, known, ids, rids))]

    def result(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        if not self.found:
            return
        self.reduce()
        i, _, score, known, ids, rids = self.found[0]
        # A row found in several windows of an anchor is one pair.
        once = np.unique(np.stack([i, rids]), axis=1, return_index=True)[1]
        i, score, known, ids, rids = (x[once] for x in (i, score, known, ids, rids))
        columns = [
            pa.array(self.rids[i], pa.int64()),
            pa.array(self.rows.ids[i], pa.int64(), mask=~self.rows.known[i]),
            pa.array(score, pa.int64()),
            pa.array(ids, pa.int64(), mask=~known),
            pa.array(rids, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PAIRS.split(", ")])


def _scored(batches: Iterator[pa.RecordBatch], **rule) -> Iterator[pa.RecordBatch]:
    """Units in order: the block of anchors first, if there is one, then the row blocks of its group."""
    unit, at = None, None
    for batch in batches:
        for x in batch.to_pylist():
            if at != (x["unit"], x["group"]):
                if unit is not None:
                    yield from unit.result()
                unit, at = None, (x["unit"], x["group"])
            if x["rids"] is not None:
                unit = Unit(x, **rule)
            elif unit is not None:
                unit.add(x)
    if unit is not None:
        yield from unit.result()


def scored(blocks: DataFrame, anchors: DataFrame, units: int, groups: int, rule: dict) -> DataFrame:
    """The first pairs of each anchor in each group of row blocks."""
    vectors = [x.split()[0] for x in VECTORS.split(", ")]
    given = [c for c in anchors.columns if c == "positives"]
    none = [F.lit(None).cast(t.dataType).alias(t.name) for t in anchors.schema if t.name in (*given, "rids")]
    left = anchors.select(
        "unit",
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.lit(-1).cast("long").alias("block"),
        F.lit(0).alias("n"),
        "rids",
        *given,
        *vectors,
    )
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group")
    each = F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit")
    right = blocks.select(each, group, "block", "n", *none, *vectors)
    both = left.unionByName(right).repartition("unit", "group").sortWithinPartitions("unit", "group", "block")
    return both.mapInArrow(partial(_scored, **rule), PAIRS)


def secondary_sorted(pairs: DataFrame) -> DataFrame:
    """Pairs dealt by anchor and sorted by (anchor, descending score, positives before negatives, id) in each partition."""
    keys = [F.col("anchor"), F.desc("score"), F.col("negative"), F.col("other_id").asc_nulls_last(), F.col("rid")]
    return pairs.repartition("anchor").sortWithinPartitions(*keys)


def _first_positives(batches: Iterator[pa.RecordBatch], positives: int) -> Iterator[pa.RecordBatch]:
    """Of the sorted pairs, the first of each anchor, numbered."""
    anchor, place = None, 0
    for batch in batches:
        places = []
        for x in batch["anchor"].to_pylist():
            anchor, place = (x, place + 1) if x == anchor else (x, 0)
            places.append(place)
        out = batch.append_column("place", pa.array(places, pa.int32()))
        yield out.filter(pa.array([p < positives for p in places], pa.bool_()))


def _windowed(batches: Iterator[pa.RecordBatch], negatives: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Positives of an anchor open windows, its negatives fall into the open ones."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = ["anchor", "anchor_id", "score", "other_id", "negative"]
    anchor, windows = None, []
    for batch in batches:
        out = []
        for at, anchor_id, score, other, negative in zip(*(batch[c].to_pylist() for c in columns), strict=True):
            if at != anchor:
                anchor, windows = at, []
            if not negative:
                windows.append([score, other, 0])
                continue
            windows = [w for w in windows if w[2] < negatives and low * w[0] <= 100 * score]
            for w in windows:
                if 100 * score <= high * w[0]:
                    w[2] += 1
                    out.append((anchor_id, w[1], w[2], other, w[0], score))
        arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: float = 256.0,
    block_anchors: int = ANCHORS,
    group_rows: int = GROUP,
) -> DataFrame:
    """For each row where ``anchor`` holds: anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score. ``block_anchors`` and ``group_rows`` set the size of a unit of work and change no result."""
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    blocks = written(rows.mapInArrow(partial(_blocks, scale=scale), BLOCKS), "vector-blocks")
    n, n_anchors = blocks.agg(F.sum("n"), F.sum("n_anchors")).first()
    units, groups = -(-(n_anchors or 0) // block_anchors) or 1, -(-(n or 0) // group_rows) or 1
    rule = {"positives": positives, "negatives": negatives, "low": low, "high": high}

    each = blocks.filter("n_anchors > 0").mapInArrow(_anchors, ANCHOR)
    unit = F.pmod(F.xxhash64("rid"), F.lit(units)).cast("int")
    anchors = written(each.withColumn("unit", unit).groupBy("unit").applyInPandas(_anchor_block, ANCHOR_BLOCKS), "anchor-blocks")

    near = scored(blocks, anchors, units, groups, rule).withColumn("negative", F.lit(0))
    best = secondary_sorted(near).mapInArrow(partial(_first_positives, positives=positives), f"{PAIRS}, negative int, place int")
    best = written(best, "positives")

    told = F.collect_list(F.struct("anchor", "score", "place")).alias("positives")
    told = best.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(units)).cast("int").alias("unit")).agg(told)
    far = scored(blocks, anchors.join(told, "unit"), units, groups, rule).withColumn("negative", F.lit(1))
    both = best.drop("place").unionByName(far)
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return secondary_sorted(both).mapInArrow(partial(_windowed, negatives=negatives, low=low, high=high), kinds)
