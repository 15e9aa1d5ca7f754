"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint bit is set where more than half of a text's shingle hashes set it. Texts link when their fingerprints differ
in at most ``radius`` bits; linked texts form components.

Equal fingerprints are merged first, so a group of copies is one row. The 64 bits are cut into more blocks than the radius
allows to differ; two linked fingerprints agree on every bit of at least one choice of (blocks - radius) blocks, so each
such choice and its bits name a shard, and no link leaves the shards. In each shard a BK-tree holds the fingerprints,
children keyed by their distance to the parent, and a search follows only edges within the radius of the query's distance.
The number of blocks follows from the number of fingerprints, so that shards stay small; any number gives the same links.

A tree travels to the tasks that search it by shuffle, not by a Spark broadcast, which would pass all fingerprints through
the driver. A shard too large for one task (many different texts about one centre) is cut into parts, and each pair of
parts is a unit of work of its own: one part is the tree, the other searches it. A unit unites what it links and passes on
one link per fingerprint instead of all pairs. Components then come from alternating large-star and small-star rounds,
each a table in the shared folder.

Cases: a null or empty text has fingerprint 0 and links like any other; fewer words than a shingle make one shingle; equal
rows fall into one component; a null id belongs to a component but does not name it; an empty table gives no rows. Input
columns named like an output are replaced by it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import packed, small, unpacked, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints expected in a shard, members of one part of a shard, and (query, node) steps held at once.
SHARD_ROWS, PART_ROWS, STEPS = 256, 4096, 1 << 22


def shingle_hashes(text: str, width: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: A-Z only, and the six white-space characters of ASCII
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = zip(starts, ends[width - 1 :], strict=False) if len(words) >= width else [(0, len(joined))]
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64)


def fingerprint(text: str, width: int) -> int:
    """As a signed 64-bit number."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(width: int = SHINGLE):
    @F.arrow_udf("long")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([fingerprint(t or "", width) for t in batch.to_pylist()], pa.int64())

    return of


def masks(n: float, radius: int = RADIUS) -> list[int]:
    """Bits that name a shard, one mask for each choice of blocks, as signed numbers."""
    blocks = radius + 1
    while n / 2 ** (64 * (blocks - radius) // blocks) > SHARD_ROWS and blocks < 2 * radius + 2:
        blocks += 1
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    bits = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    sums = [sum(c) for c in combinations(bits, blocks - radius)]
    return [x - (1 << 64) if x >> 63 else x for x in sums]


class Forest:
    """One BK-tree per unit, over fingerprints that differ within a unit."""

    def __init__(self, points: np.ndarray, unit: np.ndarray):
        self.points = points
        units, first, at = np.unique(unit, return_index=True, return_inverse=True)
        self.roots = dict(zip(units.tolist(), first.tolist(), strict=True))
        left = np.setdiff1d(np.arange(len(points)), first)
        parent, edges, children = first[at[left]], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(left):
            edge = parent * 65 + np.bitwise_count(points[left] ^ points[parent])
            keys, new, of = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(keys)
            children.append(left[new])
            parent = left[new][of]
            rest = parent != left
            left, parent = left[rest], parent[rest]
        edges, children = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edges)
        self.edges, self.children = edges[order], children[order]

    def near(self, queries: np.ndarray, unit: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, point) within the radius, level by level of the trees."""
        at = np.fromiter((self.roots[u] for u in unit.tolist()), np.int64, len(unit))
        who = np.arange(len(queries))
        while len(who):
            d = np.bitwise_count(queries[who] ^ self.points[at]).astype(np.int64)
            hit = d <= radius
            yield who[hit], at[hit]
            low = np.searchsorted(self.edges, at * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edges, at * 65 + np.minimum(d + radius, 64), "right")
            n = high - low
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, at = np.repeat(who, n), self.children[np.repeat(low, n) + step]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Labels of linked rows become equal; a label is a row that bears it."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def linked(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """For whole units: each fingerprint that has links in its unit, beside one fingerprint it is connected with."""
    unit = rows.groupby(["mask", "key", "low", "high"], sort=False).ngroup().to_numpy()
    points = rows["fp"].to_numpy().view(np.uint64)
    tree = np.flatnonzero(rows["part"] == rows["high"])
    asks = np.flatnonzero(rows["part"] == rows["low"])
    sizes = np.bincount(unit[tree], minlength=unit.max() + 1)
    tree, asks = tree[sizes[unit[tree]] > 0], asks[sizes[unit[asks]] > 0]
    label = np.arange(len(rows))
    if len(tree) and len(asks):
        forest = Forest(points[tree], unit[tree])
        block = np.cumsum(sizes[unit[asks]]) // STEPS
        for part in np.split(asks, np.flatnonzero(np.diff(block)) + 1):
            for who, at in forest.near(points[part], unit[part], radius):
                unite(label, part[who], tree[at])
    out = np.flatnonzero(label != np.arange(len(rows)))
    return pd.DataFrame({"a": points[out].view(np.int64), "b": points[label[out]].view(np.int64)})


def _linker(radius: int):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        names = ["mask", "key", "low", "high"]
        for batch in batches:
            if not len(batch):
                continue
            last = (batch[names] == batch[names].iloc[-1]).all(axis=1).to_numpy()
            cut = len(batch) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut or (kept and (kept[-1][names].iloc[-1] != batch[names].iloc[0]).any()):
                yield linked(pd.concat([*kept, batch.iloc[:cut]]), radius)
                kept = []
            kept.append(batch.iloc[cut:])
        if kept:
            yield linked(pd.concat(kept), radius)

    return link


def links(distinct: DataFrame, radius: int = RADIUS, part_rows: int = PART_ROWS) -> DataFrame:
    """Links (a, b) that connect every two fingerprints (column ``fp``, distinct) within the radius, few per fingerprint."""
    n = distinct.count()
    every = masks(n, radius)
    shards = distinct.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(every)])
        ).alias("s"),
    ).select("s.mask", "s.key", "fp")
    sizes = shards.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sizes.select("mask", "key", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    # Two fingerprints or more in each shard counted, and no more shards than a mask has values.
    counted = sum(min(n // 2, 1 << (m & ((1 << 64) - 1)).bit_count()) for m in every)
    cut = shards.join(small(sizes, counted), ["mask", "key"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    units = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "mask",
        "key",
        F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"),
        "part",
        "fp",
    )
    names = ["mask", "key", "low", "high"]
    dealt = units.repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInPandas(_linker(radius), "a long, b long")


def components(found: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots; the root is a component's smallest node."""
    edges = found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before = written(edges, "links"), None
    nodes = 2 * edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(small(least, nodes), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = large.join(small(lowest, nodes), "u").select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v"))
        edges = written(lower.filter("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, nodes = now, 2 * now[0]
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    width: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """Every row with its ``fingerprint`` (16 hex digits), ``component_id``, the smallest id of its component, and
    ``kept``: one row of each component, of those with the smallest id, is kept."""
    rows = docs.select(
        packed(docs, carry),
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("rid"),
        fingerprints(width)(F.col(text_col)).alias("fp"),
    )
    rows = written(rows, "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first")
    distinct = written(rows.groupBy("fp").agg(first), "distinct")
    roots = written(components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp"), "roots")
    named = distinct.join(small(roots, roots.count()), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    n = distinct.count()
    of = named.select("fp", "root").join(small(least, n), "root").select("fp", "first")
    out = rows.join(small(of, n), "fp").select(
        "row",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"),
        (F.col("rid") == F.col("first.rid")).alias("kept"),
    )
    return unpacked(out, "fingerprint", "component_id", "kept")
