"""Near copies by the similarity of whole texts: five-word shingle sets with a Jaccard similarity of 0.8 or more.

Candidates come from BK-trees (:mod:`tidemark.llm.simhash`): each text has MARKS fingerprints of its distinct words under
fixed random maps, and texts with fingerprints that differ in at most four bits are candidates. The fingerprints of all maps
are searched together; a chance meeting of two maps is one more candidate. Every link is confirmed on the whole shingle
sets, so no pair below the limit links.

Fingerprints of 64 bits miss similar pairs whose difference is one long passage. The rest is therefore found by min-hashes.
Each of BANDS keys is made of ROWS minima of a text's shingle hashes under fixed random maps; texts with a common key that are
not yet connected are candidates too. A pair of similarity s has no common key with probability (1 - s ** ROWS) ** BANDS, 5e-6
at 0.8.

Candidates are first joined into components, and each such component is a unit of work that gets its
texts once. A unit above PART_ROWS texts or PART_SHINGLES shingles is cut into parts, and each pair of parts is a unit. In a
unit, a text is compared, through an inverted index, only with those it is not yet connected with, so a large group of near
copies is settled by its first members and no pairs are written. Confirmed links then form the components.

Cases: texts without words have equal, empty sets and link; fewer words than a shingle make one shingle; a null id belongs
to a component but does not name it unless all are null; an empty table gives no rows. Input columns named like an output
are replaced by it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import simhash
from tidemark.llm.common import by_key, give_back, packed, small, unpacked, written
from tidemark.llm.simhash import components, shingle_hashes, unite

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
#: Similarity from which texts link, as a fraction.
LEAST, OF = 4, 5
BANDS, ROWS, SEED = 40, 6, 42
#: Fingerprints of a text.
MARKS = 4
PART_ROWS, PART_SHINGLES = 4096, 1 << 22
#: Shingles of a unit from which its memory goes back to the system.
LARGE = 1 << 17


def shingle_set(text: str) -> np.ndarray:
    found = np.unique(shingle_hashes(text, SHINGLE))
    return found if len(found) else np.zeros(1, np.uint64)


def band_keys(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> list[int]:
    from xxhash import xxh64_intdigest

    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(shingles, len(shingles) // 256 + 1):
        np.minimum(least, (part[:, None] * factors + shifts).min(axis=0), out=least)
    keys = [xxh64_intdigest(m.tobytes(), band) for band, m in enumerate(least.reshape(-1, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _maps(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    factors, shifts = (rng.integers(0, 1 << 64, n, np.uint64) for _ in range(2))
    return factors | np.uint64(1), shifts


def _banded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    maps = _maps(BANDS * ROWS)
    for batch in texts:
        sizes, keys = [], []
        for text in batch:
            shingles = shingle_set(text.as_py() or "")
            sizes.append(len(shingles))
            keys.append(band_keys(shingles, *maps))
        arrays = [pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.StructArray.from_arrays(arrays, ["size", "keys"])


def _hashed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Size, keys and marks together, so that one Python worker reads a text once."""
    maps = _maps(MARKS)
    for batch in texts:
        (banded,) = _banded(iter([batch]))
        marked = pa.array([marks(t.as_py() or "", *maps) for t in batch], pa.list_(pa.int64()))
        yield pa.StructArray.from_arrays([*banded.flatten(), marked], ["size", "keys", "marks"])
        give_back()


def marks(text: str, factors: np.ndarray, shifts: np.ndarray) -> list[int]:
    """Fingerprints of a text's distinct words, one for each map; zeros without words."""
    from xxhash import xxh64_intdigest

    words = set(text.encode().lower().split())
    hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    counts = np.zeros(64 * len(factors), np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte counts
        mapped = (hashes[at : at + 255, None] + shifts) * factors
        mapped = (mapped ^ (mapped >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        mapped ^= mapped >> np.uint64(29)
        counts += np.unpackbits(mapped.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(words), bitorder="little").view(np.int64).tolist()


def confirmed(rows: pd.DataFrame) -> pd.DataFrame:
    """For one unit: each text that has links, beside one it is connected with. Texts of equal ``linked`` are connected."""
    sets = [shingle_set(t or "") for t in rows["text"]]
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
    ends = np.cumsum(np.bincount(codes))
    first, group = np.unique(rows["linked"], return_index=True, return_inverse=True)[1:]
    label = first[group]
    tree = (rows["part"] == rows["high"]).to_numpy()
    for i, last in zip(np.flatnonzero(rows["part"] == rows["low"]), np.cumsum(sizes)[rows["part"] == rows["low"]], strict=True):
        apart = tree & (label != label[i])
        if not apart.any():
            continue
        own = codes[last - sizes[i] : last]
        high = ends[own]
        n = high - np.where(own > 0, ends[own - 1], 0)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(high - n, n)
        shared = np.bincount(holders[at], minlength=len(sets))
        hit = np.flatnonzero(apart & (OF * shared >= LEAST * (sizes + sizes[i] - shared)))
        unite(label, np.full(len(hit), i), hit)
    out = np.flatnonzero(label != np.arange(len(sets)))
    rid = rows["rid"].to_numpy()
    found = pd.DataFrame({"a": rid[out], "b": rid[label[out]]})
    if len(codes) > LARGE:
        del sets, codes, holders
        give_back()
    return found


def members(roots: DataFrame) -> DataFrame:
    """(root, rid) of every row of a component, the root too."""
    named = roots.select("root", F.col("node").alias("rid"))
    return named.unionByName(roots.select("root", F.col("root").alias("rid")).distinct())


def near(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect every two rows (rid, marks) with fingerprints near each other, few per row."""
    marked = rows.select("rid", F.explode("marks").alias("fp"))
    heads = written(marked.groupBy("fp").agg(F.min("rid").alias("b")), "heads")
    n = heads.count()
    equal = marked.join(small(heads, n), "fp").filter("rid <> b").select(F.col("rid").alias("a"), "b")
    found = simhash.links(heads.select("fp"))
    ends = [small(heads.select(F.col("fp").alias(side), F.col("b").alias(f"rid_{side}")), n) for side in ("a", "b")]
    apart = found.join(ends[0], "a").join(ends[1], "b").select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b"))
    return equal.unionByName(apart)


def sharing(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect every two rows (rid, keys, linked) with a common key whose rows are not all linked."""
    keyed = rows.select("rid", "linked", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("rid").alias("b"), F.min("linked").alias("low"), F.max("linked").alias("high"))
    shared = keyed.join(by_key(heads.filter("low < high").select("key", "b")), "key")
    return shared.filter("rid <> b").select(F.col("rid").alias("a"), "b")


def settled(
    candidates: DataFrame, rows: DataFrame, part_rows: int = PART_ROWS, part_shingles: int = PART_SHINGLES
) -> DataFrame:
    """Links (a, b) that connect every two similar candidates among rows (rid, text, size, linked), few per row."""
    found = written(members(components(candidates)), "members")
    units = written(rows.select("rid", "size", "linked").join(small(found, found.count()), "rid"), "candidates")
    parts = F.ceil(F.greatest(F.count("*") / part_rows, F.sum("size") / part_shingles)).cast("int").alias("parts")
    sizes = written(units.groupBy("root").agg(F.count("*").alias("n"), parts), "parts")
    n, placed = sizes.agg(F.count("*"), F.coalesce(F.sum(F.col("n") * F.col("parts")), F.lit(0))).first()
    cut = units.join(small(sizes.drop("n"), n), "root")
    cut = cut.withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "rid", "linked"
    )
    texts = rows.select("rid", "text").join(small(cut, placed), "rid")
    return texts.groupBy("root", "low", "high").applyInPandas(confirmed, "a long, b long")


def links(rows: DataFrame, part_rows: int = PART_ROWS, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """Links (a, b) that connect every two similar rows (rid, text, size, keys) with a common key, few per row."""
    rows = rows.withColumn("linked", F.col("rid"))
    return settled(sharing(rows), rows, part_rows, part_shingles)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row with ``component_id``, the smallest id of its component, and ``kept``: one row of each component, of
    those with the smallest id, is kept. ``text_col`` is among the carried columns or a field of one."""
    rows = docs.select(
        packed(docs, carry),
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("rid"),
        F.arrow_udf(_hashed, "struct<size: long, keys: array<long>, marks: array<long>>")(F.col(text_col)).alias("s"),
    )
    rows = written(rows.select("row", "id", "rid", "s.*"), "bands")
    texts = rows.select("rid", "size", "keys", "marks", F.col(f"row.{text_col}").alias("text"))
    by_trees = settled(near(texts), texts.withColumn("linked", F.col("rid")))
    linked = written(components(by_trees), "linked")
    rest = texts.join(small(linked.select(F.col("node").alias("rid"), "root"), linked.count()), "rid", "left")
    rest = rest.withColumn("linked", F.coalesce("root", "rid")).drop("root")
    found = settled(sharing(rest), rest).unionByName(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    similar = written(members(components(found)), "similar")
    n = similar.count()
    joined = rows.select("rid", "id").join(small(similar, n), "rid")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first")
    of = joined.select("root", "rid").join(small(joined.groupBy("root").agg(first), n), "root").select("rid", "first")
    out = rows.join(small(written(of, "first"), n), "rid", "left").select(
        "row",
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        F.coalesce(F.col("rid") == F.col("first.rid"), F.lit(True)).alias("kept"),
    )
    return unpacked(out, "component_id", "kept")
