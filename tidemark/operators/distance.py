"""Distance-based group tests under the Gower distance, without forming pairs of rows.

The Gower distance of two rows is the mean over columns of |difference| / range. The tests need sums of squared
distances over all pairs of a group. Squares of one column follow from its variance. Products of two columns,
``|dx| |dy|``, are summed by splitting the rows on the bits of their rank in x: at each bit, rows of one half meet the
other half's running sums in the order of y. That is n log n rows of work, and every pair is counted exactly once. The low
bits are split inside tasks, a block of neighbouring ranks each, so rows are copied and shuffled for the high bits only.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.operators.group_tests import anova_oneway, level_pairs
from tidemark.operators.ordered import ROWS_PER_SPAN, as_list, running, value_chunk, with_group_stats
from tidemark.operators.windows import p_adjust
from tidemark.session import cut_lineage

# Executors need not have this package installed: the sums of a block travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Blocks of at most 2**SMALL_LEVEL rows are summed in one task.
SMALL_LEVEL = 16
# Fixed value: slack when comparing permuted statistics with the observed one.
SLACK = 1.4901161193847656e-08


def scale_by_range(df: DataFrame, cols: Sequence[str], by=None) -> DataFrame:
    """Divide each column by its range over the table (a constant column becomes 0)."""
    ranges = {f"__r_{c}": F.max(c) - F.min(c) for c in cols}
    out = with_group_stats(df, by, ranges)
    return out.withColumns({c: F.coalesce(F.try_divide(c, f"__r_{c}"), F.lit(0.0)) for c in cols}).drop(*ranges)


def _rank(df: DataFrame, by: list[str], row_id: str, c: str, out: str, extra: dict | None = None) -> DataFrame:
    chunked = value_chunk(df, by, c, row_id)
    specs = {out: ("count", F.lit(1)), **(extra or {})}
    return running(chunked, by, [c, row_id], specs, F.col("__bucket")).drop("__bucket")


def block_sums(place: np.ndarray, x: np.ndarray, y: np.ndarray, levels: int) -> np.ndarray:
    """For each row the sum over the other rows of its block of ``|dx| |dy|``; ``place`` is its rank in x, from 0."""
    x, y = x - x.mean(), y - y.mean()
    rising, out = np.argsort(y, kind="stable"), np.zeros(len(x))
    for level in range(levels):
        split = (place >> (level + 1))[rising]
        at = rising[np.argsort(split, kind="stable")]
        split, upper, a, b = np.sort(split), (place[at] >> level) & 1 == 1, x[at], y[at]
        first, last = np.searchsorted(split, split), np.searchsorted(split, split, "right")
        parts = np.stack([np.ones(len(a)), a, b, a * b])
        signed = []
        for side in (~upper, upper):
            sums = np.zeros((4, len(a) + 1))
            np.cumsum(parts * side, axis=1, out=sums[:, 1:])
            signed.append(2 * sums[:, 1:] - sums[:, first] - sums[:, last])
        n, ox, oy, oxy = np.where(upper, signed[0], -signed[1])
        out[at] += n * a * b - a * oy - b * ox + oxy
    return out


def _summed_block(names: list[str], levels: int) -> Callable[[pa.Table], pa.Table]:
    def summed(block: pa.Table) -> pa.Table:
        place, x, y = (block[c].to_numpy() for c in ("__place", "__x", "__y"))
        return block.select(names).append_column("part", pa.array(block_sums(place, x, y, levels)))

    return summed


def cross_sums(df: DataFrame, by, row_id: str, x: str, y: str) -> DataFrame:
    """Parts of the sum over the other rows of the group of ``|dx| |dy|``: several rows per row id, to be added up."""
    by = as_list(by)
    base = df.select(*by, row_id, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    ranks = {"__r": ("count", F.lit(1)), "__n": ("total", F.lit(1))}
    chunked = value_chunk(base, by, ["__x", "__y"], row_id)
    sized = cut_lineage(running(chunked, by, ["__x", row_id], ranks, F.col("__bucket___x")).drop("__bucket___x"))
    place = F.col("__r") - 1
    blocks = sized.select(
        *by,
        row_id,
        "__x",
        "__y",
        F.floor(place / (1 << SMALL_LEVEL)).alias("__block"),
        (place % (1 << SMALL_LEVEL)).alias("__place"),
    )
    names = [*by, row_id]
    kind = T.StructType([*[blocks.schema[c] for c in names], T.StructField("part", T.DoubleType())])
    near = blocks.groupBy(*by, "__block").applyInArrow(_summed_block(names, SMALL_LEVEL), kind)

    top = F.ceil(F.log2(F.col("__n").cast("double"))).cast("int") - 1
    split = sized.filter(top >= SMALL_LEVEL).withColumn("__level", F.explode(F.sequence(F.lit(SMALL_LEVEL), top)))
    step = F.pow(F.lit(2.0), F.col("__level")).cast("long")
    half = F.floor((F.col("__r") - 1) / step)
    split = split.withColumn("__half", half % 2).withColumn("__block", F.floor(half / 2))
    parts = {"n": F.lit(1.0), "x": F.col("__x"), "y": F.col("__y"), "xy": F.col("__x") * F.col("__y")}
    specs = {}
    for side in (0, 1):
        for k, v in parts.items():
            mine = F.when(F.col("__half") == side, v).otherwise(F.lit(0.0))
            specs[f"__p{k}{side}"] = ("sum", mine)
            specs[f"__t{k}{side}"] = ("total", mine)
    summed = running(split, [*by, "__level", "__block"], ["__y", row_id], specs, F.col("__bucket___y"), many=True)

    def other(k: str) -> Column:
        """Twice the running sum less the total, of the other half."""
        value = [2 * F.col(f"__p{k}{s}") - F.col(f"__t{k}{s}") for s in (0, 1)]
        return F.when(F.col("__half") == 1, value[0]).otherwise(-value[1])

    a, b = F.col("__x"), F.col("__y")
    part = other("n") * a * b - a * other("y") - b * other("x") + other("xy")
    return near.unionByName(summed.select(*by, row_id, part.alias("part")))


def _pairs_of(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]


def sum_sq(df: DataFrame, by, row_id: str, cols: Sequence[str]) -> DataFrame:
    """Per group: n and the sum over its pairs of squared Gower distance (columns already scaled)."""
    by = as_list(by)
    squares = sum((F.var_pop(c) * F.count(F.lit(1)) * F.count(F.lit(1)) for c in cols), F.lit(0.0))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), squares.alias("sumsq"))
    for a, b in _pairs_of(cols):
        cross = cross_sums(df, by, row_id, a, b).groupBy(*by).agg(F.sum("part").alias("__c"))
        out = out.join(cross, by) if by else out.withColumn("__c", cross.scalar())
        out = out.withColumn("sumsq", F.col("sumsq") + F.col("__c")).drop("__c")  # both ends of a pair = twice
    return out.withColumn("sumsq", F.col("sumsq") / float(len(cols) ** 2))


def gower_row_stats(df: DataFrame, by, row_id: str, cols: Sequence[str]) -> DataFrame:
    """Per row: size of its group, mean and mean-square Gower distance to all rows of the group (itself included)."""
    by = as_list(by)
    return _row_stats(_scaled(df, [*by, row_id], cols), by, row_id, cols)


def _scaled(df: DataFrame, keep: list[str], cols: Sequence[str]) -> DataFrame:
    """The numeric columns over their ranges, written once for the passes that follow."""
    return cut_lineage(scale_by_range(df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]), cols))


def _row_stats(scaled: DataFrame, by: list[str], row_id: str, cols: Sequence[str]) -> DataFrame:
    wide, dist, square, n = scaled, F.lit(0.0), F.lit(0.0), F.col("__n")
    for i, c in enumerate(cols):
        x = F.col(c)
        sums = {f"__s{i}": ("sum", x), f"__t{i}": ("total", x), f"__q{i}": ("total", x * x)}
        sums["__n"] = ("total", F.lit(1))
        wide = cut_lineage(_rank(wide.drop("__n"), by, row_id, c, f"__r{i}", sums))
        dist = dist + x * (2 * F.col(f"__r{i}") - n) - 2 * F.col(f"__s{i}") + F.col(f"__t{i}")
        square = square + n * x * x - 2 * x * F.col(f"__t{i}") + F.col(f"__q{i}")
    p = float(len(cols))
    out = wide.select(*by, row_id, n.alias("n"), (dist / (n * p)).alias("mean_d"), square.alias("__sq"))
    for a, b in _pairs_of(cols):
        cross = cross_sums(scaled, by, row_id, a, b).groupBy(*by, row_id).agg(F.sum("part").alias("__c"))
        out = out.join(cross, [*by, row_id]).withColumn("__sq", F.col("__sq") + 2 * F.col("__c")).drop("__c")
    return out.withColumn("mean_d2", F.col("__sq") / (F.col("n") * p * p)).drop("__sq")


def shuffled_labels(df: DataFrame, by, row_id: str, label: str, perms: int, seed: int) -> DataFrame:
    """Rows for permutation 0 (as given) and 1..perms, in which labels move by the rank of md5(id:perm:seed)."""
    by = as_list(by)
    spans = value_chunk(df.select(*by, row_id, label), by, row_id)
    natural = running(spans, by, [row_id], {"__k": ("count", F.lit(1))}, F.col("__bucket"))
    labels = natural.select(*by, "__k", F.col(label).alias("__label"))
    drawn = df.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(perms))))
    drawn = drawn.withColumn("__h", F.md5(F.concat_ws(":", F.col(row_id).cast("string"), "perm", F.lit(str(seed)))))
    digits = max(2, math.ceil(math.log(max(df.count(), 1) / ROWS_PER_SPAN, 16)))  # leading hex digits: even spans of hashes
    ranked = running(
        drawn, [*by, "perm"], ["__h", row_id], {"__k": ("count", F.lit(1))}, F.substring("__h", 1, digits), many=True
    )
    # Both sides have a row for each of the table, one even for each permutation: too many to broadcast.
    moved = ranked.join(labels.hint("merge"), [*by, "__k"]).withColumn(label, F.col("__label"))
    return df.withColumn("perm", F.lit(0)).unionByName(moved.select(*df.columns, "perm"))


def permanova(df: DataFrame, row_id: str, label: str, cols: Sequence[str], perms: int = 0, seed: int = 0, by=None):
    """One-way PERMANOVA: sums of squares, pseudo-F, R squared and the permutation p-value."""
    scaled = _scaled(df, [*as_list(by), row_id, label], cols)
    return _permanova(scaled, row_id, label, cols, perms, seed, as_list(by))


def _permanova(scaled: DataFrame, row_id: str, label: str, cols, perms: int, seed: int, by: list[str]) -> DataFrame:
    total = sum_sq(scaled, by, row_id, cols).select(
        *by, F.col("n").alias("n"), F.try_divide("sumsq", "n").alias("ss_total")
    )
    rows = scaled.withColumn("perm", F.lit(0))
    if perms:
        rows = cut_lineage(shuffled_labels(scaled, by, row_id, label, perms, seed))
    within = sum_sq(rows, [*by, "perm", label], row_id, cols).groupBy(*by, "perm").agg(
        F.count(F.lit(1)).alias("groups"), F.sum(F.col("sumsq") / F.col("n")).alias("ss_within")
    )
    one = within.join(total, by) if by else within.withColumn("__t", total.select(F.struct("n", "ss_total")).scalar())
    one = one if by else one.select("*", "__t.*").drop("__t")
    between = F.col("ss_total") - F.col("ss_within")
    stat = F.try_divide(between / (F.col("groups") - 1), F.col("ss_within") / (F.col("n") - F.col("groups")))
    one = one.withColumn("f", stat)
    kept = ["n", "groups", "ss_total", "ss_within", "f"]
    observed = F.max(F.when(F.col("perm") == 0, F.struct(*kept)))
    collected = one.groupBy(*by).agg(observed.alias("__o"), F.collect_list(F.when(F.col("perm") > 0, F.col("f"))).alias("__f"))
    out = collected.select(*by, "__o.*", "__f").withColumn("r2", 1 - F.col("ss_within") / F.col("ss_total"))
    beaten = F.size(F.filter("__f", lambda v: v >= F.col("f") - SLACK))
    return out.withColumn("p", (beaten + 1) / F.lit(perms + 1.0)).drop("__f")


def pairwise_permanova(
    df: DataFrame, row_id: str, label: str, levels, cols: Sequence[str], perms: int, seed: int = 0, method: str = "bonferroni"
) -> DataFrame:
    """PERMANOVA of each pair of listed levels (ranges of the whole table) with adjusted p-values."""
    scaled = _scaled(df, [row_id, label], cols)
    pairs = level_pairs(scaled, label, levels)
    table = cut_lineage(_permanova(pairs, row_id, label, cols, perms, seed, ["level_a", "level_b"]))
    return p_adjust(table, "p", method, "p_adj")


def dispersion_distances(df: DataFrame, row_id: str, label: str, cols: Sequence[str]) -> DataFrame:
    """Distance of each row to its group's centroid in the space of the Gower distance, cut at 0.

    The centroid is the mean, not the spatial median.
    """
    scaled = _scaled(df, [row_id, label], cols)
    rows = _row_stats(scaled, [label], row_id, cols)
    centred = with_group_stats(cut_lineage(rows), label, {"__m": F.avg("mean_d2")})
    z2 = F.greatest(F.col("mean_d2") - F.col("__m") / 2, F.lit(0.0))
    return centred.select(row_id, label, F.sqrt(z2).alias("z"))


def betadisper(df: DataFrame, row_id: str, label: str, cols: Sequence[str]) -> DataFrame:
    """Homogeneity of dispersion: one-way F of the distances to the group centroids."""
    return anova_oneway(dispersion_distances(df, row_id, label, cols), label, "z")


def permanova_ic(table: DataFrame) -> DataFrame:
    """Adjusted R squared and the information criteria of a PERMANOVA table (n, groups, ss_within, r2)."""
    n, rss = F.col("n").cast("double"), F.col("ss_within")
    k = F.col("groups").cast("double")
    mse = rss / (n - k)
    extra = 2 * k * (k + 1) / (n - k - 1)
    two_pi = F.lit(2 * math.pi)
    out = table.withColumns(
        {
            "adj_r2": 1 - (1 - F.col("r2")) * (n - 1) / (n - k),
            "aic": 2 * k + n * F.log(rss / n),
            "aic_g": 2 * k + n * (1 + F.log(two_pi * rss / n)),
            "aic_mse": 2 * k + n * F.log(mse),
            "aic_pi": k + n * (1 + F.log(two_pi * rss / (n - k))),
        }
    )
    return out.withColumns({f"aicc{s}": F.col(f"aic{s}") + extra for s in ("", "_mse", "_pi")})
