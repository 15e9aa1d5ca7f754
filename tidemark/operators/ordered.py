"""Ordered-series operators that do not depend on one task per series.

``Window.partitionBy(series)`` sends a whole series to one task, so a series that holds a third of
the table stalls the job. Every operator here cuts a series into *chunks* (a monotone function of
the leading order column: a day of a timestamp, a month of a date, a span of a number) and shuffles
once on (series, chunk). A chunk that still holds too many rows is split again (see ``keyed``).


* ``neighbourhood`` - expressions looking a fixed number of rows back and ahead. Rows away from the
  chunk edges are computed inside their chunk; the edge rows of the chunks meet in blocks that overlap
  by the expression's reach.
* ``running`` - prefix aggregates. Chunk totals are aggregated map-side, their prefix is taken over
  one row per chunk, and the carried value is combined with the prefix inside the chunk.
* ``with_group_stats`` - whole-series aggregates, written as a small table and joined back (no window).

``running`` and ``with_group_stats`` read their input twice (once narrow, for the totals). Operators that chain
several of them first write the small or shared intermediate with :func:`tidemark.session.cut_lineage`.

Series keys are compared as one struct, so a NULL key is a series like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.window import WindowSpec

from tidemark.functions.time import micros
from tidemark.session import cut_lineage

SERIES, CHUNK, HEAD, SIZE, CUT = "__series", "__chunk", "__head", "__size", "__cut"

# A chunk is split when it holds more rows than a task sorts comfortably.
HOT_ROWS = 10_000_000
PARTS_PER_HOT_CHUNK = 16

# Rows of a block of chunk edges; as many as the expression's reach at least.
EDGE_ROWS = 65_536

# Spans of values: rows a span is to hold, and the least number of spans.
ROWS_PER_SPAN, LEAST_SPANS = 1_000_000, 32

# Longest length of each calendar unit in microseconds.
DAY_US = 86_400_000_000
LENGTH_US = {
    "minute": 60_000_000.0,
    "hour": 3_600_000_000.0,
    "day": 1.0 * DAY_US,
    "week": 7.0 * DAY_US,
    "month": 31.0 * DAY_US,
    "quarter": 92.0 * DAY_US,
    "year": 366.0 * DAY_US,
}


def as_list(x) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def chunk_of(df: DataFrame, order: Sequence[str], chunk=None) -> Column:
    """Chunk number of a row; monotone in the leading order column.

    ``chunk`` is a calendar unit for times and dates, a width for numbers, or a ready Column.
    """
    if isinstance(chunk, Column):
        return chunk
    lead = order[0]
    kind = df.schema[lead].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc(chunk or "day", F.col(lead))
    if isinstance(kind, T.DateType):
        return F.date_trunc(chunk or "month", F.col(lead))
    if isinstance(kind, T.NumericType):
        return F.floor(F.col(lead) / F.lit(chunk or 65536))
    raise ValueError(f"give chunk= for order column {lead} of type {kind.simpleString()}")


def _position(df: DataFrame, lead: str, chunk) -> Column:
    """Place of a row inside its chunk, from 0 to below 1; monotone in the leading order column."""
    kind = df.schema[lead].dataType
    if isinstance(kind, T.NumericType):
        width = F.lit(float(chunk or 65536))
        return F.col(lead) / width - F.floor(F.col(lead) / width)
    unit = chunk or ("month" if isinstance(kind, T.DateType) else "day")
    return (micros(F.col(lead)) - micros(F.col(CHUNK))) / F.lit(LENGTH_US[unit])


def chunked(df: DataFrame, by, order, chunk=None) -> tuple[DataFrame, Column]:
    """Fix the chunks once for a chain of operators on the same series: the table with ``__cut``, and that column.

    Pass the column on as ``chunk``; the operators then do not count the rows of the chunks again.
    """
    if isinstance(chunk, Column):
        return df, chunk
    by, order = as_list(by), as_list(order)
    return keyed(df, by, order, chunk).withColumnRenamed(CHUNK, CUT).drop(SERIES), F.col(CUT)


def keyed(df: DataFrame, by: list[str], order: list[str], chunk) -> DataFrame:
    """Add the chunk and the shuffle key (series, chunk).

    A chunk with more than ``HOT_ROWS`` rows is cut further, in equal spans of the order column. The table of such chunks
    grows with the data, so Spark picks how to join it from its size at run time.
    """
    rows = df.withColumn(CHUNK, chunk_of(df, order, chunk))
    if not isinstance(chunk, Column):
        counts = rows.groupBy(F.struct(*by, CHUNK).alias(SERIES)).agg(F.count(F.lit(1)).alias("__rows"))
        parts = F.ceil(F.col("__rows") / HOT_ROWS) * PARTS_PER_HOT_CHUNK
        hot = counts.filter(F.col("__rows") > HOT_ROWS).select(SERIES, parts.alias("__parts"))
        rows = rows.withColumn(SERIES, F.struct(*by, CHUNK)).join(hot, SERIES, "left").drop(SERIES)
        part = F.floor(_position(df, order[0], chunk) * F.col("__parts"))
        part = F.when(F.col("__parts").isNotNull(), part).otherwise(F.lit(0))
        rows = rows.withColumn(CHUNK, F.struct(F.col(CHUNK).alias("at"), part.alias("part"))).drop("__parts")
    return rows.withColumn(SERIES, F.struct(*by, CHUNK))


def _sorted(order: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def neighbourhood(
    df: DataFrame,
    by,
    order,
    exprs: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    chunk=None,
) -> DataFrame:
    """Add window expressions that see at most ``before`` rows back and ``after`` rows ahead.

    ``exprs`` receives a window ordered by ``order`` and returns named columns; row frames must stay
    within ``[-before, after]``. ``order`` must be unique within a series.
    """
    by, order = as_list(by), as_list(order)
    span = before + after
    keep = df.columns
    inside = Window.partitionBy(SERIES).orderBy(*order)
    numbered = (
        keyed(df, by, order, chunk)
        .withColumn(HEAD, F.row_number().over(inside))
        .withColumn(SIZE, F.count(F.lit(1)).over(Window.partitionBy(SERIES)))
    )
    tail = F.col(SIZE) - F.col(HEAD) + 1
    near_edge = (F.col(HEAD) <= before) | (tail <= after)

    def add(part: DataFrame, w: WindowSpec) -> DataFrame:
        named = exprs(w)
        return part.select("*", *[c.alias(n) for n, c in named.items()])

    # The branches read the same columns of the same shuffle, so Spark runs it once and reuses it.
    inner = add(numbered, inside).filter(~near_edge)
    # A chunk passes on its first and last rows, all of it where it is short. They are numbered along the series from one
    # row per chunk, cut into blocks at least as long as the reach, and only rows within reach of a block's end meet the
    # next block too: however far an expression looks, a series is spread over tasks.
    passed = F.least(F.col(SIZE), F.lit(2 * span))
    along = Window.partitionBy(*[F.col(f"{SERIES}.{c}") for c in by]).orderBy(F.col(f"{SERIES}.{CHUNK}"))
    offset = F.coalesce(F.sum(passed).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset")
    starts = numbered.filter(F.col(HEAD) == 1).select(SERIES, SIZE).select(SERIES, offset)
    edges = numbered.filter((F.col(HEAD) <= span) | (tail <= span)).join(starts, SERIES)
    gone = F.when(F.col(HEAD) > span, F.greatest(F.col(SIZE) - 2 * span, F.lit(0))).otherwise(F.lit(0))
    length, place = max(EDGE_ROWS, span), F.col("__offset") + F.col(HEAD) - 1 - gone
    home = F.floor(place / length)
    meets = F.array_distinct(F.array(home, F.floor((place - after) / length), F.floor((place + before) / length)))
    edges = edges.withColumn("__home", home).withColumn("__block", F.explode(meets)).drop("__offset")
    blocks = Window.partitionBy(*[F.col(f"{SERIES}.{c}") for c in by], "__block").orderBy(*order)
    edges = add(edges, blocks).filter(near_edge & (F.col("__home") == F.col("__block"))).drop("__home", "__block")
    out = inner.unionByName(edges)
    helpers = {SERIES, CHUNK, HEAD, SIZE}
    return out.select(*keep, *[c for c in out.columns if c not in keep and c not in helpers])


def lagged(df: DataFrame, by, order, named: dict[str, tuple[str, int]], chunk=None) -> DataFrame:
    """Add lags: ``{new: (column, k)}``; a negative ``k`` looks ahead."""
    back = max([k for _, k in named.values()] + [0])
    ahead = max([-k for _, k in named.values()] + [0])
    return neighbourhood(
        df, by, order, lambda w: {n: F.lag(c, k).over(w) for n, (c, k) in named.items()}, back, ahead, chunk
    )


_PARTIAL = {
    "sum": lambda c, o: F.sum(c),
    "count": lambda c, o: F.count(c),
    "max": lambda c, o: F.max(c),
    "min": lambda c, o: F.min(c),
    "last": lambda c, o: F.max_by(c, F.when(c.isNotNull(), o)),
    "first": lambda c, o: F.min_by(c, F.when(c.isNotNull(), o)),
}
_LOCAL = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
}
_CARRY = {**_LOCAL, "count": F.sum}


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry + local, carry, local)
    if kind == "count":
        return F.coalesce(carry, F.lit(0)) + local
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry) if kind == "last" else F.coalesce(carry, local)


def running(
    df: DataFrame, by, order, specs: dict[str, tuple], chunk=None, descending: bool = False, many: bool = False
) -> DataFrame:
    """Add prefix aggregates ``{name: (kind, column[, "before"])}`` per series.

    Kinds: sum, count, max, min, last (non-null), first (non-null), next (the first non-null at or after the row), and
    total (the sum over the whole series, from the chunk totals). With ``"before"`` the current row is left out. With
    ``descending`` the prefix runs from the largest order value down. ``many``: chunks may be too many for a broadcast; Spark
    does not see that where ``df`` comes from an explode, which it takes for one row each.
    """
    by, order = as_list(by), as_list(order)
    keep = df.columns
    base = keyed(df, by, order, chunk)
    direction = F.struct(*order)
    ends = {"last": "first", "first": "last"} if descending else {}
    partials, carries, merged = [], [], []
    chunks = Window.partitionBy(*by).orderBy(*_sorted([CHUNK], descending)).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    inside = Window.partitionBy(SERIES).orderBy(*_sorted(order, descending))
    for i, (name, spec) in enumerate(specs.items()):
        kind, col = spec[0], spec[1]
        col = F.col(col) if isinstance(col, str) else col
        if kind == "total":
            partials.append(F.sum(col).alias(f"__p{i}"))
            carries.append(F.sum(f"__p{i}").over(whole).alias(f"__c{i}"))
            merged.append(F.col(f"__c{i}").alias(name))
            continue
        if kind == "next":
            # The last one of the reversed order: a frame that only grows, unlike one that reaches to the end.
            partials.append(_PARTIAL["last" if descending else "first"](col, direction).alias(f"__p{i}"))
            after = Window.partitionBy(*by).orderBy(*_sorted([CHUNK], not descending)).rowsBetween(Window.unboundedPreceding, -1)
            carries.append(F.last(f"__p{i}", ignorenulls=True).over(after).alias(f"__c{i}"))
            back = Window.partitionBy(SERIES).orderBy(*_sorted(order, not descending))
            local = F.last(col, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
            merged.append(F.coalesce(local, F.col(f"__c{i}")).alias(name))
            continue
        frame = inside.rowsBetween(Window.unboundedPreceding, -1 if "before" in spec[2:] else 0)
        partials.append(_PARTIAL[ends.get(kind, kind)](col, direction).alias(f"__p{i}"))
        carries.append(_CARRY[kind](F.col(f"__p{i}")).over(chunks).alias(f"__c{i}"))
        merged.append(_combine(kind, F.col(f"__c{i}"), _LOCAL[kind](col).over(frame)).alias(name))
    totals = base.groupBy(SERIES).agg(*partials)
    for c in [*by, CHUNK]:
        totals = totals.withColumn(c, F.col(f"{SERIES}.{c}"))
    carried = totals.select(SERIES, *carries)
    return base.join(carried.hint("merge") if many else carried, SERIES).select(*keep, *merged)


def with_group_stats(df: DataFrame, by, stats: dict[str, Column]) -> DataFrame:
    """Add whole-group aggregates to every row: partial aggregation and a join back on the group.

    The group table is written first. Its size is then known when the join is planned: with few groups Spark broadcasts
    it and the rows are not shuffled at all, with many it joins by key. Without ``by`` the aggregate is one row and
    enters as a scalar subquery.
    """
    by = as_list(by)
    aggs = [c.alias(n) for n, c in stats.items()]
    if not by:
        one = df.agg(*aggs).select(F.struct(*stats).alias("__one")).scalar()
        return df.withColumn("__one", one).select(*df.columns, *[F.col(f"__one.{n}").alias(n) for n in stats])
    keyed_rows = df.withColumn(SERIES, F.struct(*by))
    per = cut_lineage(keyed_rows.groupBy(SERIES).agg(*aggs))
    return keyed_rows.join(per, SERIES).select(*df.columns, *stats)


def _span(bounds: Column, value: Column, steps: Sequence[int]) -> Column:
    """Number of sorted bounds at or below the value, by halving."""
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(F.get(bounds, at + s - 1) <= value, at + s).otherwise(at),
    )


def value_chunk(df: DataFrame, by, c, tie: str | None = None) -> DataFrame:
    """Add ``__bucket``: a span of ``c`` within its group, monotone in ``c``, with about as many rows as the other spans.

    The bounds are quantiles from one mergeable sketch per group, so a skewed column or an outlier does not fill one span;
    their number follows the number of rows. With ``tie``, a numeric column, the bucket is monotone in (``c``, ``tie``) and
    a value that fills whole spans alone is cut at quantiles of ``tie``. NULLs are in the first span. Several columns get
    ``__bucket_<column>`` each, from one pass.
    """
    names = {c: "__bucket"} if isinstance(c, str) else {x: f"__bucket_{x}" for x in c}
    rows = df.count()
    spans = max(LEAST_SPANS, 2 ** math.ceil(math.log2(max(rows, 1) / ROWS_PER_SPAN)))
    steps = [2**k for k in reversed(range(spans.bit_length() - 1))]
    shares = [i / spans for i in range(1, spans)]
    cut = {x: F.percentile_approx(x, shares, max(10_000, 4 * spans)) for x in [*names, *as_list(tie)]}
    out = with_group_stats(df, by, {f"__at_{x}": q for x, q in cut.items()})
    for x, name in names.items():
        bounds, value = F.col(f"__at_{x}"), F.col(x)
        span = _span(bounds, value, steps)
        if tie is not None:
            out = out.withColumn("__span", span)
            below = [F.get(bounds, F.col("__span") - k) == value for k in (1, 2)]
            alone = F.coalesce(below[0] & below[1], F.lit(False))
            part = F.when(alone, _span(F.col(f"__at_{tie}"), F.col(tie), steps)).otherwise(F.lit(0))
            span = F.struct(F.col("__span").alias("span"), (~alone).alias("rest"), part.alias("part"))
        out = out.withColumn(name, span).drop("__span")
    return out.drop(*[f"__at_{x}" for x in cut])


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
