"""Joins: key joins, interval labelling, nearest as-of, first later event, reconciliation.

Labels of ranges and nearest rows are carried along one stream per series that merges both sides in time order, chunk by
chunk (see ``ordered``). Pairs of rows and ranges meet in time buckets: a range is a bounded number of aligned spans of
buckets, whatever its length. No side is forced to broadcast.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.time import elapsed_seconds, micros
from tidemark.operators.ordered import as_list, lagged, running
from tidemark.operators.windows import change_points
from tidemark.session import cut_lineage

# Executors need not have this package installed: the sweeps travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY_US = 86_400_000_000
HOUR_US = DAY_US // 24


def _full_on(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join; missing keys match each other."""
    left = a.select(F.struct(*keys).alias("__l"), *[c for c in a.columns if c not in keys])
    right = b.select(F.struct(*keys).alias("__r"), *[c for c in b.columns if c not in keys])
    joined = left.join(right, F.col("__l") == F.col("__r"), "full").withColumn("__k", F.coalesce("__l", "__r"))
    rest = [c for c in joined.columns if c not in ("__l", "__r", "__k")]
    return joined.select(*[F.col(f"__k.{k}").alias(k) for k in keys], *rest)


def full_panel(dfs: Sequence[DataFrame], keys) -> DataFrame:
    """Full outer join of several tables on the keys; other columns two of them share are dropped."""
    keys = as_list(keys)

    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        twice = [c for c in a.columns if c in b.columns and c not in keys]
        return _full_on(a.drop(*twice), b.drop(*twice), keys)

    return reduce(step, dfs)


def natural_full(dfs: Sequence[DataFrame]) -> DataFrame:
    """Full outer joins folded over a list, all shared columns being keys."""
    return reduce(lambda a, b: _full_on(a, b, [c for c in a.columns if c in b.columns]), dfs)


def _renamed(a: DataFrame, b: DataFrame, keys: dict[str, str]) -> DataFrame:
    """``b`` with its keys named and typed as those of ``a``."""
    swap = {r: F.col(r).cast(a.schema[left].dataType).alias(left) for left, r in keys.items()}
    return b.select(*[swap.get(c, F.col(c)) for c in b.columns])


def left_on(a: DataFrame, b: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Left join on keys whose names and types differ: ``{left name: right name}``."""
    return a.join(_renamed(a, b, keys), list(keys), "left")


def inner_on(a: DataFrame, b: DataFrame, keys: dict[str, str]) -> DataFrame:
    return a.join(_renamed(a, b, keys), list(keys), "inner")


def attach_params(df: DataFrame, params: DataFrame, keys) -> DataFrame:
    """Many-to-many left join of per-group parameters."""
    return df.join(params, as_list(keys), "left")


def semi(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, as_list(on), "left_semi")


def anti(df: DataFrame, exceptions: DataFrame, on) -> DataFrame:
    return df.join(exceptions, as_list(on), "left_anti")


# A time bucket's number has at most so many bits: years 1 to 9999 in hours.
BUCKET_BITS = 27


def _cover(first: str, last: str, bits: int) -> Column:
    """The buckets ``first`` to ``last`` as few aligned nodes (level, node) of ``2 ** bits`` children each.

    A level holds the nodes between the two buckets that its parents cannot hold whole: at most a node's children on either
    side, however long the span.
    """

    def low(k: str) -> str:
        return f"-shiftright(-({first}), {bits} * ({k}))"

    def high(k: str) -> str:
        return f"(shiftright({last} + 1, {bits} * ({k})) - 1)"

    def run(a: str, b: str) -> str:
        return f"if({a} <= {b}, sequence({a}, {b}), cast(array() as array<bigint>))"

    above, below = f"shiftleft({low('k + 1')}, {bits})", f"shiftleft({high('k + 1')} + 1, {bits})"
    nodes = (
        f"if({low('k + 1')} <= {high('k + 1')}, concat({run(low('k'), f'{above} - 1')}, {run(below, high('k'))}),"
        f" {run(low('k'), high('k'))})"
    )
    levels = f"sequence(0, {BUCKET_BITS // bits})"
    return F.expr(f"flatten(transform({levels}, k -> transform({nodes}, n -> struct(k as level, n as node))))")


def _pieces(ranges: DataFrame, width: int, bits: int) -> DataFrame:
    """Ranges [__lo, __hi) in microseconds by the nodes (__level, __node) that together cover their buckets.

    A range costs a bounded number of rows, also one that ends in the year 9999. Its first and last bucket are nodes of
    their own; ``__lo`` and ``__hi`` stay, so a row is compared with the range itself.
    """
    kept = ranges.filter(F.col("__lo") < F.col("__hi"))
    kept = kept.withColumn("__first", F.floor(F.col("__lo") / width)).withColumn("__last", F.floor((F.col("__hi") - 1) / width))
    ends = F.expr("transform(array_distinct(array(__first, __last)), n -> struct(0 as level, n as node))")
    split = kept.withColumn("__n", F.explode(F.concat(ends, _cover("(__first + 1)", "(__last - 1)", bits))))
    return split.select(*ranges.columns, F.col("__n.level").alias("__level"), F.col("__n.node").alias("__node"))


def _nodes_of(bucket: str, bits: int) -> Column:
    """The nodes that hold a bucket, one per level."""
    levels = f"sequence(0, {BUCKET_BITS // bits})"
    return F.expr(f"transform({levels}, k -> struct(k as level, shiftright({bucket}, {bits} * k) as node))")


def _between(df: DataFrame, spans: DataFrame, ts: str, by: list[str], payload: list[str], width: int, how: str) -> DataFrame:
    """Rows joined with the spans [__lo, __hi) that hold their time, through time buckets.

    A span meets only the buckets that hold rows, so a long one costs no more than its matches. What is met is stored:
    Spark then knows its size, and a small table of spans is broadcast without a shuffle of the rows.
    """
    bits = 3
    out = [c for c in df.columns if c not in payload]
    left = df.select(*out).withColumn("__t", micros(F.col(ts))).withColumn("__b", F.floor(F.col("__t") / width))
    filled = left.select(*by, "__b").distinct().withColumn("__n", F.explode(_nodes_of("__b", bits)))
    filled = filled.select(*by, "__b", F.col("__n.level").alias("__level"), F.col("__n.node").alias("__node"))
    met = _pieces(spans, width, bits).join(filled, [*by, "__level", "__node"]).select(*by, "__b", "__lo", "__hi", *payload)
    left, right = left.alias("l"), cut_lineage(met).alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*by, "__b"]]
    on += [F.col("l.__t") >= F.col("r.__lo"), F.col("l.__t") < F.col("r.__hi")]
    cols = [F.col(f"l.{c}") for c in out] + [F.col(f"r.{c}") for c in payload]
    return left.join(right, reduce(lambda x, y: x & y, on), how).select(*cols)


class Open:
    """Open ranges that may still win: greater order first, each with a later end than those before it."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, order, end: int, label) -> None:
        low, high = 0, len(self.rows)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.rows[mid][0] > order else (low, mid)
        if low and self.rows[low - 1][1] >= end:
            return
        upto = low
        while upto < len(self.rows) and self.rows[upto][1] <= end:
            upto += 1
        self.rows[low:upto] = [(order, end, label)]

    def expire(self, t: int) -> None:
        """Leave out what ended at or before ``t``."""
        gone = 0
        while gone < len(self.rows) and self.rows[gone][1] <= t:
            gone += 1
        del self.rows[:gone]

    def label(self):
        return (self.rows[0][2],) if self.rows else (None,)


_EVENT = ["__series", "__chunk", "__kind", "__t", "__order", "__start", "__end", "__label"]


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple]]]:
    for batch in batches:
        yield batch, zip(*(batch[c].to_pylist() for c in _EVENT), strict=True)


def _rows(schema: pa.Schema, names: list[str], out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, columns, strict=True)], names)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of a series in order, the open ranges that its predecessors hand on."""
    at, held = None, Open()
    for batch, events in _events(batches):
        out = []
        for series, chunk, kind, t, order, start, end, label in events:
            if series != at:
                at, held = series, Open()
            if kind == 0:
                held.expire(t - 1)
                out += [(series, chunk, -1, t, o[0], o[1], e, x) for o, e, x in held.rows]
            else:
                held.add((order, start), end, label)
        yield _rows(batch.schema, _EVENT, out)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk, the times at which another label wins; the ranges carried into it come first."""
    at, now, held, shown = None, None, Open(), (None,)
    names = ["__series", "__t", "__label"]
    schema = None
    for batch, events in _events(batches):
        out, schema = [], batch.schema

        def settle() -> None:
            nonlocal shown
            if now is not None:
                held.expire(now)
                if held.label() != shown:
                    shown = held.label()
                    out.append((at[0], now, *shown))

        for series, chunk, kind, t, order, start, end, label in events:
            if (series, chunk) != at:
                settle()
                at, now, held, shown = (series, chunk), None, Open(), (None,)
            if kind == -1:
                held.add((order, start), end, label)
                shown = held.label()
                continue
            if t != now:
                settle()
                now = t
            if kind == 1:
                held.add((order, start), end, label)
        if out:
            yield _rows(schema, names, out)
    if now is not None:
        held.expire(now)
        if held.label() != shown:
            yield _rows(schema, names, [(at[0], now, *held.label())])


def _label_changes(spans: DataFrame, by: list[str], width: int) -> DataFrame:
    """Times at which the winning label of a series changes: (by, __t, __label), at most two per range.

    Starts and ends are swept chunk by chunk. What a chunk must know of its predecessors is the open ranges that may still
    win (no other of a greater order ends later); a stream over one such list per chunk carries them along a series.
    """
    none = {"__order": F.lit(None), "__start": F.lit(None), "__end": F.lit(None), "__label": F.lit(None)}
    kinds = {f.name: f.dataType for f in spans.schema}
    starts = spans.select(*by, F.lit(1).alias("__kind"), F.col("__lo").alias("__t"), "__order", F.col("__lo").alias("__start"), F.col("__hi").alias("__end"), "__label")
    typed = {n: c.cast(kinds.get(n, T.LongType())).alias(n) for n, c in none.items()}
    ends = spans.select(*by, F.lit(0).alias("__kind"), F.col("__hi").alias("__t"), *typed.values()).distinct()
    series, chunk = F.struct(F.lit(0).alias("__one"), *by).alias("__series"), F.floor(F.col("__t") / width).alias("__chunk")
    events = cut_lineage(starts.unionByName(ends).select(series, chunk, *_EVENT[2:]))

    cell = Window.partitionBy("__series", "__chunk")
    chunks = events.groupBy("__series", "__chunk").agg(F.min("__t").alias("__t"))
    heads = chunks.select("__series", "__chunk", F.lit(0).alias("__kind"), "__t", *typed.values())
    later = F.max("__end").over(cell.orderBy(F.desc("__order"), F.desc("__start")).rowsBetween(Window.unboundedPreceding, -1))
    left = events.withColumn("__until", F.max("__t").over(cell)).filter("__kind = 1 and __end > __until")
    left = left.withColumn("__later", later).filter("__later is null or __later < __end").select(*_EVENT)
    along = heads.unionByName(left).repartition("__series").sortWithinPartitions("__series", "__chunk", "__kind")
    carried = along.select(*_EVENT).mapInArrow(_carried, events.schema)

    every = events.unionByName(carried).repartition("__series", "__chunk")
    every = every.sortWithinPartitions("__series", "__chunk", F.col("__kind") >= 0, "__t")
    out = T.StructType([events.schema[n] for n in ("__series", "__t", "__label")])
    found = every.select(*_EVENT).mapInArrow(_swept, out)
    return found.select(*[F.col(f"__series.{c}").alias(c) for c in by], "__t", "__label")


def _as_of(df: DataFrame, events: DataFrame, ts: str, by: list[str], keep: list[str], specs: dict, width: int) -> DataFrame:
    """Rows of ``df`` (as ``__row``, with ``__t``) merged with events (by, __t, __event) into one stream per series; the
    ``specs`` are carried along it. An event at a row's very time comes before the row."""
    rows = df.select(F.struct(*keep).alias("__row"), *by, micros(F.col(ts)).alias("__t"), F.lit(1).alias("__side"))
    typed = events.select(*[F.col(k).cast(df.schema[k].dataType).alias(k) for k in by], "__t", "__event", F.lit(0).alias("__side"))
    known = [F.col(k).isNotNull() for k in [*by, "__t"]]
    both = rows.unionByName(typed.filter(reduce(lambda x, y: x & y, known)), allowMissingColumns=True)
    return running(both, by, ["__t", "__side"], specs, width).filter("__side = 1 and __row is not null")


def interval_label(
    df: DataFrame,
    ranges: DataFrame,
    ts: str,
    lo: str,
    hi: str,
    label: str,
    by=None,
    order: str | None = None,
    width_us: int = DAY_US,
) -> DataFrame:
    """Label each row with the range [lo, hi] (both ends included) holding its time; NULL if none does.

    Of overlapping ranges the one with the highest ``order`` wins, of equal order the one that starts last; a range
    without an order never wins. Without ``order`` the ranges are taken as disjoint. Overlaps are resolved among the ranges
    by a sweep over their starts and ends, so a range is two rows of it, however long, and a row meets at most one span.
    ``width_us`` sets the length of a bucket and changes no result.
    """
    by = as_list(by)
    spans = ranges.select(
        *by,
        micros(F.col(lo)).alias("__lo"),
        (micros(F.col(hi)) + 1).alias("__hi"),
        F.col(label).alias("__label"),
        *([F.col(order).alias("__order")] if order else []),
    ).filter("__lo < __hi")
    if order:
        changes = cut_lineage(_label_changes(spans.filter("__order is not null"), by, width_us))
        ended = lagged(changes, by, ["__t"], {"__hi": ("__t", -1)}, chunk=365 * DAY_US)
        spans = ended.select(*by, F.col("__t").alias("__lo"), "__hi", "__label").filter("__label is not null and __hi is not null")
    spans = spans.select(*by, "__lo", "__hi", F.col("__label").alias(label))
    return _between(df, spans, ts, by, [label], width_us, "left")


def range_join(df: DataFrame, ranges: DataFrame, ts: str, lo: str, hi: str, by=None, width_us: int = DAY_US):
    """Every (row, range) pair with the row's time in [lo, hi]; a row may fall in several ranges."""
    by = as_list(by)
    payload = [c for c in ranges.columns if c not in by]
    spans = ranges.withColumn("__lo", micros(F.col(lo))).withColumn("__hi", micros(F.col(hi)) + 1)
    return _between(df, spans, ts, by, payload, width_us, "inner")


def nearest_asof(
    left: DataFrame, right: DataFrame, ts: str, right_ts: str, payload, by=None, width_us: int = DAY_US
) -> DataFrame:
    """Attach the right row whose time is closest; the earlier one wins a tie, the larger payload a repeat.

    Both sides are merged into one stream per series, along which the last and the next right row are carried, so dense
    sides, long gaps and stray times cost one row each. ``width_us`` sets the length of a chunk and changes no result.
    """
    by, payload = as_list(by), as_list(payload)
    points = right.select(*by, micros(F.col(right_ts)).alias("__t"), F.struct(*payload).alias("__v"))
    points = points.groupBy(*by, "__t").agg(F.max("__v").alias("__v"))
    events = cut_lineage(points.select(*by, "__t", F.struct(F.col("__t").alias("at"), F.col("__v").alias("v")).alias("__event")))
    keep = [c for c in left.columns if c not in payload]
    found = _as_of(left, events, ts, by, keep, {"__prev": ("last", "__event"), "__next": ("next", "__event")}, width_us)
    ahead = F.col("__prev").isNull() | (F.col("__next.at") - F.col("__t") < F.col("__t") - F.col("__prev.at"))
    near = F.when(F.col("__t").isNotNull(), F.when(ahead, F.col("__next.v")).otherwise(F.col("__prev.v")))
    return found.select("__row.*", near.alias("__v")).select(*keep, *[F.col(f"__v.{c}").alias(c) for c in payload])


def nearest_spans(right: DataFrame, right_ts: str, payload, by=None) -> DataFrame:
    """The disjoint spans [__lo, __hi) of microseconds owned by each right row, from the first one's time to the last one's;
    for streams, which cannot be merged with a table in time order."""
    by, payload = as_list(by), as_list(payload)
    points = right.select(*by, micros(F.col(right_ts)).alias("__p"), F.struct(*payload).alias("__v"))
    points = points.filter("__p is not null").groupBy(*by, "__p").agg(F.max("__v").alias("__v"))
    near = lagged(cut_lineage(points), by, ["__p"], {"__prev": ("__p", 1), "__next": ("__p", -1)}, chunk=365 * DAY_US)

    def mid(a: str, b: str) -> Column:
        return F.floor((F.col(a) + F.col(b)) / 2) + 1

    lo = F.coalesce(mid("__prev", "__p"), F.col("__p"))
    hi = F.coalesce(mid("__p", "__next"), F.col("__p") + 1)
    return near.select(*by, lo.alias("__lo"), hi.alias("__hi"), "__v.*")


def between_spans(left: DataFrame, spans: DataFrame, t: Column, payload, width_us: int = HOUR_US, bits: int = 6) -> DataFrame:
    """Attach the payload of the span holding time ``t`` (microseconds); also for a stream on the left.

    ``spans`` are disjoint and hold every ``t``. A span is a bounded number of aligned nodes of hours, and a row meets the
    few nodes that hold its hour, one of which is its span's.
    """
    payload = as_list(payload)
    out = [c for c in left.columns if c not in payload]
    rows = left.select(*out, t.alias("__t"))
    rows = rows.withColumn("__b", F.floor(F.col("__t") / width_us)).withColumn("__n", F.explode(_nodes_of("__b", bits)))
    left, right = rows.alias("l"), _pieces(spans, width_us, bits).alias("r")
    on = (F.col("l.__n.level") == F.col("r.__level")) & (F.col("l.__n.node") == F.col("r.__node"))
    on = on & (F.col("l.__t") >= F.col("r.__lo")) & (F.col("l.__t") < F.col("r.__hi"))
    return left.join(right, on).select(*[F.col(f"l.{c}") for c in out], *[F.col(f"r.{c}") for c in payload])


# A cell of values is this share of the tolerance wide, so that every reading in a set point's own cell is near enough,
# rounding included; readings near enough lie at most this many cells away.
CELL_SHARE, CELLS_AWAY = 0.75, 2

_VISIT = ["__key", "__at", "__kind", "__t", "__value", "__id", "__side"]
_VISIT_TYPES = "__at bigint, __kind int, __t bigint, __value double, __id bigint, __side int"


class Later:
    """Values met so far, later ones first, of which only those can be a first match that no earlier one betters."""

    def __init__(self):
        self.up: list[tuple] = []
        self.down: list[tuple] = []

    def add(self, t: int, low: float, high: float) -> None:
        while self.up and self.up[-1][1] <= high:
            self.up.pop()
        self.up.append((t, high))
        while self.down and self.down[-1][1] >= low:
            self.down.pop()
        self.down.append((t, low))

    def first(self, setpoint: float, side: int, tol: float) -> int | None:
        """The first time at which a value is near the set point; ``side`` says on which side of it the values are."""
        rows = self.up if side <= 0 else self.down
        low, high = 0, len(rows)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if abs(rows[mid][1] - setpoint) <= tol else (low, mid)
        return rows[low - 1][0] if low else None


def _first_near(batches: Iterator[pa.RecordBatch], tol: float) -> Iterator[pa.RecordBatch]:
    """Visits of a cell in descending order, readings (kind 1) and questions (kind 0): each question beside its answer."""
    at, later = None, Later()
    for batch in batches:
        out = []
        for key, chunk, kind, t, value, number, side in zip(*(batch[c].to_pylist() for c in _VISIT), strict=True):
            if (key, chunk) != at:
                at, later = (key, chunk), Later()
            if kind == 1:
                later.add(t, value, value)
            else:
                out.append((key, chunk, 0, later.first(value, side, tol), value, number, side))
        yield _rows(batch.schema, _VISIT, out)


def _next_chunk(batches: Iterator[pa.RecordBatch], tol: float) -> Iterator[pa.RecordBatch]:
    """Per cell, chunks in descending order as their least and greatest reading: each open question beside the first later
    chunk that answers it."""
    at, later = None, Later()
    names = [*_VISIT, "__high"]
    for batch in batches:
        out = []
        for key, chunk, kind, _, value, number, side, high in zip(*(batch[c].to_pylist() for c in names), strict=True):
            if key != at:
                at, later = key, Later()
            if kind == 1:
                later.add(chunk, value, high)
            elif (found := later.first(value, side, tol)) is not None:
                out.append((key, found, 0, None, value, number, side))
        yield _rows(batch.schema, _VISIT, out)


def time_to_settle(
    df: DataFrame,
    by,
    order,
    ts: str,
    setpoint: str,
    obs: str,
    tol: float,
    horizon_s: float | None = None,
    chunk=None,
    width_us: int = DAY_US,
) -> DataFrame:
    """Per set-point change, seconds to the first later reading within ``tol`` of the new set point; NULL if never.

    Readings and changes meet in cells of values and are visited from the last to the first, chunk of time by chunk. A
    change in whose chunk no reading answers it is passed on to the first later chunk whose least or greatest reading is near
    enough, and looked up there. So each change costs a few rows, however many readings share its cell and however many set
    points differ. ``width_us`` sets the length of a chunk and changes no result.
    """
    if tol <= 0:
        raise ValueError("the tolerance must be positive")
    by, order = as_list(by), as_list(order)
    changes = change_points(df, by, order, setpoint, chunk).select(*by, F.col(ts), F.col(setpoint))
    changes = cut_lineage(changes.withColumn("__id", F.monotonically_increasing_id()))
    width = F.lit(CELL_SHARE * tol)

    def key(cell: Column) -> Column:
        return F.struct(*by, cell.cast("long").alias("__cell")).alias("__key")

    t, at = micros(F.col(ts)), F.floor(micros(F.col(ts)) / width_us)
    value, side = F.col(setpoint).cast("double"), F.col("__away")
    asked = changes.filter(F.col(setpoint).isNotNull()).withColumn(
        "__away", F.explode(F.array(*[F.lit(k) for k in range(-CELLS_AWAY, CELLS_AWAY + 1)]))
    )
    asked = asked.select(
        key(F.floor(value / width) + F.col("__away")), at.alias("__at"), F.lit(0).alias("__kind"), t.alias("__t"),
        value.alias("__value"), "__id", F.signum(side).cast("int").alias("__side"),
    )
    value = F.col(obs).cast("double")
    none = [F.lit(None).cast(k).alias(n) for n, k in (("__id", "long"), ("__side", "int"))]
    readings = df.filter(F.col(obs).isNotNull() & F.col(ts).isNotNull()).select(
        key(F.floor(value / width)), at.alias("__at"), F.lit(1).alias("__kind"), t.alias("__t"), value.alias("__value"), *none
    )
    readings = cut_lineage(readings.join(asked.select("__key").distinct(), "__key", "left_semi").select(*_VISIT))
    visit = T.StructType([readings.schema["__key"], *T.StructType.fromDDL(_VISIT_TYPES)])

    def visited(rows: DataFrame) -> DataFrame:
        # A question sees what is strictly later: of equal times it comes before the readings.
        rows = rows.select(*_VISIT).repartition("__key", "__at")
        rows = rows.sortWithinPartitions("__key", "__at", F.col("__t").desc_nulls_last(), "__kind")
        return rows.mapInArrow(lambda batches: _first_near(batches, tol), visit)

    here = cut_lineage(visited(readings.unionByName(asked)))
    spans = readings.groupBy("__key", "__at").agg(F.min("__value").alias("__value"), F.max("__value").alias("__high"))
    spans = spans.withColumns({"__kind": F.lit(1), "__t": F.lit(None).cast("long"), "__id": F.lit(None).cast("long"), "__side": F.lit(None).cast("int")})
    open_ = here.filter("__t is null").withColumn("__high", F.lit(None).cast("double"))
    along = spans.unionByName(open_).select(*_VISIT, "__high").repartition("__key")
    along = along.sortWithinPartitions("__key", F.desc("__at"), "__kind")
    passed = cut_lineage(along.mapInArrow(lambda batches: _next_chunk(batches, tol), visit))
    # A question passed on has no time: it is visited after all readings of its chunk.
    there = readings.join(passed.select("__key", "__at").distinct(), ["__key", "__at"], "left_semi")
    hits = here.unionByName(visited(there.select(*_VISIT).unionByName(passed))).filter("__t is not null")
    hits = hits.groupBy("__id").agg(F.min("__t").alias("__hit"))
    found = changes.join(hits, "__id", "left")
    seconds = (F.col("__hit") - micros(F.col(ts))) / F.lit(1e6)
    if horizon_s is not None:
        seconds = F.when(seconds <= horizon_s, seconds)
    return found.select(*by, F.col(ts), F.col(setpoint), seconds.alias("stabilization_time"))


def reconcile(master: DataFrame, counted: DataFrame, keys, count: str, candidates: Sequence[str], tol: float):
    """Rows of ``master`` whose counted number is farther than ``tol`` from every candidate, with the least distance."""
    joined = master.join(counted, as_list(keys), "left")
    gaps = [F.abs(F.col(count) - F.col(c)) for c in candidates]
    return joined.withColumn("diff", F.least(*gaps) if len(gaps) > 1 else gaps[0]).filter(F.col("diff") > tol)


def compare_series(a: DataFrame, b: DataFrame, ts: str, value: str, unit: str = "minute", by=None) -> DataFrame:
    """Two instruments at matching times: number, mean, sd, extremes of ``a - b`` and the overlap in hours."""
    by = as_list(by)

    def aligned(df: DataFrame, name: str) -> DataFrame:
        at = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
        return df.withColumn("__at", at).groupBy(*by, "__at").agg(F.avg(value).alias(name))

    d = F.col("__x") - F.col("__y")
    both = aligned(a, "__x").join(aligned(b, "__y"), [*by, "__at"])
    summary = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(d).alias("mean_diff"),
        F.stddev_samp(d).alias("sd_diff"),
        F.min(d).alias("min_diff"),
        F.max(d).alias("max_diff"),
        F.min("__at").alias("__a"),
        F.max("__at").alias("__b"),
    )
    return summary.withColumn("overlap_hours", elapsed_seconds(F.col("__b"), F.col("__a")) / 3600).drop("__a", "__b")
