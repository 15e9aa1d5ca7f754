"""Schema shaping: selection, harmonising versions, missing codes, unpivot and pivot."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.operators.ordered import as_list


def select_cols(
    df: DataFrame,
    pos: Sequence[int] | None = None,
    drop_last: int = 0,
    drop_matching: str | None = None,
    keep_matching: str | None = None,
    rename_contains: dict[str, str] | None = None,
) -> DataFrame:
    """Choose columns by position (from 1), drop the last ones, filter by regular expression, rename by substring."""
    names = list(df.columns)
    if pos is not None:
        names = [names[p - 1] for p in pos]
    if drop_last:
        names = names[:-drop_last]
    if drop_matching:
        names = [n for n in names if not re.search(drop_matching, n)]
    if keep_matching:
        names = [n for n in names if re.search(keep_matching, n)]
    renamed = {}
    for part, new in (rename_contains or {}).items():
        renamed.update({n: new for n in names if part in n})
    return df.select(*[F.col(f"`{n}`").alias(renamed.get(n, n)) for n in names])


def harmonise(dfs: Sequence[DataFrame], target: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Append tables of different schema versions in the target's column order and types.

    A column a version lacks gets its default: a value, or the name of another target column as ``"=name"``.
    """
    defaults = defaults or {}

    def fill(df: DataFrame) -> DataFrame:
        out = df
        for f in target.fields:
            if f.name not in df.columns:
                d = defaults.get(f.name)
                value = F.col(d[1:]) if isinstance(d, str) and d.startswith("=") else F.lit(d)
                out = out.withColumn(f.name, value.cast(f.dataType))
        return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])

    return reduce(DataFrame.unionByName, [fill(d) for d in dfs])


def null_sentinels(df: DataFrame, codes: Sequence, cols) -> DataFrame:
    """Turn any of several missing-value codes into NULL."""
    return df.withColumns({c: F.when(~F.col(c).isin(*codes), F.col(c)) for c in as_list(cols)})


def source_priority(df: DataFrame, cols: Sequence[str], sentinel: float, out: str, source: str) -> DataFrame:
    """First column below the sentinel wins; rows where none does are dropped."""
    usable = [F.when(F.col(c) < sentinel, F.col(c)) for c in cols]
    name: Column | None = None
    for c in cols:
        hit = F.col(c) < sentinel
        name = F.when(hit, F.lit(c)) if name is None else name.when(hit, F.lit(c))
    return df.withColumn(out, F.coalesce(*usable)).withColumn(source, name).filter(F.col(out).isNotNull())


def unify_units(df: DataFrame, out: str, twins: Sequence[str], factor: float, when: Column) -> DataFrame:
    """Coalesce twin columns and convert the unit on rows where ``when`` holds; the twins are dropped."""
    value = F.coalesce(*[F.col(c) for c in twins])
    merged = df.withColumn("__unit", F.when(when, value * F.lit(float(factor))).otherwise(value))
    return merged.drop(*twins).withColumnRenamed("__unit", out)


def fill_residual(df: DataFrame, cats: Sequence[str], total: str) -> DataFrame:
    """Missing categories: the first missing one takes ``total`` minus the present ones, further ones 0."""
    present = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in cats])
    residual = F.col(total) - present
    filled, earlier = {}, F.lit(False)
    for c in cats:
        missing = F.col(c).isNull()
        filled[c] = F.when(missing & earlier, F.lit(0)).when(missing, residual).otherwise(F.col(c))
        earlier = earlier | missing
    return df.withColumns(filled)


def require(df: DataFrame, cols) -> DataFrame:
    """Drop rows with NULL in any of the columns."""
    return df.dropna(subset=as_list(cols))


def time_filter(
    df: DataFrame,
    ts: str,
    lo: str | None = None,
    hi: str | None = None,
    closed: str = "both",
    exclude: Sequence[tuple[str, str]] = (),
    exclude_at: Sequence[str] = (),
) -> DataFrame:
    """Keep a time range (``closed``: both, left, right, neither) without closed sub-ranges and single instants."""

    def at(v: str) -> Column:
        return F.lit(v).cast("timestamp_ntz")

    t, out = F.col(ts), df
    if lo is not None:
        out = out.filter(t >= at(lo) if closed in ("both", "left") else t > at(lo))
    if hi is not None:
        out = out.filter(t <= at(hi) if closed in ("both", "right") else t < at(hi))
    for a, b in exclude:
        out = out.filter(~t.between(at(a), at(b)))
    return out.filter(~t.isin(*[at(x) for x in exclude_at])) if exclude_at else out


def rescale(df: DataFrame, c: str, lo: float, hi: float, out: str) -> DataFrame:
    """Min-max rescale over the whole table (a one-row scalar subquery)."""
    ends = df.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias("e"))
    wide = df.withColumn("__e", ends.scalar())
    share = F.try_divide(F.col(c) - F.col("__e.lo"), F.col("__e.hi") - F.col("__e.lo"))
    return wide.withColumn(out, F.lit(float(lo)) + share * F.lit(float(hi) - float(lo))).drop("__e")


def bias_correct(df: DataFrame, c: str, bias: float, out: str) -> DataFrame:
    return df.withColumn(out, F.col(c) + F.lit(float(bias)))


def to_long(df: DataFrame, ids, cols, key: str = "sensor", value: str = "temperature") -> DataFrame:
    """Unpivot probe columns into (key, value) rows."""
    return df.unpivot(as_list(ids), as_list(cols), key, value)


def to_wide(df: DataFrame, ids, key: str, value: str, keys: Sequence, agg=F.first) -> DataFrame:
    """Pivot the listed key values into columns (listing them avoids a pass over the data)."""
    return df.groupBy(*as_list(ids)).pivot(key, list(keys)).agg(agg(value))
