"""Text expressions and column-name cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def clean_name(name: str) -> str:
    """Snake case: word boundaries and other characters become one underscore; a leading digit gets ``x``."""
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
    return f"x{s}" if s[:1].isdigit() else s or "x"


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case every column; repeats get ``_2``, ``_3``, ..."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = clean_name(c)
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def interaction(*cols, sep: str = ".") -> Column:
    """Composite key; NULL if any part is NULL."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.concat_ws(sep, *[p.cast("string") for p in parts]))


def str_upper(c: Column) -> Column:
    return F.upper(c)


def str_flag(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs; a missing text has no match."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def str_part(c: Column, sep: str, i: int) -> Column:
    """The i-th part (from 1) of a separated text."""
    return F.split_part(c, F.lit(sep), F.lit(i))


def str_strip(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def str_replace_trim(c: Column, pattern: str, by: str) -> Column:
    return F.trim(F.regexp_replace(c, pattern, by))
