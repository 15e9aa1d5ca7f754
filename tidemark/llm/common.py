"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.session import checkpoint_root

# Functions for Python workers travel by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows up to which a side of a join is broadcast; their number is counted before. The second holds for rows of a few numbers.
BROADCAST_ROWS, BROADCAST_NUMBERS = 20_000, 200_000
#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder with the rows of ``df``: computed once, narrow to read, safe from lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tidemark-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The input row (or the named columns of it) as one struct, so that no own column can clash with it."""
    names = df.columns if columns is None else columns
    return F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")


def boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """Whole rows as one column ``document``, beside the columns that an operator reads."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), *columns)


def unpacked(df: DataFrame, *outputs: str) -> DataFrame:
    """The packed row's columns, then ``outputs``; an input column named like an output gives way to it."""
    own = {o.lower() for o in outputs}
    names = [f.name for f in df.schema["row"].dataType.fields if f.name.lower() not in own]
    return df.select(*[F.col("row").getField(c).alias(c) for c in names], *outputs)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, marked for broadcast if they are few, and else to be joined by its key.

    Spark itself sizes a table by its compressed files and takes an explode for one row each, so it would pass large tables
    through the driver.
    """
    numbers = all(isinstance(field.dataType, T.NumericType) for field in df.schema)
    return F.broadcast(df) if rows <= (BROADCAST_NUMBERS if numbers else BROADCAST_ROWS) else by_key(df)


def by_key(df: DataFrame) -> DataFrame:
    """``df`` marked to be joined by its key, whatever Spark takes for its size: it may be large."""
    return df.hint("merge")


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python process of a worker, across tasks."""
    return vars(sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")))


def give_back() -> None:
    """What a worker has freed goes back to the system: workers outlive their tasks, beside the executor's next ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass
