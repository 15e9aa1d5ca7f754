"""Quality rules on documents and on the hosts they come from.

Each document is measured from its whole text and tested by its own rules: two base rules, and with ``every_rule`` also the
share of symbols, of repeated lines and the mean word length. Failures are then counted per host, each host's failure rate
is drawn towards the rate of all hosts by a beta prior fitted to the hosts themselves, and a host whose drawn rate is too
high loses its remaining documents as well. A host with few documents is drawn most, so a handful of short pages does not
condemn it.

Cases: a null text has no words and fails; the null host is a host of its own; repeated rows count as often as they
occur; an empty table gives no rows; with no or only failures the prior has strength 1. Input columns named like an output
are replaced by it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import packed, small, unpacked, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_WORDS = 50
MAX_REPEAT = 50
MAX_HOST_RATE = 0.8
#: Symbols a word and repeated lines in percent, and mean characters of a word.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_CHARS = 10, 50, (3, 10)
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that occurs twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = code[:-1] * len(number) + code[1:]
    pair = np.unique(pairs, return_inverse=True)[1]
    windows = pair[:-1] * len(number) + code[2:]
    _, at, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def filled_lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip(" \t\v\f\r")]


def measure(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()  # of bytes: at the six white-space characters of ASCII only
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = filled_lines(text)
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [*(x.split()[0] for x in MEASURES.split(", ")), "n_lines"]
    for batch in texts:
        found = [(*measure(t or ""), len(filled_lines(t or ""))) for t in batch.to_pylist()]
        columns = list(zip(*found, strict=True)) or [[] for _ in names]
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def measured(text: Column) -> Column:
    kinds = ", ".join(x.replace(" ", ": ") for x in MEASURES.split(", "))
    return F.arrow_udf(_measured, f"struct<{kinds}, n_lines: long>")(text)


def rules_failed(m: Column) -> Column:
    """By the rules beyond the base rules; whole numbers only."""
    return (
        (100 * m["n_symbols"] > MAX_SYMBOLS * m["n_words"])
        | (100 * m["n_dup_lines"] > MAX_DUP_LINES * m["n_lines"])
        | (m["word_chars"] < WORD_CHARS[0] * m["n_words"])
        | (m["word_chars"] > WORD_CHARS[1] * m["n_words"])
    )


def host_rates(rows: DataFrame) -> DataFrame:
    """Documents, failures and drawn failure rate of each host (column ``rated``).

    The prior's mean is the rate of all documents; its strength follows from how much more the hosts' rates vary than
    counting alone explains (moments, weighted by documents), between 1 and a million.
    """
    hosts = rows.groupBy("host").agg(
        F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed")
    )
    hosts = written(hosts, "hosts")
    docs, failed, n, squares = hosts.agg(
        F.sum("host_docs"),
        F.sum("host_failed"),
        F.count("*"),
        F.sum(F.col("host_failed") * F.col("host_failed") / F.col("host_docs")),
    ).first()
    mean, strength = fitted_prior(docs or 0, failed or 0, n, squares or 0.0)
    drawn = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return small(hosts.select(F.col("host").alias("rated"), "host_docs", "host_failed", drawn.alias("host_rate")), n)


def fitted_prior(docs: int, failed: int, hosts: int, squares: float) -> tuple[float, float]:
    """Mean and strength; ``squares`` is the sum over hosts of failed * failed / docs."""
    mean = failed / docs if docs else 0.0
    spread = mean * (1 - mean)
    if spread <= 0:
        return mean, 1.0
    between = squares / docs - mean * mean - hosts * spread / docs
    return mean, 1e6 if between <= 0 else max(1.0, min(1e6, spread / between - 1))


def quality(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    carry: list[str] | None = None,
    max_host_rate: float = MAX_HOST_RATE,
    every_rule: bool = False,
) -> DataFrame:
    """Every row with its measures, ``base_failed``, its host's counts and rate, and ``kept``.

    ``every_rule``: documents and hosts are judged by all rules, not by the base rules alone.
    """
    names = [x.split()[0] for x in MEASURES.split(", ")]
    rows = docs.select(packed(docs, carry), F.col(host_col).alias("host"), measured(F.col(text_col)).alias("m"))
    base = (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEAT * F.col("m.n_words"))
    failed = base | rules_failed(F.col("m")) if every_rule else base
    rows = written(rows.select("row", "host", "m.*", base.alias("base_failed"), failed.alias("failed")), "quality")
    rates = host_rates(rows)
    joined = rows.join(rates, F.col("host").eqNullSafe(F.col("rated")))
    joined = joined.withColumn("kept", ~F.col("failed") & (F.col("host_rate") <= max_host_rate))
    return unpacked(joined, *names, "base_failed", "host_docs", "host_failed", "host_rate", "kept")
