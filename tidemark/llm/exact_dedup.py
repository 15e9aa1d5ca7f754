"""Exact deduplication by distributed radix partitioning, most significant bytes first.

A text is read as its length followed by its bytes. Round after round, the next stretch of bytes (the digit) splits every
group; a group of one row leaves, and so does a group whose texts have ended, whose rows are then equal byte by byte. No
digest is compared. Digits widen (64 bytes, 4 kB, 64 kB, ...), so the number of rounds grows with the logarithm of the
longest repeated text.

Each round counts rows per (group, digit) with partial sums in every task, so a group of millions of copies costs one row
per task, and joins the counts back; adaptive execution splits the rows of a large group over tasks. Each round is a table
in the shared folder.

Cases: a null text counts as empty; an empty text is a text like any other; texts are equal when they are equal after
lower-casing A-Z only; of equal rows with equal ids one is kept; a null id gives way to any other id; an empty table gives
no rows. Input columns named like an output are replaced by it.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import by_key, packed, unpacked, written

FIRST_DIGIT = 64
SECOND_DIGIT = 4096
WIDER = 16


def folded(text: Column) -> Column:
    """Null as empty, and A-Z in lower case; other letters stay."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _digit(text: Column, at: int, width: int) -> Column:
    return F.substring(folded(text).cast("binary"), at + 1, width)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """Every row with ``keep_id`` (the largest id of its group), ``group_size``, ``kept`` and ``text_sha256``.

    ``carry`` names the input columns to return (all by default); ``text_col`` may be a field of one of them, and the text
    is then not held twice. The digest is output only; nothing is compared by it.
    """
    held = carry is None or text_col.split(".")[0] in carry
    text = F.col(f"row.{text_col}") if held else F.col("text")
    own = [] if held else ["text"]
    rows = docs.select(packed(docs, carry), F.col(id_col).alias("id"), *[F.col(text_col).alias(c) for c in own])
    rows = rows.withColumns({"sha": F.unhex(F.sha2(folded(text), 256)), "length": F.octet_length(folded(text))})
    first = rows.select("length", _digit(text, 0, FIRST_DIGIT).alias("digit"))
    shared = first.groupBy("length", "digit").agg(F.count("*").alias("n")).filter("n > 1")
    tagged = rows.withColumn("digit", _digit(text, 0, FIRST_DIGIT)).join(
        by_key(shared.select("length", "digit", F.lit(True).alias("more"))), ["length", "digit"], "left"
    )
    one = ~F.coalesce(F.col("more"), F.lit(False))
    table = written(
        tagged.select(
            "row",
            "id",
            "sha",
            "length",
            F.monotonically_increasing_id().alias("rid"),
            F.lit(0).cast("long").alias("group"),
            one.alias("done"),
            *[F.when(~one, F.col(c)).alias(c) for c in own],
            F.col("id").alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"),
        ),
        "exact-1",
    )
    finished, at, width = [table.filter("done")], 0, FIRST_DIGIT + SECOND_DIGIT
    while True:
        left = table.filter("not done").withColumn("digit", _digit(text, at, width))
        counted = left.groupBy("group", "length", "digit").agg(
            F.count("*").alias("n"), F.max(F.struct("id", "rid")).alias("last")
        )
        ended = F.col("length") <= at + width
        split = left.drop("keep_id", "group_size", "kept").join(by_key(counted), ["group", "length", "digit"])
        table = written(
            split.select(
                "row",
                "id",
                "sha",
                "length",
                "rid",
                F.col("last.rid").alias("group"),
                ((F.col("n") == 1) | ended).alias("done"),
                *[F.when((F.col("n") > 1) & ~ended, F.col(c)).alias(c) for c in own],
                F.col("last.id").alias("keep_id"),
                F.col("n").alias("group_size"),
                (F.col("last.rid") == F.col("rid")).alias("kept"),
            ),
            "exact-n",
        )
        finished.append(table.filter("done"))
        if table.filter("not done").isEmpty():
            break
        at, width = at + width, width * WIDER
    out = reduce(DataFrame.unionByName, [x.select("row", "keep_id", "group_size", "kept", "sha") for x in finished])
    out = out.withColumn("text_sha256", F.lower(F.hex("sha")))
    return unpacked(out, "keep_id", "group_size", "kept", "text_sha256")
