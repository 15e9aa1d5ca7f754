"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, target / source size. Documents stand in order of
falling size; their expected copies are summed along that order, one random offset is added per source, and a document is
emitted once for each whole number its stretch of the sum crosses. The sum is kept in whole units of 2**-24 copies, so it
is exact and reruns agree.

A document above a hundredth of its source's target is large: whether it is drawn moves the total by itself. Large
documents come first in the order, so what they gave is known, and the others' expected copies are set to make up what
is then left of the target. The words taken so differ from the target by about a hundredth at most.

The running sum is made in two levels: rows are counted per (source, size) cell, cells too full for one task are cut
along a hash, and only these counts are summed along a source. No task holds a whole source.

Cases: a null or empty text has size 0 and is sampled like any other row but adds no words; a null source is a source of
its own, after all others; repeated rows are sampled one by one; an empty table gives no rows; a source without words
has target 0 and is left out of the mix (0 copies). Input columns named like an output are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import WORD, packed, small, unpacked, written

UNIT_BITS = 24
UNIT = 1 << UNIT_BITS


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Target of each source: its share of all sizes by weight, at most ``cap`` times its own size.

    ``sizes`` has one row per source (source, source_size). Shares above a cap are handed on by weight until none is
    above; with sources in order of cap / weight, those capped come first and the rest share what remains.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    everywhere = Window.partitionBy()
    weighed = sizes.select(
        "source",
        "source_size",
        F.element_at(
            F.array(*map(F.lit, weights)), ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int")
        ).alias("weight"),
    ).withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    level = weighed.select(
        "*",
        F.row_number().over(by_cap).alias("nth"),
        (
            (
                F.sum("source_size").over(everywhere)
                - F.coalesce(F.sum(cap * F.col("source_size")).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            )
            / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
        ).alias("level"),
    )
    open_ = F.col("level") * F.col("weight") <= cap * F.col("source_size")
    shared = F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("nth"))).over(everywhere)
    return level.withColumn("shared", shared).select(
        "source",
        "source_size",
        F.when(open_, F.col("shared") * F.col("weight")).otherwise(cap * F.col("source_size")).cast("double").alias("target"),
    )


def _step(wanted: Column, size: Column, cap: int) -> Column:
    """Expected copies in whole units."""
    each = F.least(F.floor(wanted / size * UNIT), F.lit(cap * UNIT))
    return F.when(size > 0, F.greatest(each, F.lit(0))).otherwise(0).cast("long")


def _whole(nth: Column, at: str = "") -> Column:
    """Whole numbers reached after ``nth`` documents of a source."""
    step, offset, large, rest = (F.col(at + c) for c in ("step", "offset", "large", "rest_step"))
    return F.shiftright(offset + F.least(nth, large) * step + F.greatest(nth - large, F.lit(0)) * rest, UNIT_BITS)


def _with_rest(cells: DataFrame, goal: DataFrame, cap: int) -> DataFrame:
    """``goal`` with the number of large documents and the step of the others."""
    along = Window.partitionBy("source").orderBy(F.desc("size"))
    placed = cells.withColumn("upto", F.sum("n").over(along)).join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
    large = F.col("size") * 100 > F.col("target")
    drawn = F.shiftright(F.col("offset") + F.col("upto") * F.col("step"), UNIT_BITS) - F.shiftright(
        F.col("offset") + (F.col("upto") - F.col("n")) * F.col("step"), UNIT_BITS
    )
    sums = placed.groupBy("goal_source", "source_size", "target", "step", "offset").agg(
        F.sum(F.when(large, F.col("n")).otherwise(0)).cast("long").alias("large"),
        F.sum(F.when(large, F.col("size") * F.col("n")).otherwise(0)).alias("large_size"),
        F.sum(F.when(large, F.col("size") * drawn).otherwise(0)).alias("large_taken"),
    )
    rest = _step(F.col("target") - F.col("large_taken"), F.col("source_size") - F.col("large_size"), cap)
    return sums.withColumn("rest_step", rest).drop("large_size", "large_taken")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: list[str] | None = None,
    reread: bool = False,
    cell_rows: int = 100_000,
) -> DataFrame:
    """One row per document with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies x size).

    ``carry`` names the input columns to keep (all by default). With ``reread`` the input is read a second time in place
    of storing the carried columns beside the sizes: for wide rows. A cell of more than ``cell_rows`` rows is cut along a
    hash. The table of sources is one small row each and is ordered in one task; everything else is split.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        packed(docs, carry),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)).alias("tie"),
    )
    narrow = written(sized.drop("row") if reread else sized, "mix-sizes")
    rows = sized if reread else narrow

    cells = written(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    per_source = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    goal = targets(per_source, weights, cap).withColumns(
        {
            "step": _step(F.col("target"), F.col("source_size"), cap),
            "offset": F.conv(
                F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("source"), F.lit("")))), 1, UNIT_BITS // 4),
                16,
                10,
            ).cast("long"),
        }
    )
    goal = written(_with_rest(cells, goal.withColumnRenamed("source", "goal_source"), cap), "mix-goals")
    full = cells.filter(F.col("n") > cell_rows).select(
        F.col("source").alias("full_source"),
        F.col("size").alias("full_size"),
        F.least(F.ceil(F.col("n") / cell_rows), F.lit(65536)).alias("parts"),
    )

    full = written(full, "mix-full")
    n_full = full.count()

    def cut(df: DataFrame) -> DataFrame:
        if not n_full:
            return df.withColumn("part", F.lit(0).cast("long"))
        part = F.floor(F.conv(F.substring("tie", 1, 4), 16, 10).cast("long") * F.col("parts") / 65536)
        same = F.col("source").eqNullSafe(F.col("full_source")) & (F.col("size") == F.col("full_size"))
        return df.join(small(full, n_full), same, "left").withColumn("part", F.coalesce(part, F.lit(0)).cast("long")).drop(*full.columns)

    # Plain columns, alike on both sides whatever their nullability; rows ranked by cell are joined without another shuffle.
    cell = ["cell_source", "cell_null", "size", *["part"] * bool(n_full)]

    def celled(df: DataFrame) -> DataFrame:
        return df.withColumns({"cell_source": F.coalesce("source", F.lit("")), "cell_null": F.col("source").isNull()})

    along = Window.partitionBy("source").orderBy(F.desc("size"), "part")
    starts = (
        cut(narrow)
        .groupBy("source", "size", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(along) - F.col("n"))
    )
    starts = celled(starts.join(goal, F.col("source").eqNullSafe(F.col("goal_source")))).select(
        *cell, "before", "source_size", "target", F.struct("step", "offset", "large", "rest_step").alias("goal")
    )
    inside = Window.partitionBy(*cell).orderBy("tie")
    placed = celled(cut(rows)).withColumn("nth", F.row_number().over(inside)).join(starts, cell)
    nth = F.col("before") + F.col("nth")
    crossed = _whole(nth, "goal.") - _whole(nth - 1, "goal.")
    mixed = placed.withColumn("copies", crossed.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return unpacked(mixed, "size", "source_size", "target", "copies", "taken")


def emitted(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it was drawn."""
    drawn = mixed.filter(F.col("copies") > 0).select(
        F.struct(*columns).alias("row"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    )
    return drawn.select("row.*")
