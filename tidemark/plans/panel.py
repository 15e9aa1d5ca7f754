"""The biology panel: counts, behaviour and sizes merged, with growth features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.numeric import band, ratio
from tidemark.operators.joins import full_panel
from tidemark.operators.shape import fill_residual
from tidemark.operators.windows import cumsum, diff_prev
from tidemark.session import cut_lineage

CATEGORIES = ["open", "partial_open", "partial_closed", "closed"]


def merge_panel(behavior: DataFrame, counts: DataFrame, sizes: DataFrame, keys: Sequence[str], since: str, phase_end: str):
    """Full outer merge on the keys with treatment, filled categories, shares and phase.

    Tanks below 6 are cold, above 10 extreme, the rest severe. The phase is ``during`` before ``phase_end``.
    """
    # ``date`` is a key: a filter above the full joins would not reach the inputs.
    recent = [x.filter(F.col("date") >= F.lit(since).cast("date")) for x in (behavior, counts, sizes)]
    merged = full_panel(recent, keys)
    merged = merged.withColumn("treatment", band(F.col("tank"), [6, 11], ["cold", "severe", "extreme"]))
    filled = fill_residual(merged, CATEGORIES, "n")
    n, part = F.col("n"), F.col
    return filled.withColumns(
        {
            "percent_open": ratio([part("open"), part("partial_open")], n),
            "percent_closed": ratio([part("closed"), part("partial_closed")], n),
            "percent_fully_open": ratio([part("open")], n),
            "mhw": band(F.col("date"), [F.lit(phase_end).cast("date")], ["during", "after"]),
        }
    )


def growth_features(panel: DataFrame, unit: Sequence[str], chunk=None) -> DataFrame:
    """Cumulative removals, true counts, and their change and growth per unit and per unit and phase."""
    unit = list(unit)
    out = cumsum(panel, unit, "date", "removed", "removed_cum", na="poison", fill=0, chunk=chunk)
    out = out.withColumn("n_true", F.col("alive") + F.col("dying_dead") + F.col("removed_cum") + F.col("floating"))
    out = cut_lineage(diff_prev(out, unit, "date", "n_true", "diff_n_cont", chunk))
    out = cumsum(out, unit, "date", "diff_n_cont", "growth_rate_cont", chunk=chunk)
    out = out.withColumn("total_biomass", F.col("avg_biomass_g") * F.col("n_true"))
    out = cut_lineage(diff_prev(out, [*unit, "mhw"], "date", "n_true", "diff_n", chunk))
    return cumsum(out, [*unit, "mhw"], "date", "diff_n", "growth_rate", chunk=chunk)
