"""Numeric expressions: calibration, polynomials, ratios, transforms, rounding, banding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def calibrate_expr(x: Column, raw_high: Column, raw_low: Column, ref_low: float, ref_high: float) -> Column:
    """Two-point linear calibration onto the reference range."""
    span = F.lit(float(ref_high) - float(ref_low))
    return F.try_divide((x - raw_low) * span, raw_high - raw_low) + F.lit(float(ref_low))


def poly_expr(x: Column, coefs: Sequence[float]) -> Column:
    """Polynomial with coefficients from the constant term up."""
    return reduce(lambda acc, c: acc * x + F.lit(float(c)), list(coefs)[-2::-1], F.lit(float(coefs[-1])))


def ratio(parts: Sequence[Column], den: Column) -> Column:
    """Sum of the parts over the denominator; NULL for a zero denominator or a missing part."""
    return F.try_divide(reduce(add, parts), den)


def row_min(*cols: Column, na: str = "skip") -> Column:
    low = F.least(*cols)
    return low if na == "skip" else F.when(reduce(add, [c.isNull().cast("int") for c in cols]) == 0, low)


def row_max(*cols: Column, na: str = "skip") -> Column:
    high = F.greatest(*cols)
    return high if na == "skip" else F.when(reduce(add, [c.isNull().cast("int") for c in cols]) == 0, high)


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; NULL stays NULL."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def transform_prop(p: Column, kind: str, n: Column | None = None, eps: float = 1e-6) -> Column:
    """Variance-stabilising transforms of a proportion.

    ``log``; ``asin_sqrt``; ``logit`` (bounded to [eps, 1-eps]); ``logit_n`` (0 and 1 moved by 0.5/n);
    ``squeeze`` ((p(n-1)+0.5)/n); ``nudge`` (0 and 1 moved by eps).
    """
    if kind == "log":
        return F.when(p > 0, F.log(p))
    if kind == "asin_sqrt":
        return F.asin(F.sqrt(p))
    if kind == "squeeze":
        return (p * (n - 1) + 0.5) / n
    if kind == "nudge":
        return F.when(p <= 0, F.lit(eps)).when(p >= 1, F.lit(1 - eps)).otherwise(p)
    if kind == "logit":
        q = clamp(p, eps, 1 - eps)
    elif kind == "logit_n":
        q = F.when(p <= 0, 0.5 / n).when(p >= 1, 1 - 0.5 / n).otherwise(p)
    else:
        raise ValueError(kind)
    return F.log(q / (1 - q))


def round_half_even(c: Column, k: int) -> Column:
    return F.bround(c, k)


def band(c: Column, cuts: Sequence, labels: Sequence[str], closed: str = "left") -> Column:
    """Label by ordered cuts: labels[i] below cuts[i] (``closed="left"``) or up to it (``"right"``)."""
    out = None
    for cut, label in zip(cuts, labels):
        inside = c < cut if closed == "left" else c <= cut
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return F.when(c.isNotNull(), out.otherwise(F.lit(labels[-1])))


def choose_by_label(label: Column, options: dict[str, Column]) -> Column:
    """The column belonging to the row's label; NULL for any other label."""
    out = None
    for name, col in options.items():
        out = F.when(label == name, col) if out is None else out.when(label == name, col)
    return out
