"""Small Column-expression helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def measured(x) -> Column:
    """The value as double, NaN as NULL: a NaN is a missing measurement in
    every operator that needs a place or a distance for each value."""
    c = _c(x).cast("double")
    return F.when(~F.isnan(c), c)


def safe_div(num, den, default=None) -> Column:
    """num / den, ``default`` (NULL) when den is 0 or NULL (ANSI-safe)."""
    n, d = _c(num), _c(den)
    fallback = F.lit(default) if default is not None else F.lit(None).cast("double")
    return F.when(d.isNull() | (d == 0), fallback).otherwise(n / d)


def bin_index(x, lo: float, width: float, nbins: int) -> Column:
    """Equal-width bin over [lo, lo + nbins*width], last bin closed."""
    c = _c(x).cast("double")
    if width <= 0:
        return F.when(c.isNotNull(), F.lit(0).cast("long"))
    return F.least(F.floor((c - F.lit(lo)) / F.lit(width)), F.lit(nbins - 1)).cast("long")


def right_closed_bins(x, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Interval label of ``x`` for right-closed bins (lowest edge included).

    ``edges`` e0 < e1 < ... < ek define bins [e0, e1], (e1, e2], ...; values
    outside [e0, ek] or NULL give NULL. Returns the label (or the 0-based
    bin number when ``labels`` is None).
    """
    if len(edges) < 2:
        raise ValueError("need at least two edges")
    if labels is not None and len(labels) != len(edges) - 1:
        raise ValueError("labels must have one entry per bin")
    c = _c(x).cast("double")
    outs = [F.lit(lab) for lab in labels] if labels is not None else [F.lit(i) for i in range(len(edges) - 1)]
    expr = F.when(c.isNull() | (c < F.lit(float(edges[0]))) | (c > F.lit(float(edges[-1]))), F.lit(None))
    for i in range(1, len(edges)):
        expr = expr.when(c <= F.lit(float(edges[i])), outs[i - 1])
    return expr


def boxcox_expr(x, lam: float) -> Column:
    """(x^λ - 1)/λ, ln x at λ = 0 (input must be positive)."""
    c = _c(x).cast("double")
    if lam == 0:
        return F.log(c)
    return (F.pow(c, F.lit(float(lam))) - F.lit(1.0)) / F.lit(float(lam))
