"""Null profile, imputation, row/column dropping, IQR outliers,
positive shift and Box-Cox.

Each statistic is one wide aggregate over all requested columns; fitted
values come back to the driver as one small row and are applied as Column
expressions, so the plan stays a single scan per fit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.functions.exprs import boxcox_expr
from tabstat.operators.order_stats import modes, quantile_wide
from tabstat.session import materialize


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Percent of NULL (or NaN) per column -> (column, pct_null)."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)

    def missing(c):
        m = F.col(c).isNull()
        if types[c] in ("double", "float"):
            m = m | F.isnan(c)
        return m

    wide = df.agg(*[(F.avg(missing(c).cast("double")) * 100.0).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "pct_null")


def median_values(df: DataFrame, cols: Sequence[str], method: str = "exact") -> dict:
    q = quantile_wide(df, cols, {"median": 0.5}, method=method).collect()
    return {r["column"]: r["median"] for r in q}


def _known(c: str, kind: str):
    """The column with NaN as NULL."""
    return F.when(~F.isnan(c), F.col(c)) if kind in ("double", "float") else F.col(c)


def _fill(df: DataFrame, values: dict, widen: bool = False) -> DataFrame:
    """NULL and NaN replaced. ``widen``: integer columns become double."""
    types = dict(df.dtypes)
    exprs = {}
    for c, v in values.items():
        if v is None:
            continue
        kind = "double" if widen and types[c] in ("tinyint", "smallint", "int", "bigint") else types[c]
        exprs[c] = F.coalesce(_known(c, types[c]).cast(kind), F.lit(v).cast(kind))
    return df.withColumns(exprs) if exprs else df


def impute_median(df: DataFrame, cols: Sequence[str], method: str = "exact") -> DataFrame:
    """Fill NULL and NaN with the exact whole-column median.

    Integer columns become double, as the median may lie between two values;
    a column without any value stays as it is.
    """
    return _fill(df, median_values(df, cols, method), widen=True)


def mode_values(df: DataFrame, cols: Sequence[str]) -> dict:
    rows = modes(df, cols).collect()
    types = dict(df.dtypes)
    out = {}
    for r in rows:
        kind = "str_value" if types[r["column"]] == "string" else "num_value" if r["int_value"] is None else "int_value"
        out[r["column"]] = r[kind]
    return out


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill NULL and NaN with the most frequent value (smallest on ties)."""
    return _fill(df, mode_values(df, cols))


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """C4: drop rows with a NULL in any of ``cols`` (all columns by default)."""
    return df.na.drop(how="any", subset=list(cols) if cols else None)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Projection by exclusion."""
    return df.drop(*cols)


def iqr_table(df: DataFrame, cols: Sequence[str], decimals: int | None = 2,
              method: str = "exact") -> DataFrame:
    """(column, q1, q3, iqr) with linear-interpolated quartiles."""
    q = quantile_wide(df, cols, {"q1": 0.25, "q3": 0.75}, method=method)
    iqr = F.col("q3") - F.col("q1")
    if decimals is None:
        return q.select("column", "q1", "q3", iqr.alias("iqr"))
    return q.select("column", F.round("q1", decimals).alias("q1"), F.round("q3", decimals).alias("q3"),
                    F.round(iqr, decimals).alias("iqr"))


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5, method: str = "exact") -> dict:
    rows = quantile_wide(df, cols, {"q1": 0.25, "q3": 0.75}, method=method).collect()
    out = {}
    for r in rows:
        q1, q3 = r["q1"], r["q3"]
        if q1 is None or q3 is None:
            out[r["column"]] = (None, None)
        else:
            out[r["column"]] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def _keep(col: str, lo, hi):
    if lo is None:
        return F.lit(False)
    return (F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi))


def remove_outliers_iqr(df: DataFrame, cols: Sequence[str], k: float = 1.5,
                        sequential: bool = True, method: str = "exact") -> DataFrame:
    """Keep rows with Q1 - k·IQR <= x <= Q3 + k·IQR (inclusive).

    ``sequential`` (the reference's behaviour): each column's quartiles are
    taken on the rows that survived the previous columns, so the result
    depends on column order. Otherwise all bounds come from one pass.
    Rows with NULL in a filtered column are dropped, so a column without any
    value leaves no row.
    """
    cols = list(cols)
    if not sequential:
        bounds = iqr_bounds(df, cols, k, method)
        cond = F.lit(True)
        for c in cols:
            cond = cond & _keep(c, *bounds[c])
        return df.where(cond)
    out = df
    for c in cols:
        lo, hi = iqr_bounds(out, [c], k, method)[c]
        out = out.where(_keep(c, lo, hi))
    return out


def positive_shift_constants(df: DataFrame, cols: Sequence[str]) -> dict:
    row = df.agg(*[F.min(c).alias(c) for c in cols]).first()
    out = {}
    for c in cols:
        m = row[c]
        if m is not None and m <= 0:
            out[c] = abs(m) + 1
    return out


def positive_shift(df: DataFrame, cols: Sequence[str], constants: dict | None = None) -> DataFrame:
    """Add |min| + 1 to every column whose minimum is <= 0."""
    consts = positive_shift_constants(df, cols) if constants is None else constants
    if not consts:
        return df
    return df.withColumns({c: F.col(c) + F.lit(v) for c, v in consts.items()})


# --- C9 Box-Cox -------------------------------------------------------------

def _llf(lam: float, n: int, sum_log: float, var_y: float) -> float:
    """Box-Cox profile log-likelihood; var_y is var_pop(x^λ) (or of ln x)."""
    if var_y is None or not var_y > 0 or n == 0:
        return -math.inf
    v = var_y if lam == 0 else var_y / (lam * lam)
    return (lam - 1.0) * sum_log - n / 2.0 * math.log(v)


def _power_moments(df: DataFrame, grids: dict) -> dict:
    """var_pop(x^λ) (ln x at λ = 0) for every column and λ, one pass.

    Each partition evaluates its whole λ grid with numpy and emits
    (n, mean, M2) per (column, λ); built-in aggregates merge the partials
    about the mean of their means (numerically stable, no Σy² cancellation).
    Output rows are columns × grid points × partitions, merged by Spark.
    """
    import numpy as np
    import pandas as pd

    cols = list(grids)
    sel = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    lam_arrays = [np.asarray(grids[c], dtype=float) for c in cols]

    def part(batches):
        acc = [[0, np.zeros(len(l)), np.zeros(len(l))] for l in lam_arrays]
        for pdf in batches:
            for i, lam in enumerate(lam_arrays):
                x = pdf[f"c{i}"].to_numpy(dtype=float)
                x = x[~np.isnan(x)]
                if x.size == 0:
                    continue
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    log = np.log(x)
                    y = np.exp(lam[:, None] * log) if (x >= 0).all() else x ** lam[:, None]  # exp is the faster one
                    y[lam == 0] = log
                    nb = x.size
                    mb = y.mean(axis=1)
                    y -= mb[:, None]
                    m2b = np.einsum("ij,ij->i", y, y)
                na, ma, m2a = acc[i]
                tot = na + nb
                delta = mb - ma
                acc[i] = [tot, ma + delta * nb / tot, m2a + m2b + delta * delta * na * nb / tot]
        rows = []
        for i, (n, m, m2) in enumerate(acc):
            if n:
                rows.append(pd.DataFrame({"col": i, "g": np.arange(len(m)), "n": n, "mean": m, "m2": m2}))
        if rows:
            yield pd.concat(rows, ignore_index=True)

    schema = "col int, g long, n long, mean double, m2 double"
    parts = materialize(sel.mapInPandas(part, schema), "checkpoint")  # read twice below, a few rows a partition
    # Chan's update for all partials of a cell at once: their own M2, and the
    # spread of their means about a mean of means that is close to all of them
    near = parts.groupBy("col", "g").agg(F.avg("mean").alias("near"))
    shifted = parts.join(near, ["col", "g"]).withColumn("d", F.col("mean") - F.col("near"))
    merged = shifted.groupBy("col", "g").agg(
        ((F.sum("m2") + F.sum(F.col("n") * F.col("d") * F.col("d")) - F.sum(F.col("n") * F.col("d")) * F.sum(F.col("n") * F.col("d")) / F.sum("n"))
         / F.sum("n")).alias("var")).collect()
    out = {c: [None] * len(grids[c]) for c in cols}
    for r in merged:
        out[cols[r["col"]]][r["g"]] = r["var"]
    return out


def boxcox_llf(df: DataFrame, col: str, lams: Sequence[float]) -> list[float]:
    """Box-Cox log-likelihood of ``col`` at each λ (one pass)."""
    row = df.agg(F.count(col).alias("n"), F.sum(F.log(F.col(col))).alias("sl")).first()
    var = _power_moments(df, {col: list(lams)})[col]
    return [_llf(lam, row["n"], row["sl"], v) for lam, v in zip(lams, var)]


def boxcox_lambdas(df: DataFrame, cols: Sequence[str], lo: float = -5.0, hi: float = 5.0,
                   points: int = 41, rounds: int = 4) -> dict:
    """Maximum-likelihood λ per column.

    Every round evaluates a λ grid for all columns in one vectorised pass
    and narrows the bracket around the best point (10× per round); a final
    parabola through the best three points refines λ. The bracket moves
    outwards when the optimum sits on its edge.
    """
    cols = list(cols)
    first = df.agg(*[F.min(c).alias(f"{c}__min") for c in cols],
                   *[F.count(c).alias(f"{c}__n") for c in cols],
                   *[F.sum(F.log(F.col(c))).alias(f"{c}__sl") for c in cols]).first()
    for c in cols:
        m = first[f"{c}__min"]
        if m is not None and m <= 0:
            raise ValueError(f"column {c!r} has values <= 0; shift it first (positive_shift)")
    grids = {c: [lo + (hi - lo) * i / (points - 1) for i in range(points)] for c in cols}
    best = {}
    narrowed = {c: 0 for c in cols}
    for _ in range(rounds + 6):
        active = [c for c in cols if narrowed[c] < rounds]
        if not active:
            break
        var = _power_moments(df, {c: grids[c] for c in active})
        for c in active:
            g = grids[c]
            vals = [_llf(lam, first[f"{c}__n"], first[f"{c}__sl"], v) for lam, v in zip(g, var[c])]
            j = max(range(len(g)), key=lambda i: vals[i])
            step = g[1] - g[0]
            best[c] = (g[j], vals[j], g, vals, j)
            if j in (0, len(g) - 1) and narrowed[c] == 0:
                centre = g[j] + (-1 if j == 0 else 1) * step * (len(g) // 2)
                grids[c] = [centre + step * (i - len(g) // 2) for i in range(len(g))]
                continue
            narrowed[c] += 1
            if narrowed[c] < rounds:
                new_step = step / 10.0
                grids[c] = [g[j] + new_step * (i - 10) for i in range(21)]
    out = {}
    for c in cols:
        lam, _, g, vals, j = best[c]
        if 0 < j < len(g) - 1:
            x0, x1 = g[j - 1], g[j]
            y0, y1, y2 = vals[j - 1], vals[j], vals[j + 1]
            den = (y0 - 2 * y1 + y2)
            if den < 0 and all(math.isfinite(v) for v in (y0, y1, y2)):
                lam = x1 + 0.5 * (x1 - x0) * (y0 - y2) / den
        out[c] = float(lam)
    return out


def boxcox(df: DataFrame, cols: Sequence[str], lambdas: dict | None = None) -> tuple[DataFrame, dict]:
    """Box-Cox transform with given or maximum-likelihood λ per column."""
    cols = list(cols)
    if lambdas is None:
        lambdas = boxcox_lambdas(df, cols)
    else:
        row = df.agg(*[F.min(c).alias(c) for c in cols]).first()
        for c in cols:
            if row[c] is not None and row[c] <= 0:
                raise ValueError(f"column {c!r} has values <= 0; shift it first (positive_shift)")
    return df.withColumns({c: boxcox_expr(c, lambdas[c]) for c in cols}), lambdas
