"""Grouped and calendar aggregates, describe, correlation,
histograms, kernel densities, box statistics, trend lines, class weights.

Densities evaluate a fixed grid inside one aggregate: every (collapsed)
value row is expanded by ``explode(sequence(0, G-1))`` within the same
codegen stage and summed per grid index with partial aggregation, so no
join is needed and the shuffle carries at most groups x G rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabstat.functions.exprs import bin_index, measured, safe_div
from tabstat.operators.order_stats import melt_values, modes, quantile_wide
from tabstat.operators.rank import _as_list, broadcast_if_small

_AGGS = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max,
         "count": F.count, "std": F.stddev_samp, "var": F.var_samp}


def _attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach per-group statistics: a null-safe equi-join on the group keys
    against the size-checked side table (a NULL group keeps its rows); without
    group keys the single statistics row is inlined as literals (no join)."""
    if by:
        small, _ = broadcast_if_small(stats)
        left, right = df.alias("_l"), small.alias("_s")
        on = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_s.{k}")) for k in by]
        return left.join(right, on=on, how="inner").select("_l.*", *[F.col(f"_s.{c}") for c in stats.columns if c not in by])
    row = stats.first()
    if row is None:
        return df.where(F.lit(False)).select("*", *[F.lit(None).alias(c) for c in stats.columns])
    return df.select("*", *[F.lit(row[c]).alias(c) for c in stats.columns])


def group_agg(df: DataFrame, keys: Sequence[str], spec: Mapping[str, tuple[str, str]]) -> DataFrame:
    """A1-A3: ``spec`` maps output name -> (column, aggregate name)."""
    return df.groupBy(*keys).agg(*[_AGGS[a](c).alias(name) for name, (c, a) in spec.items()])


def group_sum(df: DataFrame, keys: Sequence[str], col: str, out: str = "total") -> DataFrame:
    return group_agg(df, keys, {out: (col, "sum")})


def group_mean(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return group_agg(df, keys, {f"mean_{c}": (c, "mean") for c in cols})


def value_counts(df: DataFrame, col: str, out: str = "count") -> DataFrame:
    """A4: count per category (sorted by count desc, then value)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), F.asc(col))


def share_of_total(df: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """A5: each group's total and its share of the grand total.

    The grand total is one aggregate over the groups, so a key of any
    cardinality stays distributed.
    """
    amount = F.sum(value) if value else F.count(F.lit(1))
    agg = df.groupBy(key).agg(amount.cast("double").alias("total"))
    grand = agg.agg(F.sum("total")).first()[0]
    return agg.withColumn("share", F.col("total") / F.lit(grand).cast("double"))


_UNIT_INTERVAL = {"year": "1 year", "quarter": "3 months", "month": "1 month", "week": "7 days",
                  "day": "1 day", "hour": "1 hour"}


def resample(df: DataFrame, ts: str, unit: str, spec: Mapping[str, tuple[str, str]],
             label: str | None = None) -> DataFrame:
    """Calendar bins between the first and last observation.

    Empty bins are emitted (sum 0, count 0, other aggregates NULL) through a
    spine built with ``sequence`` from the min/max period: the spine has one
    row per period, not per observation. Labels follow the pandas
    convention: period end for year/quarter/month, start otherwise.
    Output: period (yyyy-MM-dd text), then one column per spec entry.
    """
    if unit not in _UNIT_INTERVAL:
        raise ValueError(f"unsupported unit {unit!r}")
    label = label or ("end" if unit in ("year", "quarter", "month") else "start")
    p = F.date_trunc(unit, F.col(ts).cast("timestamp"))
    agg = df.groupBy(p.alias("_p")).agg(*[_AGGS[a](c).alias(name) for name, (c, a) in spec.items()])
    bounds = agg.agg(F.min("_p").alias("lo"), F.max("_p").alias("hi"))
    spine = bounds.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {_UNIT_INTERVAL[unit]}"))).alias("_p"))
    joined = spine.join(agg, on="_p", how="left")
    out = []
    for name, (_, a) in spec.items():
        if a in ("sum", "count"):
            out.append(F.coalesce(F.col(name), F.lit(0)).alias(name))
        else:
            out.append(F.col(name))
    if label == "end":
        step = {"year": "1 year", "quarter": "3 months", "month": "1 month"}[unit]
        lab = F.date_sub(F.to_date(F.col("_p") + F.expr(f"INTERVAL {step}")), 1)
    else:
        lab = F.to_date("_p") if unit != "hour" else F.col("_p")
    fmt = "yyyy-MM-dd HH:mm:ss" if unit == "hour" else "yyyy-MM-dd"
    return joined.select(F.date_format(lab, fmt).alias("period"), *out)


def describe_table(df: DataFrame, cols: Sequence[str], decimals: int = 2, method: str = "exact") -> DataFrame:
    """(column, mean, median, mode, stddev, min, max).

    Mean, median, mode and sample std rounded to ``decimals``; min and max
    raw. One moments aggregate, one quantile job, one mode shuffle.
    """
    cols = list(cols)
    mom = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("stddev"),
                            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c)
                   for c in cols])
    mom = mom.unpivot([], cols, "column", "_s").select("column", "_s.*")
    med = quantile_wide(df, cols, {"median": 0.5}, method=method)
    mo = modes(df, cols).select("column", F.col("num_value").alias("mode"))
    out = mom.join(med, "column", "left").join(mo, "column", "left")
    r = lambda c: F.round(c, decimals)
    return out.select("column", r("mean").alias("mean"), r("median").alias("median"), r("mode").alias("mode"),
                      r("stddev").alias("stddev"), "min", "max")


def _pairs(cols, diagonal=True):
    for i, a in enumerate(cols):
        for b in cols[i if diagonal else i + 1:]:
            yield a, b


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation, long form (x, y, corr), both triangles."""
    cols = list(cols)
    pairs = list(_pairs(cols, diagonal=False))
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)]) if pairs else None
    r = row.first() if row is not None else None
    data = [(c, c, 1.0) for c in cols]
    for i, (a, b) in enumerate(pairs):
        v = r[f"{i}"]
        data += [(a, b, v), (b, a, v)]
    return df.sparkSession.createDataFrame(data, "x string, y string, corr double")


def cov_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample covariance, long form (x, y, cov)."""
    cols = list(cols)
    pairs = list(_pairs(cols))
    r = df.agg(*[F.covar_samp(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    data = []
    for i, (a, b) in enumerate(pairs):
        v = r[f"{i}"]
        data.append((a, b, v))
        if a != b:
            data.append((b, a, v))
    return df.sparkSession.createDataFrame(data, "x string, y string, cov double")


def histogram(df: DataFrame, cols: Sequence[str], nbins: int = 20) -> DataFrame:
    """A10: equal-width counts over [min, max] per column, last bin closed.

    Output (column, bin, lo, hi, count) for non-empty bins; all columns share
    one melt + one grouped count. NaN counts as missing, here and in the other
    operators of this module.
    """
    if not 1 <= nbins:
        raise ValueError("nbins must be >= 1")
    cols = list(cols)
    r = df.agg(*[F.min(measured(c)).alias(f"{c}__lo") for c in cols],
               *[F.max(measured(c)).alias(f"{c}__hi") for c in cols]).first()
    long = melt_values(df, cols)
    expr = None
    meta = []
    for c in cols:
        lo, hi = r[f"{c}__lo"], r[f"{c}__hi"]
        if lo is None:
            continue
        w = (hi - lo) / nbins
        meta.append((c, lo, w))
        b = bin_index(F.col("value"), lo, w, nbins)
        expr = F.when(F.col("column") == c, b) if expr is None else expr.when(F.col("column") == c, b)
    if expr is None:
        return df.sparkSession.createDataFrame([], "column string, bin long, lo double, hi double, count long")
    counted = long.select("column", expr.alias("bin")).groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
    m = df.sparkSession.createDataFrame(meta, "column string, _lo double, _w double")
    return (counted.join(F.broadcast(m), "column")
            .select("column", "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("hi"), "count"))


def histogram_density(df: DataFrame, col: str, width: float = 1.0, origin: float = 0.0,
                      by: Sequence[str] = ()) -> DataFrame:
    """Fixed-width bins from ``origin``; density = count / (n · width)."""
    x = measured(col)
    b = F.floor((x - F.lit(origin)) / F.lit(width)).cast("long")
    counted = df.where(x.isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    n = F.sum("count").over(Window.partitionBy(*by))  # over aggregated bins only
    return counted.select(*by, "bin", (F.lit(origin) + F.col("bin") * F.lit(width)).alias("lo"),
                          (F.lit(origin) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "count",
                          (F.col("count") / (n * F.lit(width))).alias("density"))


def histogram_2d(df: DataFrame, x: str, y: str, nx: int = 40, ny: int = 40) -> DataFrame:
    """2-D equal-width count grid (bx, by, count), non-empty cells."""
    both = df.select(measured(x).alias("x"), measured(y).alias("y"))
    r = both.agg(F.min("x").alias("xl"), F.max("x").alias("xh"), F.min("y").alias("yl"), F.max("y").alias("yh")).first()
    if r["xl"] is None or r["yl"] is None:  # no row has both values
        return df.sparkSession.createDataFrame([], "bx long, by long, count long")
    bx = bin_index("x", r["xl"], (r["xh"] - r["xl"]) / nx, nx)
    by_ = bin_index("y", r["yl"], (r["yh"] - r["yl"]) / ny, ny)
    return (both.where(F.col("x").isNotNull() & F.col("y").isNotNull())
            .groupBy(bx.alias("bx"), by_.alias("by")).agg(F.count(F.lit(1)).alias("count")))


#: Bandwidths beyond which a kernel counts as 0 (exp(-REACH² / 2) < 3e-18).
REACH = 9.0


def _window(offset: Column, width: Column, step: Column, grid: int) -> Column:
    """Grid indices (lo, hi) within REACH widths of a value ``offset`` above
    the first grid point; lo > hi where there is none."""
    return F.struct(F.greatest(F.lit(0), F.ceil((offset - REACH * width) / step)).cast("int").alias("lo"),
                    F.least(F.lit(grid - 1), F.floor((offset + REACH * width) / step)).cast("int").alias("hi"))


def kde(df: DataFrame, col: str, by: Sequence[str] = (), grid: int = 500, bw: str | float = "scott",
        bins: int | None = None) -> DataFrame:
    """Gaussian KDE on a grid of ``grid`` points per group.

    Bandwidth h = factor · sample std (Scott n^(-1/5) or Silverman); grid
    x_i = min + i·(max-min)/grid, i = 0..grid-1. Output (by..., i, x, density).
    Values are first collapsed to (value, count), then each distinct value
    adds count·φ((x_i - v)/h) to the grid points within REACH bandwidths, the
    others being below 3e-18 of its peak: the sum is exact to double precision,
    with work proportional to distinct values x grid points in reach.

    A group of one row or one distinct value has no density: it gives one row
    (i = 0, x = the value, density NULL).

    ``bins``: snap values to the centres of ``bins`` equal-width bins per
    group before collapsing (linear-binning approximation, error O((w/h)²)
    for bin width w), so the density work is groups × bins × grid whatever
    the row count — the setting for very large inputs.
    """
    by = list(by)
    x = measured(col)
    data = df.where(x.isNotNull()).select(*by, x.alias("_v"))
    stats = data.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_s"),
                                  F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if isinstance(bw, str) and bw not in ("scott", "silverman"):
        raise ValueError("bw must be 'scott', 'silverman' or a number")
    if bw == "scott":
        fac = F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    elif bw == "silverman":
        fac = F.pow(F.col("_n").cast("double") * F.lit(0.75), F.lit(-0.2))
    else:
        fac = F.lit(float(bw))
    stats, _ = broadcast_if_small(stats.withColumn("_h", fac * F.col("_s")))  # a row per group
    flat = stats.where(~F.coalesce(F.col("_h") > 0, F.lit(False))).select(
        *by, F.lit(0).cast("long").alias("i"), F.col("_lo").alias("x"), F.lit(None).cast("double").alias("density"))
    stats = stats.where(F.col("_h") > 0)
    if bins:
        with_stats = _attach(data, stats, by)
        w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
        b = F.least(F.floor((F.col("_v") - F.col("_lo")) / w), F.lit(bins - 1))
        with_stats = with_stats.withColumn("_v", F.col("_lo") + (b + 0.5) * w)
        joined = with_stats.groupBy(*by, "_v", "_n", "_s", "_lo", "_hi", "_h").agg(F.count(F.lit(1)).alias("_c"))
    else:
        collapsed = data.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
        joined = _attach(collapsed, stats, by)
    gx = F.col("_lo") + F.col("i") * (F.col("_hi") - F.col("_lo")) / F.lit(float(grid))
    z = (gx - F.col("_v")) / F.col("_h")
    contrib = F.col("_c") * F.exp(-0.5 * z * z)
    names = [*by, "_v", "_c", "_lo", "_hi", "_h", "_n"]
    near = _window(F.col("_v") - F.col("_lo"), F.col("_h"), (F.col("_hi") - F.col("_lo")) / F.lit(float(grid)), grid)
    expanded = joined.withColumn("_w", near).where("_w.lo <= _w.hi").select(*names, F.explode(F.sequence("_w.lo", "_w.hi")).alias("i"))
    # every grid point of every group is there, also one that no value is near
    spine = stats.select(*by, F.col("_lo").alias("_v"), F.lit(0).cast("long").alias("_c"), "_lo", "_hi", "_h", "_n",
                         F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    expanded = expanded.unionByName(spine)
    dens = expanded.groupBy(*by, "i").agg(
        F.sum(contrib).alias("_k"), F.first(gx).alias("x"),
        F.first(F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))).alias("_norm"))
    return dens.select(*by, F.col("i").cast("long").alias("i"), "x", (F.col("_k") / F.col("_norm")).alias("density")).unionByName(
        flat if by else flat.where(F.col("x").isNotNull()))


def violin(df: DataFrame, col: str, by: Sequence[str], grid: int = 100, bw: str | float = "scott",
           bins: int | None = None) -> DataFrame:
    """Per-group density curve with the inner box (A13 joined to A15 on
    the group keys; both sides are per-group tables)."""
    dens = kde(df, col, by=by, grid=grid, bw=bw, bins=bins)
    box = box_stats(df, col, by=by)
    return _attach(dens, box, by)


def kde_2d(df: DataFrame, x: str, y: str, by: Sequence[str] = (), grid: int = 40,
           bw: str | float = "scott", bins: int | None = None) -> DataFrame:
    """2-D Gaussian KDE with full covariance bandwidth per group.

    Σ_h = factor² · sample covariance, factor = n^(-1/6) (Scott, d = 2).
    Grid: grid × grid points over [min, max] of each axis (i/grid spacing).
    Output (by..., ix, iy, x, y, density); a value adds to the grid points
    within REACH bandwidths on either axis. A group without spread in two
    dimensions has no density: it gives one row (ix = iy = 0, its least values,
    density NULL), as in ``kde``. ``bins`` snaps points to the
    centres of a bins × bins lattice per group first (work independent of
    the row count; error O((w/h)²)).
    """
    by = list(by)
    xc, yc = measured(x), measured(y)
    data = df.where(xc.isNotNull() & yc.isNotNull()).select(*by, xc.alias("_x"), yc.alias("_y"))
    stats = data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.var_samp("_x").alias("_vx"), F.var_samp("_y").alias("_vy"),
        F.covar_samp("_x", "_y").alias("_cxy"), F.min("_x").alias("_xl"), F.max("_x").alias("_xh"),
        F.min("_y").alias("_yl"), F.max("_y").alias("_yh"))
    if bw == "scott":
        f2 = F.pow(F.col("_n").cast("double"), F.lit(-1.0 / 3.0))
    elif bw == "silverman":
        f2 = F.pow(F.col("_n").cast("double"), F.lit(-1.0 / 3.0))  # (n·4/4)^(-1/6) squared
    else:
        f2 = F.lit(float(bw) ** 2)
    a, b, c = F.col("_vx") * f2, F.col("_cxy") * f2, F.col("_vy") * f2
    det = a * c - b * b
    spread = F.coalesce(det > 0, F.lit(False))
    stats, _ = broadcast_if_small(stats.select(  # a row per group
        *by, "_n", "_xl", "_xh", "_yl", "_yh", F.sqrt(a).alias("_sx"), F.sqrt(c).alias("_sy"), F.when(spread, c / det).alias("_ia"),
        F.when(spread, -b / det).alias("_ib"), F.when(spread, a / det).alias("_ic"), F.when(spread, det).alias("_det")))
    flat = stats.where("_det is null and _xl is not null").select(
        *by, F.lit(0).cast("long").alias("ix"), F.lit(0).cast("long").alias("iy"), F.col("_xl").alias("x"), F.col("_yl").alias("y"),
        F.lit(None).cast("double").alias("density"))
    stats = stats.where("_det is not null")
    if bins:
        lat = _attach(data, stats, by)
        wx = (F.col("_xh") - F.col("_xl")) / F.lit(float(bins))
        wy = (F.col("_yh") - F.col("_yl")) / F.lit(float(bins))
        bx = F.least(F.floor((F.col("_x") - F.col("_xl")) / wx), F.lit(bins - 1))
        byy = F.least(F.floor((F.col("_y") - F.col("_yl")) / wy), F.lit(bins - 1))
        lat = lat.withColumns({"_x": F.col("_xl") + (bx + 0.5) * wx, "_y": F.col("_yl") + (byy + 0.5) * wy})
        joined = lat.groupBy(*by, "_x", "_y", *[c for c in stats.columns if c not in by]).agg(
            F.count(F.lit(1)).alias("_c"))
    else:
        collapsed = data.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_c"))
        joined = _attach(collapsed, stats, by)
    wx = _window(F.col("_x") - F.col("_xl"), F.col("_sx"), (F.col("_xh") - F.col("_xl")) / F.lit(float(grid)), grid)
    wy = _window(F.col("_y") - F.col("_yl"), F.col("_sy"), (F.col("_yh") - F.col("_yl")) / F.lit(float(grid)), grid)
    ex = joined.withColumns({"_wx": wx, "_wy": wy}).where("_wx.lo <= _wx.hi and _wy.lo <= _wy.hi")
    ex = ex.withColumn("_i", F.explode(F.sequence("_wx.lo", "_wx.hi"))).withColumn("_j", F.explode(F.sequence("_wy.lo", "_wy.hi"))).drop("_wx", "_wy")
    # every grid point of every group is there, also one that no value is near
    spine = stats.withColumns({"_x": F.col("_xl"), "_y": F.col("_yl"), "_c": F.lit(0).cast("long")})
    spine = spine.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    ex = ex.unionByName(spine.select(*ex.columns))
    ix, iy = F.col("_i"), F.col("_j")
    gx = F.col("_xl") + ix * (F.col("_xh") - F.col("_xl")) / F.lit(float(grid))
    gy = F.col("_yl") + iy * (F.col("_yh") - F.col("_yl")) / F.lit(float(grid))
    dx, dy = gx - F.col("_x"), gy - F.col("_y")
    q = F.col("_ia") * dx * dx + 2 * F.col("_ib") * dx * dy + F.col("_ic") * dy * dy
    dens = ex.groupBy(*by, "_i", "_j").agg(
        F.sum(F.col("_c") * F.exp(-0.5 * q)).alias("_s"), F.first(ix).alias("ix"), F.first(iy).alias("iy"),
        F.first(gx).alias("x"), F.first(gy).alias("y"),
        F.first(F.col("_n") * F.lit(2 * math.pi) * F.sqrt("_det")).alias("_norm"))
    return dens.select(*by, F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), "x", "y",
                       (F.col("_s") / F.col("_norm")).alias("density")).unionByName(flat)


def box_stats(df: DataFrame, col: str, by: Sequence[str] = (), k: float = 1.5, method: str = "exact") -> DataFrame:
    """Per group q1, median, q3, whiskers and outlier count.

    Whiskers are the most extreme values inside the fences q1 - k·IQR and
    q3 + k·IQR; outliers are the values outside. Quartiles are exact
    (linear interpolation); the per-group table is joined back once.
    """
    by = list(by)
    q = quantile_wide(df, [col], {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=by, method=method).drop("column")
    iqr = F.col("q3") - F.col("q1")
    q = q.select(*by, "q1", "median", "q3", (F.col("q1") - k * iqr).alias("_lf"), (F.col("q3") + k * iqr).alias("_uf"))
    x = measured(col)
    joined = _attach(df.where(x.isNotNull()).select(*by, x.alias("_x")), q, by)
    inside = (F.col("_x") >= F.col("_lf")) & (F.col("_x") <= F.col("_uf"))
    return joined.groupBy(*by).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_outliers"))


def trendline(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Simple OLS line per group: slope, intercept, r2, n."""
    return df.groupBy(*by).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                               F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                               F.regr_r2(F.col(y), F.col(x)).alias("r2"),
                               F.regr_count(F.col(y), F.col(x)).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class count, balanced weight n/(k·n_c) and n_neg/n_pos.

    The window runs over the aggregated class rows only.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()
    n = F.sum("count").over(w)
    k = F.count(F.lit(1)).over(w)
    neg = F.sum(F.when(F.col(label) == 0, F.col("count"))).over(w)
    pos = F.sum(F.when(F.col(label) == 1, F.col("count"))).over(w)
    return counts.select(label, "count", (n / (k * F.col("count"))).alias("balanced_weight"),
                         safe_div(neg.cast("double"), pos.cast("double")).alias("pos_weight"))


def with_weight_column(df: DataFrame, label: str, weights: Mapping | str = "balanced",
                       out: str = "weight") -> DataFrame:
    """Attach a per-row weight: a fixed {class: weight} map or 'balanced'."""
    if isinstance(weights, str):
        if weights != "balanced":
            raise ValueError("weights must be a mapping or 'balanced'")
        cw = class_weights(df, label).select(label, F.col("balanced_weight").alias(out))
        small, _ = broadcast_if_small(cw)
        return df.join(small, on=label, how="left")
    pairs = []
    for kk, v in weights.items():
        pairs += [F.lit(kk), F.lit(float(v))]
    return df.withColumn(out, F.coalesce(F.create_map(*pairs)[F.col(label)], F.lit(1.0)))

