"""N1-N4 normality tests and A17 Q-Q points.

All order-dependent sums run on Spark over :func:`global_rank` (one range
shuffle for every column and group together, after a melt); only a
handful of per-(group, column) numbers reach the driver for p-values.

* KS (N1): D = max_i max(i/n - Φ(x_i), Φ(x_i) - (i-1)/n) against N(0, 1)
  (optionally after standardising), p from the Kolmogorov distribution.
* Shapiro-Wilk (N2): Royston's (1992/1995) approximation of the weights
  a_i from m_i = Φ⁻¹((i - 3/8)/(n + 1/4)) and his normalising transform for
  the p-value.
* D'Agostino-Pearson K² (N3): skewness and kurtosis z-scores from the
  population moments; K² ~ χ²(2).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.functions.dist import (
    _E,
    _fn,
    _pow,
    chi2_sf,
    kolmogorov_sf,
    norm_cdf_array,
    norm_ppf,
    norm_ppf_array,
    phi_sf,
    sql_leaf,
)
from tabstat.operators.order_stats import melt_values
from tabstat.operators.rank import global_rank

ALPHA = 0.05

# Royston's polynomial coefficients (AS R94).
SW_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
SW_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SW_G = [-2.273, 0.459]
SW_C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
SW_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
SW_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
SW_C6 = [-0.4803, -0.082676, 0.0030302]


def _poly_up(coefs, x):
    """c0 + c1 x + c2 x² + ..."""
    return sum(c * x ** i for i, c in enumerate(coefs))


def _ranked(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    long = melt_values(df, cols, by)
    return global_rank(long, ["value"], by=[*by, "column"], rank_col="i", group_size_col="n")


def _staged(r: DataFrame, ppf: bool = True) -> DataFrame:
    """Φ(value) and the Shapiro-Wilk score Φ⁻¹((i - 3/8)/(n + 1/4)) as plain
    columns, from whole arrays of values: as expressions they are too long for
    the JVM to compile."""

    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        return pd.Series(norm_cdf_array(x.to_numpy(float)))

    @F.pandas_udf("double")
    def score(i: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(norm_ppf_array((i.to_numpy(float) - 0.375) / (n.to_numpy(float) + 0.25)))

    return r.withColumns({"_cdf": cdf("value"), **({"_m": score("i", "n")} if ppf else {})})


def qq_points(df: DataFrame, col: str, by: Sequence[str] = (), plotting: str = "(i-0.5)/n") -> DataFrame:
    """(by..., i, sample, theoretical) with theoretical = Φ⁻¹(position).

    ``plotting``: "(i-0.5)/n" (default) or "i/n" (the reference's position;
    the last point is +inf and is returned as NULL).
    """
    by = list(by)
    r = _ranked(df, [col], by)
    if plotting == "(i-0.5)/n":
        pos = (F.col("i") - 0.5) / F.col("n")
    elif plotting == "i/n":
        pos = F.col("i") / F.col("n")
    else:
        raise ValueError("plotting must be '(i-0.5)/n' or 'i/n'")
    theo = F.when(pos < 1.0, norm_ppf(pos))
    return r.select(*by, F.col("i").cast("long").alias("i"), F.col("value").alias("sample"), theo.alias("theoretical"))


def qq_line(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reference line of a Q-Q plot: min and max over both axes."""
    lo = F.least(F.min("sample"), F.min("theoretical"))
    hi = F.greatest(F.max("sample"), F.max("theoretical"))
    return points.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi"))


def ks_statistic(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), standardize: bool = False) -> DataFrame:
    """N1 statistic: (by..., column, n, statistic) against N(0, 1)."""
    by = list(by)
    src = df
    if standardize:
        m = df.agg(*[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_samp(c).alias(f"{c}__s") for c in cols]).first()
        src = df.withColumns({c: (F.col(c) - m[f"{c}__m"]) / m[f"{c}__s"] for c in cols})
    r = _staged(_ranked(src, cols, by), ppf=False)
    cdf = F.col("_cdf")
    d = F.greatest(F.col("i") / F.col("n") - cdf, cdf - (F.col("i") - 1) / F.col("n"))
    return r.groupBy(*by, "column").agg(F.first("n").cast("long").alias("n"), F.max(d).alias("statistic"))


def ks_test(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), standardize: bool = False) -> DataFrame:
    """Statistic plus p-value (Kolmogorov distribution, driver scalar)."""
    stat = ks_statistic(df, cols, by, standardize).collect()
    rows = [(*[r[b] for b in by], r["column"], "kolmogorov-smirnov", float(r["statistic"]),
             kolmogorov_sf(float(r["statistic"]), int(r["n"]))) for r in stat]
    return _report(df, rows, by)


def _report(df: DataFrame, rows, by):
    types = dict(df.dtypes)
    schema = ", ".join([f"`{b}` {types[b]}" for b in by] + ["column string", "test string", "statistic double",
                                                            "p_value double"])
    out = df.sparkSession.createDataFrame(rows, schema)
    return out.withColumn("interpretation", F.when(F.col("p_value") > ALPHA, "Normal").otherwise("Not Normal"))


def shapiro_sums(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per (group, column) sums that determine W: n, Σm², Σ_mid m·x, extremes, SST."""
    by = list(by)
    r = _staged(_ranked(df, cols, by))
    i, n = F.col("i"), F.col("n")
    m = F.col("_m")
    x = F.col("value")
    mid = F.when(n > 5, (i >= 3) & (i <= n - 2)).otherwise((i >= 2) & (i <= n - 1))
    return r.groupBy(*by, "column").agg(
        F.first("n").cast("long").alias("n"),
        F.sum(m * m).alias("summ2"),
        F.sum(F.when(mid, m * x).otherwise(0.0)).alias("smx_mid"),
        F.max(F.when(i == 1, x)).alias("x1"), F.max(F.when(i == 2, x)).alias("x2"),
        F.max(F.when(i == n - 1, x)).alias("xn1"), F.max(F.when(i == n, x)).alias("xn"),
        F.max(F.when(i == n, m)).alias("mn"), F.max(F.when(i == n - 1, m)).alias("mn1"),
        (F.var_pop(x) * F.count(x)).alias("sst"))


def shapiro_w(row) -> tuple[float, float]:
    """W and p from the sums of :func:`shapiro_sums` (Royston 1995)."""
    n = int(row["n"])
    if n < 3:
        return math.nan, math.nan
    sst = row["sst"]
    if not sst or sst <= 0:
        return math.nan, math.nan  # constant column
    if n == 3:
        a = math.sqrt(0.5)
        num = a * (row["xn"] - row["x1"])
        w = min(1.0, num * num / sst)
        p = max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        return w, p
    summ2, mn, mn1 = row["summ2"], row["mn"], row["mn1"]
    u = 1.0 / math.sqrt(n)
    an = mn / math.sqrt(summ2) + _poly_up(SW_C1, u)
    if n > 5:
        an1 = mn1 / math.sqrt(summ2) + _poly_up(SW_C2, u)
        phi_ = (summ2 - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1)
        num = an * (row["xn"] - row["x1"]) + an1 * (row["xn1"] - row["x2"]) + row["smx_mid"] / math.sqrt(phi_)
    else:
        phi_ = (summ2 - 2 * mn * mn) / (1 - 2 * an * an)
        num = an * (row["xn"] - row["x1"]) + row["smx_mid"] / math.sqrt(phi_)
    w = min(1.0, num * num / sst)
    y = math.log1p(-w) if w < 1 else -math.inf
    if n <= 11:
        gamma = _poly_up(SW_G, n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mu = _poly_up(SW_C3, n)
        s = math.exp(_poly_up(SW_C4, n))
    else:
        ln_n = math.log(n)
        mu = _poly_up(SW_C5, ln_n)
        s = math.exp(_poly_up(SW_C6, ln_n))
    if math.isinf(y):
        return w, 1.0
    return w, phi_sf((y - mu) / s)


def shapiro_test(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Shapiro-Wilk W and p per (group, column).

    W is computed at any n; Royston's p-value approximation is validated up
    to n = 5000 (larger n: the p-value is reported but flagged by callers).
    """
    sums = shapiro_sums(df, cols, by).collect()
    rows = []
    for r in sums:
        w, p = shapiro_w(r)
        rows.append((*[r[b] for b in by], r["column"], "shapiro-wilk", w, p))
    return _report(df, rows, by)


def _k2_exprs(n: _E, b1: _E, b2: _E):
    """D'Agostino skew z, kurtosis z and K² from n, sqrt(b1) (skewness) and b2."""
    y = b1 * _fn("sqrt", ((n + 1.0) * (n + 3.0)) / (6.0 * (n - 2.0)))
    beta2 = (3.0 * (n * n + 27.0 * n - 70.0) * (n + 1.0) * (n + 3.0)) / (
        (n - 2.0) * (n + 5.0) * (n + 7.0) * (n + 9.0))
    w2 = -1.0 + _fn("sqrt", 2.0 * (beta2 - 1.0))
    delta = 1.0 / _fn("sqrt", 0.5 * _fn("ln", w2))
    alpha = _fn("sqrt", 2.0 / (w2 - 1.0))
    ya = y / alpha
    zs = delta * _fn("ln", ya + _fn("sqrt", ya * ya + 1.0))
    e = 3.0 * (n - 1.0) / (n + 1.0)
    varb2 = 24.0 * n * (n - 2.0) * (n - 3.0) / ((n + 1.0) * (n + 1.0) * (n + 3.0) * (n + 5.0))
    xk = (b2 - e) / _fn("sqrt", varb2)
    sb1 = 6.0 * (n * n - 5.0 * n + 2.0) / ((n + 7.0) * (n + 9.0)) * _fn(
        "sqrt", 6.0 * (n + 3.0) * (n + 5.0) / (n * (n - 2.0) * (n - 3.0)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + _fn("sqrt", 1.0 + 4.0 / (sb1 * sb1)))
    term1 = 1.0 - 2.0 / (9.0 * a)
    denom = 1.0 + xk * _fn("sqrt", 2.0 / (a - 4.0))
    term2 = _fn("sign", denom) * _pow((1.0 - 2.0 / a) / _fn("abs", denom), 1.0 / 3.0)
    zk = (term1 - term2) / _fn("sqrt", 2.0 / (9.0 * a))
    k2 = zs * zs + zk * zk
    return zs, zk, k2


def dagostino_moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n, population skewness and kurtosis (b2 = m4/m2²) per (group, column)."""
    long = melt_values(df, cols, by)
    return long.groupBy(*by, "column").agg(
        F.count("value").cast("double").alias("n"), F.skewness("value").alias("b1"),
        (F.kurtosis("value") + 3.0).alias("b2"))


def dagostino_k2(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, z_skew, z_kurt, k2, p_value); needs n >= 8."""
    mom = dagostino_moments(df, cols, by)
    zs, zk, k2 = _k2_exprs(_E(F.col("n"), "n"), _E(F.col("b1"), "b1"), _E(F.col("b2"), "b2"))
    return mom.select(*by, "column", zs.col.alias("z_skew"), zk.col.alias("z_kurt"), k2.col.alias("k2"),
                      F.exp(-k2.col / 2.0).alias("p_value"))


def dagostino_sql(n_sql: str = "n", b1_sql: str = "b1", b2_sql: str = "b2"):
    """SQL text of (z_skew, z_kurt, k2) over columns n, b1, b2."""
    zs, zk, k2 = _k2_exprs(sql_leaf(n_sql), sql_leaf(b1_sql), sql_leaf(b2_sql))
    return zs.sql, zk.sql, k2.sql


def dagostino_test(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    k = dagostino_k2(df, cols, by).collect()
    rows = [(*[r[b] for b in by], r["column"], "dagostino-k2", r["k2"],
             chi2_sf(r["k2"], 2) if r["k2"] is not None else None) for r in k]
    return _report(df, rows, by)


def normality_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """KS D, Shapiro-Wilk sums and D'Agostino K² for every (group, column)
    from ONE ranked frame and ONE aggregate."""
    by = list(by)
    r = _ranked(df, cols, by)
    i, n, x = F.col("i"), F.col("n"), F.col("value")
    r = _staged(r)
    cdf, m = F.col("_cdf"), F.col("_m")
    d = F.greatest(i / n - cdf, cdf - (i - 1) / n)
    mid = F.when(n > 5, (i >= 3) & (i <= n - 2)).otherwise((i >= 2) & (i <= n - 1))
    agg = r.groupBy(*by, "column").agg(
        F.first("n").cast("long").alias("n"), F.max(d).alias("ks_d"),
        F.sum(m * m).alias("summ2"), F.sum(F.when(mid, m * x).otherwise(0.0)).alias("smx_mid"),
        F.max(F.when(i == 1, x)).alias("x1"), F.max(F.when(i == 2, x)).alias("x2"),
        F.max(F.when(i == n - 1, x)).alias("xn1"), F.max(F.when(i == n, x)).alias("xn"),
        F.max(F.when(i == n, m)).alias("mn"), F.max(F.when(i == n - 1, m)).alias("mn1"),
        (F.var_pop(x) * F.count(x)).alias("sst"),
        F.skewness(x).alias("b1"), (F.kurtosis(x) + 3.0).alias("b2"))
    zs, zk, k2 = _k2_exprs(_E(F.col("n").cast("double"), "n"), _E(F.col("b1"), "b1"), _E(F.col("b2"), "b2"))
    return agg.withColumn("k2", k2.col)


def normality_report(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                     transform: DataFrame | None = None) -> DataFrame:
    """The three tests on the raw columns and, if given, on a transformed
    frame (e.g. Box-Cox output); long table with a ``transformed`` flag.

    Each frame is ranked once and reduced by one aggregate
    (:func:`normality_stats`); p-values are scalar functions of the result.
    """
    by = list(by)
    rows = []
    for flag, frame in ((False, df), (True, transform)):
        if frame is None:
            continue
        for r in normality_stats(frame, cols, by).collect():
            key = [r[b] for b in by]
            w, p_sw = shapiro_w(r)
            rows.append((*key, r["column"], "kolmogorov-smirnov", float(r["ks_d"]),
                         kolmogorov_sf(float(r["ks_d"]), int(r["n"])), flag))
            rows.append((*key, r["column"], "shapiro-wilk", w, p_sw, flag))
            k2 = r["k2"]
            rows.append((*key, r["column"], "dagostino-k2", k2, chi2_sf(k2, 2) if k2 is not None else None,
                         flag))
    types = dict(df.dtypes)
    schema = ", ".join([f"`{b}` {types[b]}" for b in by] + ["column string", "test string", "statistic double",
                                                            "p_value double", "transformed boolean"])
    out = df.sparkSession.createDataFrame(rows, schema)
    return out.withColumn("interpretation", F.when(F.col("p_value") > ALPHA, "Normal").otherwise("Not Normal"))
