"""OLS with inference, diagnostics, VIF, backward elimination,
prediction intervals, forest importance and correlation-based dropping.

Every fit is solved on the driver from the p×p moments of one
:func:`gramian` scan; backward elimination and VIF reuse that single scan
for all their refits. Predictions, residuals and intervals are Column
expressions evaluated by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.functions.dist import chi2_sf, f_sf, t_ppf, t_two_sided_p
from tabstat.operators.features import standard_fit
from tabstat.operators.matrix import condition_number, Gram, gramian, scaled, triangle
from tabstat.operators.normality import _k2_exprs
from tabstat.functions.dist import _E


@dataclass
class OLSResult:
    y: str
    xs: list
    intercept: bool
    n: int
    params: np.ndarray          # intercept first when present
    cov_params: np.ndarray
    ssr: float
    tss: float
    rank: int
    names: list = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.params)

    @property
    def df_resid(self) -> float:
        return self.n - self.rank

    @property
    def df_model(self) -> float:
        return self.rank - (1 if self.intercept else 0)

    @property
    def scale(self) -> float:
        return self.ssr / self.df_resid if self.df_resid > 0 else float("nan")

    @property
    def r2(self) -> float:
        return 1.0 - self.ssr / self.tss if self.tss > 0 else float("nan")

    @property
    def adj_r2(self) -> float:
        num = (self.n - (1 if self.intercept else 0))
        return 1.0 - num / self.df_resid * (1.0 - self.r2) if self.df_resid > 0 else float("nan")

    @property
    def llf(self) -> float:
        n = self.n
        if self.ssr <= 0:
            return float("inf")
        return -n / 2.0 * (math.log(2 * math.pi) + math.log(self.ssr / n) + 1.0)

    @property
    def aic(self) -> float:
        return -2.0 * self.llf + 2.0 * self.rank

    @property
    def bic(self) -> float:
        return -2.0 * self.llf + self.rank * math.log(self.n)

    @property
    def fvalue(self) -> float:
        if self.df_model <= 0 or self.df_resid <= 0 or self.ssr <= 0:
            return float("nan") if self.ssr > 0 else float("inf")
        return ((self.tss - self.ssr) / self.df_model) / (self.ssr / self.df_resid)

    @property
    def f_pvalue(self) -> float:
        return f_sf(self.fvalue, self.df_model, self.df_resid)

    @property
    def bse(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov_params), 0.0, None))

    @property
    def tvalues(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.params / self.bse

    @property
    def pvalues(self) -> np.ndarray:
        return np.array([t_two_sided_p(float(t), self.df_resid) for t in self.tvalues])

    def conf_int(self, alpha: float = 0.05) -> np.ndarray:
        q = t_ppf(1 - alpha / 2, self.df_resid)
        return np.c_[self.params - q * self.bse, self.params + q * self.bse]

    def coef(self, name: str) -> float:
        return float(self.params[self.names.index(name)])

    def summary_rows(self, alpha: float = 0.05) -> list[tuple]:
        ci = self.conf_int(alpha)
        return [(nm, float(b), float(se), float(t), float(p), float(lo), float(hi))
                for nm, b, se, t, p, (lo, hi) in zip(self.names, self.params, self.bse, self.tvalues,
                                                     self.pvalues, ci)]

    def fit_stats(self) -> dict:
        return {"n": self.n, "r2": self.r2, "adj_r2": self.adj_r2, "llf": self.llf, "aic": self.aic,
                "bic": self.bic, "f": self.fvalue, "f_p": self.f_pvalue, "mse_resid": self.scale}

    def predict_column(self) -> Column:
        """ŷ as a Column expression."""
        expr = F.lit(float(self.params[0])) if self.intercept else F.lit(0.0)
        off = 1 if self.intercept else 0
        for j, c in enumerate(self.xs):
            expr = expr + F.col(c).cast("double") * F.lit(float(self.params[off + j]))
        return expr

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.predict_column())

    def _design(self) -> list[Column]:
        cols = [F.lit(1.0)] if self.intercept else []
        return cols + [F.col(c).cast("double") for c in self.xs]

    def prediction_interval(self, df: DataFrame, alpha: float = 0.05, keep: Sequence[str] = ()) -> DataFrame:
        """Mean, CI of the mean and the observation interval per row.

        se_mean = sqrt(x₀ᵀ Σ x₀) (Σ = cov of the coefficients), evaluated as
        a quadratic-form Column expression; obs adds s².
        """
        q = t_ppf(1 - alpha / 2, self.df_resid)
        x = self._design()
        quad = None
        for i in range(self.k):
            for j in range(self.k):
                term = x[i] * x[j] * F.lit(float(self.cov_params[i, j]))
                quad = term if quad is None else quad + term
        mean = self.predict_column()
        se_mean = F.sqrt(F.greatest(quad, F.lit(0.0)))
        se_obs = F.sqrt(F.greatest(quad, F.lit(0.0)) + F.lit(float(self.scale)))
        return df.select(*keep, mean.alias("mean"), (mean - q * se_mean).alias("mean_lo"),
                         (mean + q * se_mean).alias("mean_hi"), (mean - q * se_obs).alias("obs_lo"),
                         (mean + q * se_obs).alias("obs_hi"))


def interval_in_units(train: DataFrame, test: DataFrame, y: str, xs: Sequence[str], alpha: float = 0.05, keep: Sequence[str] = ()) -> DataFrame:
    """R7 in original units: target and predictors are standardised by the
    training rows, the fit and its intervals are taken on that scale, and mean
    and bounds are turned back. ``test`` needs no target; a row with a null
    predictor has null bounds."""
    scaler = standard_fit(train, [y, *xs])
    model = ols_fit(scaler.transform(train, [y, *xs]), y, xs)
    held = {f"_keep_{k}": F.col(c) for k, c in enumerate(keep)}  # a kept predictor stays as it was
    out = model.prediction_interval(scaler.transform(test.withColumns(held) if held else test, xs), alpha, keep=list(held))
    bounds = [scaler.inverse(c, y).alias(c) for c in ("mean", "mean_lo", "mean_hi", "obs_lo", "obs_hi")]
    return out.select(*(F.col(h).alias(c) for h, c in zip(held, keep)), *bounds)


def _solve(a: np.ndarray, b: np.ndarray):
    """Least-squares solve at unit diagonal, with the rank (the minimum-norm
    solution of the scaled system where columns depend on each other)."""
    if a.size == 0:
        return np.zeros(0), np.zeros((0, 0)), 0
    unit, d, rank = scaled(a)
    inv = np.linalg.pinv(unit, hermitian=True) if rank < a.shape[0] else np.linalg.inv(unit)
    return (inv @ (b / d)) / d, inv / np.outer(d, d), rank


def ols_from_gram(g: Gram, y: str, xs: Sequence[str], intercept: bool = True) -> OLSResult:
    """R1 core: OLS from moments (centred system when an intercept is fitted)."""
    xs = list(xs)
    ix = g.index(xs)
    iy = g.cols.index(y)
    n = g.n
    if intercept:
        sxx = g.centred[np.ix_(ix, ix)]
        sxy = g.centred[ix, iy]
        syy = g.centred[iy, iy]
        beta, inv, rank = _solve(sxx, sxy)
        xbar = g.mean[ix]
        b0 = g.mean[iy] - float(xbar @ beta)
        ssr = max(syy - float(sxy @ beta), 0.0)
        k_rank = rank + 1
        s2 = ssr / (n - k_rank) if n > k_rank else float("nan")
        p = len(xs)
        cov = np.zeros((p + 1, p + 1))
        cov[1:, 1:] = s2 * inv
        cov[0, 1:] = cov[1:, 0] = -s2 * (inv @ xbar)
        cov[0, 0] = s2 * (1.0 / n + float(xbar @ inv @ xbar))
        params = np.r_[b0, beta]
        return OLSResult(y, xs, True, n, params, cov, float(ssr), float(syy), k_rank, ["const", *xs])
    sxx = g.raw[np.ix_(ix, ix)]
    sxy = g.raw[ix, iy]
    syy = g.raw[iy, iy]
    beta, inv, rank = _solve(sxx, sxy)
    ssr = max(syy - float(sxy @ beta), 0.0)
    s2 = ssr / (n - rank) if n > rank else float("nan")
    return OLSResult(y, xs, False, n, beta, s2 * inv, float(ssr), float(syy), rank, list(xs))


def ols_fit(df: DataFrame, y: str, xs: Sequence[str], intercept: bool = True) -> OLSResult:
    """OLS of y on xs (one scan)."""
    return ols_from_gram(gramian(df, [*xs, y]), y, xs, intercept)


def residual_column(model: OLSResult) -> Column:
    return F.col(model.y).cast("double") - model.predict_column()


def ols_diagnostics(df: DataFrame, model: OLSResult, order_col: str | None = None) -> dict:
    """R2: residual skew, kurtosis, Jarque-Bera, omnibus (K²), Durbin-Watson
    and the condition number of the design.

    Moments come from one aggregate over the residual column. Durbin-Watson
    needs row order: residuals are ranked by ``order_col`` (ties by residual)
    and joined to their predecessor by rank (an equi-join, no window over all
    rows).
    """
    e = residual_column(model)
    d = df.na.drop(subset=[model.y, *model.xs]).select(*([order_col] if order_col else []), e.alias("e"))
    mom = d.agg(F.count("e").alias("n"), F.skewness("e").alias("skew"), F.kurtosis("e").alias("kurt"),
                F.sum(F.col("e") * F.col("e")).alias("ss")).first()
    n, skew, kurt = mom["n"], mom["skew"], (mom["kurt"] + 3.0 if mom["kurt"] is not None else None)
    jb = n / 6.0 * (skew ** 2 + (kurt - 3.0) ** 2 / 4.0) if skew is not None else float("nan")
    k2v = None  # constant residuals have no skew and no kurtosis
    if skew is not None and kurt is not None:
        zs, zk, k2 = _k2_exprs(_E(F.lit(float(n)), "n"), _E(F.lit(float(skew)), "s"), _E(F.lit(float(kurt)), "k"))
        k2v = df.sparkSession.range(1).select(k2.col.alias("k2")).first()["k2"]
    out = {"n": n, "skew": skew, "kurtosis": kurt, "jarque_bera": jb, "jb_p": chi2_sf(jb, 2),
           "omnibus": k2v, "omnibus_p": chi2_sf(k2v, 2) if k2v is not None else None}
    if order_col:
        from tabstat.operators.rank import global_rank
        r = global_rank(d, [order_col], tiebreak=["e"], rank_col="_r").select("_r", "e")
        prev = r.select((F.col("_r") + 1).alias("_r"), F.col("e").alias("_e0"))
        num = r.join(prev, "_r").agg(F.sum((F.col("e") - F.col("_e0")) ** 2).alias("s")).first()["s"]
        out["durbin_watson"] = float(num) / float(mom["ss"]) if mom["ss"] else float("nan")
    whole = df.na.drop(subset=[model.y, *model.xs])
    out["condition_number"] = condition_number(triangle(whole, model.xs, intercept=model.intercept))
    return out


def mse(df: DataFrame, y: str, pred: Column | str) -> DataFrame:
    """Mean squared error and test R² (1 - SSR/SST) in one aggregate."""
    p = F.col(pred) if isinstance(pred, str) else pred
    d = df.select(F.col(y).cast("double").alias("_y"), p.alias("_p")).na.drop()
    res = (F.col("_y") - F.col("_p"))
    return d.agg(F.avg(res * res).alias("mse"),
                 (1.0 - F.sum(res * res) / (F.var_pop("_y") * F.count("_y"))).alias("r2"))


def vif_from_gram(g: Gram, cols: Sequence[str] | None = None) -> list[tuple[str, float]]:
    """1/(1-R²_j) with no intercept = diag((XᵀX)⁻¹)·diag(XᵀX)."""
    cols = list(cols or g.cols)
    ix = g.index(cols)
    a = g.raw[np.ix_(ix, ix)]
    unit, _, rank = scaled(a)
    if rank < len(cols):
        return [(c, float("inf")) for c in cols]
    inv = np.linalg.inv(unit)
    return [(c, float(inv[i, i])) for i, c in enumerate(cols)]


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """R4 as a (variable, vif) DataFrame; one scan for all columns."""
    rows = vif_from_gram(gramian(df, cols), cols)
    return df.sparkSession.createDataFrame(rows, "variable string, vif double")


def backward_elimination(df: DataFrame, y: str, xs: Sequence[str], drops: Sequence[str] | str = "auto",
                         alpha: float = 0.05, intercept: bool = True, g: Gram | None = None) -> tuple[list, OLSResult]:
    """Refit after each drop, logging fit statistics and the t-test of
    the variable about to go. ``drops``: an explicit order, or "auto"
    (largest p-value above ``alpha``). All refits come from one Gramian.

    Returns (log rows, final model); log rows are
    (step, dropped, r2, adj_r2, aic, bic, f, f_p, t, t_p).
    """
    xs = list(xs)
    g = g or gramian(df, [*xs, y])
    current = list(xs)
    log = []
    step = 0
    order = list(drops) if not isinstance(drops, str) else None
    while current:
        m = ols_from_gram(g, y, current, intercept)
        if order is not None:
            if step >= len(order):
                break
            victim = order[step]
        else:
            off = 1 if intercept else 0
            pv = m.pvalues[off:]
            j = int(np.nanargmax(pv))
            if not pv[j] > alpha:
                break
            victim = current[j]
        vi = m.names.index(victim)
        log.append((step + 1, victim, m.r2, m.adj_r2, m.aic, m.bic, m.fvalue, m.f_pvalue,
                    float(m.tvalues[vi]), float(m.pvalues[vi])))
        current.remove(victim)
        step += 1
    if not current and not intercept:
        return log, None
    return log, ols_from_gram(g, y, current, intercept)  # intercept-only if all went


ELIMINATION_SCHEMA = ("step int, dropped string, r2 double, adj_r2 double, aic double, bic double, f double, "
                      "f_p double, t double, t_p double")


def compare_regressions(models: dict, test: DataFrame | dict | None = None, decimals: int = 3) -> list[tuple]:
    """(model, r2, adj_r2, aic, bic, mse) rows; mse on ``test`` (one
    frame for all models, or a {model: frame} map when the models need
    differently prepared inputs, e.g. PCA scores)."""
    rows = []
    for name, m in models.items():
        err = float("nan")
        frame = test.get(name) if isinstance(test, dict) else test
        if frame is not None:
            err = mse(frame, m.y, m.predict_column()).first()["mse"]
        rows.append((name, *[round(float(v), decimals) for v in (m.r2, m.adj_r2, m.aic, m.bic, err)]))
    return rows


def forest_importance(df: DataFrame, y: str, xs: Sequence[str], num_trees: int = 100, max_depth: int = 30,
                      min_importance: float = 0.01, seed: int = 1729) -> DataFrame:
    """Impurity importance of a random-forest regressor, sorted, >= cut."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    xs = list(xs)
    data = VectorAssembler(inputCols=xs, outputCol="_f", handleInvalid="skip").transform(
        df.select(*xs, F.col(y).cast("double").alias("_y")))
    model = RandomForestRegressor(featuresCol="_f", labelCol="_y", numTrees=num_trees, maxDepth=max_depth,
                                  featureSubsetStrategy="all", seed=seed).fit(data)
    imp = model.featureImportances.toArray()
    rows = sorted(((c, float(v)) for c, v in zip(xs, imp)), key=lambda t: -t[1])
    out = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return out.where(F.col("importance") >= min_importance).orderBy(F.desc("importance"))


def drop_correlated(df: DataFrame, cols: Sequence[str], threshold: float | None = 0.9,
                    drop: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Drop an explicit list, or greedily drop the later column of every
    pair with |corr| above ``threshold`` (one correlation aggregate)."""
    cols = list(cols)
    if drop is None:
        pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
        r = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else None
        dropped = []
        for i, (a, b) in enumerate(pairs):
            v = r[f"{i}"]
            if v is not None and abs(v) > threshold and a not in dropped and b not in dropped:
                dropped.append(b)
    else:
        dropped = list(drop)
    return df.drop(*dropped), dropped
