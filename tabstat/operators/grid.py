"""A whole grid of regularised logistic fits or support vector machines,
all folds, in shared scans.

Every (penalty, C, class weights, fold) is a column of one weight matrix. A
pass over the rows evaluates the loss, gradient and Hessian of every column
that still moves, each under its own mask (rows of its fold count 0) and class
weights; partial sums of the tasks are added per column on the executors. The
driver holds (d + 1)² numbers a column and takes a proximal Newton step for
each: the quadratic model with the L1 term is minimised by cyclic coordinate
descent (all columns at once), the one with the L2 term by a solve; a step that
does not lower a column's objective enough is halved in the next pass. The
number of passes is that of the slowest column, some ten to twenty, whatever
the number of points, folds and rows. The whole-table refit of every point is
a further column, so the best point needs no fit of its own, and one last pass
counts right predictions of every column on its held-out fold.

The objective is that of ``models.logistic`` (mean weighted loss + penalty with
λ = 1 / (C · Σw), the intercept free), so results agree with single MLlib fits
run to convergence.

For tables of up to a few hundred features; a task holds a batch of rows and
(d + 1)² numbers a column. Rows with a null label, fold or feature vector take
no part; a fold without rows, or one whose training part has one class only,
raises an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.operators.models import KernelMap, kernel_map, mean_variance
from tabstat.session import materialize, ship_package

TOL = 1e-9          # largest change of a scaled weight at the end
MAX_PASSES = 100    # passes after which columns that still move are an error
PASS_ROWS = 1024    # rows whose matrices a task holds at once
SWEEPS = 400        # of coordinate descent in one step


@dataclass
class Fit:
    """A logistic model: ``score`` is its probability of label 1."""

    intercept: float
    coefficients: np.ndarray
    iterations: int

    def score(self, features: Column) -> Column:
        w = F.array(*[F.lit(float(x)) for x in self.coefficients])
        dot = F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return 1.0 / (1.0 + F.exp(-(dot + self.intercept)))


@dataclass
class Grid:
    """Points in grid order with their accuracy on each fold; the best one is
    the first of the highest mean."""

    points: list[dict]
    folds: list[int]
    accuracy: np.ndarray                # points x folds
    refits: list[Fit]                   # on all rows
    fold_fits: list[list[Fit]] = field(repr=False, default_factory=list)
    passes: int = 0

    @property
    def mean(self) -> np.ndarray:
        return self.accuracy.mean(axis=1)

    @property
    def best(self) -> int:
        return int(np.argmax(self.mean))


def _rows(df: DataFrame, label: str, features: str, fold: str) -> DataFrame:
    x = F.col(features) if dict(df.dtypes)[features].startswith("array") else vector_to_array(F.col(features))
    return df.where(F.col(features).isNotNull()).select(x.cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("f")).na.drop()


def _mass(y: np.ndarray, f: np.ndarray, weights: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """(rows, columns): a row's weight for each column, 0 in its own fold."""
    return np.where(y[:, None] == 1, weights[None, :, 1], weights[None, :, 0]) * (f[:, None] != fold[None, :])


def _logistic(z: np.ndarray, y: np.ndarray):
    """Loss, slope and bend in the margin z of label y."""
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return np.logaddexp(0, z) - y * z, p - y, p * (1 - p)


def _squared_hinge(z: np.ndarray, y: np.ndarray):
    sign = 2 * y - 1
    short = np.maximum(1 - sign * z, 0.0)
    return short ** 2, -2 * sign * short, 2.0 * (short > 0)


LOSSES = {"logistic": _logistic, "squared_hinge": _squared_hinge}


def _slices(batches):
    """The batches in pieces of at most PASS_ROWS rows, none of them empty."""
    for b in batches:
        for i in range(0, len(b), PASS_ROWS):
            yield b.iloc[i:i + PASS_ROWS]


def _passed(rows: DataFrame, w: np.ndarray, weights: np.ndarray, fold: np.ndarray, which: np.ndarray, loss: str = "logistic") -> dict[int, np.ndarray]:
    """Sums over the rows for the columns ``which``: weight, loss, gradient,
    and the upper half of the Hessian, at weights ``w`` (intercept first)."""
    d = w.shape[1]
    upper = np.triu_indices(d)

    def part(batches):
        total = np.zeros((len(which), 2 + d + len(upper[0])))
        for b in _slices(batches):
            x = np.hstack([np.ones((len(b), 1)), np.vstack(b["x"].to_numpy())])
            y, f = b["y"].to_numpy(), b["f"].to_numpy()
            m = _mass(y, f, weights, fold)
            value, slope, bend = LOSSES[loss](x @ w.T, y[:, None])
            total[:, 0] += m.sum(0)
            total[:, 1] += (m * value).sum(0)
            total[:, 2:2 + d] += (m * slope).T @ x
            bend = m * bend
            for c in range(len(which)):
                total[c, 2 + d:] += ((x * bend[:, c:c + 1]).T @ x)[upper]
        yield pd.DataFrame({"c": which, "v": list(total)})

    sums = rows.mapInPandas(part, "c long, v array<double>").select("c", array_to_vector("v").alias("v")).groupBy("c").agg(Summarizer.sum(F.col("v")).alias("v"))
    return {r["c"]: r["v"].toArray() for r in sums.collect()}


def _step(w: np.ndarray, g: np.ndarray, h: np.ndarray, lam: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The proximal Newton direction of each column; the first weight (the
    intercept) is free of the penalty."""
    d = w.shape[1]
    limit = np.repeat(lam[:, None], d, axis=1)
    limit[:, 0] = 0.0
    h = h + 1e-12 * np.trace(h, axis1=1, axis2=2)[:, None, None] / d * np.eye(d)
    out = np.zeros_like(w)
    two = ~l1
    if two.any():
        ridge = h[two] + limit[two][:, :, None] * np.eye(d)
        out[two] = np.linalg.solve(ridge, -(g[two] + limit[two] * w[two])[..., None])[..., 0]
    if l1.any():
        hh, ww, lim = h[l1], w[l1], limit[l1]
        diag = np.maximum(np.einsum("cjj->cj", hh), 1e-300)
        move = np.zeros_like(ww)
        slope = g[l1].copy()                                  # gradient of the model at w + move
        for _ in range(SWEEPS):
            most = 0.0
            for j in range(d):
                at = ww[:, j] + move[:, j]
                new = at - slope[:, j] / diag[:, j]
                new = np.sign(new) * np.maximum(np.abs(new) - lim[:, j] / diag[:, j], 0.0)
                by = new - at
                move[:, j] += by
                slope += hh[:, :, j] * by[:, None]
                most = max(most, np.abs(by).max())
            if most < TOL / 10:
                break
        out[l1] = move
    return out


def _objective(total: np.ndarray, w: np.ndarray, lam: np.ndarray, l1: np.ndarray) -> np.ndarray:
    return total + np.where(l1, lam * np.abs(w[:, 1:]).sum(1), lam / 2 * (w[:, 1:] ** 2).sum(1))


def logistic_grid(train: DataFrame, grid: Mapping[str, Sequence], fold: str = "fold", label: str = "label", features: str = "features",
                  loss: str = "logistic") -> Grid:
    """Cross-validated accuracy of every point of ``grid`` (keys penalty: l1 or
    l2, C, max_iter, class_weight: a mapping of label to weight or None;
    missing keys have one value: l2, 1.0, 100, None), points in the order of
    ``itertools.product``.

    Points that differ in ``max_iter`` only share their columns; one whose
    limit is below the steps to convergence takes the iterate it stands at.
    ``loss`` is ``logistic`` or ``squared_hinge`` (a support vector machine).
    """
    ship_package(train.sparkSession)
    values = {"penalty": ["l2"], "C": [1.0], "max_iter": [100], "class_weight": [None], **grid}
    unknown = set(values) - {"penalty", "C", "max_iter", "class_weight"}
    if unknown or set(values["penalty"]) - {"l1", "l2"}:
        raise ValueError(f"unknown grid entries {sorted(unknown) or values['penalty']}")
    points = [dict(zip(values, v)) for v in product(*values.values())]
    rows = materialize(_rows(train, label, features, fold), "persist")
    try:
        folds = sorted(r[0] for r in rows.select("f").distinct().collect())
        if len(folds) < 2:
            raise ValueError("cross-validation needs two folds with rows")
        d = 1 + rows.agg(F.max(F.size("x"))).first()[0]
        shared: dict[tuple, int] = {}
        of_point = []
        for p in points:
            cw = p["class_weight"] or {}
            key = (p["penalty"], float(p["C"]), float(cw.get(0, 1.0)), float(cw.get(1, 1.0)))
            of_point.append(shared.setdefault(key, len(shared)))
        keys = [(k, f) for k in shared for f in [*folds, -1]]   # columns; -1 holds nothing out
        l1 = np.array([k[0] == "l1" for k, _ in keys])
        weights = np.array([k[2:] for k, _ in keys])
        held = np.array([f for _, f in keys])
        limits = sorted({int(p["max_iter"]) for p in points})
        n = len(keys)
        w, direction, size = np.zeros((n, d)), np.zeros((n, d)), np.ones(n)
        trial, value, slope = w.copy(), np.full(n, np.inf), np.zeros(n)
        lam, steps, stood = np.zeros(n), np.zeros(n, int), [dict() for _ in range(n)]
        active, passes = np.arange(n), 0
        upper = np.triu_indices(d)
        while len(active):
            if passes >= MAX_PASSES:
                raise RuntimeError(f"{len(active)} columns did not converge in {MAX_PASSES} passes")
            sums = _passed(rows, trial[active], weights[active], held[active], active, loss)
            passes += 1
            taken = []
            for c in active:
                s = sums[c]
                if value[c] == np.inf:
                    lam[c] = 1.0 / (keys[c][0][1] * s[0])
                    if s[0] <= 0 or not np.isfinite(lam[c]):
                        raise ValueError(f"no weight outside fold {held[c]}")
                now = float(_objective(s[1:2] / s[0], trial[c:c + 1], lam[c:c + 1], l1[c:c + 1])[0])
                if now <= value[c] + 1e-4 * size[c] * slope[c] + 1e-13 * abs(now) or size[c] < 1e-10:
                    steps[c] += value[c] != np.inf
                    w[c], value[c], size[c] = trial[c], now, 1.0
                    if steps[c] in limits:
                        stood[c][int(steps[c])] = w[c].copy()
                    taken.append(c)
                else:
                    size[c] /= 2
                    trial[c] = w[c] + size[c] * direction[c]
            if taken:
                own = np.array(taken)
                g = np.stack([sums[c][2:2 + d] / sums[c][0] for c in taken])
                h = np.zeros((len(own), d, d))
                h[:, upper[0], upper[1]] = np.stack([sums[c][2 + d:] / sums[c][0] for c in taken])
                h = h + np.triu(h, 1).transpose(0, 2, 1)
                direction[own] = _step(w[own], g, h, lam[own], l1[own])
                trial[own] = w[own] + direction[own]
                pen = np.where(l1[own], lam[own] * (np.abs(trial[own][:, 1:]).sum(1) - np.abs(w[own][:, 1:]).sum(1)),
                               lam[own] * (w[own][:, 1:] * direction[own][:, 1:]).sum(1))
                slope[own] = (g * direction[own]).sum(1) + pen
                done = own[(np.abs(direction[own]).max(1) < TOL * (1 + np.abs(w[own]).max(1))) | (steps[own] >= limits[-1])]
                active = np.setdiff1d(active, done)

        def fit(c: int, limit: int) -> Fit:
            own = stood[c].get(limit, w[c]) if steps[c] >= limit else w[c]
            return Fit(float(own[0]), own[1:].copy(), int(min(steps[c], limit)))

        at = {key: c for c, key in enumerate(keys)}
        names = list(shared)
        fits = [[fit(at[names[of_point[i]], f], int(p["max_iter"])) for f in folds] for i, p in enumerate(points)]
        refits = [fit(at[names[of_point[i]], -1], int(p["max_iter"])) for i, p in enumerate(points)]
        return Grid(points, folds, _accuracy(rows, fits, folds), refits, fits, passes + 1)
    finally:
        rows.unpersist()


@dataclass
class SvmGrid:
    """Points, accuracy (points, folds), and each point's kernel map and fit on
    all rows; ``best`` is the first maximum of the mean accuracy."""

    points: list[dict]
    accuracy: np.ndarray
    maps: list[KernelMap]
    refits: list[Fit]

    @property
    def best(self) -> int:
        return int(np.argmax(self.accuracy.mean(1)))

    def margin(self, df: DataFrame, point: int | None = None, features: str = "features", out: str = "margin") -> DataFrame:
        """Adds the margin of a point's model (the best one's)."""
        k = self.best if point is None else point
        fit, wide = self.refits[k], self.maps[k].transform(df, features, "_mapped")
        terms = F.zip_with(vector_to_array("_mapped"), F.array(*(F.lit(float(c)) for c in fit.coefficients)), lambda a, b: a * b)
        return wide.withColumn(out, F.aggregate(terms, F.lit(fit.intercept), lambda s, v: s + v)).drop("_mapped")


def svm_grid(train: DataFrame, grid: Mapping[str, Sequence], dim: int, fold: str = "fold", label: str = "label", features: str = "features",
             class_weight: Mapping[int, float] | None = None, n_components: int = 128, seed: int = 1729) -> SvmGrid:
    """Cross-validated accuracy of support vector machines over C, kernel
    (linear, rbf, poly of degree 3) and gamma (scale, auto or a number).

    Kernels are feature maps of ``n_components`` columns (random Fourier
    features, tensor sketches), the loss is the squared hinge. Every C and fold
    of a map is a column of the same scans; points that differ in the gamma of
    a linear kernel only share their columns.
    """
    values = {"C": [1.0], "kernel": ["rbf"], "gamma": ["scale"], **grid}
    if set(values) - {"C", "kernel", "gamma"} or set(values["kernel"]) - {"linear", "rbf", "poly"}:
        raise ValueError("a grid of C, kernel (linear, rbf, poly) and gamma")
    points = [dict(zip(values, v)) for v in product(*values.values())]
    variance = mean_variance(train.where(F.col(features).isNotNull()), features)
    done: dict[tuple, tuple[KernelMap, Grid]] = {}
    for p in points:
        key = (p["kernel"], None if p["kernel"] == "linear" else p["gamma"])
        if key not in done:
            own = kernel_map({"poly": "poly_sketch"}.get(p["kernel"], p["kernel"]), dim, p["gamma"], n_components, variance, seed)
            mapped = own.transform(train.where(F.col(features).isNotNull()), features, "_mapped").select(F.col("_mapped").alias("x"), label, fold)
            done[key] = own, logistic_grid(mapped, {"C": values["C"], "class_weight": [class_weight]}, fold, label, "x", "squared_hinge")
    own = [done[(p["kernel"], None if p["kernel"] == "linear" else p["gamma"])] for p in points]
    at = [values["C"].index(p["C"]) for p in points]
    return SvmGrid(points, np.stack([g.accuracy[i] for (_, g), i in zip(own, at)]), [m for m, _ in own], [g.refits[i] for (_, g), i in zip(own, at)])


def svm_table(spark, grid: SvmGrid) -> DataFrame:
    """One row a point: its parameters, accuracy on each fold, mean, best."""
    rows = [(i, p["kernel"], float(p["C"]), str(p["gamma"]), [float(a) for a in grid.accuracy[i]], float(grid.accuracy[i].mean()), i == grid.best)
            for i, p in enumerate(grid.points)]
    return spark.createDataFrame(rows, "point int, kernel string, C double, gamma string, fold_accuracy array<double>, cv_accuracy double, best boolean")


def _accuracy(rows: DataFrame, fits: list[list[Fit]], folds: list[int]) -> np.ndarray:
    """Share of right predictions of each fit on the fold it did not see."""
    w = np.array([[[m.intercept, *m.coefficients] for m in own] for own in fits])   # points, folds, d

    def part(batches):
        right, seen = np.zeros((len(fits), len(folds))), np.zeros(len(folds))
        for b in _slices(batches):
            for k, f in enumerate(folds):
                own = b[b["f"] == f]
                if len(own):
                    x = np.hstack([np.ones((len(own), 1)), np.vstack(own["x"].to_numpy())])
                    right[:, k] += ((x @ w[:, k].T > 0) == (own["y"].to_numpy()[:, None] == 1)).sum(0)
                    seen[k] += len(own)
        yield pd.DataFrame({"v": [np.concatenate([right.ravel(), seen])]})

    total = rows.mapInPandas(part, "v array<double>").select(array_to_vector("v").alias("v")).agg(Summarizer.sum(F.col("v"))).first()[0].toArray()
    total = np.rint(total)
    return total[:-len(folds)].reshape(len(fits), len(folds)) / total[-len(folds):]


def grid_table(spark, grid: Grid) -> DataFrame:
    """One row a point: its parameters, accuracy on each fold, mean, best."""
    rows = [(i, p["penalty"], float(p["C"]), int(p["max_iter"]), str(p["class_weight"]), [float(a) for a in grid.accuracy[i]], float(grid.mean[i]),
             i == grid.best) for i, p in enumerate(grid.points)]
    return spark.createDataFrame(rows, "point int, penalty string, C double, max_iter int, class_weight string, fold_accuracy array<double>, "
                                       "cv_accuracy double, best boolean")
