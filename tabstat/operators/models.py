"""Classifiers, grid search, cross-validation and
k-means on MLlib.

MLlib estimators are different algorithms from the reference's libraries
(binned splits, L-BFGS/OWL-QN, no dropout, first-order boosting), so the
capability matches, not the decimals. Mappings:

* logistic: sklearn's C·Σloss + ½‖w‖² equals MLlib's mean loss + λ/2‖w‖²
  with λ = 1/(C·Σw); L1 via elasticNetParam = 1; no standardisation.
* fully grown tree: depth capped at MLlib's limit of 30.
* extra-trees importance: forest without bootstrap, sqrt features (random
  thresholds have no MLlib form).
* SVM: LinearSVC; rbf via random Fourier features, poly(3) via
  PolynomialExpansion or, for many columns, a tensor sketch; Platt probabilities from a 1-D logistic fit on the
  margin.
* neural net: MultilayerPerceptronClassifier (sigmoid hidden layers,
  L-BFGS; ``network`` has ReLU, dropout and Adam); probability of class 1 cut at a threshold (0.4 by default).

Folds come from :func:`stratified_folds` (hash-deterministic), fed to
``CrossValidator(foldCol=...)``; the best grid point is the first maximum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 30  # MLlib's hard limit for trees
MAPPED = 1 << 18  # numbers of a kernel map that a task computes and passes on at once


def assemble(df: DataFrame, cols: Sequence[str] | str, out: str = "features", keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns (or one array column) into an ML vector column."""
    if isinstance(cols, str):
        return df.select(*keep, array_to_vector(F.col(cols).cast("array<double>")).alias(out))
    va = VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error")
    return va.transform(df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])).select(*keep, out)


def positive_probability(pred: DataFrame, prob_col: str = "probability", out: str = "score") -> DataFrame:
    """Probability of class 1 as a double column."""
    return pred.withColumn(out, vector_to_array(F.col(prob_col))[1])


def _weight_sum(df: DataFrame, weight_col: str | None) -> float:
    if weight_col is None:
        return float(df.count())
    return float(df.agg(F.sum(weight_col)).first()[0])


def logistic(train: DataFrame, label: str = "label", features: str = "features", C: float = 1.0,
             penalty: str = "l2", weight_col: str | None = None, max_iter: int = 100) -> Model:
    """G1: L1/L2 logistic regression with sklearn's C convention."""
    reg = 1.0 / (C * _weight_sum(train, weight_col))
    lr = LogisticRegression(featuresCol=features, labelCol=label, regParam=reg,
                            elasticNetParam=1.0 if penalty == "l1" else 0.0, standardization=False,
                            maxIter=max_iter)
    if weight_col:
        lr.setWeightCol(weight_col)
    return lr.fit(train)


def decision_tree(train: DataFrame, label: str = "label", features: str = "features", max_depth: int = MAX_DEPTH,
                  min_instances: int = 1, impurity: str = "gini", weight_col: str | None = None,
                  max_bins: int = 32, seed: int = 1729) -> Model:
    """(nearly) fully grown tree, depth capped at 30."""
    dt = DecisionTreeClassifier(featuresCol=features, labelCol=label, maxDepth=min(max_depth, MAX_DEPTH),
                                minInstancesPerNode=min_instances, impurity=impurity, maxBins=max_bins, seed=seed)
    if weight_col:
        dt.setWeightCol(weight_col)
    return dt.fit(train)


def tree_ensemble_importance(train: DataFrame, names: Sequence[str], label: str = "label",
                             features: str = "features", num_trees: int = 100, max_depth: int = MAX_DEPTH, seed: int = 1729) -> list[tuple]:
    """Importances of an unbootstrapped sqrt-feature forest, sorted."""
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=num_trees, bootstrap=False,
                                featureSubsetStrategy="sqrt", maxDepth=min(max_depth, MAX_DEPTH), seed=seed).fit(train)
    imp = rf.featureImportances.toArray()
    return sorted(zip(names, map(float, imp)), key=lambda t: -t[1])


def pre_pruned_tree_search(train: DataFrame, fold_col: str = "fold", label: str = "label",
                           features: str = "features", max_depth=(3, 5, 8), min_instances=(1, 5),
                           max_features=("all", "sqrt"), impurity=("gini", "entropy"),
                           weights: Mapping[str, Mapping[int, float] | None] | None = None,
                           parallelism: int = 4, seed: int = 1729):
    """Grid over depth, min leaf size, max features, criterion and class
    weights of a single tree (a one-tree forest without bootstrap exposes
    max-features). Each weighting is its own weight column; returns
    (best model, best params, best cv accuracy, all points)."""
    weights = weights or {"none": None}
    best = None
    allp = []
    for wname, wmap in weights.items():
        data = train
        wcol = None
        if wmap is not None:
            pairs = []
            for k, v in wmap.items():
                pairs += [F.lit(k), F.lit(float(v))]
            wcol = f"w_{wname}"
            data = train.withColumn(wcol, F.coalesce(F.create_map(*pairs)[F.col(label)], F.lit(1.0)))
        est = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=1, bootstrap=False, seed=seed)
        if wcol:
            est.setWeightCol(wcol)
        grid = {"maxDepth": list(max_depth), "minInstancesPerNode": list(min_instances),
                "featureSubsetStrategy": list(max_features), "impurity": list(impurity)}
        model, params, score, pts = grid_search(est, grid, data, fold_col, label, parallelism, seed=seed)
        for p_, s_ in pts:
            allp.append(({**p_, "weights": wname}, s_))
        if best is None or score > best[2]:
            best = (model, {**params, "weights": wname}, score)
    return best[0], best[1], best[2], allp


def random_forest(train: DataFrame, label: str = "label", features: str = "features", num_trees: int = 100,
                  max_depth: int = MAX_DEPTH, min_instances: int = 1, weight_col: str | None = None,
                  seed: int = 1729, **kw) -> Model:
    """Random forest classifier (unlimited depth maps to 30)."""
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=num_trees,
                                maxDepth=min(max_depth, MAX_DEPTH), minInstancesPerNode=min_instances, seed=seed, **kw)
    if weight_col:
        rf.setWeightCol(weight_col)
    return rf.fit(train)


def boosted_trees(train: DataFrame, label: str = "label", features: str = "features", max_iter: int = 50,
                  max_depth: int = 3, step_size: float = 0.1, subsampling: float = 1.0,
                  feature_subset: str = "all", weight_col: str | None = None, seed: int = 1729) -> Model:
    """Gradient-boosted trees (scale_pos_weight -> a weight column)."""
    gbt = GBTClassifier(featuresCol=features, labelCol=label, maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step_size, subsamplingRate=subsampling, featureSubsetStrategy=feature_subset,
                        seed=seed)
    if weight_col:
        gbt.setWeightCol(weight_col)
    return gbt.fit(train)


# --- G8 SVM -----------------------------------------------------------------

@dataclass
class KernelMap:
    """Feature map for kernel SVMs: random Fourier features, all monomials
    (``poly``) or a tensor sketch of (γ x·y + coef0)^degree (``poly_sketch``).

    For a sketch ``w`` holds a bucket and ``b`` a sign for each factor and
    component. A null vector maps to null.
    """
    kind: str
    w: np.ndarray | None = None
    b: np.ndarray | None = None
    degree: int = 3
    width: int = 0
    gamma: float = 1.0
    coef0: float = 0.0

    def transform(self, df: DataFrame, features: str = "features", out: str = "kfeatures") -> DataFrame:
        if self.kind == "linear":
            return df.withColumn(out, F.col(features))
        if self.kind == "poly":
            return PolynomialExpansion(degree=self.degree, inputCol=features, outputCol=out).transform(df)
        if self.kind == "poly_sketch":
            own, size = self, max(1, MAPPED // self.width)

            @F.pandas_udf("array<double>")
            def sketched(cols: Iterator[pd.Series]) -> Iterator[pd.Series]:
                for col in cols:
                    for i in range(0, len(col), size):  # a wide sketch of a whole batch takes much memory
                        part = col.iloc[i:i + size]
                        known = part[part.notna()]
                        done = iter(own.sketch(np.vstack(known.to_numpy())) if len(known) else ())
                        yield pd.Series([next(done) if some else None for some in part.notna()], dtype=object)

            z = sketched(F.when(F.col(features).isNotNull(), vector_to_array(F.col(features))))
            return df.withColumn("_z", z).withColumn(out, F.when(F.col("_z").isNotNull(), array_to_vector("_z"))).drop("_z")
        w, b, size = self.w, self.b, max(1, MAPPED // len(self.w))
        scale = math.sqrt(2.0 / w.shape[0])

        @F.pandas_udf("array<double>")
        def rff(cols: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for col in cols:
                for i in range(0, len(col), size):
                    z = np.vstack(col.iloc[i:i + size].to_numpy()) @ w.T
                    z += b
                    np.cos(z, out=z)
                    z *= scale
                    yield pd.Series(list(z))

        return df.withColumn(out, array_to_vector(rff(vector_to_array(F.col(features)))))

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """Rows whose inner products estimate the polynomial kernel without bias:
        count sketches of each factor, multiplied in the frequency domain."""
        x = np.hstack([math.sqrt(self.gamma) * x, np.full((len(x), 1), math.sqrt(self.coef0))])
        product = np.ones((len(x), self.width // 2 + 1), complex)
        for bucket, sign in zip(self.w, self.b):
            # components of a bucket are added up: d + 1 columns become ``width``
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            counted = np.zeros((len(x), self.width))
            counted[:, bucket[order][starts]] = np.add.reduceat((x * sign)[:, order], starts, axis=1)
            product *= np.fft.rfft(counted, axis=1)
        return np.fft.irfft(product, self.width, axis=1)


def kernel_map(kind: str, dim: int, gamma: float | str = "scale", n_components: int = 100,
               variance: float = 1.0, seed: int = 1729, degree: int = 3, coef0: float = 0.0) -> KernelMap:
    """rbf: Rahimi-Recht features for exp(-γ‖x-y‖²); poly_sketch: a tensor
    sketch of ``n_components`` columns; gamma 'scale' = 1/(d·var), 'auto' = 1/d."""
    if kind in ("linear", "poly"):
        return KernelMap(kind)
    if gamma == "scale":
        g = 1.0 / (dim * variance) if variance > 0 else 1.0
    elif gamma == "auto":
        g = 1.0 / dim
    else:
        g = float(gamma)
    rng = np.random.default_rng(seed)
    if kind == "poly_sketch":
        return KernelMap(kind, rng.integers(0, n_components, size=(degree, dim + 1)), rng.choice([-1.0, 1.0], size=(degree, dim + 1)),
                         degree, n_components, g, coef0)
    return KernelMap("rbf", rng.normal(0.0, math.sqrt(2 * g), size=(n_components, dim)),
                     rng.uniform(0, 2 * math.pi, size=n_components))


def svm(train: DataFrame, label: str = "label", features: str = "features", C: float = 1.0,
        weight_col: str | None = None, max_iter: int = 100) -> Model:
    """Linear SVM (hinge loss) with sklearn's C convention."""
    svc = LinearSVC(featuresCol=features, labelCol=label, regParam=1.0 / (C * _weight_sum(train, weight_col)),
                    maxIter=max_iter, standardization=False)
    if weight_col:
        svc.setWeightCol(weight_col)
    return svc.fit(train)


def mean_variance(df: DataFrame, features: str = "features") -> float:
    """Variance of all entries of a vector column, for gamma = 'scale'."""
    entry = F.explode(vector_to_array(F.col(features))).alias("_x")
    return float(df.select(entry).agg(F.var_pop("_x")).first()[0] or 0.0)


def platt(model: Model, train: DataFrame, label: str = "label") -> Model:
    """Platt scaling: a 1-D logistic fit of the label on the SVM margin."""
    data = _margin(model.transform(train))
    return LogisticRegression(featuresCol="_mf", labelCol=label, regParam=0.0, predictionCol="_p", rawPredictionCol="_r",
                              probabilityCol="_pp").fit(data)


def platt_scores(scaler: Model, scored: DataFrame, out: str = "score") -> DataFrame:
    """The probability of class 1 for rows an SVM has scored."""
    done = scaler.transform(_margin(scored)).withColumn(out, vector_to_array("_pp")[1])
    return done.drop("_mf", "_margin", "_p", "_r", "_pp")


def _margin(scored: DataFrame) -> DataFrame:
    wide = scored.withColumn("_margin", vector_to_array("rawPrediction")[1])
    return VectorAssembler(inputCols=["_margin"], outputCol="_mf").transform(wide)


def neural_net(train: DataFrame, n_features: int, label: str = "label", features: str = "features",
               hidden: Sequence[int] = (64, 32), max_iter: int = 50, seed: int = 1729,
               initial_weights=None) -> Model:
    """Dense network d-64-32-2 (sigmoid hidden layers, L-BFGS)."""
    mlp = MultilayerPerceptronClassifier(featuresCol=features, labelCol=label,
                                         layers=[n_features, *hidden, 2], maxIter=max_iter, seed=seed)
    if initial_weights is not None:
        mlp.setInitialWeights(initial_weights)
    return mlp.fit(train)


def learning_curve(train: DataFrame, valid: DataFrame, n_features: int, label: str = "label",
                   features: str = "features", epochs: Sequence[int] = (5, 10, 20, 50), seed: int = 1729) -> list:
    """Accuracy and log-loss on train and validation after rising
    iteration counts, each fit warm-started from the previous weights."""
    rows = []
    weights = None
    done = 0
    for e in epochs:
        m = neural_net(train, n_features, label, features, max_iter=max(1, e - done), seed=seed,
                       initial_weights=weights)
        weights = m.weights
        done = e
        for name, d in (("train", train), ("valid", valid)):
            p = positive_probability(m.transform(d))
            ll = -(F.col(label) * F.log(F.greatest(F.col("score"), F.lit(1e-15)))
                   + (1 - F.col(label)) * F.log(F.greatest(1 - F.col("score"), F.lit(1e-15))))
            r = p.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("acc"),
                      F.avg(ll).alias("loss")).first()
            rows.append((e, name, float(r["acc"]), float(r["loss"])))
    return rows


# --- H1 / H2 ------------------------------------------------------------------

def grid_search(estimator: Estimator, grid: Mapping[str, Sequence], train: DataFrame, fold_col: str = "fold",
                label: str = "label", parallelism: int = 4, max_points: int | None = None,
                seed: int = 1729) -> tuple[Model, dict, float, list]:
    """H1: k-fold accuracy over a parameter grid (folds from ``fold_col``).

    Returns (model refit on all of train, best params, best mean accuracy,
    [(params, mean accuracy)] in grid order). Ties -> first in grid order.
    ``max_points`` evaluates a seeded random subset of the grid.
    """
    names = list(grid)
    points = [dict(zip(names, vals)) for vals in product(*[grid[n] for n in names])]
    if max_points is not None and len(points) > max_points:
        rng = np.random.default_rng(seed)
        idx = sorted(rng.choice(len(points), size=max_points, replace=False))
        points = [points[i] for i in idx]
    maps = []
    for p in points:
        maps.append({estimator.getParam(k): v for k, v in p.items()})
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    k = int(train.agg(F.max(fold_col)).first()[0]) + 1
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=ev, foldCol=fold_col,
                        numFolds=k, parallelism=parallelism, seed=seed)
    cvm = cv.fit(train)
    avg = list(cvm.avgMetrics)
    best = int(np.argmax(avg))
    return cvm.bestModel, points[best], float(avg[best]), list(zip(points, avg))


def cross_validate(fit, df: DataFrame, fold_col: str = "fold", label: str = "label", k: int | None = None) -> list:
    """H2: accuracy per fold: ``fit(train_df)`` returns a transformer."""
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect()) if k is None else list(range(k))
    out = []
    for f in folds:
        model = fit(df.where(F.col(fold_col) != f))
        pred = model.transform(df.where(F.col(fold_col) == f))
        acc = pred.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
        out.append((int(f), float(acc)))
    return out


# --- U1 / U2 ------------------------------------------------------------------

def kmeans(train: DataFrame, k: int, features: str = "features", seed: int = 1729, max_iter: int = 20) -> Model:
    """K-means (k-means|| initialisation)."""
    return KMeans(featuresCol=features, k=k, seed=seed, maxIter=max_iter).fit(train)


def elbow_curve(train: DataFrame, ks: Sequence[int] = range(2, 10), features: str = "features",
                seed: int = 1729, silhouette: bool = False) -> list[tuple]:
    """Within-cluster sum of squares for each k (cache the input), with
    the squared-Euclidean silhouette of each clustering if asked for."""
    rows = []
    for k in ks:
        model = kmeans(train, k, features, seed)
        row = (int(k), float(model.summary.trainingCost))
        if silhouette:
            score = ClusteringEvaluator(featuresCol=features, predictionCol="prediction")
            row += (float(score.evaluate(model.transform(train))),)
        rows.append(row)
    return rows
