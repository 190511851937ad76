"""The shared-scan logistic grid against single MLlib fits."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabstat.operators import grid as gr
from tabstat.operators import models as md

GRID = {"penalty": ["l1", "l2"], "C": [0.01, 0.1, 1, 10], "max_iter": [100, 300], "class_weight": [None, {0: 0.1, 1: 0.9}]}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5)) * [1, 1, 2, 0.5, 1] + [0, 1, 0, 0, -1]
    y = (rng.random(600) < 1 / (1 + np.exp(-(x @ [1.5, -1, 0, 0, 0.5] - 0.5)))).astype(int)
    rows = [(int(i), [float(a) for a in v], int(t), int(i % 3)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, label int, fold int").withColumn("features", array_to_vector("x")).repartition(3).cache()


@pytest.fixture(scope="module")
def fitted(data):
    return gr.logistic_grid(data, GRID)


def single(data, p):
    cw = p["class_weight"]
    w = data.withColumn("w", F.when(F.col("label") == 1, float(cw[1])).otherwise(float(cw[0])) if cw else F.lit(1.0))
    reg = 1.0 / (p["C"] * w.agg(F.sum("w")).first()[0])
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(regParam=reg, elasticNetParam=float(p["penalty"] == "l1"), standardization=False, maxIter=2000, tol=1e-12, weightCol="w").fit(w)


@pytest.mark.parametrize("k", (0, 5, 11, 17, 23, 30))
def test_every_kind_of_point_equals_a_single_fit(data, fitted, k):
    p = fitted.points[k]
    for own, part in ((fitted.refits[k], data), (fitted.fold_fits[k][1], data.where("fold <> 1"))):
        m = single(part, p)
        assert own.intercept == pytest.approx(m.intercept, abs=1e-4)
        assert own.coefficients == pytest.approx(m.coefficients.toArray(), abs=1e-4)
    right = single(data.where("fold <> 1"), p).transform(data.where("fold = 1")).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert fitted.accuracy[k, 1] == pytest.approx(right, abs=1e-12)


def test_passes_do_not_grow_with_the_points(data, fitted):
    few = gr.logistic_grid(data, {"C": [0.01, 10], "penalty": ["l1"]})
    assert len(fitted.points) == 32 and fitted.passes <= few.passes + 4 <= 30


def test_first_best_and_order(fitted):
    assert fitted.points[0] == {"penalty": "l1", "C": 0.01, "max_iter": 100, "class_weight": None}
    assert fitted.best == int(np.flatnonzero(fitted.mean == fitted.mean.max())[0])
    assert np.array_equal(fitted.accuracy[0], fitted.accuracy[2])  # only max_iter differs


def test_limit_of_steps_takes_the_iterate(data):
    out = gr.logistic_grid(data, {"max_iter": [1, 2, 100], "C": [10.0]})
    assert [f.iterations for f in out.refits][:2] == [1, 2] and out.refits[2].iterations > 3
    assert not np.allclose(out.refits[0].coefficients, out.refits[2].coefficients, atol=1e-3)


def test_same_at_any_partitioning(data):
    a, b = (gr.logistic_grid(data.repartition(n), {"C": [1.0], "penalty": ["l1", "l2"]}) for n in (1, 8))
    for x, y in zip(a.refits, b.refits):
        assert np.allclose(x.coefficients, y.coefficients, atol=1e-7)
    assert np.array_equal(a.accuracy, b.accuracy)


def test_score_column_null_rows_and_errors(spark, data):
    out = gr.logistic_grid(data.select("label", "fold", "features").unionByName(
        spark.createDataFrame([(None, 0, [0.0] * 5), (1, None, [0.0] * 5), (1, 2, None)], "label int, fold int, x array<double>")
        .select("label", "fold", F.when(F.col("x").isNotNull(), array_to_vector(F.coalesce("x", F.array(*[F.lit(0.0)] * 5)))).alias("features"))), {"C": [1.0]})
    plain = gr.logistic_grid(data, {"C": [1.0]}, features="x")
    assert np.allclose(out.refits[0].coefficients, plain.refits[0].coefficients)
    row = data.select("x", plain.refits[0].score(F.col("x")).alias("s")).first()
    assert row.s == pytest.approx(1 / (1 + np.exp(-(np.dot(row.x, plain.refits[0].coefficients) + plain.refits[0].intercept))))
    with pytest.raises(ValueError):
        gr.logistic_grid(data.where("fold = 0"), {"C": [1.0]})
    with pytest.raises(ValueError):
        gr.logistic_grid(data, {"gamma": [1.0]})
