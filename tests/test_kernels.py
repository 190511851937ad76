"""Tensor sketches against the polynomial kernel, the grid of support
vector machines against a direct minimisation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabstat.operators import grid as gr
from tabstat.operators import models as md


def test_sketch_is_unbiased_and_narrows():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 30, 6))
    want = (0.5 * (x * y).sum(1) + 1.0) ** 3
    scale = np.sqrt((0.5 * (x * x).sum(1) + 1) ** 3 * (0.5 * (y * y).sum(1) + 1) ** 3)
    errors = {}
    for width in (64, 1024):
        got = []
        for seed in range(60):
            km = md.kernel_map("poly_sketch", 6, gamma=0.5, n_components=width, seed=seed, coef0=1.0)
            got.append((km.sketch(x) * km.sketch(y)).sum(1))
        errors[width] = np.sqrt((((np.array(got) - want) / scale) ** 2).mean())
        assert (np.abs(np.mean(got, axis=0) - want) < 5 * np.std(got, axis=0) / np.sqrt(60) + 1e-9).all()
    assert errors[1024] < 0.4 * errors[64] < 0.2


def test_count_sketch_by_hand():
    km = md.KernelMap("poly_sketch", np.array([[0, 2, 2, 1]]), np.array([[1.0, -1.0, 1.0, 1.0]]), 1, 4, 1.0, 0.0)
    assert km.sketch(np.array([[3.0, 5.0, 7.0]])) == pytest.approx(np.array([[3.0, 0.0, 2.0, 0.0]]))


@pytest.fixture(scope="module")
def shell(spark):
    """Label 1 where the product of two components is positive."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    rows = [(i, [float(a) for a in v], int(t), i % 4) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, x array<double>, label int, fold int").withColumn("features", array_to_vector("x")).cache()


def test_sketched_column_and_nulls(spark, shell):
    km = md.kernel_map("poly_sketch", 2, gamma=1.0, n_components=16)
    odd = shell.limit(3).unionByName(shell.limit(1).withColumn("features", F.when(F.col("id") < 0, F.col("features"))))
    rows = km.transform(odd).withColumn("k", F.when(F.col("kfeatures").isNotNull(), vector_to_array("kfeatures"))).collect()
    assert sum(r.k is None for r in rows) == 1
    for r in rows:
        if r.k is not None:
            assert r.k == pytest.approx(km.sketch(np.array([r.x]))[0])


def objective(w, x, t, c):
    return c * (np.maximum(1 - t * (x @ w[1:] + w[0]), 0) ** 2).sum() + 0.5 * (w[1:] ** 2).sum()


def test_grid_of_machines(shell):
    values = {"C": [0.1, 10.0], "kernel": ["linear", "rbf", "poly"], "gamma": ["scale", 0.5]}
    grid = gr.svm_grid(shell, values, 2, n_components=64)
    assert len(grid.points) == 12 and grid.accuracy.shape == (12, 4)
    by = {(p["kernel"], p["C"], p["gamma"]): k for k, p in enumerate(grid.points)}
    assert by["linear", 0.1, "scale"] != by["linear", 0.1, 0.5]
    assert (grid.accuracy[by["linear", 0.1, "scale"]] == grid.accuracy[by["linear", 0.1, 0.5]]).all()
    assert grid.accuracy.mean(1)[by["rbf", 10.0, 0.5]] > 0.9 > 0.7 > grid.accuracy.mean(1)[by["linear", 10.0, "scale"]]
    assert grid.best == int(np.argmax(grid.accuracy.mean(1)))

    # no direction lowers a fit's objective, which is sklearn's with the squared hinge
    rows = shell.collect()
    x, t = np.array([r.x for r in rows]), np.array([2 * r.label - 1 for r in rows])
    fit = grid.refits[by["linear", 0.1, "scale"]]
    w = np.array([fit.intercept, *fit.coefficients])
    for move in np.random.default_rng(1).normal(scale=1e-3, size=(50, 3)):
        assert objective(w + move, x, t, 0.1) >= objective(w, x, t, 0.1) - 1e-12

    scored = grid.margin(shell, by["rbf", 10.0, 0.5])
    assert scored.agg(F.avg(((F.col("margin") > 0).cast("int") == F.col("label")).cast("int"))).first()[0] > 0.9


def test_wrong_grid(shell):
    with pytest.raises(ValueError):
        gr.svm_grid(shell, {"kernel": ["sigmoid"]}, 2)


def test_kernel_maps_hold_few_rows_at_once(spark):
    limit = 1 << 18
    assert md.MAPPED == limit

    class Watched(md.KernelMap):
        def sketch(self, x):
            assert len(x) * self.width <= limit, len(x)
            return super().sketch(x)

    df = spark.range(3000, numPartitions=1).selectExpr("CASE WHEN id % 7 <> 3 THEN array(id / 3000D, 1D, 0D) END AS a").select(F.when(F.col("a").isNotNull(), array_to_vector("a")).alias("features"))
    plain = md.kernel_map("poly_sketch", 3, "auto", 512)
    own = Watched(plain.kind, plain.w, plain.b, plain.degree, plain.width, plain.gamma, plain.coef0)
    got = own.transform(df).collect()
    assert all((r.features is None) == (r.kfeatures is None) for r in got)
    known = [r for r in got if r.features is not None]
    assert np.allclose([r.kfeatures.toArray() for r in known], plain.sketch(np.array([r.features.toArray() for r in known])))
    rbf = md.kernel_map("rbf", 3, 1.0, 128)
    known = rbf.transform(df.where("features is not null")).collect()
    assert np.allclose([r.kfeatures.toArray() for r in known], np.sqrt(2 / 128) * np.cos(np.array([r.features.toArray() for r in known]) @ rbf.w.T + rbf.b))


def test_passes_take_bounded_slices():
    from tabstat.operators import grid as gr

    got = list(gr._slices([pd.DataFrame({"y": range(2500)}), pd.DataFrame({"y": []})]))
    assert [len(b) for b in got] == [1024, 1024, 452] and list(pd.concat(got)["y"]) == list(range(2500))
