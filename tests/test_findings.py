"""Inputs that once gave wrong answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabstat.operators import clean, evaluate as ev, matrix as mx, profile as pr, pruning, regress as rg
from tabstat.operators.order_stats import modes, quantile_wide


def test_gramian_far_from_zero_and_wide(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e8, 1.0, size=(4000, 60))
    x[:, 10:] = (rng.random((4000, 50)) < 0.1)  # one-hot like
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(60)])).repartition(5)
    g = mx.gramian(df, df.columns)
    d = x - x.mean(axis=0)
    assert np.allclose(g.centred, d.T @ d, rtol=1e-6, atol=1e-3)
    assert g.n == 4000 and np.allclose(g.mean, x.mean(axis=0))
    assert np.allclose(mx.pca_fit(g).explained_variance.sum(), x.var(axis=0, ddof=1).sum() * 0.95, rtol=0.06)


def test_ols_and_vif_on_badly_scaled_columns(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.normal(0, 1e6, 2000), "b": rng.normal(0, 1e-3, 2000)})
    pdf["y"] = 2e-6 * pdf.a + 3000 * pdf.b + rng.normal(0, 0.01, 2000)
    df = spark.createDataFrame(pdf)
    m = rg.ols_fit(df, "y", ["a", "b"])
    ref = np.linalg.lstsq(np.c_[np.ones(2000), pdf.a, pdf.b], pdf.y, rcond=None)[0]
    assert m.coef("b") == pytest.approx(ref[2], rel=1e-8) and m.coef("a") == pytest.approx(ref[1], rel=1e-8) and m.rank == 3
    assert all(v == pytest.approx(1.0, abs=0.01) for _, v in rg.vif_from_gram(mx.gramian(df, ["a", "b"])))
    twice = df.withColumn("c", F.col("b") * 2)
    assert rg.ols_fit(twice, "y", ["a", "b", "c"]).rank == 3
    assert all(np.isinf(v) for _, v in rg.vif_from_gram(mx.gramian(twice, ["a", "b", "c"])))


def test_vif_of_three_by_regressions(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(5, 1, 500), "b": rng.normal(size=500)})
    pdf["c"] = pdf.a + 0.3 * pdf.b + 0.1 * rng.normal(size=500)
    for name, v in rg.vif_from_gram(mx.gramian(spark.createDataFrame(pdf), ["a", "b", "c"])):
        rest = pdf.drop(columns=name).to_numpy()
        fit = rest @ np.linalg.lstsq(rest, pdf[name], rcond=None)[0]
        assert v == pytest.approx((pdf[name] ** 2).sum() / ((pdf[name] - fit) ** 2).sum(), rel=1e-6)


def test_roc_with_infinite_score(spark):
    df = spark.createDataFrame([(1, float("inf")), (1, 0.9), (0, 0.5), (0, float("-inf"))], "y int, s double")
    assert ev.roc_auc(df, "y", "s") == 1.0
    curve = ev.roc_curve(df, "y", "s").collect()
    assert len(curve) == 5 and sum(r.pos for r in curve) == 2


def test_medians_with_nan_and_integers(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (4.0, None), (None, 3), (2.0, 4)], "x double, k int")
    out = clean.impute_median(df, ["x", "k"]).collect()
    assert [r.x for r in out] == [1.0, 2.0, 4.0, 2.0, 2.0] and [r.k for r in out] == [1.0, 2.0, 2.5, 3.0, 4.0]


def test_mode_of_large_integers(spark):
    big = 2 ** 53
    df = spark.createDataFrame([(big + 1,), (big + 1,), (big,), (None,)], "k long")
    row = modes(df, ["k"]).first()
    assert int(row["int_value"]) == big + 1 and row["count"] == 2
    assert [r.k for r in clean.impute_mode(df, ["k"]).collect()] == [big + 1, big + 1, big, big + 1]


def test_columns_and_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), (None, 5.0, None), ("b", None, None)], "g string, x double, z double")
    q = {(r.g, r.column): r.m for r in quantile_wide(df, ["x", "z"], {"m": 0.5}, by=["g"]).collect()}
    assert q == {("a", "x"): 2.0, (None, "x"): 5.0, ("b", "x"): None, ("a", "z"): None, (None, "z"): None, ("b", "z"): None}
    assert clean.remove_outliers_iqr(df, ["z"]).count() == 0
    assert {r.column: r.q1 for r in clean.iqr_table(df, ["x", "z"]).collect()} == {"x": 2.0, "z": None}
    assert {r.g: r["median"] for r in pr.box_stats(df, "x", by=["g"]).collect()} == {"a": 2.0, None: 5.0}
    dens = pr.kde(df, "x", by=["g"], grid=4).collect()
    assert sum(r.g == "a" for r in dens) == 4 and [(r.x, r.density) for r in dens if r.g is None] == [(5.0, None)]


def test_empty_histogram(spark):
    assert pr.histogram_2d(spark.createDataFrame([], "x double, y double"), "x", "y").collect() == []


def test_durbin_watson_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"t": np.repeat(range(40), 5), "x": rng.normal(size=200)})
    pdf["y"] = pdf.x + rng.normal(size=200)
    df = spark.createDataFrame(pdf)
    m = rg.ols_fit(df, "y", ["x"])
    values = {round(rg.ols_diagnostics(df.repartition(n), m, "t")["durbin_watson"], 10) for n in (1, 3, 7)}
    assert len(values) == 1


def test_links_that_go_at_one_alpha():
    # two mirror subtrees: both are pruned at the same alpha
    t = pruning.TreeTable(np.arange(7), np.array([1, 3, 5, -1, -1, -1, -1]), np.array([2, 4, 6, -1, -1, -1, -1]), np.array([-1, 0, 0, 1, 1, 2, 2]),
                          np.array([[50, 50], [40, 10], [10, 40], [30, 2], [10, 8], [2, 30], [8, 10]], float),
                          np.array([0.5, 0.32, 0.32, 2 * 30 * 2 / 32 ** 2, 2 * 80 / 18 ** 2, 2 * 30 * 2 / 32 ** 2, 2 * 80 / 18 ** 2]), [3, 4, 5, 6])
    order = []
    path = pruning.pruning_path(t, {"valid": np.array([[30, 2], [10, 8], [2, 30], [8, 10]], float)}, order)
    assert path.alpha.iloc[1] == path.alpha.iloc[2] and set(order[:2]) == {1, 2} and list(path.n_leaves) == [4, 3, 2, 1]


def test_no_private_checkpoint_folder_on_a_cluster():
    from types import SimpleNamespace

    from tabstat.session import checkpoint_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(sparkContext=sc))
