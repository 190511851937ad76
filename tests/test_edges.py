"""Edge rules: null and shared keys in splits, NaN as missing, collinear and
nearly collinear columns, exact Kolmogorov p-values, sampled silhouette."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabstat.functions.dist import EXACT_N, kolmogorov_cdf_exact, kolmogorov_sf
from tabstat.operators import features as fe
from tabstat.operators import matrix as mx
from tabstat.operators import neighbors as nb
from tabstat.operators import profile as pr
from tabstat.operators import sample as sm

NAN = float("nan")


def test_split_with_null_keys_ends(spark):
    df = spark.createDataFrame([(None, "a")] * 90 + [(k, "a") for k in range(10)], "k long, g string").repartition(4)
    out = sm.split_column(df, "k", 0.2)
    assert {(r.split, r.n) for r in out.groupBy("split").agg(F.count("k").alias("n")).collect()} == {("test", 2), ("train", 8)}
    assert out.where("k is null and split = 'test'").count() == 0
    folds = sm.stratified_folds(df, "k", "g", k=5)
    assert sorted((r.fold, r.n) for r in folds.where("k is not null").groupBy("fold").agg(F.count("k").alias("n")).collect()) == [(i, 2) for i in range(5)]
    assert {r.fold for r in folds.where("k is null").select("fold").collect()} == {0}
    assert sm.split_column(df.where("k is null"), "k", 0.2).where("split = 'train'").count() == 90


def test_rows_of_a_shared_key_stay_together(spark):
    df = spark.createDataFrame([(7,)] * 300 + [(k,) for k in range(100, 400)], "k long").repartition(5)
    out = sm.split_column(df, "k", 0.2).groupBy("k").agg(F.countDistinct("split").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("split").alias("s")).collect()
    assert all(r.n == 1 for r in out)
    test = sum(r.rows for r in out if r.s == "test")
    assert 120 <= test < 120 + 300


@pytest.fixture(scope="module")
def with_nan(spark):
    values = [1.0, 2.0, 2.5, 4.0, 7.0, 7.5, 40.0]
    clean = spark.createDataFrame([(v, 2 * v) for v in values], "x double, y double")
    return clean, clean.unionByName(spark.createDataFrame([(NAN, 3.0), (NAN, NAN), (None, 1.0)], "x double, y double")).repartition(2)


@pytest.mark.parametrize("name", ["histogram", "histogram_density", "histogram_2d", "kde", "kde_binned", "box_stats", "kde_2d"])
def test_nan_is_missing(with_nan, name):
    run = {
        "histogram": lambda d: pr.histogram(d, ["x"], 5), "histogram_density": lambda d: pr.histogram_density(d, "x", 2.0),
        "histogram_2d": lambda d: pr.histogram_2d(d.withColumn("y", F.when(F.col("x").isNotNull() & ~F.isnan("x"), F.col("y"))), "x", "y", 4, 4),
        "kde": lambda d: pr.kde(d, "x", grid=20), "kde_binned": lambda d: pr.kde(d, "x", grid=20, bins=8), "box_stats": lambda d: pr.box_stats(d, "x"),
        "kde_2d": lambda d: pr.kde_2d(d.withColumn("y", F.when(F.col("x") != 2.0, F.col("y") * F.col("y"))), "x", "y", grid=5),
    }[name]
    a, b = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in run(d).collect()) for d in with_nan)
    assert a == b and not any(isinstance(v, float) and math.isnan(v) for r in b for v in r)


def test_scaling_leaves_nan_out(with_nan):
    clean, dirty = with_nan
    for fit in (fe.minmax_fit, fe.standard_fit):
        a, b = fit(clean, ["x"]), fit(dirty, ["x"])
        assert a.shift == pytest.approx(b.shift) and a.scale == pytest.approx(b.scale)
    scaled = [r.x for r in fe.minmax_scale(dirty, None, ["x"])[0].collect()]
    assert sorted(v for v in scaled if v is not None and not math.isnan(v))[0::6] == [0.0, 1.0]


def test_condition_number_of_collinear_and_nearly_collinear(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 3)) * [1.0, 1e4, 1.0]
    exact = pd.DataFrame({"a": a[:, 0], "b": a[:, 1], "c": a[:, 0] * 2})
    assert mx.condition_number(mx.triangle(spark.createDataFrame(exact), ["a", "b", "c"])) == math.inf
    u, _ = np.linalg.qr(rng.normal(size=(300, 3)))
    v, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    near = pd.DataFrame((u * [3e10, 5.0, 1.0]) @ v.T, columns=list("abc"))
    for parts in (1, 7):
        r = mx.triangle(spark.createDataFrame(near).repartition(parts), list("abc"))
        assert mx.condition_number(r) == pytest.approx(3e10, rel=1e-4)
        assert mx.singular_values(r) == pytest.approx(np.linalg.svd(near.to_numpy(), compute_uv=False), rel=1e-4)
    one = mx.triangle(spark.createDataFrame(exact), ["a"], intercept=True)
    assert np.abs(one.T @ one) == pytest.approx(np.abs(np.array([[300, a[:, 0].sum()], [a[:, 0].sum(), (a[:, 0] ** 2).sum()]])), rel=1e-10)
    few = mx.triangle(spark.createDataFrame(exact.head(2)), ["a", "b", "c"])
    assert mx.condition_number(few) == math.inf and mx.condition_number(mx.triangle(spark.createDataFrame(exact).limit(0), ["a"])) == math.inf


def test_kolmogorov_exact():
    for d in (0.55, 0.7, 0.95):
        assert kolmogorov_cdf_exact(d, 1) == pytest.approx(2 * d - 1, abs=1e-14)
        assert kolmogorov_cdf_exact(d, 2) == pytest.approx(1 - 2 * (1 - d) ** 2, abs=1e-14)
    assert kolmogorov_cdf_exact(0.4, 2) == pytest.approx(2 * (2 * 0.4 - 0.5) ** 2, abs=1e-14)
    # published: Marsaglia, Tsang, Wang (2003)
    assert kolmogorov_cdf_exact(0.274, 10) == pytest.approx(0.6284796154565, abs=1e-10)
    assert kolmogorov_cdf_exact(0.04, 2000) == pytest.approx(0.99676943191713676985, abs=1e-10)
    assert kolmogorov_sf(0.04, 2000) == pytest.approx(1 - 0.99676943191713676985, abs=1e-10)
    assert kolmogorov_sf(0.03, EXACT_N) == pytest.approx(kolmogorov_sf(0.03, EXACT_N + 1), abs=2e-3)
    assert kolmogorov_sf(0.9, 100) < 1e-15 and kolmogorov_sf(0.001, 100) == 1.0
    rng = np.random.default_rng(1)
    u = np.sort(rng.random((20_000, 8)), axis=1)
    d = np.maximum(np.arange(1, 9) / 8 - u, u - np.arange(8) / 8).max(1)
    assert (d >= 0.3).mean() == pytest.approx(kolmogorov_sf(0.3, 8), abs=0.012)


def silhouettes(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = (c == c[i]).sum() - 1
        b = min(d[i, c == k].mean() for k in set(c.tolist()) if k != c[i])
        a = d[i, c == c[i]].sum() / own if own else 0
        out.append((b - a) / max(a, b) if own else 0.0)
    return np.array(out)


def test_sampled_silhouette(spark):
    rng = np.random.default_rng(6)
    c = rng.choice(3, 600, p=[0.6, 0.3, 0.1])
    x = rng.normal(size=(600, 2)) + np.array([[0, 0], [2.5, 0], [0, 3]])[c]
    s = silhouettes(x, c)
    df = spark.createDataFrame([(int(i), [float(a) for a in v], int(k)) for i, (v, k) in enumerate(zip(x, c))], "id long, v array<double>, c int").repartition(4)
    whole = nb.silhouette_sampled(df, "v", "c", "id", anchors=1000).first()
    assert whole.silhouette == pytest.approx(s.mean()) == pytest.approx(nb.silhouette(df, "v", "c", "id").first().silhouette) and whole.std_error == 0
    sizes = {k: int((c == k).sum()) for k in range(3)}

    hashes = np.array([r.h for r in df.orderBy("id").select(F.array(*[F.xxhash64("id", F.lit(k)) for k in range(100)]).alias("h")).collect()])

    def estimate(seed):
        return nb.stratified_mean({k: s[sorted(np.flatnonzero(c == k), key=lambda i: hashes[i, seed])[:30]] for k in range(3)}, sizes)

    got = nb.silhouette_sampled(df, "v", "c", "id", anchors=30, seed=5).first()
    assert (got.silhouette, got.std_error) == pytest.approx(estimate(5)) and got.n_anchors == 90 and got.n == 600
    inside = sum(abs(m - s.mean()) <= 1.96 * e for m, e in map(estimate, range(100)))
    assert inside >= 90
    assert nb.silhouette_sampled(df.limit(0), "v", "c", "id").first().silhouette is None


def test_kde_windows_equal_the_full_sum(spark):
    """Two far clusters: grid points between them are out of every reach."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 150), rng.normal(500, 2, 150)])
    y = np.concatenate([rng.normal(0, 1, 150), rng.normal(-80, 3, 150)])
    df = spark.createDataFrame([(float(a), float(b), "flat" if k < 0 else "g") for k, (a, b) in enumerate(zip(x, y))] + [(1.0, 2.0, "flat")] * 3, "x double, y double, g string")
    got = pr.kde(df.where("g = 'g'"), "x", grid=400, bw=0.01).orderBy("i").toPandas()
    h = 0.01 * x.std(ddof=1)
    at = x.min() + np.arange(400) * (x.max() - x.min()) / 400
    full = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(1) / (300 * h * math.sqrt(2 * math.pi))
    assert len(got) == 400 and np.abs(got.density.to_numpy() - full).max() < 1e-12 and (got.density == 0).any()
    two = pr.kde_2d(df, "x", "y", by=["g"], grid=30, bw=0.05).toPandas()
    own = two[two.g == "g"].sort_values(["ix", "iy"])
    pts = np.column_stack([x, y])
    cov = np.cov(pts.T) * 0.05 ** 2
    inv = np.linalg.inv(cov)
    d = np.stack([own.x, own.y], axis=1)[:, None] - pts[None]
    full = np.exp(-0.5 * np.einsum("abi,ij,abj->ab", d, inv, d)).sum(1) / (300 * 2 * math.pi * math.sqrt(np.linalg.det(cov)))
    assert len(own) == 900 and np.abs(own.density.to_numpy() - full).max() < 1e-12
    flat = two[two.g == "flat"]
    assert len(flat) == 1 and (flat.iloc[0].x, flat.iloc[0].y) == (1.0, 2.0) and math.isnan(flat.iloc[0].density)
