import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabstat.operators import clean, features as fe, profile as pr
from tabstat.operators.order_stats import modes, quantiles


def test_mode_ties_smallest_and_nulls_ignored(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 1.0), ("c", None)], "s string, x double")
    got = {r["column"]: r for r in modes(df, ["s", "x"]).collect()}
    assert got["s"]["str_value"] == "a"
    assert got["x"]["num_value"] == 1.0
    filled = clean.impute_mode(df, ["x"]).collect()
    assert [r["x"] for r in filled][-1] == 1.0


def test_even_median_interpolated(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    q = quantiles(df, ["x"], [0.5]).collect()
    assert q[0]["value"] == 2.5
    assert clean.impute_median(df, ["x"]).agg(F.sum("x")).first()[0] == 18.5


def test_quantiles_match_numpy_with_groups(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "x": np.round(rng.gamma(2.0, 3.0, 400), 1),
                        "y": rng.normal(size=400)})
    df = spark.createDataFrame(pdf).repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles(df, ["x", "y"], probs, by=["g"]).collect()
    for r in got:
        ref = np.percentile(pdf.loc[pdf.g == r["g"], r["column"]], r["prob"] * 100)
        assert r["value"] == pytest.approx(ref, rel=1e-12, abs=1e-12)


def _seq_numpy(pdf, cols, k):
    out = pdf.copy()
    for c in cols:
        q1, q3 = np.percentile(out[c], 25), np.percentile(out[c], 75)
        out = out[(out[c] >= q1 - k * (q3 - q1)) & (out[c] <= q3 + k * (q3 - q1))]
    return out


def test_sequential_outliers_order_dependent(spark):
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(0, 1, 200), [15.0, 16, 17, 18, 19, 20]]
    y = np.r_[rng.normal(0, 1, 200), [0.0, 0, 0, 0, 0, 0]] + np.r_[np.zeros(200), np.linspace(3, 4, 6)]
    pdf = pd.DataFrame({"id": range(len(x)), "x": x, "y": y})
    df = spark.createDataFrame(pdf)
    for k in (1.5, 4.5):
        a = sorted(r["id"] for r in clean.remove_outliers_iqr(df, ["x", "y"], k=k).collect())
        b = sorted(r["id"] for r in clean.remove_outliers_iqr(df, ["y", "x"], k=k).collect())
        assert a == sorted(_seq_numpy(pdf, ["x", "y"], k).id.tolist())
        assert b == sorted(_seq_numpy(pdf, ["y", "x"], k).id.tolist())
    once = clean.remove_outliers_iqr(df, ["x", "y"], k=1.5, sequential=False).count()
    assert once <= len(pdf)


def test_iqr_table_rounded(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]], "x double")
    r = clean.iqr_table(df, ["x"]).first()
    assert (r["q1"], r["q3"], r["iqr"]) == (3.25, 7.75, 4.5)


def test_positive_shift_and_boxcox(spark):
    df = spark.createDataFrame([(-3.0,), (0.0,), (5.0,)], "x double")
    assert [r["x"] for r in clean.positive_shift(df, ["x"]).orderBy("x").collect()] == [1.0, 4.0, 9.0]
    d2 = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double")
    for lam, fn in ((0.0, np.log), (1.0, lambda v: v - 1.0), (0.5, lambda v: (np.sqrt(v) - 1) / 0.5)):
        out, _ = clean.boxcox(d2, ["x"], {"x": lam})
        got = [r["x"] for r in out.orderBy("x").collect()]
        assert got == pytest.approx(list(fn(np.array([1.0, 2, 4, 8]))))
    with pytest.raises(ValueError):
        clean.boxcox(df, ["x"], {"x": 1.0})


def test_boxcox_mle_is_a_maximum(spark):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.lognormal(1.0, 0.6, 500)}))
    lam = clean.boxcox_lambdas(df, ["x"])["x"]
    ll = clean.boxcox_llf(df, "x", [lam - 1e-3, lam, lam + 1e-3])
    assert ll[1] >= ll[0] and ll[1] >= ll[2]
    assert abs(lam) < 0.3  # log-normal data: λ near 0


def test_null_profile(spark):
    df = spark.createDataFrame([(1.0, None), (None, "a"), (float("nan"), "b"), (2.0, "c")], "x double, s string")
    got = {r["column"]: r["pct_null"] for r in clean.null_profile(df).collect()}
    assert got == {"x": 50.0, "s": 25.0}


def test_bin_edges_right_closed(spark):
    vals = [0.0, 0.1, 0.1000001, 20.0, 380.0, 381.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = fe.bin_labels(df, "x", [0, 0.1, 20, 50, 380], ["none", "light", "moderate", "heavy"]).collect()
    assert [r["bin"] for r in out] == ["none", "none", "light", "light", "heavy", None, None]


def test_one_hot_sorted_first_dropped(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "a")], "id int, c string")
    out = fe.one_hot(df, ["c"]).orderBy("id")
    assert out.columns == ["id", "c_b", "c_c"]
    assert [(r["c_b"], r["c_c"]) for r in out.collect()] == [(1, 0), (0, 0), (0, 1), (0, 0)]


def test_scalers_constant_column_and_population_std(spark):
    tr = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    te = spark.createDataFrame([(5.0, 5.0)], "x double, k double")
    _, t2, m = fe.minmax_scale(tr, te, ["x", "k"])
    r = t2.first()
    assert (r["x"], r["k"]) == (2.0, 0.0)
    _, t3, m2 = fe.standard_scale(tr, te, ["x"])
    assert t3.first()["x"] == pytest.approx(3.0)  # (5 - 2) / 1 (population std)


def test_map_labels_unknown_is_null(spark):
    df = spark.createDataFrame([("No",), ("Yes",), ("Maybe",)], "v string")
    assert [r["v"] for r in fe.map_labels(df, "v", {"No": 0, "Yes": 1}).collect()] == [0, 1, None]


def test_resample_gap_year(spark):
    df = spark.createDataFrame([("2000-03-01", 1.0), ("2000-06-01", 3.0), ("2002-01-05", 5.0)], "d string, v double")
    df = df.withColumn("d", F.to_timestamp("d"))
    out = pr.resample(df, "d", "year", {"m": ("v", "mean"), "s": ("v", "sum")}).orderBy("period").collect()
    assert [(r["period"], r["m"], r["s"]) for r in out] == [
        ("2000-12-31", 2.0, 4.0), ("2001-12-31", None, 0.0), ("2002-12-31", 5.0, 5.0)]


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4]], "x double")
    got = {r["bin"]: r["count"] for r in pr.histogram(df, ["x"], nbins=2).collect()}
    assert got == {0: 2, 1: 3}


def test_kde_matches_direct_evaluation(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=300)}))
    d = pr.kde(df, "x", grid=400).orderBy("i").toPandas()
    x = d.x.to_numpy()
    pdf = df.toPandas().x.to_numpy()
    n, s = len(pdf), pdf.std(ddof=1)
    bw = n ** (-0.2) * s
    ref = np.exp(-0.5 * ((x[:, None] - pdf[None, :]) / bw) ** 2).sum(1) / (n * bw * math.sqrt(2 * math.pi))
    assert np.allclose(d.density.to_numpy(), ref, rtol=1e-9)


def test_box_stats_whiskers(spark):
    vals = [1.0, 2, 3, 4, 5, 6, 7, 8, 9, 100]
    df = spark.createDataFrame([("g", float(v)) for v in vals], "g string, x double")
    r = pr.box_stats(df, "x", by=["g"]).first()
    q1, q3 = np.percentile(vals, 25), np.percentile(vals, 75)
    assert (r["q1"], r["q3"]) == (q1, q3)
    assert r["whisker_hi"] == 9.0 and r["whisker_lo"] == 1.0 and r["n_outliers"] == 1


def test_read_csv_na_tokens_and_schema(spark, tmp_path):
    from pyspark.sql import types as T

    from tabstat.sources.io import read_csv, select_numeric

    p = tmp_path / "w.csv"
    p.write_text("day,shop,amount,paid\n2010-01-01,A,1.5,no\n2010-01-02,B,NA,yes\n"
                 "2010-01-03,,nan,NA\n2010-01-04,C,#N/A,null\n")
    schema = T.StructType([T.StructField("day", T.DateType()), T.StructField("shop", T.StringType()),
                           T.StructField("amount", T.DoubleType()), T.StructField("paid", T.StringType())])
    rows = read_csv(spark, str(p), schema).orderBy("day").collect()
    assert [r["amount"] for r in rows] == [1.5, None, None, None]
    assert [r["shop"] for r in rows] == ["A", "B", None, "C"]
    assert [r["paid"] for r in rows] == ["no", "yes", None, None]
    df = read_csv(spark, str(p), schema)
    assert select_numeric(df).columns == ["amount"]


def test_binned_kde_close_to_exact(spark):
    rng = np.random.default_rng(15)
    df = spark.createDataFrame(pd.DataFrame({"g": rng.integers(0, 2, 3000), "x": rng.gamma(3.0, 2.0, 3000)}))
    exact = pr.kde(df, "x", by=["g"], grid=100).toPandas().sort_values(["g", "i"])
    binned = pr.kde(df, "x", by=["g"], grid=100, bins=2048).toPandas().sort_values(["g", "i"])
    assert np.allclose(exact.x.to_numpy(), binned.x.to_numpy())
    assert not np.array_equal(exact.density.to_numpy(), binned.density.to_numpy())  # binning took effect
    rel = np.abs(exact.density.to_numpy() - binned.density.to_numpy()).max() / exact.density.max()
    pdf = df.toPandas()
    w_over_h = max((p.x.max() - p.x.min()) / 2048 / (len(p) ** -0.2 * p.x.std()) for _, p in pdf.groupby("g"))
    assert rel < w_over_h ** 2  # linear-binning error bound O((w/h)^2)
    v = pr.violin(df, "x", by=["g"], grid=50).toPandas()
    assert len(v) == 100 and v.q1.notna().all()


def test_kde_2d_direct_and_binned(spark):
    rng = np.random.default_rng(21)
    pdf = pd.DataFrame({"x": rng.normal(size=400), "y": rng.normal(size=400)})
    pdf["y"] += 0.5 * pdf.x
    df = spark.createDataFrame(pdf)
    got = pr.kde_2d(df, "x", "y", grid=10).toPandas()
    n = len(pdf)
    cov = np.cov(pdf[["x", "y"]].to_numpy().T) * n ** (-1 / 3)
    inv, det = np.linalg.inv(cov), np.linalg.det(cov)
    pts = pdf[["x", "y"]].to_numpy()
    for _, r in got.iterrows():
        d = pts - np.array([r.x, r.y])
        ref = np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, inv, d)).sum() / (n * 2 * math.pi * math.sqrt(det))
        assert r.density == pytest.approx(ref, rel=1e-9)
    binned = pr.kde_2d(df, "x", "y", grid=10, bins=512).toPandas().sort_values(["ix", "iy"])
    exact = got.sort_values(["ix", "iy"])
    assert not np.array_equal(binned.density.to_numpy(), exact.density.to_numpy())  # binning took effect
    fac = n ** (-1 / 6)
    bound = max(((pdf[c].max() - pdf[c].min()) / 512 / (fac * pdf[c].std())) ** 2 for c in ("x", "y"))
    err = np.abs(binned.density.to_numpy() - exact.density.to_numpy()).max() / exact.density.max()
    assert err < 2 * bound  # lattice-binning error O((w/h)^2) per axis
