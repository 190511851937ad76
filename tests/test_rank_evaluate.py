import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabstat.functions import dist
from tabstat.operators import evaluate as ev
from tabstat.operators import normality as nm
from tabstat.operators.rank import global_rank


def _frame(spark, n=600, seed=1, hot=True):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 4, n)
    if hot:
        g[: n // 3] = 0  # one group holds a third of the rows
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": np.round(rng.normal(size=n), 1)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_global_rank_partition_invariant(spark, parts):
    pdf, df = _frame(spark)
    df = df.repartition(parts).orderBy(F.rand(3))
    got = {r["id"]: r["rank"] for r in global_rank(df, ["v"], tiebreak=["id"], num_partitions=parts).collect()}
    ref = pdf.sort_values(["v", "id"]).id.tolist()
    assert [got[i] for i in ref] == list(range(1, len(ref) + 1))
    by = global_rank(df, ["v"], by=["g"], tiebreak=["id"], descending=True, group_size_col="n").toPandas()
    for g, part in pdf.groupby("g"):
        order = part.sort_values(["v", "id"], ascending=[False, True]).id.tolist()
        sub = by[by.g == g].set_index("id")
        assert [sub.loc[i, "rank"] for i in order] == list(range(1, len(order) + 1))
        assert (sub.n == len(order)).all()


def test_prefix_sums(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.permutation(500), "a": rng.random(500)})
    out = ev.prefix_sums(spark.createDataFrame(pdf).repartition(7), ["k"], ["a"], descending=True).toPandas()
    ref = pdf.sort_values("k", ascending=False).a.cumsum().to_numpy()
    assert np.allclose(out.sort_values("k", ascending=False).a_cum.to_numpy(), ref)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.5, 0), (0.1, 0)], "s double, y int")
    assert ev.roc_auc(df, "y", "s") == pytest.approx(2.0 / 3.0)
    roc = ev.roc_curve(df, "y", "s").orderBy(F.desc("threshold")).collect()
    assert [(r["fpr"], r["tpr"]) for r in roc] == [(0.0, 0.0), (1 / 3, 0.5), (2 / 3, 1.0), (1.0, 1.0)]


def test_metrics_with_empty_cell(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0), (0, 0)], "y int, p int")
    r = ev.classification_metrics(df, "y", "p", decimals=None).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"], r["specificity"]) == (0.0, 0.0, 0.0, 0.5, 1.0)
    cm = {(r["label"], r["pred"]): r["count"] for r in ev.confusion_matrix(df, "y", "p").collect()}
    assert cm == {(0, 0): 2, (0, 1): 0, (1, 0): 2, (1, 1): 0}


def test_norm_cdf_and_ppf_precision(spark):
    xs = np.r_[np.linspace(-38, 38, 761), [-7.0710678, 7.0710679, 0.0]]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = df.select("x", dist.norm_cdf("x").alias("c")).toPandas()
    ref = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in got.x])
    assert np.max(np.abs(got.c - ref)) < 1e-14
    ps = np.r_[1e-12, 1e-6, 0.001, 0.02425, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]
    pdf = spark.createDataFrame([(float(p),) for p in ps], "p double")
    q = dist.with_norm_ppf(pdf.withColumn("a", dist.norm_ppf("p")), "p", "x").toPandas()
    back = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in q.x])
    assert np.all(np.abs(back - q.p) <= 1e-14 + 1e-13 * q.p)
    assert np.all(np.abs(q.a - q.x) <= 1e-8 * np.maximum(1, np.abs(q.x)))


def test_driver_special_functions():
    z = 1.959963984540054
    assert dist.t_ppf(0.975, 1e9) == pytest.approx(z, rel=1e-8)
    nu = 1e5  # Cornish-Fisher expansion is exact to O(nu^-3) here
    cf = z + (z ** 3 + z) / (4 * nu) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * nu ** 2)
    assert dist.t_ppf(0.975, nu) == pytest.approx(cf, rel=1e-10)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    t = 2.3
    assert dist.f_sf(t * t, 1, 17) == pytest.approx(2 * dist.t_sf(t, 17), rel=1e-10)
    assert dist.chi2_sf(3.0, 2) == pytest.approx(math.exp(-1.5))
    assert dist.chi2_sf(4.0, 3) == pytest.approx(0.26146412994911117, rel=1e-9)
    assert dist.phi_inv(0.975) == pytest.approx(1.959963984540054, rel=1e-12)


def test_ks_statistic_brute_force(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(0.2, 1.1, 300), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    d = nm.ks_statistic(df, ["x"]).first()["statistic"]
    xs = np.sort(x)
    n = len(xs)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in xs])
    ref = max(np.max(np.arange(1, n + 1) / n - cdf), np.max(cdf - np.arange(0, n) / n))
    assert d == pytest.approx(ref, abs=1e-13)


def test_shapiro_and_dagostino_behaviour(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"normal": rng.normal(size=400), "skewed": rng.exponential(size=400)})
    df = spark.createDataFrame(pdf)
    sw = {r["column"]: r for r in nm.shapiro_test(df, ["normal", "skewed"]).collect()}
    assert 0.98 < sw["normal"]["statistic"] <= 1.0 and sw["normal"]["p_value"] > 0.01
    assert sw["skewed"]["statistic"] < 0.9 and sw["skewed"]["p_value"] < 1e-6
    k2 = {r["column"]: r for r in nm.dagostino_test(df, ["normal", "skewed"]).collect()}
    assert k2["normal"]["p_value"] > 0.01 and k2["skewed"]["p_value"] < 1e-6
    # W from the full Royston weight vector in numpy equals the distributed sums
    x = np.sort(pdf.normal.to_numpy())
    n = len(x)
    m = np.array([dist.phi_inv((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u = 1 / math.sqrt(n)
    c = m / math.sqrt(m @ m)
    an = c[-1] + sum(k * u ** i for i, k in enumerate(nm.SW_C1))
    an1 = c[-2] + sum(k * u ** i for i, k in enumerate(nm.SW_C2))
    phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
    a = m / math.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = an, an1, -an, -an1
    w = (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()
    assert sw["normal"]["statistic"] == pytest.approx(w, rel=1e-7)


def test_qq_points_positions(spark):
    df = spark.createDataFrame([(float(v),) for v in [3, 1, 2, 4]], "x double")
    pts = nm.qq_points(df, "x").orderBy("i").collect()
    assert [p["sample"] for p in pts] == [1.0, 2.0, 3.0, 4.0]
    assert pts[0]["theoretical"] == pytest.approx(dist.phi_inv(0.125), abs=1e-8)
    last = nm.qq_points(df, "x", plotting="i/n").orderBy("i").collect()[-1]
    assert last["theoretical"] is None


def test_normality_report_matches_individual_tests(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.normal(size=300), "b": rng.gamma(2.0, size=300)}))
    rep = {(r["column"], r["test"]): r for r in nm.normality_report(df, ["a", "b"]).collect()}
    for t in (nm.ks_test(df, ["a", "b"]), nm.shapiro_test(df, ["a", "b"]), nm.dagostino_test(df, ["a", "b"])):
        for r in t.collect():
            got = rep[(r["column"], r["test"])]
            assert got["statistic"] == pytest.approx(r["statistic"], rel=1e-12)
            assert got["p_value"] == pytest.approx(r["p_value"], rel=1e-9)
            assert got["interpretation"] == r["interpretation"]


def test_normal_scores_of_arrays_equal_the_expressions(spark):
    x = np.array([0.0, -0.0, 0.3, -2.5, 7.07, 7.08, -7.08, 36.9, 37.1, -40.0, np.inf, -np.inf])
    p = np.array([0.0, 1e-300, 1e-9, 0.024, 0.02425, 0.3, 0.5, 0.9, 0.97575, 0.98, 1 - 1e-12, 1.0])
    got = spark.createDataFrame(pd.DataFrame({"k": range(len(x)), "x": x, "p": p})).select(
        "k", dist.norm_cdf("x").alias("c"), dist.norm_ppf("p").alias("q")).orderBy("k").toPandas()
    np.testing.assert_allclose(dist.norm_cdf_array(x), got.c, rtol=1e-13)
    np.testing.assert_allclose(dist.norm_ppf_array(p), got.q, rtol=1e-13)


def test_normality_report_reads_rows_once_a_pass_and_scores_whole_arrays(spark):
    from tabstat.operators import clean

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame(pd.DataFrame({"a": np.random.default_rng(6).gamma(2.0, size=300)})).mapInPandas(count, "a double")
    grid = np.array([-1.0, 0.0, 0.5, 2.0])
    got = clean._power_moments(df, {"a": grid})["a"]
    assert seen.value == 300
    x = df.toPandas().a.to_numpy()
    assert got == pytest.approx([np.var(np.log(x) if g == 0 else x ** g) for g in grid])
    plan = nm.normality_stats(df, ["a"])._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and str(dist.HART_NUM[0]) not in plan
