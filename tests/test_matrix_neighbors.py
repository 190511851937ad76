import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabstat.operators import matrix as mx
from tabstat.operators import neighbors as nb
from tabstat.operators import regress as rg
from tabstat.operators import sample as sm


def _reg_frame(spark, n=300, seed=4):
    rng = np.random.default_rng(seed)
    x1, x2, x3 = rng.normal(size=n), rng.normal(size=n), rng.uniform(0, 5, n)
    y = 1.5 + 2.0 * x1 - 0.7 * x2 + 0.1 * x3 + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame({"x1": x1, "x2": x2, "x3": x3, "y": y})
    return pdf, spark.createDataFrame(pdf)


def test_ols_matches_numpy(spark):
    pdf, df = _reg_frame(spark)
    m = rg.ols_fit(df, "y", ["x1", "x2", "x3"])
    X = np.c_[np.ones(len(pdf)), pdf[["x1", "x2", "x3"]].to_numpy()]
    beta, *_ = np.linalg.lstsq(X, pdf.y.to_numpy(), rcond=None)
    res = pdf.y.to_numpy() - X @ beta
    s2 = res @ res / (len(pdf) - 4)
    se = np.sqrt(np.diag(s2 * np.linalg.inv(X.T @ X)))
    assert np.allclose(m.params, beta, rtol=1e-9)
    assert np.allclose(m.bse, se, rtol=1e-7)
    assert m.ssr == pytest.approx(res @ res, rel=1e-9)
    n = len(pdf)
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(res @ res / n) + 1)
    assert m.aic == pytest.approx(-2 * llf + 8, rel=1e-10)
    assert m.bic == pytest.approx(-2 * llf + 4 * math.log(n), rel=1e-10)
    assert 0.0 <= m.f_pvalue < 1e-10


def test_exact_line(spark):
    df = spark.createDataFrame([(float(x), 3.0 + 2.0 * x) for x in range(10)], "x double, y double")
    m = rg.ols_fit(df, "y", ["x"])
    assert m.params == pytest.approx([3.0, 2.0])
    assert m.r2 == pytest.approx(1.0)


def test_collinear_vif_and_rank(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x, float(x % 3)) for x in range(20)], "a double, b double, c double")
    v = {r["variable"]: r["vif"] for r in rg.vif(df, ["a", "b", "c"]).collect()}
    assert math.isinf(v["a"]) and math.isinf(v["b"])
    m = rg.ols_fit(df.withColumn("y", F.col("a") + F.col("c")), "y", ["a", "b", "c"])
    assert m.rank == 3  # intercept + 2 independent columns


def test_vif_equals_uncentred_regressions(spark):
    pdf, df = _reg_frame(spark)
    cols = ["x1", "x2", "x3"]
    got = dict(rg.vif_from_gram(mx.gramian(df, cols)))
    X = pdf[cols].to_numpy()
    for j, c in enumerate(cols):
        others = np.delete(X, j, axis=1)
        beta, *_ = np.linalg.lstsq(others, X[:, j], rcond=None)
        r = X[:, j] - others @ beta
        r2 = 1 - (r @ r) / (X[:, j] @ X[:, j])
        assert got[c] == pytest.approx(1 / (1 - r2), rel=1e-9)


def test_backward_elimination_auto_drops_noise(spark):
    pdf, df = _reg_frame(spark)
    df = df.withColumn("noise", F.sin(F.col("x1") * 1000.0))
    log, final = rg.backward_elimination(df, "y", ["x1", "x2", "x3", "noise"], drops="auto", alpha=0.05)
    assert "x1" in final.xs and "x2" in final.xs
    assert all(row[9] > 0.05 for row in log)


def test_interval_in_units_equals_the_unscaled_fit(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(50, 2)) * [3.0, 200.0] + [10.0, -40.0]
    y = x @ [2.0, 0.05] + 7 + rng.normal(size=50)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id int, x1 double, x2 double, y double")
    test = df.where("id % 5 = 0").drop("y").unionByName(spark.createDataFrame([(99, None, 1.0)], "id int, x1 double, x2 double"))
    want = {r.id: r for r in rg.ols_fit(df, "y", ["x1", "x2"]).prediction_interval(test, 0.1, ["id", "x1"]).collect()}
    got = rg.interval_in_units(df, test, "y", ["x1", "x2"], 0.1, ["id", "x1"]).collect()
    assert len(got) == 11
    for r in got:
        assert tuple(r)[2:] == (None,) * 5 if r.id == 99 else tuple(r) == pytest.approx(tuple(want[r.id]), rel=1e-9)


def test_prediction_interval_single_predictor(spark):
    pdf, df = _reg_frame(spark)
    m = rg.ols_fit(df, "y", ["x1"])
    out = m.prediction_interval(df.limit(5).select("x1"), keep=["x1"]).toPandas()
    n = len(pdf)
    x = pdf.x1.to_numpy()
    sxx = ((x - x.mean()) ** 2).sum()
    s2 = m.scale
    from tabstat.functions.dist import t_ppf
    q = t_ppf(0.975, n - 2)
    for _, r in out.iterrows():
        se_mean = math.sqrt(s2 * (1 / n + (r.x1 - x.mean()) ** 2 / sxx))
        assert r.mean_hi - r["mean"] == pytest.approx(q * se_mean, rel=1e-7)
        assert r.obs_hi - r["mean"] == pytest.approx(q * math.sqrt(se_mean ** 2 + s2), rel=1e-7)


def test_pca_and_singular_values(spark):
    pdf, df = _reg_frame(spark)
    cols = ["x1", "x2", "x3"]
    g = mx.gramian(df, cols)
    X = pdf[cols].to_numpy()
    assert np.allclose(mx.singular_values(g), np.linalg.svd(X, compute_uv=False), rtol=1e-9)
    m = mx.pca_fit(g, variance=None)
    vals = np.sort(np.linalg.eigvalsh(np.cov(X.T)))[::-1]
    assert np.allclose(m.explained_variance, vals, rtol=1e-9)
    scores = m.transform(df).toPandas().to_numpy()
    assert np.allclose(scores.mean(0), 0, atol=1e-9)  # centred at transform


def _brute_knn(pts, ids, k, exclude_self):
    out = {}
    for i, p in enumerate(pts):
        d = np.sqrt(((pts - p) ** 2).sum(1))
        cand = [(d[j], ids[j]) for j in range(len(pts)) if not (exclude_self and ids[j] == ids[i])]
        out[ids[i]] = [t for _, t in sorted(cand)[:k]]
    return out


def test_knn_matches_brute_force_with_duplicates(spark):
    rng = np.random.default_rng(0)
    pts = np.round(rng.normal(size=(120, 3)), 1)
    pts[10] = pts[11] = pts[12]  # duplicated points: ties broken by id
    ids = list(range(100, 220))
    pdf = pd.DataFrame({"id": ids, "v": list(pts)})
    df = spark.createDataFrame(pdf, "id long, v array<double>")
    got = nb.knn(df, None, 7, "v", "id", exclude_self=True, block_rows=25).toPandas()
    ref = _brute_knn(pts, ids, 7, True)
    for q, part in got.groupby("qid"):
        assert part.sort_values("rank").tid.tolist() == ref[q]
    few = nb.knn(df.limit(3), None, 10, "v", "id").groupBy("qid").count().collect()
    assert all(r["count"] == 3 for r in few)  # k > n returns n


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    pts = np.r_[rng.normal(0, 1, (40, 2)), rng.normal(4, 1, (30, 2)), [[10.0, 10.0]]]
    lab = np.r_[np.zeros(40), np.ones(30), [2]].astype(int)
    pdf = pd.DataFrame({"id": range(len(pts)), "v": list(pts), "c": lab})
    got = nb.silhouette(spark.createDataFrame(pdf, "id long, v array<double>, c long"), "v", "c", "id",
                        block_rows=16).first()["silhouette"]
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    s = []
    for i in range(len(pts)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(s), rel=1e-9)


def test_smote_parity_and_segments(spark):
    rng = np.random.default_rng(8)
    mino = rng.normal(0, 1, (6, 2))
    majo = rng.normal(5, 1, (20, 2))
    pdf = pd.DataFrame({"id": range(26), "v": list(np.r_[mino, majo]), "y": [1] * 6 + [0] * 20})
    out = sm.smote(spark.createDataFrame(pdf, "id long, v array<double>, y int"), "y", "v", "id", k=5).toPandas()
    syn = out[out.synthetic]
    assert len(syn) == 14 and (out.y == 1).sum() == 20
    for v in syn.features:
        v = np.asarray(v)
        ok = False
        for i in range(6):
            for j in range(6):
                if i != j:
                    a, b = mino[i], mino[j]
                    t = np.dot(v - a, b - a) / np.dot(b - a, b - a)
                    if -1e-9 <= t <= 1 + 1e-9 and np.allclose(a + t * (b - a), v, atol=1e-9):
                        ok = True
        assert ok


@pytest.mark.parametrize("parts", [1, 8])
def test_split_exact_disjoint_and_partition_invariant(spark, parts):
    df = spark.range(1000).withColumnRenamed("id", "k").withColumn("y", (F.col("k") % 10 == 0).cast("int"))
    tr, te = sm.split(df.repartition(parts), "k", 0.2)
    a = {r["k"] for r in tr.collect()}
    b = {r["k"] for r in te.collect()}
    assert len(b) == 200 and len(a) == 800 and not (a & b)
    tr2, te2 = sm.split(df.repartition(3), "k", 0.2)
    assert {r["k"] for r in te2.collect()} == b
    s_tr, s_te = sm.stratified_split(df, "k", "y", 0.2)
    assert s_te.where("y = 1").count() == 20 and s_te.count() == 200
    folds = sm.stratified_folds(df, "k", "y", k=5).groupBy("fold", "y").count().collect()
    assert {(r["y"], r["count"]) for r in folds} == {(0, 180), (1, 20)}


def test_cost_complexity_path_properties(spark):
    from tabstat.operators import models as md
    from tabstat.operators.pruning import cost_complexity_prune

    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 3))
    y = ((x[:, 0] + 0.5 * rng.normal(size=300)) > 0.3).astype(int)
    pdf = pd.DataFrame({"id": range(300), "f0": x[:, 0], "f1": x[:, 1], "f2": x[:, 2], "label": y})
    df = md.assemble(spark.createDataFrame(pdf), ["f0", "f1", "f2"], keep=["id", "label"])
    tr, va = df.where("id % 3 <> 0"), df.where("id % 3 = 0")
    path, best, model = cost_complexity_prune(tr, va)
    p = path.toPandas()
    assert (np.diff(p.alpha) >= 0).all() and (np.diff(p.n_leaves) < 0).all()
    full = model.model.transform(va).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert p.valid_accuracy.iloc[0] == pytest.approx(full)
    at_best = p[p.alpha == best].iloc[-1]
    cut = model.transform(va).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert cut == pytest.approx(at_best.valid_accuracy) and model.n_leaves == at_best.n_leaves
    assert p.n_leaves.iloc[-1] == 1
    ytr = pdf[pdf.id % 3 != 0].label
    assert p.train_accuracy.iloc[-1] == pytest.approx(max(ytr.mean(), 1 - ytr.mean()))
    last = p.groupby("alpha").tail(1).reset_index(drop=True)
    assert best == last.alpha.iloc[int(last.valid_accuracy.to_numpy().argmax())]


def test_knn_and_silhouette_with_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(nb, "CHUNK_ROWS", 7)
    rng = np.random.default_rng(31)
    pts = rng.normal(size=(90, 4))
    lab = rng.integers(0, 3, 90)
    ids = list(range(90))
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "v": list(pts), "c": lab}), "id long, v array<double>, c long")
    got = nb.knn(df, None, 5, "v", "id", exclude_self=True, block_rows=40).toPandas()
    ref = _brute_knn(pts, ids, 5, True)
    for q, part in got.groupby("qid"):
        assert part.sort_values("rank").tid.tolist() == ref[q]
    s = nb.silhouette(df, "v", "c", "id", block_rows=40).first()["silhouette"]
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    vals = []
    for i in range(90):
        own = lab == lab[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        vals.append((b - a) / max(a, b))
    assert s == pytest.approx(np.mean(vals), rel=1e-9)


def test_backward_elimination_to_intercept_only(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.normal(size=200), "y": rng.normal(size=200)})
    log, final = rg.backward_elimination(spark.createDataFrame(pdf), "y", ["a", "b"], drops=["a", "b"])
    assert [r[1] for r in log] == ["a", "b"]
    assert final.xs == [] and final.params[0] == pytest.approx(pdf.y.mean())
    assert final.r2 == pytest.approx(0.0, abs=1e-12)


def test_wide_projection_is_one_function(spark):
    from tabstat.operators import matrix as mx

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 30))
    names = [f"c{j}" for j in range(30)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    pca = mx.pca_fit(df, names, k=25)
    odd = df.unionByName(df.limit(1).selectExpr("99L AS id", "CAST(NULL AS double) AS c0", *names[1:]))
    wide = pca.transform(odd, keep=["id"])
    assert len(wide._jdf.queryExecution().analyzed().toString()) < 20_000
    got = {r["id"]: r for r in wide.collect()}
    assert got[99].pc1 is None
    assert np.allclose([[got[i][f"pc{a + 1}"] for a in range(25)] for i in range(60)], (x - x.mean(0)) @ pca.components.T)
