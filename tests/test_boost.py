"""Second-order boosting against numpy and against MLlib's boosting."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabstat.operators import boost as bo
from tabstat.operators import trees as tr


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(300, 4)), 2)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(300) < 0.1)).astype(int)
    df = spark.createDataFrame([([float(a) for a in v], int(t)) for v, t in zip(x, y)], "x array<double>, label int").withColumn("features", array_to_vector("x"))
    return df.repartition(4).cache(), x, y


def brute(x, y, edges, rounds, depth, rate, lam, pos):
    """(tree, feature, threshold, gain) in the order of nodes, and margins."""
    m, out = np.zeros(len(x)), []
    for t in range(rounds):
        p = 1 / (1 + np.exp(-m))
        w = np.where(y == 1, pos, 1.0)
        g, h = w * (p - y), w * p * (1 - p)
        level, step = [np.arange(len(x))], np.zeros(len(x))
        for k in range(depth + 1):
            new = []
            for own in level:
                step[own] = -rate * g[own].sum() / (h[own].sum() + lam)
                best = (1e-12, None, None)
                for f in range(x.shape[1]) if k < depth else ():
                    for c in edges[f][np.isfinite(edges[f])]:
                        a, b = own[x[own, f] <= c], own[x[own, f] > c]
                        if min(h[a].sum(), h[b].sum()) < 1:
                            continue
                        score = lambda s: g[s].sum() ** 2 / (h[s].sum() + lam)
                        gain = 0.5 * (score(a) + score(b) - score(own))
                        if gain > best[0] + 1e-12:
                            best = (gain, f, c, a, b)
                if best[1] is not None:
                    out.append((t, best[1], best[2], best[0]))
                    new += best[3:]
            level = new
        m = m + step
    return out, m


def test_gains_and_scores_equal_numpy(spark, data):
    df, x, y = data
    model = bo.boosted_trees(df, rounds=3, max_depth=3, learning_rate=0.3, pos_weight=1.5, features="x", bins=16)
    edges = tr.bin_edges(df.select("x"), 4, 16)
    want, margin = brute(x, y, edges, 3, 3, 0.3, 1.0, 1.5)
    assert [(t, f) for t, _, f, _, _ in model.gains] == [(t, f) for t, f, _, _ in want]
    assert [g for *_, g in model.gains] == pytest.approx([g for *_, g in want]) and [c for _, _, _, c, _ in model.gains] == pytest.approx([c for _, _, c, _ in want])
    assert bo._margin(x, model.trees) == pytest.approx(margin)
    rows = model.score(df.unionByName(spark.createDataFrame([(None, 1, None)], df.schema)), "x").collect()
    assert [r.score for r in rows if r.x is None] == [None]
    assert {tuple(r.x): r.score for r in rows if r.x} == pytest.approx({tuple(map(float, v)): 1 / (1 + np.exp(-a)) for v, a in zip(x, margin)})


def loss(rows, score):
    p = F.greatest(F.least(score, F.lit(1 - 1e-12)), F.lit(1e-12))
    return rows.agg(F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]


def test_mean_loss_is_not_above_first_order_boosting(spark):
    """Equal rounds, full steps (MLlib never shrinks its first tree) and no
    limit on leaves in either, over three tables."""
    ours, other = [], []
    for seed in (1, 2, 3):
        rng = np.random.default_rng(seed)
        x = np.round(rng.normal(size=(600, 4)), 2)
        y = (rng.random(600) < 1 / (1 + np.exp(-(3 * np.sin(2 * x[:, 0]) + x[:, 1] ** 2 - 1)))).astype(int)
        df = spark.createDataFrame([([float(a) for a in v], int(t)) for v, t in zip(x, y)], "x array<double>, label int").withColumn("features", array_to_vector("x")).cache()
        model = bo.boosted_trees(df, rounds=10, max_depth=3, learning_rate=1.0, features="x", reg_lambda=0.01, min_child=0.0, bins=32)
        ours.append(loss(model.score(df), F.col("score")))
        other.append(loss(GBTClassifier(maxIter=10, maxDepth=3, stepSize=1.0, seed=1).fit(df).transform(df), vector_to_array("probability")[1]))
    assert np.mean(ours) <= np.mean(other) and all(a <= 1.05 * b for a, b in zip(ours, other))


def test_pinned_margins_change_nothing(data, monkeypatch):
    df, x, _ = data
    a = bo.boosted_trees(df, rounds=4, max_depth=2, features="x")
    monkeypatch.setattr(bo, "PIN", 2)
    b = bo.boosted_trees(df, rounds=4, max_depth=2, features="x")
    assert bo._margin(x, a.trees) == pytest.approx(bo._margin(x, b.trees))


def test_sampling_is_by_hash(data):
    df = data[0]
    kw = dict(rounds=2, max_depth=2, subsample=0.6, colsample=0.5, features="x")
    a, b = (bo.boosted_trees(df.repartition(n), **kw) for n in (1, 5))
    assert [g[:4] for g in a.gains] == [g[:4] for g in b.gains] and len({f for t, _, f, _, _ in a.gains if t == 0}) <= 2
    assert a.importance(4).sum() == pytest.approx(1.0)
    whole = bo.boosted_trees(df, rounds=2, max_depth=2, features="x")
    assert [g[4] for g in whole.gains][:1] != [g[4] for g in a.gains][:1]


def test_one_class_and_empty(spark):
    one = spark.createDataFrame([([1.0], 1), ([2.0], 1), (None, 0), ([3.0], None)], "x array<double>, label int")
    model = bo.boosted_trees(one, rounds=2, features="x")
    assert model.trees == [] and {r.score for r in model.score(one.where("x is not null"), "x").collect()} == {0.5}
    assert bo.boosted_trees(one.limit(0), rounds=2, features="x").trees == []
