"""Properties of the model layer on separable data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabstat.operators import evaluate as ev
from tabstat.operators import models as md
from tabstat.operators import sample as sm
from tabstat.operators.profile import with_weight_column


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.2 * rng.normal(size=400) > 0.4).astype(int)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(id=range(400), label=y)
    return md.assemble(spark.createDataFrame(pdf), list("abcd"), keep=["id", "label"]).cache()


def accuracy(pred):
    return pred.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def majority(df):
    share = df.agg(F.avg("label")).first()[0]
    return max(share, 1 - share)


@pytest.mark.parametrize("fit", [
    md.logistic, md.decision_tree, lambda d: md.random_forest(d, num_trees=10, max_depth=5), lambda d: md.boosted_trees(d, max_iter=5),
    md.svm, lambda d: md.neural_net(d, 4, max_iter=40)], ids=["logistic", "tree", "forest", "boost", "svm", "network"])
def test_beats_majority_and_repeats(frame, fit):
    train, test = frame.where("id % 4 > 0"), frame.where("id % 4 = 0")
    first = fit(train).transform(test)
    assert accuracy(first) > majority(test) + 0.1
    again = fit(train).transform(test)
    key = [r.prediction for r in first.orderBy("id").collect()]
    assert key == [r.prediction for r in again.orderBy("id").collect()]


def test_l1_is_sparser(frame):
    l1, l2 = (md.logistic(frame, C=0.02, penalty=p).coefficients.toArray() for p in ("l1", "l2"))
    assert (np.abs(l1) < 1e-9).sum() > (np.abs(l2) < 1e-9).sum()


def test_logistic_gradient_is_small(frame):
    m = md.logistic(frame, C=1.0, max_iter=200)
    rows = frame.collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r.label for r in rows])
    p = 1 / (1 + np.exp(-(x @ m.coefficients.toArray() + m.intercept)))
    assert np.abs(x.T @ (p - y) + m.coefficients.toArray()).max() < 0.3


def test_weights_move_the_forest(frame):
    plain = md.random_forest(frame, num_trees=8, max_depth=3).transform(frame)
    heavy = md.random_forest(with_weight_column(frame, "label", {0: 1.0, 1: 30.0}, out="w"), num_trees=8, max_depth=3, weight_col="w").transform(frame)
    count = lambda d: d.where("prediction = 1").count()
    assert count(heavy) > count(plain)


def test_platt_scores_are_calibrated(frame):
    m = md.svm(frame)
    scored = md.platt_scores(md.platt(m, frame), m.transform(frame))
    mean = scored.agg(F.avg("score"), F.avg("label")).first()
    assert mean[0] == pytest.approx(mean[1], abs=0.01) and ev.roc_auc(scored, "label", "score") > 0.95


def test_grid_and_folds(frame):
    folded = sm.stratified_folds(frame, "id", "label", k=3).cache()
    per = folded.groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in per if r.label == label]
        assert len(counts) == 3 and max(counts) - min(counts) <= 1
    from pyspark.ml.classification import LogisticRegression

    est = LogisticRegression(standardization=False)
    _, best, score, points = md.grid_search(est, {"regParam": [0.01, 0.01, 5.0]}, folded)
    means = [s for _, s in points]
    assert means[0] == means[1] and score == max(means) and best == points[int(np.argmax(means))][0]
    by_hand = []
    for f in range(3):
        fit = md.logistic(folded.where(F.col("fold") != f))
        by_hand.append(accuracy(fit.transform(folded.where(F.col("fold") == f))))
    assert [a for _, a in md.cross_validate(md.logistic, folded)] == pytest.approx(by_hand)


def test_stratified_split_sizes(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    train, test = sm.stratified_split(df, "k", "y", 0.25)
    assert test.where("y = 1").count() == 25 and test.count() == 250 and train.count() == 750
    assert train.join(test, "k").count() == 0


def test_kmeans_finds_planted_centres(spark):
    rng = np.random.default_rng(9)
    centres = np.array([[0, 0], [10, 0], [0, 10]], float)
    x = np.vstack([c + 0.3 * rng.normal(size=(60, 2)) for c in centres])
    df = md.assemble(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=range(180))), ["a", "b"], keep=["id"]).cache()
    found = np.array(sorted(map(tuple, md.kmeans(df, 3).clusterCenters())))
    assert np.abs(found - np.array(sorted(map(tuple, centres)))).max() < 0.3
    curve = md.elbow_curve(df, (2, 3, 4), silhouette=True)
    assert curve[0][1] > curve[1][1] and max(curve, key=lambda r: r[2])[0] == 3


def test_importance_finds_the_signal(frame):
    assert md.tree_ensemble_importance(frame, list("abcd"), num_trees=10, max_depth=5)[0][0] == "a"


def test_learning_curve_rows(frame):
    rows = md.learning_curve(frame.where("id % 4 > 0"), frame.where("id % 4 = 0"), 4, epochs=(2, 20))
    assert [(r[0], r[1]) for r in rows] == [(2, "train"), (2, "valid"), (20, "train"), (20, "valid")]
    assert rows[2][3] < rows[0][3]
