"""Registry entries: MLlib models, grid search, cross-validation, k-means
(G1-G10, H1-H2, U1-U2) on the embeddings table (rows-only checks; the property
checks are in tests/test_models.py)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabstat.operators import boost as bo
from tabstat.operators import evaluate as ev
from tabstat.operators import grid as gr
from tabstat.operators import models as md
from tabstat.operators import network as nw
from tabstat.operators import sample as sm
from tabstat.operators import trees as tg
from tabstat.operators.features import melt
from tabstat.operators.profile import class_weights, with_weight_column
from tabstat.operators.rank import global_rank
from tabstat.plans.classification import compare_models_query, compare_roc_query, prepared
from tabstat.plans.registry import query
from tabstat.session import materialize


def _metrics(pred, name):
    return ev.classification_metrics(md.positive_probability(pred).withColumn(
        "pred", F.col("prediction").cast("int")), "label", "pred", model=name)


@query("model_comparison")
def q_model_comparison(spark, sf):
    """Flagship: nine weighted models compared on held-out rows."""
    return compare_models_query(spark, sf)


@query("model_roc")
def q_model_roc(spark, sf):
    """The ROC curves of the flagship's models and the chance line."""
    return compare_roc_query(spark, sf)


@query("logistic")
def q_logistic(spark, sf):
    _, _, tr, te, _ = prepared(spark, sf)
    l2 = md.logistic(tr, C=1.0, penalty="l2")
    l1 = md.logistic(tr, C=1.0, penalty="l1")
    return _metrics(l2.transform(te), "logistic_l2").unionByName(_metrics(l1.transform(te), "logistic_l1"))


@query("tree")
def q_tree(spark, sf):
    _, _, tr, te, _ = prepared(spark, sf)
    w = tr.withColumn("w", F.when(F.col("label") == 1, 7.0).otherwise(3.0))
    m = md.decision_tree(w, weight_col="w")
    return _metrics(m.transform(te), "tree_full").unionByName(_metrics(m.transform(tr), "tree_full_train"))


@query("forest")
def q_forest(spark, sf):
    """G6 with balanced class weights; 30 trees of depth 10 instead of the
    default 100 of depth 30, to keep the query short."""
    _, _, tr, te, _ = prepared(spark, sf)
    tr = with_weight_column(tr, "label", "balanced", out="w")
    return _metrics(md.random_forest(tr, num_trees=30, max_depth=10, weight_col="w").transform(te), "forest")


@query("boost")
def q_boost(spark, sf):
    """G7 with the positive class weighted by n_neg / n_pos; 20 rounds instead
    of the default 50, to keep the query short."""
    _, _, tr, te, _ = prepared(spark, sf)
    ratio = class_weights(tr, "label").where("label = 1").first()["pos_weight"]
    tr = with_weight_column(tr, "label", {0: 1.0, 1: ratio}, out="w")
    return _metrics(md.boosted_trees(tr, max_iter=20, max_depth=3, weight_col="w").transform(te), "gbt")


@query("second_order_boost")
def q_second_order_boost(spark, sf):
    """G7, second order: 50 rounds of depth 3 with row and column sampling, the
    positive class weighted by n_neg / n_pos."""
    _, _, tr, te, _ = prepared(spark, sf)
    ratio = class_weights(tr, "label").where("label = 1").first()["pos_weight"]
    model = bo.boosted_trees(tr, rounds=50, max_depth=3, subsample=0.8, colsample=0.8, pos_weight=float(ratio))
    return ev.classification_metrics(ev.apply_threshold(model.score(te), "score", 0.5), "label", "pred", model="second_order_boost")


@query("svm")
def q_svm(spark, sf):
    """Linear, rbf and cubic kernels with balanced weights and Platt scores
    (64 random features; a tensor sketch of 256 columns, as the 64 components
    have 45,760 monomials)."""
    _, _, tr, te, dim = prepared(spark, sf)
    tr = with_weight_column(tr, "label", "balanced", out="w")
    rows = None
    variance = md.mean_variance(tr)
    for kind, width in (("linear", 0), ("rbf", 64), ("poly_sketch", 256)):
        km = md.kernel_map(kind, dim, gamma="scale", n_components=width, variance=variance)
        ktr, kte = km.transform(tr), km.transform(te)
        ktr = materialize(ktr, "persist")  # the optimiser scans it every iteration
        m = md.svm(ktr, features="kfeatures", C=1.0, weight_col="w")
        scored = md.platt_scores(md.platt(m, ktr), m.transform(kte))
        r = ev.classification_metrics(ev.apply_threshold(scored, "score", 0.5), "label", "pred", model=f"svm_{kind.removesuffix('_sketch')}")
        rows = r if rows is None else rows.unionByName(r)
    return rows


@query("poly_kernel_error")
def q_poly_kernel_error(spark, sf):
    """How far tensor sketches of rising width are from the cubic kernel,
    over every embedding and the one after it in order of vec_id: the root mean
    square error as a share of the kernel's scale, sqrt(k(x, x) k(y, y))."""
    tr, te, _, _, dim = prepared(spark, sf)
    both = md.assemble(tr.unionByName(te), "embedding", keep=["vec_id"])
    ranked = global_rank(both, ["vec_id"], rank_col="_r")
    maps = {width: md.kernel_map("poly_sketch", dim, gamma="auto", n_components=width) for width in (128, 512, 2048)}
    for width, km in maps.items():
        ranked = km.transform(ranked, out=f"z{width}").withColumn(f"z{width}", vector_to_array(f"z{width}"))
    ranked = materialize(ranked.withColumn("x", vector_to_array("features")).drop("features"), "checkpoint")
    after = ranked.select((F.col("_r") - 1).alias("_r"), *(F.col(c).alias(f"{c}_next") for c in ranked.columns if c not in ("_r", "vec_id")))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    def cubic(a, b):
        return F.pow(dot(a, b) / dim, 3)

    pairs = ranked.join(after, "_r")
    scale = F.sqrt(cubic("x", "x") * cubic("x_next", "x_next"))
    errors = [F.sqrt(F.avg(F.pow((dot(f"z{w}", f"z{w}_next") - cubic("x", "x_next")) / scale, 2))).alias(f"sketch_{w}") for w in maps]
    return melt(pairs.agg(F.count(F.lit(1)).alias("pairs"), *errors), ["pairs"], [f"sketch_{w}" for w in maps], "kernel", "rms_error")


@query("svm_grid")
def q_svm_grid(spark, sf):
    """C x kernel x gamma with balanced weights, five folds, all values of C
    and all folds of a kernel in shared scans."""
    _, _, tr, _, dim = prepared(spark, sf)
    folded = materialize(sm.stratified_folds(tr, "vec_id", "label", k=5), "persist")
    weights = {r["label"]: r["balanced_weight"] for r in class_weights(folded, "label").collect()}
    grid = gr.svm_grid(folded, {"C": [0.1, 1.0, 10.0], "kernel": ["linear", "rbf", "poly"], "gamma": ["scale", "auto"]}, dim, class_weight=weights)
    return gr.svm_table(spark, grid)


@query("mlp")
def q_mlp(spark, sf):
    _, _, tr, te, dim = prepared(spark, sf)
    m = md.neural_net(tr, dim, max_iter=50)
    p = md.positive_probability(m.transform(te))
    return ev.classification_metrics(ev.apply_threshold(p, "score", 0.4), "label", "pred", model="mlp")


@query("learning_curve")
def q_learning_curve(spark, sf):
    _, _, tr, te, dim = prepared(spark, sf)
    rows = md.learning_curve(tr, te, dim)
    return spark.createDataFrame(rows, "epochs int, dataset string, accuracy double, loss double")


@query("network")
def q_network(spark, sf):
    """G9 by Adam, ReLU and dropout: 50 epochs of 4 batches, label at p > 0.4;
    one network without each of five folds and one of all rows, trained in the
    same jobs, each measured on rows it has not seen."""
    _, _, tr, te, _ = prepared(spark, sf)
    folded = sm.stratified_folds(tr, "vec_id", "label", k=5)
    folded = materialize(folded, "persist")
    nets = nw.fit(folded, "vec_id", epochs=50, steps=4, learning_rate=5e-3, fold="fold")
    rows = None
    for fold, net in nets.items():
        unseen, name = (te, "network") if fold is None else (folded.where(F.col("fold") == fold), f"network_fold_{fold}")
        r = ev.classification_metrics(ev.apply_threshold(net.score(unseen), "score", 0.4), "label", "pred", model=name)
        rows = r if rows is None else rows.unionByName(r)
    return rows


@query("network_curve")
def q_network_curve(spark, sf):
    """Loss and accuracy after each of 50 epochs on 80 % of the training
    rows, on the other 20 % and on the test rows."""
    _, _, tr, te, _ = prepared(spark, sf)
    fit, valid = sm.stratified_split(tr, "vec_id", "label", 0.2, 17)
    net = nw.fit(fit, "vec_id", epochs=50, steps=4, learning_rate=5e-3)[None]
    return nw.learning_curve(net, {"train": fit, "valid": valid, "test": te})


@query("kmeans")
def q_kmeans(spark, sf):
    _, _, tr, te, _ = prepared(spark, sf)
    m = md.kmeans(tr, 4, seed=1730)
    return m.transform(te).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query("elbow")
def q_elbow(spark, sf):
    """U2 with the squared-Euclidean silhouette of every k."""
    _, _, tr, _, _ = prepared(spark, sf)
    return spark.createDataFrame(md.elbow_curve(tr, range(2, 10), silhouette=True), "k int, wcss double, silhouette double")


@query("grid_search")
def q_grid_search(spark, sf):
    """H1: 6 of the 60 logistic points a full search would take."""
    _, _, tr, _, _ = prepared(spark, sf)
    folded = sm.stratified_folds(tr, "vec_id", "label", k=5)
    from pyspark.ml.classification import LogisticRegression
    est = LogisticRegression(featuresCol="features", labelCol="label", standardization=False)
    _, best, score, allp = md.grid_search(est, {"regParam": [0.001, 0.01, 0.1], "elasticNetParam": [0.0, 1.0]},
                                          folded, fold_col="fold")
    return spark.createDataFrame([(str(p), float(s), p == best) for p, s in allp],
                                 "params string, cv_accuracy double, best boolean")


#: The logistic grid of the reference, 60 points.
LOGISTIC_GRID = {
    "penalty": ["l1", "l2"],
    "C": [0.001, 0.01, 0.1, 1, 10],
    "max_iter": [100, 300, 500],
    "class_weight": [{0: 0.1, 1: 0.9}, {0: 0.3, 1: 0.7}],
}


@query("logistic_grid")
def q_logistic_grid(spark, sf):
    """H1 in full: 60 logistic points x 5 folds in shared scans."""
    _, _, tr, _, _ = prepared(spark, sf)
    folded = sm.stratified_folds(tr, "vec_id", "label", k=5)
    return gr.grid_table(spark, gr.logistic_grid(folded, LOGISTIC_GRID))


#: The grid of the reference's pre-pruned tree, 1,440 points.
TREE_GRID = {
    "max_depth": [5, 10, 15, 20],
    "min_samples_split": [2, 6, 8, 10, 20],
    "min_samples_leaf": [5, 10, 15],
    "max_features": ["sqrt", "log2"],
    "splitter": ["best", "random"],
    "criterion": ["gini", "entropy"],
    "class_weight": [{0: 3, 1: 7}, {0: 4, 1: 6}, {0: 1, 1: 9}],
}


@query("tree_grid")
def q_tree_grid(spark, sf):
    """G4 in full: 1,440 points x 5 folds from 432 trees grown in shared passes."""
    _, _, tr, _, _ = prepared(spark, sf)
    folded = sm.stratified_folds(tr, "vec_id", "label", k=5)
    points, mean, best, _ = tg.pre_pruned_grid(folded, TREE_GRID)
    rows = [(i, *(str(p[k]) for k in TREE_GRID), float(mean[i]), i == best) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "point int, " + ", ".join(f"{k} string" for k in TREE_GRID) + ", cv_accuracy double, best boolean")


@query("extra_trees")
def q_extra_trees(spark, sf):
    """G3 as specified: 100 extremely randomised trees, classes weighted 3:7."""
    _, _, tr, _, dim = prepared(spark, sf)
    rows = tg.extra_trees_importance(tr, [f"e{i}" for i in range(dim)], weights=(3.0, 7.0))
    return spark.createDataFrame(rows, "feature string, importance double")


@query("cross_validate")
def q_cross_validate(spark, sf):
    _, _, tr, _, _ = prepared(spark, sf)
    folded = sm.stratified_folds(tr, "vec_id", "label", k=5).cache()
    res = md.cross_validate(lambda d: md.logistic(d, C=1.0), folded, k=5)
    return spark.createDataFrame(res, "fold int, accuracy double")


@query("tree_importance")
def q_tree_importance(spark, sf):
    """G3 with 20 trees instead of the default 100, to keep the query short."""
    _, _, tr, _, dim = prepared(spark, sf)
    return spark.createDataFrame(md.tree_ensemble_importance(tr, [f"e{i}" for i in range(dim)], num_trees=20),
                                 "feature string, importance double")


@query("pruned_tree")
def q_pruned_tree(spark, sf):
    """α path of one fully grown tree scored on train and held-out rows."""
    from tabstat.operators.pruning import cost_complexity_prune

    _, _, tr, te, _ = prepared(spark, sf)
    path, _, _ = cost_complexity_prune(tr, te)
    return path


@query("pruned_tree_metrics")
def q_pruned_tree_metrics(spark, sf):
    """The tree cut back at the best α, scored on the held-out rows."""
    from tabstat.operators.pruning import cost_complexity_prune

    _, _, tr, te, _ = prepared(spark, sf)
    _, _, tree = cost_complexity_prune(tr, te)
    pred = tree.transform(te).withColumn("pred", F.col("prediction").cast("int"))
    return ev.classification_metrics(pred, "label", "pred", model="pruned_tree")


@query("pre_pruned_tree")
def q_pre_pruned_tree(spark, sf):
    """8 points of the default grid of 48, with two weightings."""
    _, _, tr, _, _ = prepared(spark, sf)
    folded = sm.stratified_folds(tr, "vec_id", "label", k=5).cache()
    _, best, _, allp = md.pre_pruned_tree_search(folded, max_depth=(3, 6), min_instances=(5,),
                                                 max_features=("all", "sqrt"), impurity=("gini",),
                                                 weights={"none": None, "3:7": {0: 3.0, 1: 7.0}})
    return spark.createDataFrame([(str(p), float(s), p == best) for p, s in allp],
                                 "params string, cv_accuracy double, best boolean")
