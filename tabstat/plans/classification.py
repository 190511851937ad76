"""End-to-end classification comparison (the flagship query).

embeddings -> binary target -> stratified split -> standard scaling fitted
on train -> weighted logistic (plain and on PCA scores), trees (plain and
pruned), forest, boosting, kernel SVM with Platt scores, network and k-NN ->
one metrics row per model (accuracy, precision, recall, f1, specificity,
counts, exact ROC AUC) and one ROC table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabstat.operators import evaluate as ev
from tabstat.operators import features as fe
from tabstat.operators import matrix as mx
from tabstat.operators import models as md
from tabstat.operators import neighbors as nb
from tabstat.operators import sample as sm
from tabstat.operators.profile import class_weights, with_weight_column
from tabstat.operators.pruning import cost_complexity_prune
from tabstat.session import materialize
from tabstat.sources.io import read_table


def embedding_frame(spark: SparkSession, sf_dir: str, positive_class: int = 0) -> DataFrame:
    """(vec_id, binary label, embedding array<double>)."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", (F.col("label") == positive_class).cast("int").alias("label"),
                      F.col("embedding").cast("array<double>").alias("embedding")).na.drop()


def prepared(spark: SparkSession, sf_dir: str, seed: int = 1729):
    """Stratified 80/20 split, standard scaling fitted on train, vectors.

    Returns (train, test) with the scaled array plus their ML-vector forms
    (pinned: iterative fitters scan them many times) and the dimension.
    """
    frame = embedding_frame(spark, sf_dir)
    train, test = sm.stratified_split(frame, "vec_id", "label", 0.2, seed)
    scaler = fe.standard_fit_array(train, "embedding")
    tr, te = scaler.transform(train, "embedding"), scaler.transform(test, "embedding")
    # checkpoints cut the lineage of split and scaling: every later plan would
    # otherwise hold it again, and the driver keeps the plans
    tr = materialize(tr, "checkpoint")
    te = materialize(te, "checkpoint")
    tr_v = materialize(md.assemble(tr, "embedding", keep=["vec_id", "label"]), "persist")
    te_v = materialize(md.assemble(te, "embedding", keep=["vec_id", "label"]), "persist")
    dim = len(scaler.shift)
    return tr, te, tr_v, te_v, dim


#: Models that are fitted in a few passes; the others take dozens of jobs each.
QUICK = ("logistic", "tree", "forest", "knn")


def scored_models(spark: SparkSession, sf_dir: str, seed: int = 1729, only: tuple[str, ...] | None = None) -> DataFrame:
    """(model, vec_id, label, score, pred) of every model (or of ``only``
    those named) on the held-out rows.

    Classes are weighted (balanced; the positive class by n_neg / n_pos for
    boosting). Sizes below the operators' defaults, to keep the plan short:
    forest of 20 trees of depth 8, 10 boosting rounds, 64 random features.
    """
    tr, te, tr_v, te_v, dim = prepared(spark, sf_dir, seed)
    weights = {r["label"]: r for r in class_weights(tr_v, "label").collect()}  # two rows
    balanced = {k: r["balanced_weight"] for k, r in weights.items()}
    tr_w = materialize(with_weight_column(tr_v, "label", balanced, out="w"), "persist")
    wanted = lambda name: only is None or name in only
    out = []

    def add(name, pred, score="score"):
        narrow = pred.select(F.lit(name).alias("model"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
                             F.col(score).cast("double").alias("score"), F.col("prediction").cast("int").alias("pred"))
        # scored at once: no later plan holds this model, and the driver lets it go
        out.append(materialize(narrow, "checkpoint"))

    for name, fit in (
            ("logistic", lambda: md.logistic(tr_w, C=1.0, weight_col="w")),
            ("tree", lambda: md.decision_tree(tr_w, max_depth=5, weight_col="w")),
            ("forest", lambda: md.random_forest(tr_w, num_trees=20, max_depth=8, weight_col="w", seed=seed)),
            ("network", lambda: md.neural_net(tr_v, dim, max_iter=30, seed=seed))):
        if wanted(name):
            add(name, md.positive_probability(fit().transform(te_v)))
    if wanted("logistic_pca"):
        names = [f"e{i}" for i in range(dim)]
        spread = lambda d: d.select("vec_id", "label", *[F.col("embedding")[i].alias(c) for i, c in enumerate(names)])
        pca = mx.pca_fit(spread(tr), names, variance=0.95)
        scores = lambda d: materialize(md.assemble(pca.transform(spread(d), keep=["vec_id", "label"]), [f"pc{i + 1}" for i in range(pca.k)], keep=["vec_id", "label"]), "persist")
        tr_pc = materialize(with_weight_column(scores(tr), "label", balanced, out="w"), "persist")
        add("logistic_pca", md.positive_probability(md.logistic(tr_pc, C=1.0, weight_col="w").transform(scores(te))))
        tr_pc.unpersist()
    if wanted("boost"):
        ratio = weights[1]["pos_weight"] if 1 in weights else 1.0
        tr_p = materialize(with_weight_column(tr_v, "label", {0: 1.0, 1: ratio}, out="w"), "persist")
        add("boost", md.positive_probability(md.boosted_trees(tr_p, max_iter=10, weight_col="w", seed=seed).transform(te_v)))
        tr_p.unpersist()
    if wanted("svm_rbf"):
        kernel = md.kernel_map("rbf", dim, n_components=64, variance=md.mean_variance(tr_v), seed=seed)
        tr_k = materialize(kernel.transform(tr_w), "persist")
        svm = md.svm(tr_k, features="kfeatures", weight_col="w")
        add("svm_rbf", md.platt_scores(md.platt(svm, tr_k), svm.transform(kernel.transform(te_v))))
        tr_k.unpersist()
    if wanted("pruned_tree"):
        folds = sm.split_column(tr_v, "vec_id", 0.25, seed + 1, by=["label"])
        _, _, pruned = cost_complexity_prune(folds.where("split = 'train'").drop("split"), folds.where("split = 'test'").drop("split"))
        add("pruned_tree", pruned.transform(te_v))
    knn = nb.knn_classify(tr, te, 11, "embedding", "vec_id", "label", query_id="vec_id", positive=1)
    truth = te.select(F.col("vec_id").cast("long").alias("qid"), "label")
    add("knn", knn.join(truth, "qid").select(F.col("qid").alias("vec_id"), "label", F.col("prob").alias("score"), (F.col("prob") > 0.5).cast("int").alias("prediction")))
    scored = out[0]
    for frame in out[1:]:
        scored = scored.unionByName(frame)
    return materialize(scored, "persist")  # narrow rows, read by every metric


def compare_models_query(spark: SparkSession, sf_dir: str, seed: int = 1729, only: tuple[str, ...] | None = None) -> DataFrame:
    """E6 end to end: one row per model with metrics and AUC."""
    return ev.compare_scored(scored_models(spark, sf_dir, seed, only))


def compare_roc_query(spark: SparkSession, sf_dir: str, seed: int = 1729) -> DataFrame:
    """E6 end to end: all ROC curves and the chance line in one table."""
    return ev.roc_long(scored_models(spark, sf_dir, seed))
