"""Minimal cost-complexity pruning of one fitted tree, no refits.

1. Fit one fully grown tree (MLlib, depth <= 30) with ``leafCol``.
2. Read its node table (id, impurity, impurityStats, children) from the
   saved model in the shared checkpoint folder.
3. Weakest-link path on that node table: R(t) = impurity(t)·w_t/W, prune
   the internal node with the smallest g(t) = (R(t) - R(T_t))/(|T_t| - 1)
   until only the root is left (α made non-decreasing).
4. Score every α on train and validation from per-(leaf, label) counts (one
   grouped aggregate per frame): a leaf's rows are predicted by the majority
   class of its highest pruned ancestor.

The counts tables have (#leaves × #classes) rows; the node table has the
size of the model, which MLlib already keeps on the driver.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.operators.models import decision_tree
from tabstat.session import checkpoint_dir, remove_path


@dataclass
class TreeTable:
    ids: np.ndarray          # node ids (pre-order)
    left: np.ndarray         # child index into arrays, -1 for leaves
    right: np.ndarray
    parent: np.ndarray
    stats: np.ndarray        # (nodes, classes) weighted class counts
    impurity: np.ndarray
    leaf_order: list         # node index of the i-th leaf (left-first DFS)


def tree_table(model, spark) -> TreeTable:
    """Node table of a fitted MLlib tree via its saved (parquet) form."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "id", "impurity", "impurityStats", "leftChild", "rightChild").orderBy("id").toPandas()
    remove_path(spark, path)
    pos = {int(i): k for k, i in enumerate(nodes["id"])}
    left = np.array([pos.get(int(c), -1) if c >= 0 else -1 for c in nodes["leftChild"]])
    right = np.array([pos.get(int(c), -1) if c >= 0 else -1 for c in nodes["rightChild"]])
    parent = np.full(len(nodes), -1)
    for k in range(len(nodes)):
        for c in (left[k], right[k]):
            if c >= 0:
                parent[c] = k
    stats = np.vstack([np.asarray(s, dtype=float) for s in nodes["impurityStats"]])
    root = int(np.nonzero(parent < 0)[0][0])
    order, stack = [], [root]
    while stack:
        k = stack.pop()
        if left[k] < 0:
            order.append(k)
        else:
            stack.append(right[k])
            stack.append(left[k])
    return TreeTable(nodes["id"].to_numpy(), left, right, parent, stats, nodes["impurity"].to_numpy(float), order)


def _leaf_counts(pred: DataFrame, label: str, n_classes: int) -> np.ndarray:
    rows = pred.groupBy("leaf", label).agg(F.count(F.lit(1)).alias("n")).collect()
    nleaf = max([int(r["leaf"]) for r in rows], default=-1) + 1
    out = np.zeros((nleaf, n_classes))
    for r in rows:
        out[int(r["leaf"]), int(r[label])] += r["n"]
    return out


def pruning_path(t: TreeTable, counts: dict[str, np.ndarray], order_out: list | None = None) -> pd.DataFrame:
    """α path with leaf counts, total leaf impurity and accuracy per frame.

    ``order_out`` receives the pruned nodes in order, one for each row after
    the first.
    """
    n = len(t.ids)
    w = t.stats.sum(1)
    W = w[t.parent < 0].sum()
    r_node = t.impurity * w / W
    is_leaf = t.left < 0
    pred = np.argmax(t.stats, axis=1)  # ties -> smaller class index
    # per-node class counts of each evaluated frame (bottom-up sums)
    node_counts = {}
    for name, leafc in counts.items():
        nc = np.zeros((n, t.stats.shape[1]))
        for i, k in enumerate(t.leaf_order):
            if i < leafc.shape[0]:
                nc[k] = leafc[i]
        post = []
        stack = [int(np.nonzero(t.parent < 0)[0][0])]
        while stack:
            k = stack.pop()
            post.append(k)
            if not is_leaf[k]:
                stack += [t.left[k], t.right[k]]
        for k in reversed(post):
            if not is_leaf[k]:
                nc[k] = nc[t.left[k]] + nc[t.right[k]]
        node_counts[name] = nc
    correct_at = {name: nc[np.arange(n), pred] for name, nc in node_counts.items()}
    totals = {name: nc[np.nonzero(t.parent < 0)[0][0]].sum() for name, nc in node_counts.items()}
    # subtree aggregates of the current tree
    r_branch = np.where(is_leaf, r_node, 0.0)
    n_leaves = np.where(is_leaf, 1, 0)
    cur_correct = {name: np.where(is_leaf, c, 0.0) for name, c in correct_at.items()}
    order = []
    stack = [int(np.nonzero(t.parent < 0)[0][0])]
    while stack:
        k = stack.pop()
        order.append(k)
        if not is_leaf[k]:
            stack += [t.left[k], t.right[k]]
    for k in reversed(order):
        if not is_leaf[k]:
            r_branch[k] = r_branch[t.left[k]] + r_branch[t.right[k]]
            n_leaves[k] = n_leaves[t.left[k]] + n_leaves[t.right[k]]
            for name in cur_correct:
                cur_correct[name][k] = cur_correct[name][t.left[k]] + cur_correct[name][t.right[k]]
    root = int(np.nonzero(t.parent < 0)[0][0])
    in_tree = np.ones(n, dtype=bool)
    internal = ~is_leaf
    pruned = [] if order_out is None else order_out
    rows = []

    def record(alpha):
        row = {"step": len(rows), "alpha": float(alpha), "n_leaves": int(n_leaves[root]),
               "impurity": float(r_branch[root])}
        for name in cur_correct:
            row[f"{name}_accuracy"] = float(cur_correct[name][root] / totals[name]) if totals[name] else float("nan")
        rows.append(row)

    record(0.0)

    def gain(k):
        return float((r_node[k] - r_branch[k]) / (n_leaves[k] - 1))

    # weakest links first; an entry counts only while its node's gain stands
    weakest = [(gain(k), int(k)) for k in np.nonzero(internal)[0]]
    heapq.heapify(weakest)
    prev = 0.0
    while internal[root]:
        g, j = heapq.heappop(weakest)
        if not (internal[j] and in_tree[j]) or g != gain(j):
            continue
        alpha = max(prev, g)
        # prune j: its subtree leaves the tree, j becomes a leaf
        stack = [j]
        while stack:
            k = stack.pop()
            if internal[k]:
                for c in (t.left[k], t.right[k]):
                    in_tree[c] = False
                    stack.append(c)
        d_r = r_node[j] - r_branch[j]
        d_n = n_leaves[j] - 1
        d_c = {name: correct_at[name][j] - cur_correct[name][j] for name in cur_correct}
        internal[j] = False
        r_branch[j], n_leaves[j] = r_node[j], 1
        for name in cur_correct:
            cur_correct[name][j] = correct_at[name][j]
        a = t.parent[j]
        while a >= 0:
            r_branch[a] += d_r
            n_leaves[a] -= d_n
            for name in cur_correct:
                cur_correct[name][a] += d_c[name]
            heapq.heappush(weakest, (gain(a), int(a)))
            a = t.parent[a]
        pruned.append(j)
        prev = alpha
        record(alpha)
    return pd.DataFrame(rows)


@dataclass
class PrunedTree:
    """A fitted tree cut back at one α: the leaves of the full tree vote as
    the node they were pruned to."""

    model: object
    alpha: float
    n_leaves: int
    prediction: list     # class of each leaf of the full tree
    probability: list    # class shares of each leaf of the full tree

    def transform(self, df: DataFrame, prediction: str = "prediction", probability: str = "score") -> DataFrame:
        """Adds the class and the share of the highest class."""
        out = self.model.transform(df.drop(prediction))
        keep = [c for c in df.columns if c not in (prediction, probability)]
        # a table of the leaves: as literals they would be a node each of every later plan
        leaves = df.sparkSession.createDataFrame(pd.DataFrame({"_at": np.arange(len(self.prediction), dtype=float), "_p": np.asarray(self.prediction, float),
                                                               "_s": np.array([p[-1] for p in self.probability], float)}))
        return out.join(F.broadcast(leaves), F.col("leaf") == F.col("_at"), "left").select(*keep, F.col("_p").alias(prediction), F.col("_s").alias(probability))


def pruned_tree(model, t: TreeTable, pruned: list[int], alpha: float) -> PrunedTree:
    """The tree after the given nodes became leaves."""
    cut = set(pruned)
    ends = []
    for k in t.leaf_order:
        top, a = k, k
        while a >= 0:
            if a in cut:
                top = a
            a = t.parent[a]
        ends.append(int(top))
    share = t.stats / np.maximum(t.stats.sum(1, keepdims=True), 1e-300)
    return PrunedTree(model, float(alpha), len(set(ends)), [float(np.argmax(t.stats[e])) for e in ends], [share[e].tolist() for e in ends])


def cost_complexity_prune(train: DataFrame, valid: DataFrame, label: str = "label", features: str = "features",
                          n_classes: int = 2, max_depth: int = 30, weight_col: str | None = None, seed: int = 1729):
    """Fit once, return (path DataFrame, best α, pruned tree).

    Several links may go at one α; the tree at that α is the one after all of
    them. Best α = the first α with the highest validation accuracy.
    """
    model = decision_tree(train, label, features, max_depth=max_depth, weight_col=weight_col, seed=seed)
    model.setLeafCol("leaf")
    t = tree_table(model, train.sparkSession)
    counts = {"train": _leaf_counts(model.transform(train), label, n_classes),
              "valid": _leaf_counts(model.transform(valid), label, n_classes)}
    order: list[int] = []
    path = pruning_path(t, counts, order)
    last = path.groupby("alpha", sort=True)["step"].max().to_numpy()
    best = int(last[path["valid_accuracy"].to_numpy()[last].argmax()])
    alpha = float(path["alpha"].iloc[best])
    sdf = train.sparkSession.createDataFrame(path)
    return sdf, alpha, pruned_tree(model, t, order[:best], alpha)
