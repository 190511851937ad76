"""Second-order gradient boosting of trees for a 0/1 label.

Each tree is grown level by level. A pass over the rows adds up gradient and
hessian of the logistic loss (the positive class weighted by ``pos_weight``) for
every open node, drawn feature and bin; the tasks' sums are added per node on
the executors, which also pick the split of largest regularised gain

    1/2 (GL²/(HL + λ) + GR²/(HR + λ) - G²/(H + λ)) - γ

and the leaves' values -G/(H + λ), shrunk by the learning rate. The driver
receives one row per node. Rows carry their margin; it is brought up to date
and checkpointed every ``PIN`` trees, in between a pass walks the trees since.
Row and column sampling are hashes of (seed, tree, row or feature), so the
result does not depend on partitioning, except for the rounding of sums.

Rows with a null label or feature take no part; without rows of both labels the
model has no trees and scores 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.operators.trees import _sum, _walk, bin_edges, draw
from tabstat.session import materialize, ship_package

PIN = 20


@dataclass
class Boosted:
    """Trees as (feature, threshold, left, right, value) arrays; feature is -1
    at a leaf. ``gains`` has (tree, node, feature, threshold, gain)."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    gains: list[tuple[int, int, int, float, float]] = field(default_factory=list)

    def score(self, df: DataFrame, features: str = "features", out: str = "score") -> DataFrame:
        """Adds the probability of label 1 (null for a null feature vector)."""
        trees = self.trees

        @F.pandas_udf("double")
        def probability(v: pd.Series) -> pd.Series:
            done = pd.Series(np.nan, index=v.index, dtype=float)
            known = v.notna()
            if known.any():
                done[known] = 1 / (1 + np.exp(-_margin(np.vstack(v[known].to_numpy()), trees)))
            return done

        x = F.col(features)
        if not dict(df.dtypes)[features].startswith("array"):
            x = F.when(x.isNotNull(), vector_to_array(x))
        p = probability(x.cast("array<double>"))
        return df.withColumn(out, F.when(~F.isnan(p), p))

    def importance(self, d: int) -> np.ndarray:
        """Total gain by feature, scaled to sum 1."""
        total = np.zeros(d)
        for _, _, f, _, gain in self.gains:
            total[f] += gain
        return total / total.sum() if total.sum() else total


def _margin(x: np.ndarray, trees) -> np.ndarray:
    out = np.zeros(len(x))
    for *nodes, value in trees:
        out += value[_walk(x, tuple(nodes))]
    return out


def boosted_trees(train: DataFrame, rounds: int = 100, max_depth: int = 6, learning_rate: float = 0.1, subsample: float = 1.0, colsample: float = 1.0,
                  pos_weight: float = 1.0, reg_lambda: float = 1.0, min_gain: float = 0.0, min_child: float = 1.0, label: str = "label",
                  features: str = "features", bins: int = 64, seed: int = 1729) -> Boosted:
    """Fits ``rounds`` trees. ``min_child`` is the least hessian of a child,
    ``min_gain`` the γ of the gain, ``reg_lambda`` its λ."""
    ship_package(train.sparkSession)
    x = F.col(features) if dict(train.dtypes)[features].startswith("array") else vector_to_array(F.col(features))
    rows = train.where(F.col(features).isNotNull()).select(x.cast("array<double>").alias("x"), F.col(label).cast("int").alias("y")).na.drop()
    rows = materialize(rows.withColumns({"u": F.xxhash64("x", "y"), "m": F.lit(0.0)}), "checkpoint")
    model = Boosted()
    if rows.select("y").distinct().count() < 2:
        return model
    d = rows.select(F.size("x")).first()[0]
    edges = bin_edges(rows, d, bins)
    columns = max(1, int(np.ceil(colsample * d)))
    since: list[tuple[np.ndarray, ...]] = []
    for t in range(rounds):
        if len(since) >= PIN:
            done = list(since)

            def moved(batches, done=done):
                for b in batches:
                    yield b.assign(m=b["m"] + _margin(np.vstack(b["x"].to_numpy()), done)) if len(b) else b

            rows, since = materialize(rows.mapInPandas(moved, rows.schema), "checkpoint"), []
        use = np.sort(np.argsort(draw(seed, t, np.arange(d), 2), kind="stable")[:columns])
        tree = _tree(rows, since, t, use, edges, max_depth, learning_rate, subsample, pos_weight, reg_lambda, min_gain, min_child, seed, model)
        model.trees.append(tree)
        since.append(tree)
    return model


def _tree(rows, since, t, use, edges, max_depth, learning_rate, subsample, pos_weight, lam, min_gain, min_child, seed, model):
    nodes = {"feature": [-1], "threshold": [0.0], "left": [-1], "right": [-1], "value": [0.0]}
    width = edges.shape[1] + 1
    open_nodes, depth = [0], 0
    while open_nodes:
        flat = tuple(np.array(nodes[k]) for k in ("feature", "threshold", "left", "right"))
        last, wanted = depth >= max_depth, list(open_nodes)

        def part(batches):
            total = np.zeros((len(wanted), 1 if last else len(use), width, 2))
            slot = np.full(len(flat[0]), -1)
            slot[wanted] = np.arange(len(wanted))
            for b in batches:
                if not len(b):
                    continue
                x, y = np.vstack(b["x"].to_numpy()), b["y"].to_numpy()
                p = 1 / (1 + np.exp(-(b["m"].to_numpy() + _margin(x, since))))
                w = np.where(y == 1, pos_weight, 1.0)
                at = slot[_walk(x, flat)]
                if subsample < 1:
                    at = np.where(draw(seed + 1, t, b["u"].to_numpy().view(np.uint64), 3) < subsample, at, -1)
                own = np.flatnonzero(at >= 0)
                g, h = (w * (p - y))[own], (w * p * (1 - p))[own]
                for j, f in enumerate(use[:total.shape[1]]):
                    k = at[own] * width + np.searchsorted(edges[f], x[own, f], "left")
                    n = len(wanted) * width
                    total[:, j] += np.stack([np.bincount(k, g, n), np.bincount(k, h, n)], axis=1).reshape(len(wanted), width, 2)
            yield pd.DataFrame({"t": 0, "k": range(len(wanted)), "v": [v.ravel() for v in total]})

        def pick(batches):
            for b in batches:
                out = []
                for k, v in zip(b["k"], b["v"]):
                    sums = np.cumsum(np.array(v).reshape(-1, width, 2), axis=1)
                    g, h = sums[0, -1]
                    row = (k, g, h, -1, 0.0, 0.0)
                    if not last:
                        left = sums[:, :-1]
                        right = sums[:, -1:] - left
                        gain = 0.5 * (left[..., 0] ** 2 / (left[..., 1] + lam) + right[..., 0] ** 2 / (right[..., 1] + lam) - g * g / (h + lam)) - min_gain
                        fine = (left[..., 1] >= min_child) & (right[..., 1] >= min_child) & np.isfinite(edges[use])
                        gain = np.where(fine, gain, -np.inf)
                        at = int(np.argmax(gain >= gain.max() - 1e-12))
                        j, c = divmod(at, gain.shape[1])
                        if gain[j, c] > 1e-12:
                            row = (k, g, h, int(use[j]), float(edges[use[j], c]), float(gain[j, c]))
                    out.append(row)
                yield pd.DataFrame(out, columns=["k", "g", "h", "f", "cut", "gain"])

        found = _sum(rows.mapInPandas(part, "t int, k int, v array<double>")).mapInPandas(
            pick, "k int, g double, h double, f int, cut double, gain double").collect()
        open_nodes = []
        for r in sorted(found, key=lambda r: r["k"]):
            k = wanted[r["k"]]
            nodes["value"][k] = -learning_rate * r["g"] / (r["h"] + lam) if r["h"] + lam > 0 else 0.0
            if r["f"] >= 0:
                model.gains.append((t, k, r["f"], r["cut"], r["gain"]))
                nodes["feature"][k], nodes["threshold"][k] = r["f"], r["cut"]
                for side in ("left", "right"):
                    nodes[side][k] = len(nodes["feature"])
                    open_nodes.append(len(nodes["feature"]))
                    for name, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", 0.0)):
                        nodes[name].append(v)
        depth += 1
    return tuple(np.array(nodes[k]) for k in ("feature", "threshold", "left", "right", "value"))
