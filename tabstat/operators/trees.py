"""Many classification trees grown level by level in shared passes.

All trees of a call (the members of an ensemble, or a grid's points on every
fold) grow together. A level takes one pass for its counts and, if some tree
draws thresholds at random, one before it for the ranges:

* ranges: least and largest value of every feature in every open node of those
  trees;
* counts: for every open node and each of its drawn features, rows and class
  weights by bin (splitter ``best``: bounds shared by the whole table) or left
  of one threshold (splitter ``random``: uniform in the node's range of the
  feature, as in extremely randomised trees).

Rows find their node by walking the trees so far, so nothing is stored with
them. The tasks' partial counts are added per node on the executors, which
also pick each node's split; the driver receives one row per new node. Which
features a node sees and its thresholds are hashes of (seed, node, feature): the
result does not depend on partitioning, on the other trees or on the depth
limit. So a limit on depth or on the rows of a node to be split only cuts a
tree short, and ``pre_pruned_grid`` reads all such points of a grid from one
tree per remaining setting.

A node of at most LOCAL_ROWS rows is grown to its end by one task, all nodes of
a level in the same array operations. The task gets the rows of that node only
(bin numbers for the splitter ``best``), once for up to SHARED nodes of different
trees to which the same splits lead, as these hold the same rows, and returns
what the call asks of the subtree: its part of the importances, its counts of
held-out rows at each limit, or its nodes. The driver thus holds the nodes above
that size, and whole trees only where ``grow`` is asked for them. Nodes whose
moved rows together exceed WAVE_ROWS are finished in turn, which bounds the shuffle.

Counts of rows (``min_split``, ``min_leaf``) ignore class weights, impurities
and labels use them. A drawn feature that is constant in a node is replaced by
the next one drawn. Rows with a null label, fold or feature take no part.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.session import materialize, ship_package

BINS = 32            # bins of a feature for the best splitter
EDGE_ROWS = 10_000   # rows (of least hash) whose quantiles bound the bins
LOCAL_ROWS = 16_384  # training rows of a node that one task grows to its end
WAVE_ROWS = 4_000_000  # rows of such nodes, over all trees, moved at once
SHARED = 6           # nodes with the same rows that one task grows
CELLS = 1 << 20      # numbers of a level that are held at once, about


@dataclass(frozen=True)
class Growth:
    """How one tree grows. ``fold`` is left out of its training rows (-1: none)."""

    splitter: str = "best"
    max_features: int = 0            # 0: all
    criterion: str = "gini"
    min_leaf: int = 1
    weights: tuple[float, float] = (1.0, 1.0)
    fold: int = -1
    seed: int = 1729


@dataclass
class Tree:
    """Nodes in order of creation; -1 where there is no split."""

    growth: Growth
    number: list[int] = field(default_factory=lambda: [1])      # heap numbering: 2n and 2n + 1 below n
    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    rows: list[int] = field(default_factory=lambda: [0])
    mass: list[tuple[float, float]] = field(default_factory=lambda: [(0.0, 0.0)])

    def depth(self, k: int) -> int:
        return self.number[k].bit_length() - 1

    def add(self, number: int, rows: int, mass: tuple[float, float]) -> int:
        """A new node without a split; its place."""
        for column, v in ((self.number, number), (self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.rows, rows), (self.mass, mass)):
            column.append(v)
        return len(self.number) - 1

    def label(self, k: int) -> int:
        return int(self.mass[k][1] > self.mass[k][0])

    def decrease(self, d: int) -> np.ndarray:
        """Decrease of weighted impurity by feature."""
        out = np.zeros(d)
        for k, f in enumerate(self.feature):
            if f >= 0:
                m, a, b = (np.array(self.mass[i]) for i in (k, self.left[k], self.right[k]))
                out[f] += sum(s * x.sum() * impurity(x[None], self.growth.criterion)[0] for s, x in ((1, m), (-1, a), (-1, b)))
        return out

    def importance(self, d: int) -> np.ndarray:
        """The decrease by feature, scaled to sum 1."""
        return _scaled(self.decrease(d))

    def stops(self, max_depth: int, min_split: int) -> np.ndarray:
        """Nodes at which the tree cut short by these limits ends: those that
        stop and whose parent does not (below a node that stops, all do)."""
        depth = np.array([n.bit_length() - 1 for n in self.number])
        stop = (np.array(self.feature) < 0) | (depth >= max_depth) | (np.array(self.rows) < min_split)
        reached = np.ones(len(stop), bool)
        for side in (self.left, self.right):
            child = np.array(side)
            reached[child[child >= 0]] = ~stop[child >= 0]
        return np.flatnonzero(stop & reached)


def _scaled(v: np.ndarray) -> np.ndarray:
    return v / v.sum() if v.sum() > 0 else v


def impurity(mass: np.ndarray, criterion: str) -> np.ndarray:
    """Gini impurity or entropy (bits) of class weights in the last axis."""
    total = mass.sum(-1, keepdims=True)
    p = np.divide(mass, total, out=np.zeros_like(mass, dtype=float), where=total > 0)
    if criterion == "gini":
        return np.where(total[..., 0] > 0, 1 - (p * p).sum(-1), 0.0)
    return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(-1)


def draw(seed: int, node, feature, use: int) -> np.ndarray:
    """Uniform numbers in [0, 1) by hash; ``use`` tells features from thresholds."""
    with np.errstate(over="ignore"):
        x = np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(node, np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x = x + np.asarray(feature, np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) + np.uint64(use) * np.uint64(0xABC98388FB8FAC03)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def drawn(g: Growth, node: int, d: int) -> np.ndarray:
    """All features in the order in which the node tries them."""
    if not g.max_features or g.max_features >= d:
        return np.arange(d)
    return np.argsort(draw(g.seed, node, np.arange(d), 0), kind="stable")


def _flat(trees: list[Tree]) -> list[tuple[np.ndarray, ...]]:
    return [(np.array(t.feature), np.array(t.threshold), np.array(t.left), np.array(t.right)) for t in trees]


def _walk(x: np.ndarray, nodes: tuple[np.ndarray, ...], visit=None) -> np.ndarray:
    """The last node of each row."""
    feature, threshold, left, right = nodes
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        if visit is not None:
            visit(at, rows)
        go = feature[at[rows]] >= 0
        rows = rows[go]
        if not len(rows):
            return at
        k = at[rows]
        at[rows] = np.where(x[rows, feature[k]] <= threshold[k], left[k], right[k])


def _members(x: np.ndarray, f: np.ndarray, nodes: tuple[np.ndarray, ...], g: Growth, which):
    """Each node of ``which`` with the training rows that end there."""
    own = np.flatnonzero(f != g.fold)
    at = _walk(x[own], nodes)
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    for k in which:
        yield k, own[np.searchsorted(at, k):np.searchsorted(at, k, "right")]


def _inputs(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.vstack(batch["x"].to_numpy()), batch["y"].to_numpy().astype(np.int64), batch["f"].to_numpy()


def bin_edges(rows: DataFrame, d: int, bins: int) -> np.ndarray:
    """(d, bins - 1) split points: midpoints between neighbouring quantiles of
    a sample by hash; infinite where a feature has fewer."""
    sample = rows.select("x", F.xxhash64("x").alias("h")).orderBy("h", "x").limit(EDGE_ROWS).toPandas()
    x = np.sort(np.vstack(sample["x"].to_numpy()), axis=0)
    out = np.full((d, bins - 1), np.inf)
    for f in range(d):
        own = np.unique(x[:, f])
        cuts = (own[1:] + own[:-1]) / 2
        if len(cuts) > bins - 1:
            at = np.linspace(0, len(x) - 1, bins + 1)[1:-1].astype(int)
            below = np.searchsorted(own, x[at, f])
            cuts = np.unique(cuts[np.minimum(below, len(cuts) - 1)])
        out[f, :len(cuts)] = cuts
    return out


def _sum(parts: DataFrame) -> DataFrame:
    """(t, k, v): the sum of the tasks' vectors of each tree and node."""
    return (parts.select("t", "k", array_to_vector("v").alias("v")).groupBy("t", "k")
            .agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("v")))


def _ranges(rows: DataFrame, trees: list[Tree], open_nodes: list[tuple[int, int]], d: int) -> dict[tuple[int, int], np.ndarray]:
    """Least and largest value of each feature in each open node."""
    flat, growth = _flat(trees), [t.growth for t in trees]
    of = {}
    for t, k in open_nodes:
        of.setdefault(t, []).append(k)

    def part(batches):
        found: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            x, _, f = _inputs(b)
            for t, nodes in of.items():
                for k, which in _members(x, f, flat[t], growth[t], nodes):
                    own = x[which]
                    if len(own):
                        now = np.concatenate([own.min(0), -own.max(0)])
                        found[t, k] = np.minimum(found[t, k], now) if (t, k) in found else now
        if found:
            yield pd.DataFrame({"t": [t for t, _ in found], "k": [k for _, k in found], "v": list(found.values())})

    got = rows.mapInPandas(part, "t int, k int, v array<double>").select("t", "k", array_to_vector("v").alias("v")).groupBy("t", "k").agg(
        vector_to_array(Summarizer.min(F.col("v"))).alias("v")).collect()
    return {(r["t"], r["k"]): np.stack([np.array(r["v"][:d]), -np.array(r["v"][d:])]) for r in got}


def _choose(g: Growth, counts: np.ndarray, features: np.ndarray, thresholds: np.ndarray, constant: np.ndarray):
    """The split of a node from (features, cuts, 3) sums left of each cut (rows,
    weight of 0, weight of 1), the last cut being the whole node: (feature,
    threshold, rows left, weights left) or None. Ties go to the feature tried
    first, then the smaller threshold."""
    whole = counts[0, -1]
    total = whole[1:].sum()
    if whole[1] == 0 or whole[2] == 0:
        return None
    left = counts[:, :-1]
    right = whole - left
    least = max(1, g.min_leaf)
    fine = (left[..., 0] >= least) & (right[..., 0] >= least) & np.isfinite(thresholds) & ~constant[:, None]
    gain = impurity(whole[None, 1:], g.criterion)[0] - sum(s[..., 1:].sum(-1) / total * impurity(s[..., 1:], g.criterion) for s in (left, right))
    gain = np.where(fine, gain, -1.0)
    cut = np.argmax(gain >= gain.max(1, keepdims=True) - 1e-12, axis=1)
    value, some = gain[np.arange(len(cut)), cut], fine.any(1)
    best, tried = None, 0
    for j in np.flatnonzero(~constant):
        if some[j] and (best is None or value[j] > best[0] + 1e-12):
            c = cut[j]
            best = (float(value[j]), int(features[j]), float(thresholds[j][c]), left[j, c])
        tried += 1
        if g.max_features and tried >= g.max_features and best is not None:
            break
    return None if best is None else best[1:]


def _drawn_cuts(g: Growth, number: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of a node of a ``random`` tree with their threshold, from the
    ranges of all features, and which of them are constant."""
    f = drawn(g, number, len(low))
    low, high = low[f], high[f]
    flat = high <= low
    if g.max_features:  # as many as can matter: that many that vary
        f = f[np.cumsum(~flat) <= g.max_features] if (~flat).any() else f[:1]
        low, high, flat = low[:len(f)], high[:len(f)], flat[:len(f)]
    cut = low + draw(g.seed, number, f, 1) * (high - low)
    return f, np.where(cut >= high, low, cut)[:, None], flat


def _counts(side: np.ndarray, width: int, y: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    """(features x width, 3): rows and weights of class 0 and 1 by feature and bin."""
    slot = (np.arange(side.shape[1]) * width + side) * 2 + y[:, None]
    n = np.bincount(slot.ravel(), minlength=2 * side.shape[1] * width).reshape(-1, 2)
    return np.column_stack([n.sum(1), n * np.array(weights)])


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.uint8 if edges.shape[1] < 256 else np.uint32)


def _pick(g: Growth, left: np.ndarray, whole: np.ndarray, possible: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``_choose`` picks, for many nodes at once: the places of each node's
    feature (-1: no split) and cut, from (nodes, features, cuts, 2) rows of class
    0 and 1 left of each cut and (nodes, 2) in all."""
    weights, least = np.array(g.weights), max(1, g.min_leaf)
    rows = left.sum(-1)
    fine = possible & use[..., None] & (rows >= least) & (whole.sum(-1)[:, None, None] - rows >= least)
    fine[..., 1:] &= rows[..., 1:] > rows[..., :-1]  # else the cut before has the same gain, and is smaller
    at = np.nonzero(fine)
    mass = whole * weights
    a = left[at] * weights
    own = mass[at[0]]
    total = own.sum(-1)
    gain = np.full(fine.shape, -1.0)
    gain[at] = impurity(mass, g.criterion)[at[0]] - sum(s.sum(-1) / total * impurity(s, g.criterion) for s in (a, own - a))
    cut = np.argmax(gain >= gain.max(2, keepdims=True) - 1e-12, axis=2)
    value, some = np.take_along_axis(gain, cut[..., None], 2)[..., 0], fine.any(2)
    best, place, tried = np.zeros(len(left)), np.full(len(left), -1), np.zeros(len(left), int)
    for j in range(left.shape[1]):
        ended = (tried >= g.max_features) & (place >= 0) if g.max_features else np.zeros(len(left), bool)
        better = some[:, j] & ~ended & ((place < 0) | (value[:, j] > best + 1e-12))
        best[better], place[better] = value[better, j], j
        tried += use[:, j]
    return place, cut[np.arange(len(left)), place]


def _try(g: Growth, numbers: np.ndarray, order: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray, sizes: np.ndarray, whole: np.ndarray,
         edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The splits of some nodes of a level by the first features that each tries
    (``order``): (feature or -1, threshold, whether further features matter)."""
    n, m = order.shape
    node, at = np.repeat(np.arange(n), sizes), np.arange(n)
    values, ones = x[own[:, None], order[node]], y[own][:, None]
    if g.splitter == "best":
        width = edges.shape[1] + 1
        slot = ((node[:, None] * m + np.arange(m)) * width + values) * 2 + ones
        counts = np.bincount(slot.ravel(), minlength=n * m * width * 2).reshape(n, m, width, 2)
        place, cut = _pick(g, np.cumsum(counts[:, :, :-1], axis=2), whole, np.isfinite(edges)[order], np.ones((n, m), bool))
        return np.where(place < 0, -1, order[at, place]), cut.astype(float), place < 0
    starts = np.cumsum(sizes) - sizes
    low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
    flat = high <= low
    use = ~flat & (np.cumsum(~flat, axis=1) <= g.max_features) if g.max_features else ~flat
    cuts = low + draw(g.seed, numbers[:, None], order, 1) * (high - low)
    cuts = np.where(cuts >= high, low, cuts)
    on_left = ~(values > cuts[node])
    rows, of_one = (np.add.reduceat(v, starts, dtype=np.int64) for v in (on_left, on_left & (ones == 1)))
    place, _ = _pick(g, np.stack([rows - of_one, of_one], axis=-1)[:, :, None], whole, np.isfinite(cuts)[..., None], use)
    return np.where(place < 0, -1, order[at, place]), cuts[at, place], flat.any(1)


def _level(g: Growth, numbers: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray, sizes: np.ndarray, whole: np.ndarray,
           edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none) and threshold of every node of a level; ``own`` holds
    their rows one node after the other."""
    d, feature, threshold = x.shape[1], np.full(len(sizes), -1), np.zeros(len(sizes))
    few = g.max_features if 0 < g.max_features < d else d
    starts, todo = np.cumsum(sizes) - sizes, np.arange(len(sizes))
    for m in dict.fromkeys((few, d)):  # further features only where these do not decide
        again = []
        part = np.cumsum((sizes[todo] + edges.shape[1] + 1) * m) // CELLS
        for which in np.split(todo, np.flatnonzero(np.diff(part)) + 1) if len(todo) else []:
            order = np.tile(np.arange(d), (len(which), 1)) if few == d else np.argsort(
                draw(g.seed, numbers[which, None], np.arange(d), 0), axis=1, kind="stable")[:, :m]
            rows = np.concatenate([own[starts[i]:starts[i] + sizes[i]] for i in which])
            feature[which], threshold[which], more = _try(g, numbers[which], order, x, y, rows, sizes[which], whole[which], edges)
            again.append(which[more])
        todo = np.concatenate(again) if again else todo[:0]
    return feature, threshold


def _subtree(g: Growth, number: int, x: np.ndarray, y: np.ndarray, max_depth: int, min_split: int, edges: np.ndarray) -> Tree:
    """The tree below one node from all its training rows, level by level. For
    the splitter ``best`` both ``x`` and the thresholds are numbers of bins."""
    tree, places = Tree(g, number=[number]), np.zeros(1, int)
    own, sizes = np.arange(len(y)), np.array([len(y)])
    while len(own):
        ones = np.add.reduceat(y[own], np.cumsum(sizes) - sizes)
        whole = np.stack([sizes - ones, ones], axis=1)
        mass = whole * np.array(g.weights)
        for k, n, m in zip(places.tolist(), sizes.tolist(), mass.tolist()):
            tree.rows[k], tree.mass[k] = n, tuple(m)
        if tree.depth(places[0]) >= max_depth:
            break
        go_on = (sizes >= max(2, min_split)) & (mass != 0).all(1)
        own, places, sizes, whole = own[np.repeat(go_on, sizes)], places[go_on], sizes[go_on], whole[go_on]
        feature, threshold = _level(g, np.array([tree.number[k] for k in places], np.uint64), x, y, own, sizes, whole, edges)
        some = feature >= 0
        own, places, sizes, feature, threshold = own[np.repeat(some, sizes)], places[some], sizes[some], feature[some], threshold[some]
        node = np.repeat(np.arange(len(sizes)), sizes)
        right = ~(x[own, feature[node]] <= threshold[node])
        own = own[np.argsort(2 * node + right, kind="stable")]
        sizes = np.bincount(2 * node + right, minlength=2 * len(sizes))
        below = []
        for k, f, cut in zip(places.tolist(), feature.tolist(), threshold.tolist()):
            tree.feature[k], tree.threshold[k] = f, cut
            tree.left[k], tree.right[k] = (tree.add(2 * tree.number[k] + side, 0, (0.0, 0.0)) for side in (0, 1))
            below += [tree.left[k], tree.right[k]]
        places = np.array(below, int)
    return tree


def grow(train: DataFrame, growths: Sequence[Growth], max_depth: int, min_split: int = 2, label: str = "label", features: str = "features",
         fold: str | None = None, bins: int = BINS, local_rows: int = LOCAL_ROWS) -> list[Tree]:
    """One tree per growth, all in the same passes; the driver holds them whole."""
    ship_package(train.sparkSession)
    rows = materialize(_rows(train, label, features, fold), "persist")
    try:
        return _whole(rows, *_grow(rows, growths, max_depth, min_split, bins, local_rows), max_depth, min_split)
    finally:
        rows.unpersist()


def _whole(rows: DataFrame, trees: list[Tree], pending: list[tuple[int, int]], edges: np.ndarray, max_depth: int, min_split: int) -> list[Tree]:
    """The trees with the subtrees of their pending nodes."""

    def nodes(tree, x, y):
        return np.column_stack([tree.number, tree.feature, tree.threshold, tree.left, tree.right, tree.rows, tree.mass]).ravel()

    for (t, k), v in sorted(_finish(rows, trees, pending, edges, max_depth, min_split, nodes).items()):
        tree, at = trees[t], []
        for i, (number, _, _, _, _, n, *mass) in enumerate(v.reshape(-1, 8)):
            at.append(tree.add(int(number), int(n), tuple(mass)) if i else k)
            tree.rows[at[i]], tree.mass[at[i]] = int(n), tuple(mass)
        for i, (_, f, threshold, left, right, *_) in enumerate(v.reshape(-1, 8)):
            if f >= 0:
                tree.feature[at[i]] = int(f)
                tree.threshold[at[i]] = float(edges[int(f), int(threshold)]) if tree.growth.splitter == "best" else float(threshold)
                tree.left[at[i]], tree.right[at[i]] = at[int(left)], at[int(right)]
    return trees


def _alike(trees: list[Tree], pending: list[tuple[int, int]]) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """The pending nodes, together where the same splits lead to them: these
    hold the same rows, apart from their folds. Up to SHARED nodes each, with
    the first of all that are alike."""
    found: dict[tuple, list[tuple[int, int]]] = {}
    above: dict[int, dict[int, tuple[int, int]]] = {}
    for t, k in pending:
        tree = trees[t]
        if t not in above:
            above[t] = {c: (p, i) for i, side in enumerate((tree.left, tree.right)) for p, c in enumerate(side) if c >= 0}
        path, at = [], k
        while at in above[t]:
            at, side = above[t][at]
            path.append((tree.feature[at], tree.threshold[at], side))
        found.setdefault((tree.growth.splitter, *path), []).append((t, k))
    return [(nodes[0], nodes[i:i + SHARED]) for nodes in found.values() for i in range(0, len(nodes), SHARED)]


def _finish(rows: DataFrame, trees: list[Tree], pending: list[tuple[int, int]], edges: np.ndarray, max_depth: int, min_split: int,
            report) -> dict[tuple[int, int], np.ndarray]:
    """(tree, node) -> ``report(subtree, x, y)`` of the pending nodes, each grown
    to its end by one task; x, y are the rows of the tree's own fold that reach
    the node."""
    out: dict[tuple[int, int], np.ndarray] = {}
    wave: list[tuple[tuple[int, int], list[tuple[int, int]]]] = []
    size, units = 0, _alike(trees, pending)
    for i, unit in enumerate(units):
        wave.append(unit)
        size += max(trees[t].rows[k] for t, k in unit[1])
        if size >= WAVE_ROWS or i + 1 == len(units):
            out.update(_finish_wave(rows, trees, wave, edges, max_depth, min_split, report))
            wave, size = [], 0
    return out


def _finish_wave(rows, trees, wave, edges, max_depth, min_split, report):
    of: dict[int, dict[int, list[int]]] = {}
    for u, ((t, k), _) in enumerate(wave):
        of.setdefault(t, {}).setdefault(k, []).append(u)
    flat = {t: _flat([trees[t]])[0] for t in of}
    best = [trees[t].growth.splitter == "best" for (t, _), _ in wave]
    alike = [[(t, k, trees[t].growth, trees[t].number[k]) for t, k in nodes] for _, nodes in wave]
    d, kind = len(edges), np.uint8 if edges.shape[1] < 256 else np.uint32

    def route(batches):
        for b in batches:
            if not len(b):
                continue
            x, y, f = _inputs(b)
            bins = _binned(x, edges) if edges.shape[1] else None
            for t, nodes in of.items():
                at = _walk(x, flat[t])
                order = np.argsort(at, kind="stable")
                at = at[order]
                found = []
                for k, units in nodes.items():
                    own = order[np.searchsorted(at, k):np.searchsorted(at, k, "right")]
                    if len(own):
                        found.append((units, (bins if best[units[0]] else x)[own].tobytes(), y[own].astype(np.int8).tobytes(), f[own].astype(np.int32).tobytes()))
                if found:
                    yield pd.DataFrame(found, columns=["units", "x", "y", "f"])

    def finish(key, blocks):
        u = int(key[0])
        x = np.frombuffer(b"".join(blocks["x"]), kind if best[u] else float).reshape(-1, d)
        y, f = np.frombuffer(b"".join(blocks["y"]), np.int8).astype(np.int64), np.frombuffer(b"".join(blocks["f"]), np.int32)
        out = []
        for t, k, g, number in alike[u]:
            h = f == g.fold
            tree = _subtree(g, number, x[~h], y[~h], max_depth, min_split, edges)
            out.append((t, k, np.asarray(report(tree, x[h], y[h]), float)))
        return pd.DataFrame(out, columns=["t", "k", "v"])

    moved = rows.mapInPandas(route, "units array<int>, x binary, y binary, f binary").select(F.explode("units").alias("u"), "x", "y", "f").repartition(
        min(4 * len(wave), 256), "u")
    got = moved.groupBy("u").applyInPandas(finish, "t int, k int, v array<double>").collect()
    return {(r["t"], r["k"]): np.array(r["v"]) for r in got}


def _rows(train: DataFrame, label: str, features: str, fold: str | None) -> DataFrame:
    x = F.col(features) if dict(train.dtypes)[features].startswith("array") else vector_to_array(F.col(features))
    f = F.col(fold).cast("int") if fold else F.lit(-2)
    return train.where(F.col(features).isNotNull()).select(x.cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"), f.alias("f")).na.drop()


def _grow(rows: DataFrame, growths: Sequence[Growth], max_depth: int, min_split: int, bins: int,
          local_rows: int = LOCAL_ROWS) -> tuple[list[Tree], list[tuple[int, int]], np.ndarray]:
    """The trees down to their nodes of at most ``local_rows`` rows, those of
    these nodes that are still to be grown, and the bounds of the bins."""
    first = rows.select(F.size("x").alias("d")).first()
    trees = [Tree(g) for g in growths]
    if first is None:
        return trees, [], np.zeros((0, 0))
    d = first["d"]
    edges = bin_edges(rows, d, bins) if any(g.splitter == "best" for g in growths) else np.zeros((d, 0))
    sizes = {r["f"]: r["n"] for r in rows.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    for t in trees:
        t.rows[0] = sum(n for f, n in sizes.items() if f != t.growth.fold)
    open_nodes = [(t, 0) for t in range(len(trees)) if trees[t].rows[0] > local_rows]
    pending = [(t, 0) for t in range(len(trees)) if 0 < trees[t].rows[0] <= local_rows]
    for level in range(max_depth + 1):
        if not open_nodes:
            break
        spans = _ranges(rows, trees, [(t, k) for t, k in open_nodes if trees[t].growth.splitter == "random"], d) if any(
            g.splitter == "random" for g in growths) else {}
        plan: dict[int, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for t, k in open_nodes:
            g, number = growths[t], trees[t].number[k]
            if g.splitter == "random":
                span = spans.get((t, k))
                if span is None:
                    continue
                plan.setdefault(t, {})[k] = _drawn_cuts(g, number, span[0], span[1])
            else:
                f = drawn(g, number, d)
                plan.setdefault(t, {})[k] = (f, edges[f], np.zeros(len(f), bool))
        found = _splits(rows, trees, plan, edges, level >= max_depth, min_split)
        open_nodes = []
        for (t, k), (n, mass, split) in sorted(found.items()):
            tree = trees[t]
            tree.rows[k], tree.mass[k] = n, mass
            if split is None:
                continue
            f, threshold, left = split
            tree.feature[k], tree.threshold[k] = f, threshold
            for side, (rows_in, m) in enumerate(((int(left[0]), (left[1], left[2])), (n - int(left[0]), (mass[0] - left[1], mass[1] - left[2])))):
                at = tree.add(2 * tree.number[k] + side, rows_in, m)
                (tree.right if side else tree.left)[k] = at
                if level + 1 < max_depth and rows_in >= max(2, min_split) and m[0] > 0 and m[1] > 0:
                    (open_nodes if rows_in > local_rows else pending).append((t, at))
    return trees, pending, edges


def _splits(rows: DataFrame, trees: list[Tree], plan: dict, edges: np.ndarray, last: bool, min_split: int) -> dict:
    """(tree, node) -> (rows, class weights, split or None) of the planned nodes."""
    flat, growths = _flat(trees), [t.growth for t in trees]
    cuts = edges.shape[1] + 1

    def part(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            x, y, f = _inputs(b)
            binned = _binned(x, edges) if cuts > 1 else None
            for t, nodes in plan.items():
                g = growths[t]
                for k, own in _members(x, f, flat[t], g, nodes):
                    if not len(own):
                        continue
                    features, thresholds, _ = nodes[k]
                    side = binned[own][:, features].astype(np.int64) if g.splitter == "best" else (x[own][:, features] > thresholds[:, 0]).astype(np.int64)
                    sums = _counts(side, cuts if g.splitter == "best" else 2, y[own], g.weights).ravel()
                    total[t, k] = total[t, k] + sums if (t, k) in total else sums
        if total:
            yield pd.DataFrame({"t": [t for t, _ in total], "k": [k for _, k in total], "v": list(total.values())})

    def pick(batches):
        for b in batches:
            out = []
            for t, k, v in zip(b["t"], b["k"], b["v"]):
                features, thresholds, constant = plan[t][k]
                counts = np.array(v).reshape(len(features), -1, 3)
                counts[..., 0] = np.rint(counts[..., 0])  # the sums are floating-point
                counts = np.cumsum(counts, axis=1)
                n, m0, m1 = counts[0, -1]
                split = None if last or n < max(2, min_split) else _choose(growths[t], counts, features, thresholds, constant)
                out.append((t, k, int(n), m0, m1, *((split[0], split[1], *map(float, split[2])) if split else (-1, 0.0, 0.0, 0.0, 0.0))))
            yield pd.DataFrame(out, columns=["t", "k", "n", "m0", "m1", "f", "cut", "ln", "l0", "l1"])

    schema = "t int, k int, n long, m0 double, m1 double, f int, cut double, ln double, l0 double, l1 double"
    got = _sum(rows.mapInPandas(part, "t int, k int, v array<double>")).mapInPandas(pick, schema).collect()
    return {(r["t"], r["k"]): (r["n"], (r["m0"], r["m1"]), (r["f"], r["cut"], (r["ln"], r["l0"], r["l1"])) if r["f"] >= 0 else None) for r in got}


def extra_trees_importance(train: DataFrame, names: Sequence[str], label: str = "label", features: str = "features", num_trees: int = 100,
                           max_depth: int = 30, weights: tuple[float, float] = (1.0, 1.0), seed: int = 1729,
                           local_rows: int = LOCAL_ROWS) -> list[tuple[str, float]]:
    """Importances of extremely randomised trees (random thresholds, sqrt
    of the features a node, no resampling), largest first."""
    k = max(1, int(math.sqrt(len(names))))
    growths = [Growth("random", k, "gini", 1, weights, -1, seed + i) for i in range(num_trees)]
    ship_package(train.sparkSession)
    rows, d = materialize(_rows(train, label, features, None), "persist"), len(names)
    try:
        trees, pending, edges = _grow(rows, growths, max_depth, 2, BINS, local_rows)
        below = _finish(rows, trees, pending, edges, max_depth, 2, lambda tree, x, y: tree.decrease(d))
    finally:
        rows.unpersist()
    total = [t.decrease(d) for t in trees]
    for (t, _), v in sorted(below.items()):
        total[t] = total[t] + v
    mean = np.mean([_scaled(v) for v in total], axis=0)
    return sorted(zip(names, map(float, mean)), key=lambda x: (-x[1], x[0]))


def pre_pruned_grid(train: DataFrame, grid: Mapping[str, Sequence], fold: str = "fold", label: str = "label", features: str = "features",
                    seed: int = 1729, bins: int = BINS, local_rows: int = LOCAL_ROWS) -> tuple[list[dict], np.ndarray, int, Tree]:
    """Accuracy on the folds of every point of a grid over max_depth,
    min_samples_split, min_samples_leaf, max_features (sqrt, log2 or all),
    splitter (best, random), criterion (gini, entropy) and class_weight, in the
    order of ``itertools.product``. Points that differ in max_depth and
    min_samples_split share a tree. Returns (points, mean accuracies, first
    best point, its tree on all rows, to be cut by that point's limits)."""
    values = {"max_depth": [5], "min_samples_split": [2], "min_samples_leaf": [1], "max_features": ["all"], "splitter": ["best"],
              "criterion": ["gini"], "class_weight": [None], **grid}
    points = [dict(zip(values, v)) for v in product(*values.values())]
    ship_package(train.sparkSession)
    rows = materialize(_rows(train, label, features, fold), "persist")
    try:
        d = rows.select(F.size("x").alias("d")).first()["d"]
        folds = sorted(r[0] for r in rows.select("f").distinct().collect())
        most = {"sqrt": max(1, int(math.sqrt(d))), "log2": max(1, int(math.log2(d))), "all": 0}
        growths: dict[Growth, int] = {}

        def growth(p: dict, f: int) -> Growth:
            cw = p["class_weight"] or {}
            return Growth(p["splitter"], most[p["max_features"]], p["criterion"], p["min_samples_leaf"], (float(cw.get(0, 1)), float(cw.get(1, 1))), f, seed)

        for p in points:
            for f in [*folds, -1]:
                growths.setdefault(growth(p, f), len(growths))
        deepest, least = max(values["max_depth"]), min(values["min_samples_split"])
        limits = list(product(values["max_depth"], values["min_samples_split"]))
        trees, pending, edges = _grow(rows, list(growths), deepest, least, bins, local_rows)

        def scores(tree, x, y):
            right, seen = _passing(tree, x, y)
            ends = [tree.stops(*limit) for limit in limits]
            return np.array([[right[e].sum(), seen[e].sum()] for e in ends]).ravel()

        below = {key: v.reshape(-1, 2) for key, v in _finish(rows, trees, pending, edges, deepest, least, scores).items()}
        right, seen = _held_out(rows, trees) if any(len(t.number) > 1 for t in trees) else ([np.zeros(1)] * len(trees), [np.zeros(1)] * len(trees))
        hits = np.zeros((len(trees), len(limits), 2))
        for t, tree in enumerate(trees):
            for i, limit in enumerate(limits):
                for k in tree.stops(*limit):
                    hits[t, i] += below[t, k][i] if (t, k) in below else (right[t][k], seen[t][k])
        mean = np.zeros(len(points))
        for i, p in enumerate(points):
            for f in folds:
                good, all_ = hits[growths[growth(p, f)], limits.index((p["max_depth"], p["min_samples_split"]))]
                mean[i] += good / all_ / len(folds)
        best = int(np.argmax(mean))
        own = growth(points[best], -1)
        whole = _whole(rows, [trees[growths[own]]], [(0, k) for t, k in pending if t == growths[own]], edges, deepest, least)
        return points, mean, best, whole[0]
    finally:
        rows.unpersist()


def _passing(tree: Tree, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every node: rows that pass it with the node's label, and all that do."""
    labels = np.array([tree.label(k) for k in range(len(tree.number))])
    right, seen = np.zeros(len(labels)), np.zeros(len(labels))

    def visit(at, which):
        k = at[which]
        right[:] += np.bincount(k, labels[k] == y[which], len(labels))
        seen[:] += np.bincount(k, minlength=len(labels))

    _walk(x, _flat([tree])[0], visit)
    return right, seen


def _held_out(rows: DataFrame, trees: list[Tree]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For every node of every tree: held-out rows that pass it, and those
    whose label is the node's."""
    flat = _flat(trees)
    labels = [np.array([t.label(k) for k in range(len(t.number))]) for t in trees]
    folds = [t.growth.fold for t in trees]

    def part(batches):
        total = [np.zeros((2, len(v))) for v in labels]
        for b in batches:
            x, y, f = _inputs(b)
            for t, nodes in enumerate(flat):
                own = f == folds[t]
                if folds[t] >= 0 and own.any():
                    truth = y[own]

                    def visit(at, which, t=t, truth=truth):
                        k = at[which]
                        total[t][0] += np.bincount(k, labels[t][k] == truth[which], len(labels[t]))
                        total[t][1] += np.bincount(k, minlength=len(labels[t]))

                    _walk(x[own], nodes, visit)
        yield pd.DataFrame({"t": range(len(total)), "k": 0, "v": [v.ravel() for v in total]})

    got = {r["t"]: np.rint(r["v"]).reshape(2, -1) for r in _sum(rows.mapInPandas(part, "t int, k int, v array<double>")).collect()}
    return [got[t][0] for t in range(len(trees))], [got[t][1] for t in range(len(trees))]
