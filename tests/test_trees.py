"""Level-wise trees against a recursive builder that sees all rows."""

import numpy as np
import pytest

from tabstat.operators import trees as tr


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(200, 6)), 2)
    x[:, 5] = 1.0  # constant
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(int) ^ (rng.random(200) < 0.1)
    f = rng.integers(0, 3, 200)
    df = spark.createDataFrame([([float(a) for a in v], int(t), int(k)) for v, t, k in zip(x, y, f)], "x array<double>, label int, fold int").repartition(4).cache()
    return df, x, y.astype(int), f


def brute(x, y, g, max_depth, min_split, edges, number=1):
    """Nested (number, rows, feature, threshold, left, right)."""
    n, d = len(y), x.shape[1]
    mass = np.array([g.weights[0] * (y == 0).sum(), g.weights[1] * (y == 1).sum()])
    leaf = (number, n, -1, 0.0, None, None)
    if number.bit_length() - 1 >= max_depth or n < max(2, min_split) or min(mass) == 0:
        return [leaf]
    best, tried = None, 0
    for f in tr.drawn(g, number, d):
        low, high = x[:, f].min(), x[:, f].max()
        if g.splitter == "random":
            if low >= high:
                continue
            cuts = [low + float(tr.draw(g.seed, number, f, 1)) * (high - low)]
            cuts = [low] if cuts[0] >= high else cuts
        else:
            cuts = [c for c in edges[f] if np.isfinite(c)]
        for c in cuts:
            a, b = y[x[:, f] <= c], y[x[:, f] > c]
            if min(len(a), len(b)) < max(1, g.min_leaf):
                continue
            m = [np.array([g.weights[0] * (s == 0).sum(), g.weights[1] * (s == 1).sum()]) for s in (a, b)]
            gain = tr.impurity(mass[None], g.criterion)[0] - sum(s.sum() / mass.sum() * tr.impurity(s[None], g.criterion)[0] for s in m)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, c)
        tried += 1
        if g.max_features and tried >= g.max_features and best is not None:
            break
    if best is None:
        return [leaf]
    _, f, c = best
    go = x[:, f] <= c
    return [(number, n, int(f), pytest.approx(c), None, None), *brute(x[go], y[go], g, max_depth, min_split, edges, 2 * number),
            *brute(x[~go], y[~go], g, max_depth, min_split, edges, 2 * number + 1)]


GROWTHS = [tr.Growth(s, m, c, leaf, w, fold, seed) for s, m, c, leaf, w, fold, seed in [
    ("best", 0, "gini", 1, (1.0, 1.0), -1, 1), ("best", 2, "entropy", 5, (3.0, 7.0), 0, 2), ("random", 2, "gini", 1, (3.0, 7.0), -1, 3),
    ("random", 0, "entropy", 4, (1.0, 9.0), 2, 4), ("random", 1, "gini", 1, (1.0, 1.0), 1, 5), ("best", 1, "gini", 10, (1.0, 1.0), 1, 6)]]


@pytest.mark.parametrize("max_depth,min_split", [(30, 2), (4, 12)])
def test_equal_a_brute_force_builder(data, max_depth, min_split):
    df, x, y, f = data
    edges = tr.bin_edges(df.select("x"), 6, tr.BINS)
    trees = tr.grow(df, GROWTHS, max_depth, min_split, features="x", fold="fold")
    for t in trees:
        own = f != t.growth.fold
        want = sorted(brute(x[own], y[own], t.growth, max_depth, min_split, edges))
        got = sorted((t.number[k], t.rows[k], t.feature[k], t.threshold[k], None, None) for k in range(len(t.number)))
        assert len(got) > 3 and got == want


def test_same_at_any_partitioning_and_company(data):
    df = data[0]
    a = tr.grow(df.repartition(1), GROWTHS, 4, features="x", fold="fold")
    b = [tr.grow(df.repartition(7), [g], 4, features="x", fold="fold")[0] for g in GROWTHS[1:3]]
    for s, t in zip(a[1:], b):
        assert sorted(zip(s.number, s.feature, s.threshold, s.rows)) == sorted(zip(t.number, t.feature, t.threshold, t.rows))


def test_importances_find_the_features_and_sum_to_one(data):
    got = tr.extra_trees_importance(data[0], list("abcdef"), features="x", num_trees=30, max_depth=6)
    assert {got[0][0], got[1][0]} == {"a", "b"} and got[-1] == ("f", 0.0)
    assert sum(v for _, v in got) == pytest.approx(1.0)


def test_grid_points_equal_trees_grown_alone(data):
    df, x, y, f = data
    grid = {"max_depth": [2, 5], "min_samples_split": [2, 20], "min_samples_leaf": [1, 5], "max_features": ["sqrt", "all"], "splitter": ["best", "random"],
            "class_weight": [None, {0: 1, 1: 9}]}
    points, mean, best, tree = tr.pre_pruned_grid(df, grid, features="x")
    assert len(points) == 64 and best == int(np.flatnonzero(mean == mean.max())[0])
    for i in (5, 22, 43, 60):
        p = points[i]
        cw = p["class_weight"] or {0: 1, 1: 1}
        own = []
        alone = [tr.Growth(p["splitter"], {"sqrt": 2, "all": 0}[p["max_features"]], "gini", p["min_samples_leaf"], (cw[0], cw[1]), k) for k in range(3)]
        for k, t in enumerate(tr.grow(df, alone, p["max_depth"], p["min_samples_split"], features="x", fold="fold")):
            at = tr._walk(x[f == k], tr._flat([t])[0])
            own.append(np.mean([t.label(n) == v for n, v in zip(at, y[f == k])]))
        assert mean[i] == pytest.approx(np.mean(own))


def test_empty_null_and_one_class(spark):
    empty = spark.createDataFrame([], "x array<double>, label int, fold int")
    assert tr.grow(empty, [tr.Growth()], 3, features="x")[0].feature == [-1]
    rows = spark.createDataFrame([([1.0, 2.0], 1, 0), ([2.0, 2.0], 1, 0), (None, 1, 0), ([1.0, 5.0], None, 0)], "x array<double>, label int, fold int")
    t = tr.grow(rows, [tr.Growth(splitter="random")], 3, features="x")[0]
    assert t.feature == [-1] and t.rows == [2] and t.label(0) == 1


@pytest.mark.parametrize("local_rows", [0, 40, 10_000])
def test_same_trees_whatever_part_one_task_grows(data, local_rows):
    df, x, y, f = data
    edges = tr.bin_edges(df.select("x"), 6, tr.BINS)
    for t in tr.grow(df, GROWTHS, 30, 2, features="x", fold="fold", local_rows=local_rows):
        own = f != t.growth.fold
        want = sorted(brute(x[own], y[own], t.growth, 30, 2, edges))
        assert sorted((t.number[k], t.rows[k], t.feature[k], t.threshold[k], None, None) for k in range(len(t.number))) == want


def test_driver_holds_large_nodes_only(data, monkeypatch):
    df = data[0]
    rows = tr._rows(df, "label", "x", "fold")
    trees, pending, _ = tr._grow(rows, GROWTHS, 30, 2, tr.BINS, 40)
    assert len(pending) > len(trees)
    for n, t in enumerate(trees):
        assert all(t.rows[k] > 40 for k in range(len(t.number)) if t.feature[k] >= 0)
    monkeypatch.setattr(tr, "WAVE_ROWS", 100)
    names, kw = list("abcdef"), dict(features="x", num_trees=5, weights=(3.0, 7.0))
    a, b = (dict(tr.extra_trees_importance(df, names, local_rows=n, **kw)) for n in (0, 40))
    assert a == pytest.approx(b) and sum(a.values()) == pytest.approx(1.0)
    grid = {"max_depth": [2, 5], "min_samples_split": [2, 20], "max_features": ["sqrt"], "splitter": ["best", "random"]}
    a, b = (tr.pre_pruned_grid(df, grid, features="x", local_rows=n) for n in (0, 40))
    assert list(a[1]) == pytest.approx(list(b[1])) and a[2] == b[2] and sorted(a[3].number) == sorted(b[3].number)


def test_equal_rows_move_once_and_a_level_is_one_step(data, monkeypatch):
    growths = [tr.Growth(s, 2, "gini", leaf, (1.0, 1.0), f) for s in ("best", "random") for leaf in (1, 5) for f in (0, 1, 2)]
    rows = tr._rows(data[0], "label", "x", "fold")
    trees, pending, _ = tr._grow(rows, growths, 20, 2, tr.BINS)
    assert pending == [(t, 0) for t in range(12)]
    assert [len(nodes) for _, nodes in tr._alike(trees, pending)] == [6, 6]  # roots hold the same rows, in one form per splitter
    trees, pending, _ = tr._grow(rows, growths, 20, 2, tr.BINS, 100)
    units = tr._alike(trees, pending)
    assert sorted(p for _, nodes in units for p in nodes) == sorted(pending) and any(len(nodes) > 1 for _, nodes in units)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(3_000, 6)), rng.integers(0, 2, 3_000)
    steps = []
    monkeypatch.setattr(tr, "impurity", lambda m, c, f=tr.impurity: steps.append(1) or f(m, c))
    for g in (tr.Growth("random", 2), tr.Growth("best", 2)):
        steps.clear()
        tree = tr._subtree(g, 1, tr._binned(x, np.sort(rng.normal(size=(6, 31)))) if g.splitter == "best" else x, y, 12, 2,
                           np.zeros((6, 31)) if g.splitter == "best" else np.zeros((6, 0)))
        assert len(tree.number) > 500 and len(steps) <= 13 * 2 * 3
