"""Gradients against finite differences, independence of partitions,
learning, null and empty inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstat.operators import network as nw

UNIT = 2.0 ** (nw.ACTIVATION_BITS + nw.ERROR_BITS)


def loss(layers, x, y, w, kept):
    for k, (a, b) in enumerate(layers[:-1]):
        x = np.maximum(x @ a + b, 0) * kept[k]
    p = 1 / (1 + np.exp(-(x @ layers[-1][0] + layers[-1][1])[:, 0]))
    return -(w * np.where(y == 1, np.log(p), np.log(1 - p))).sum()


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(4)
    widths = [5, 7, 4, 1]
    x, y, w = rng.normal(size=(40, 5)), rng.integers(0, 2, 40).astype(float), rng.uniform(0.5, 2, 40)
    kept = [(rng.random((40, n)) >= 0.5) * 2.0 for n in (7, 4)]
    flat = nw._flat(nw.initial(widths, 3)) + rng.normal(scale=0.1, size=5 * 7 + 7 + 7 * 4 + 4 + 4 + 1)
    got = nw.gradient(nw._shaped(flat, widths), x, y, w, kept)
    assert got.dtype == np.int64 and got[-1] / UNIT == pytest.approx(w.sum(), abs=1e-4)
    for k in range(len(flat)):
        ends = []
        for step in (1e-5, -1e-5):
            moved = flat.copy()
            moved[k] += step
            ends.append(loss(nw._shaped(moved, widths), x, y, w, kept))
        assert got[k] / UNIT == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=5e-3)


@pytest.fixture(scope="module")
def ring(spark):
    """Points inside a circle against those outside: no line parts them."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 3))
    y = (x[:, 0] ** 2 + x[:, 1] ** 2 < 1.2).astype(int)
    return spark.createDataFrame([(i, [float(a) for a in v], int(t), i % 3) for i, (v, t) in enumerate(zip(x, y))], "id int, x array<double>, label int, fold int").cache()


def test_same_at_any_partitioning(ring):
    kw = dict(key="id", features="x", hidden=(8, 4), epochs=2, steps=3)
    a, b = (nw.fit(ring.repartition(n), **kw)[None] for n in (1, 8))
    assert all(np.array_equal(p, q) for p, q in zip(a.layers[0] + a.layers[-1], b.layers[0] + b.layers[-1]))
    assert len(a.epochs) == 2


def test_learns_what_no_line_parts_and_shares_jobs_over_folds(ring):
    nets = nw.fit(ring, "id", features="x", hidden=(16, 8), epochs=25, steps=6, dropout=0.1, learning_rate=0.02, fold="fold")
    assert list(nets) == [None, 0, 1, 2]
    for fold in (0, 1, 2):
        scored = nets[fold].score(ring.where(F.col("fold") == fold), "x")
        assert scored.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("int"))).first()[0] > 0.9
    curve = sorted(nw.learning_curve(nets[0], {"train": ring.where("fold <> 0"), "valid": ring.where("fold = 0"), "none": ring.limit(0)}, features="x").collect())
    assert [(r.epoch, r.dataset) for r in curve] == [(e, d) for e in range(1, 26) for d in ("train", "valid")]
    first, last = ([r for r in curve if r.epoch == e and r.dataset == "train"][0] for e in (1, 25))
    assert last.loss < 0.6 * first.loss and last.accuracy > first.accuracy


def test_without_a_fold_is_a_fit_without_its_rows(ring):
    kw = dict(key="id", features="x", hidden=(4,), epochs=1, steps=2)
    a = nw.fit(ring, fold="fold", **kw)[1]
    b = nw.fit(ring.where("fold <> 1"), **kw)[None]
    assert all(np.array_equal(p, q) for la, lb in zip(a.layers, b.layers) for p, q in zip(la, lb))


def test_odd_rows(spark, ring):
    odd = spark.createDataFrame([(None, [1.0, 2.0, 3.0], 1, 0), (1, None, 1, 0), (2, [1.0, None, 2.0], 0, 0), (3, [float("nan"), 1.0, 1.0], 1, 1), (4, [1.0, 1.0, 1.0], None, 1)], ring.schema)
    kw = dict(key="id", features="x", hidden=(4,), epochs=1, steps=2)
    with_odd = nw.fit(ring.unionByName(odd.where("id > 0")), **kw)[None]
    assert np.array_equal(with_odd.layers[0][0], nw.fit(ring, **kw)[None].layers[0][0])
    rows = with_odd.score(odd, "x").collect()
    assert [r.score is None for r in rows if r.x is None] == [True]
    assert nw.fit(odd.limit(0), **kw)[None].epochs == []
    assert nw.fit(odd.where("id is null"), **kw)[None].epochs != []
