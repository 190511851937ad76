"""Operator 5 against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from tabstat.llm import top_k


def brute(rows, k, every):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            best = sorted(((sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q), key=lambda s: (-s[0], s[1]))[:k]
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 24)))]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2002, [None] * 24), (2004, [float("nan")] * 24), (2006, [float("inf")] + [0.0] * 23), (None, rows[1][1]), (2008, [1e6] * 24), (2010, [1.0, 2.0]), (2012, []), (7, rows[5][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0)).repartition(4)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k.top_k(frame, F.col("vec_id") % 10 == 0, 5).collect())
    assert got == brute(rows, 5, 10)


def test_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [0.5])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k.top_k(frame, F.col("vec_id") % 20 == 0).collect()) == [(0, 1, 1, 8192), (0, 2, 20, 2048), (20, 1, 1, 4096), (20, 2, 0, 2048)]
    assert top_k.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_bound_holds():
    rng = np.random.default_rng(4)
    q, x = rng.integers(-64, 64, (40, 50)).astype(float), rng.integers(-64, 64, (60, 50)).astype(float)
    last = None
    for s in top_k.levels(50):
        bound = top_k.statistics(q, s) @ top_k.statistics(x, s).T
        assert (bound >= q @ x.T - 1e-6).all()
        last = bound if last is None else last
    assert len(top_k.levels(50)) == 3
