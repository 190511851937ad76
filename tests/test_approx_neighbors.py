"""Approximate nearest neighbours: recall, copies, cuts of hot cells."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabstat.operators import neighbors as nb
from tabstat.operators.approx_neighbors import _matrix, _vectors, _visits, approx_knn, directions, recall


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(a) for a in v] if v is not None else None) for i, v in zip(ids, x)], "id long, v array<double>").repartition(3)


def clustered(n, dim=16, groups=40, seed=2):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] * 4 + rng.normal(size=(n, dim)) * 0.5


def exact(x, q, k, skip=None):
    d = np.sqrt(((x - q) ** 2).sum(1))
    return [int(i) for i in np.lexsort((np.arange(len(x)), d)) if i != skip][:k]


def test_visits_are_the_least_costly_flips():
    rng = np.random.default_rng(0)
    margins = rng.normal(size=(20, 8))
    own, seen = _visits(margins, 24)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for i in range(20):
        side = (margins[i] > 0).astype(int)
        cost = (np.where(bits != side, margins[i] ** 2, 0)).sum(1)
        assert own[i] == (side << np.arange(8)).sum() and own[i] in seen[i]
        assert sorted(cost[seen[i]]) == pytest.approx(sorted(cost)[:24]) and len(set(seen[i])) == 24


def test_directions_are_orthonormal():
    a = directions(6, 10, 3, 1)
    assert a.shape == (3, 6, 10) and np.allclose(a[1][:, :6].T @ a[1][:, :6], np.eye(6))


@pytest.mark.parametrize("block", [8192, 60])
def test_recall_on_clustered_vectors(spark, block):
    x = clustered(1200)
    df = frame(spark, x)
    found = approx_knn(df, None, 4, "v", "id", exclude_self=True, block_rows=block)
    rows = recall(nb.knn(df, None, 4, "v", "id", exclude_self=True), found).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4] and all(r.recall >= 0.95 and r.pairs == 1200 for r in rows)
    got = found.collect()
    assert all(r.qid != r.tid and r.distance == pytest.approx(np.linalg.norm(x[r.qid] - x[r.tid])) for r in got)


def test_all_signs_visited_is_exact(spark):
    x = clustered(150, groups=5)
    got = approx_knn(frame(spark, x), None, 3, "v", "id", bits=4, probes=16, tables=1, block_rows=20).collect()
    near = {}
    for r in sorted(got, key=lambda r: (r.qid, r["rank"])):
        near.setdefault(r.qid, []).append(r.tid)
    assert near == {i: exact(x, x[i], 3) for i in range(len(x))}


def test_result_does_not_depend_on_blocks_or_partitions(spark):
    x = clustered(300)
    a = {tuple(r) for r in approx_knn(frame(spark, x), None, 3, "v", "id", bits=6, probes=4).collect()}
    b = {tuple(r) for r in approx_knn(frame(spark, x).repartition(7), None, 3, "v", "id", bits=6, probes=4).collect()}
    assert a == b
    cut = {(r.qid, r["rank"]): r.distance for r in approx_knn(frame(spark, x), None, 3, "v", "id", bits=6, probes=4, block_rows=7).collect()}
    assert cut == pytest.approx({(q, r): d for q, t, r, d in a})


def test_hot_copies_ties_and_odd_rows(spark):
    x = np.vstack([np.ones((400, 4)), clustered(100, dim=4, groups=3)])
    df = frame(spark, x).unionByName(frame(spark, [None, [1.0, float("nan"), 0, 0], [float("inf"), 0, 0, 0]], [900, 901, 902]))
    got = nb.knn(df, None, 3, "v", "id", exclude_self=True, approx=True, block_rows=50).collect()
    near = {}
    for r in sorted(got, key=lambda r: (r.qid, r["rank"])):
        near.setdefault(r.qid, []).append((r.tid, r.distance))
    assert set(near) == set(range(500))
    for q in range(400):  # copies: the smallest ids first, itself left out
        assert near[q] == [(i, 0.0) for i in range(5) if i != q][:3]
    assert approx_knn(df.where("id > 900"), None, 3, "v", "id").count() == 0
    other = approx_knn(df, df.where("id in (0, 450)").select(F.col("id").alias("key"), "v"), 2, "v", "id", query_id="key").collect()
    assert {r.qid for r in other} == {0, 450} and all(r.distance == 0 for r in other if r["rank"] == 1)


def test_plan_has_no_all_pairs_stage(spark):
    text = approx_knn(frame(spark, clustered(100)), None, 3, "v", "id")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_recall_on_structureless_vectors_of_many_rows(spark):
    x = np.random.default_rng(5).normal(size=(12_000, 48))
    df = frame(spark, x)
    some = df.where(F.col("id") % 100 == 0)
    rows = recall(nb.knn(df, some, 5, "v", "id", exclude_self=True), approx_knn(df, some, 5, "v", "id", exclude_self=True)).collect()
    assert sum(r.pairs for r in rows) == 600 and sum(r.hits for r in rows) >= 0.9 * 600


def test_search_queries_ask_every_hundredth_id(spark, tmp_path):
    from tabstat.plans.registry import QUERIES

    x = clustered(300)
    spark.createDataFrame([(i, [float(a) for a in v], i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.qid for r in QUERIES["knn_approx"](spark, str(tmp_path)).collect()} == {0, 100, 200}
    assert all(r.pairs == 3 for r in QUERIES["knn_approx_recall"](spark, str(tmp_path)).collect())


def embeddings(spark, path, x, ids=None):
    rows = [(i, [float(a) for a in v], n % 3) for n, (i, v) in enumerate(zip(range(len(x)) if ids is None else ids, x))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")


def test_knn_approx_asks_every_vector(spark, tmp_path):
    from tabstat.plans.registry import QUERIES

    x = clustered(250).astype(np.float32).astype(float)
    embeddings(spark, tmp_path, x, ids=range(7, 757, 3))
    got = QUERIES["knn_approx"](spark, str(tmp_path)).collect()
    assert {(r.qid, r["rank"]) for r in got} == {(i, r) for i in range(7, 757, 3) for r in range(1, 6)}
    assert all(r.qid != r.tid and r.distance == pytest.approx(np.linalg.norm(x[(r.qid - 7) // 3] - x[(r.tid - 7) // 3]), abs=1e-4) for r in got)


def test_knn_approx_recall_counts_every_vector(spark, tmp_path):
    from tabstat.plans.registry import QUERIES

    embeddings(spark, tmp_path, clustered(250), ids=range(7, 757, 3))
    rows = QUERIES["knn_approx_recall"](spark, str(tmp_path)).collect()
    assert {r["rank"]: r.pairs for r in rows} == dict.fromkeys(range(1, 6), 250) and all(r.recall >= 0.95 for r in rows)


def test_floats_stay_floats_with_the_results_of_doubles(spark):
    x = np.vstack([clustered(300).astype(np.float32), np.zeros((2, 16), np.float32), np.full((2, 16), -0.0, np.float32)]).astype(float)
    wide = frame(spark, x)
    narrow = wide.withColumn("v", F.col("v").cast("array<float>"))
    assert _vectors(narrow, "v", "id").schema["v"].dataType.elementType.typeName() == "float"
    want = sorted(map(tuple, approx_knn(wide, None, 3, "v", "id", bits=6, probes=4, block_rows=40).collect()))
    assert sorted(map(tuple, approx_knn(narrow, None, 3, "v", "id", bits=6, probes=4, block_rows=40).collect())) == want
    assert sorted(map(tuple, approx_knn(narrow, wide, 3, "v", "id", bits=6, probes=4).collect())) == want


def test_vectors_of_two_lengths_fail():
    assert _matrix(pa.array([[1.0, 2.0], [3.0, 4.0]]).slice(1), 2).tolist() == [[3.0, 4.0]]
    with pytest.raises(ValueError):
        _matrix(pa.array([[1.0], [2.0, 3.0, 4.0]]), 2)


@pytest.mark.parametrize("block", [None, 13])
def test_silhouette_by_pairs_of_blocks(spark, block):
    x = clustered(90, dim=3, groups=4)
    c = [None if i % 11 == 0 else i % 3 for i in range(90)]
    ids = [i // 2 if i < 10 else i for i in range(90)]  # equal ids count as one point without distance
    df = spark.createDataFrame([(i, [float(a) for a in v], k) for i, v, k in zip(ids, x, c)], "id long, v array<double>, c int").repartition(3)
    alone = df.where("id >= 10")
    row = nb.silhouette(alone, "v", "c", "id", block_rows=block).first()
    own, total = np.array([-1 if k is None else k for k in c])[10:], 0.0
    d = np.sqrt(((x[10:, None] - x[None, 10:]) ** 2).sum(-1))
    for i, k in enumerate(own):
        if k >= 0:
            a = d[i, own == k].sum() / ((own == k).sum() - 1)
            b = min(d[i, own == j].mean() for j in range(3) if j != k)
            total += (b - a) / max(a, b)
    assert row.n == 80 and row.silhouette == pytest.approx(total / 80)
    assert nb._runs(np.array([0.0, 0.0, 2.0, np.nan]))[:2] == [(0.0, 0, 2), (2.0, 2, 3)]
    assert nb.silhouette(df, "v", "c", "id", block_rows=block).first().silhouette == pytest.approx(nb.silhouette(df, "v", "c", "id", block_rows=500).first().silhouette)
