"""Exact Euclidean k-nearest neighbours and silhouette.

Exact search is a blocked all-pairs computation that never materialises
pairs as rows:

* every query row gets a query block ``qb = xxhash64(id) mod Q`` and every
  reference row a block ``tb = xxhash64(id) mod T``; T and Q come from the
  counted row numbers and a fixed block size, so a task holds two blocks of
  about ``BLOCK_ROWS`` rows and a ``CHUNK_ROWS`` x ``BLOCK_ROWS`` slice of
  distances at any size; the shuffle carries n·Q + m·T rows;
* query rows are replicated once per reference block and reference rows
  once per query block (an equi-join key, not a cross join), so each
  (tb, qb) cell is one cogroup task holding two bounded blocks;
* a numpy kernel inside the task computes the block of distances and emits
  only each query's k best (kNN) or per-cluster distance sums
  (silhouette);
* the per-query merge keeps at most k·T candidates.

Total work is the inherent n·m·d of exact search, spread over T·Q tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabstat.session import ship_package

BLOCK_ROWS = 8192      # rows of a block, whatever the size of the table
CHUNK_ROWS = 1024      # query rows per distance matrix inside a cell
SILHOUETTE_ROWS = 24_576   # rows of a block of the exact silhouette
PAIRS = 1 << 22        # distances that such a task holds at once


def vector_column(df: DataFrame, features: str | Sequence[str]) -> Column:
    """array<double> from one array column or a list of numeric columns."""
    if isinstance(features, str):
        dt = dict(df.dtypes)[features]
        if dt.startswith("array"):
            return F.col(features).cast("array<double>")
        return F.array(F.col(features).cast("double"))
    return F.array(*[F.col(c).cast("double") for c in features])


def _blocks(n: int, block_rows: int | None) -> int:
    """Number of blocks of about ``block_rows`` rows: what a task holds does
    not depend on n, the number of tasks does."""
    return max(1, math.ceil(n / (block_rows or BLOCK_ROWS)))


def _block_of(col: str, nblocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(col), F.lit(seed)), F.lit(nblocks)).cast("int")


def _stack(vs) -> np.ndarray:
    if len(vs) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in vs])


def _sq_dist(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    d2 = (q * q).sum(1)[:, None] + (t * t).sum(1)[None, :] - 2.0 * (q @ t.T)
    return np.maximum(d2, 0.0)


def knn(reference: DataFrame, query: DataFrame | None, k: int, features: str | Sequence[str],
        ref_id: str, query_id: str | None = None, exclude_self: bool = False,
        block_rows: int | None = None, seed: int = 17, approx: bool = False) -> DataFrame:
    """K1: the k nearest reference rows of every query row, exact unless
    ``approx`` asks for the multi-probe search of ``approx_neighbors``.

    Output (qid, tid, rank, distance); ties broken by reference id; k > n
    returns all n. ``query=None`` searches the reference against itself;
    ``exclude_self`` drops the pair with equal ids.
    """
    if approx:
        from tabstat.operators.approx_neighbors import approx_knn

        return approx_knn(reference, query, k, features, ref_id, query_id, exclude_self, block_rows=block_rows or BLOCK_ROWS, seed=seed)
    query_id = query_id or ref_id
    q_src = reference if query is None else query
    tr = reference.select(F.col(ref_id).cast("long").alias("_tid"), vector_column(reference, features).alias("_tv"))
    qr = q_src.select(F.col(query_id).cast("long").alias("_qid"), vector_column(q_src, features).alias("_qv"))
    nt, nq = tr.count(), qr.count()
    T, Q = _blocks(nt, block_rows), _blocks(nq, block_rows)
    tr = tr.withColumn("_tb", _block_of("_tid", T, seed)).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(Q - 1))))
    qr = qr.withColumn("_qb", _block_of("_qid", Q, seed + 1)).withColumn("_tb", F.explode(F.sequence(F.lit(0), F.lit(T - 1))))
    kk = k + (1 if exclude_self else 0)

    def cell(qpdf: pd.DataFrame, tpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or tpdf.empty:
            return pd.DataFrame({"_qid": [], "_tid": [], "_d2": []})
        qv_all, tv = _stack(qpdf["_qv"].tolist()), _stack(tpdf["_tv"].tolist())
        qid_all, tid = qpdf["_qid"].to_numpy(), tpdf["_tid"].to_numpy()
        m = min(kk, tv.shape[0])
        tnorm_max = (tv * tv).sum(1).max()
        out_q, out_t, out_d = [], [], []
        for c0 in range(0, qv_all.shape[0], CHUNK_ROWS):  # bounded memory per cell
            qv, qid = qv_all[c0:c0 + CHUNK_ROWS], qid_all[c0:c0 + CHUNK_ROWS]
            d2 = _sq_dist(qv, tv)
            if exclude_self:
                d2 = np.where(qid[:, None] == tid[None, :], np.inf, d2)
            # the expansion carries rounding noise: keep every candidate within
            # an error band of the k-th value, then rank by exact distance and id
            kth = np.partition(d2, m - 1, axis=1)[:, m - 1]
            tol = 1e-9 * ((qv * qv).sum(1) + tnorm_max) + 1e-300
            for i in range(d2.shape[0]):
                if not np.isfinite(kth[i]):
                    idx = np.nonzero(np.isfinite(d2[i]))[0]
                else:
                    idx = np.nonzero(d2[i] <= kth[i] + tol[i])[0]
                if idx.size == 0:
                    continue
                diff = tv[idx] - qv[i]
                exact = np.sqrt((diff * diff).sum(1))  # rank on the distance itself
                order = np.lexsort((tid[idx], exact))[:m]
                out_q.append(np.full(order.size, qid[i]))
                out_t.append(tid[idx][order])
                out_d.append(exact[order])
        if not out_q:
            return pd.DataFrame({"_qid": [], "_tid": [], "_d2": []})
        out_q, out_t, out_d = np.concatenate(out_q), np.concatenate(out_t), np.concatenate(out_d)
        return pd.DataFrame({"_qid": out_q, "_tid": out_t, "_d2": out_d})

    cand = qr.groupBy("_tb", "_qb").cogroup(tr.groupBy("_tb", "_qb")).applyInPandas(
        cell, "_qid long, _tid long, _d2 double")
    w = Window.partitionBy("_qid").orderBy("_d2", "_tid")  # at most k·T rows per query
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("_qid").alias("qid"), F.col("_tid").alias("tid"), F.col("rank").cast("int").alias("rank"),
                      F.col("_d2").alias("distance"))


def knn_classify(reference: DataFrame, query: DataFrame | None, k: int, features, ref_id: str, label: str,
                 query_id: str | None = None, exclude_self: bool = False, positive=None,
                 block_rows: int | None = None) -> DataFrame:
    """K1 vote: majority label of the k nearest (ties -> smallest label).

    Output (qid, pred, prob): prob is the vote share of ``positive`` when
    given, else of the predicted label.
    """
    nn = knn(reference, query, k, features, ref_id, query_id, exclude_self, block_rows)
    labels = reference.select(F.col(ref_id).cast("long").alias("tid"), F.col(label).alias("_lab"))
    votes = nn.join(labels, "tid").groupBy("qid", "_lab").agg(F.count(F.lit(1)).alias("_v"))
    tot = F.sum("_v")
    best = votes.groupBy("qid").agg(F.min(F.struct((-F.col("_v")).alias("nv"), F.col("_lab").alias("lab"))).alias("_b"),
                                    tot.alias("_n"),
                                    F.sum(F.when(F.col("_lab") == F.lit(positive), F.col("_v")).otherwise(0)).alias("_p")
                                    if positive is not None else F.lit(None).alias("_p"))
    prob = (F.col("_p") / F.col("_n")) if positive is not None else (-F.col("_b.nv") / F.col("_n"))
    return best.select("qid", F.col("_b.lab").alias("pred"), prob.cast("double").alias("prob"))


def knn_error_curve(reference: DataFrame, ks: Sequence[int], features, ref_id: str, label: str,
                    query: DataFrame | None = None, query_id: str | None = None,
                    exclude_self: bool = True) -> DataFrame:
    """K2: error rate of the k-NN vote for every k in ``ks`` from one
    max(ks)-NN pass (a neighbour of rank r votes for every k >= r)."""
    ks = sorted(set(int(x) for x in ks))
    kmax = ks[-1]
    q_src = reference if query is None else query
    qid_col = query_id or ref_id
    nn = knn(reference, query, kmax, features, ref_id, query_id, exclude_self)
    labels = reference.select(F.col(ref_id).cast("long").alias("tid"), F.col(label).alias("_lab"))
    truth = q_src.select(F.col(qid_col).cast("long").alias("qid"), F.col(label).alias("_true"))
    ks_arr = F.array(*[F.lit(x) for x in ks])
    votes = (nn.join(labels, "tid")
             .select("qid", "_lab", F.explode(F.filter(ks_arr, lambda x: x >= F.col("rank"))).alias("k"))
             .groupBy("qid", "k", "_lab").agg(F.count(F.lit(1)).alias("_v")))
    pred = votes.groupBy("qid", "k").agg(F.min(F.struct((-F.col("_v")).alias("nv"), F.col("_lab").alias("lab")))
                                         .alias("_b"))
    return (pred.join(truth, "qid")
            .groupBy("k").agg(F.avg((F.col("_b.lab") != F.col("_true")).cast("double")).alias("error"))
            .select(F.col("k").cast("int").alias("k"), "error"))


def _runs(clusters: np.ndarray) -> list[tuple]:
    """(cluster, start, stop) of sorted clusters; rows without one, which are
    the last, are an empty run."""
    known = clusters[~np.isnan(clusters)] if clusters.dtype.kind == "f" else clusters
    names, starts = np.unique(known, return_index=True)
    return [*zip(names, starts, [*starts[1:], len(known)]), *([(np.nan, len(known), len(known))] if len(known) < len(clusters) else [])]


def silhouette(df: DataFrame, features, cluster: str, id_col: str, block_rows: int | None = None,
               seed: int = 23) -> DataFrame:
    """Exact mean Euclidean silhouette (one row: silhouette, n).

    a(i) = mean distance to its own cluster (self excluded), b(i) = lowest
    mean distance to another cluster, s(i) = (b - a)/max(a, b), and 0 for
    singleton clusters. Each task compares one unordered pair of blocks of
    ``SILHOUETTE_ROWS`` rows and emits per (point, cluster) distance sums only,
    for the points of both blocks: n²/2 distances, n times the number of blocks
    of rows in the shuffle.
    """
    pts = df.select(F.col(id_col).cast("long").alias("_id"), vector_column(df, features).alias("_v"),
                    F.col(cluster).cast("long").alias("_c"))
    n = pts.count()
    B = _blocks(n, block_rows or SILHOUETTE_ROWS)
    # one cell a pair of blocks: its distances serve the rows of both sides
    own_block = pts.withColumn("_tb", _block_of("_id", B, seed))
    left = own_block.withColumn("_qb", F.col("_tb")).withColumn("_tb", F.explode(F.sequence(F.col("_qb"), F.lit(B - 1))))
    right = own_block.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_tb"))))

    def cell(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({"_id": [], "_c": [], "_s": [], "_n": []})
        same = lp["_qb"].iloc[0] == rp["_tb"].iloc[0]  # equal ids share a block
        lp, rp = lp.sort_values("_c", kind="stable"), rp.sort_values("_c", kind="stable")
        lv, rv = _stack(lp["_v"].tolist()), _stack(rp["_v"].tolist())
        lid, rid = lp["_id"].to_numpy(), rp["_id"].to_numpy()
        lc, rc = _runs(lp["_c"].to_numpy()), _runs(rp["_c"].to_numpy())
        rnorm, lnorm = (rv * rv).sum(1), (lv * lv).sum(1)
        to_right, to_left = np.zeros((len(lp), len(rc))), np.zeros((len(rp), len(lc)))
        step = max(1, PAIRS // len(rp))
        for c0 in range(0, len(lp), step):  # bounded memory per cell
            d = lv[c0:c0 + step] @ rv.T
            d *= -2.0
            d += lnorm[c0:c0 + step, None]
            d += rnorm[None, :]
            np.sqrt(np.maximum(d, 0.0, out=d), out=d)
            if same:
                d[lid[c0:c0 + step, None] == rid[None, :]] = 0.0
            for j, (_, a, b) in enumerate(rc):
                to_right[c0:c0 + step, j] = d[:, a:b].sum(1)
            for j, (_, a, b) in enumerate(lc if not same else ()):
                a, b = max(a - c0, 0), min(b - c0, len(d))
                if a < b:
                    to_left[:, j] += d[a:b].sum(0)
        parts = [(lid, c, to_right[:, j], b - a) for j, (c, a, b) in enumerate(rc)]
        parts += [(rid, c, to_left[:, j], b - a) for j, (c, a, b) in enumerate(lc if not same else ())]
        return pd.DataFrame({"_id": np.concatenate([ids for ids, *_ in parts]), "_c": np.concatenate([np.full(len(ids), c) for ids, c, *_ in parts]),
                             "_s": np.concatenate([s for _, _, s, _ in parts]), "_n": np.concatenate([np.full(len(ids), m) for ids, _, _, m in parts])})

    sums = left.groupBy("_qb", "_tb").cogroup(right.groupBy("_qb", "_tb")).applyInPandas(
        cell, "_id long, _c long, _s double, _n long")
    per = sums.groupBy("_id", "_c").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    own = pts.select("_id", F.col("_c").alias("_own"))
    j = per.join(own, "_id")
    stats = j.groupBy("_id").agg(
        F.max(F.when((F.col("_c") == F.col("_own")) & (F.col("_n") > 1), F.col("_s") / (F.col("_n") - 1))).alias("a"),
        F.max(F.when(F.col("_c") == F.col("_own"), F.col("_n"))).alias("own_n"),
        F.min(F.when(F.col("_c") != F.col("_own"), F.col("_s") / F.col("_n"))).alias("b"))
    s = F.when((F.col("own_n") <= 1) | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise(
        (F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return stats.agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def stratified_mean(values: dict, sizes: dict) -> tuple[float, float]:
    """Mean and standard error of a value of which some members of each stratum
    are known: strata weighted by size, sampled without replacement. A stratum
    with one known member takes the pooled variance."""
    n = sum(sizes.values())
    known = {c: np.asarray(v, float) for c, v in values.items()}
    free = sum(max(len(v) - 1, 0) for v in known.values())
    pooled = sum(((v - v.mean()) ** 2).sum() for v in known.values()) / free if free else 0.0
    mean = sum(sizes[c] / n * v.mean() for c, v in known.items())
    var = sum((sizes[c] / n) ** 2 * (v.var(ddof=1) if len(v) > 1 else pooled) / len(v) * (1 - len(v) / sizes[c]) for c, v in known.items())
    return float(mean), math.sqrt(max(var, 0.0))


def silhouette_sampled(df: DataFrame, features, cluster: str, id_col: str, anchors: int = 200, seed: int = 23) -> DataFrame:
    """U3 in linear time: mean Euclidean silhouette from ``anchors`` points of
    each cluster (those of least hash; all points of a smaller one).

    An anchor's own silhouette is exact: one pass over the table adds up the
    distances from every row to all anchors (a small broadcast table, clusters
    x anchors rows) by (anchor, cluster). The mean is weighted by the sizes of
    the clusters. One row: silhouette, std_error, lo, hi (1.96 standard errors
    either way), n, n_anchors; with every point an anchor the error is 0 and
    the value that of ``silhouette``. Rows with a null id, cluster or vector
    take no part; without rows the values are null.
    """
    from tabstat.operators.features import bounded_points

    ship_package(df.sparkSession)
    pts = df.select(F.col(id_col).cast("long").alias("_id"), vector_column(df, features).alias("_v"), F.col(cluster).cast("long").alias("_c")).na.drop()
    picked = bounded_points(pts, ["_v"], "_id", anchors, by=["_c"], unit=F.xxhash64("_id", F.lit(seed))).orderBy("_c", "_id").collect()
    schema = "silhouette double, std_error double, lo double, hi double, n long, n_anchors long"
    if not picked:
        return df.sparkSession.createDataFrame([(None, None, None, None, 0, 0)], schema)
    av, aid, ac = np.array([r["_v"] for r in picked]), np.array([r["_id"] for r in picked]), np.array([r["_c"] for r in picked])
    sizes = {r["_c"]: r["n"] for r in picked}
    order = sorted(sizes)

    def part(batches):
        total = np.zeros((len(av), len(order)))
        for b in batches:
            for c0 in range(0, len(b), CHUNK_ROWS):
                own = b.iloc[c0:c0 + CHUNK_ROWS]
                v = _stack(own["_v"].tolist())
                diff = np.sqrt(_sq_dist(v, av))
                diff[own["_id"].to_numpy()[:, None] == aid[None, :]] = 0.0
                for j, c in enumerate(order):
                    total[:, j] += diff[own["_c"].to_numpy() == c].sum(0)
        a, c = np.indices(total.shape)
        yield pd.DataFrame({"a": a.ravel(), "c": c.ravel(), "s": total.ravel()})

    sums = np.zeros((len(av), len(order)))
    for r in pts.mapInPandas(part, "a long, c long, s double").groupBy("a", "c").agg(F.sum("s").alias("s")).collect():
        sums[r["a"], r["c"]] = r["s"]
    counts = np.array([sizes[c] for c in order], float)
    at = np.array([order.index(c) for c in ac])
    rows = np.arange(len(av))
    own = counts[at] - 1
    a = np.divide(sums[rows, at], own, out=np.zeros(len(av)), where=own > 0)
    other = sums / counts
    other[rows, at] = np.inf
    b = other.min(1)
    top = np.maximum(a, b)
    s = np.where((own > 0) & np.isfinite(b) & (top > 0), (np.where(np.isfinite(b), b, 0) - a) / np.where((top > 0) & np.isfinite(top), top, 1), 0.0)
    mean, error = stratified_mean({c: s[ac == c] for c in order}, sizes)
    row = (mean, error, mean - 1.96 * error, mean + 1.96 * error, int(sum(sizes.values())), len(av))
    return df.sparkSession.createDataFrame([row], schema)


def silhouette_squared(df: DataFrame, features, cluster: str) -> float:
    """U3 at scale: MLlib's silhouette with squared Euclidean distance
    (O(n) via per-cluster sums; a different number from the Euclidean
    silhouette above, which is exact but O(n²))."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = df.select(array_to_vector(vector_column(df, features)).alias("_f"),
                     F.col(cluster).cast("double").alias("_c"))
    ev = ClusteringEvaluator(featuresCol="_f", predictionCol="_c", metricName="silhouette",
                             distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(data))
