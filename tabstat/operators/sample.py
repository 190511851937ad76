"""Deterministic splits, stratified folds and SMOTE.

Splits and folds order rows by a portable hash of their key (the same number
in any SQL engine), ties by the key. Exact sizes need only the (hash, key) at
a few ranks of that order: the hash is close to uniform, so a rank lies in a
narrow band around its share of the hash range; rows below the band are
counted and only the band (about sqrt(n) rows) is sorted. Rows are then
assigned map-side by comparing with the bound; no row is moved. A band that
misses its rank is widened until it holds it. Rows of a band are counted by key
before they are ordered, so a key of many rows is one entry.

A row whose key is null has no place in the order: it counts in no group, and
is a training row, of fold 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabstat.operators.features import sample_unit
from tabstat.operators.neighbors import knn, vector_column
from tabstat.operators.rank import _as_list, broadcast_if_small, global_rank


def _same(left: str, right: str, by: Sequence[str]) -> list:
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by]


def _with_bounds(df: DataFrame, key: str, seed: int, by: Sequence[str], targets) -> DataFrame:
    """Adds ``_bounds``, an array<struct<u, key>> of the order's entries at
    ``targets(n)``, a list of ranks, for the row's group of n rows, and the
    row's own ``_at``. Groups (classes) are collected, rows are not."""
    spark = df.sparkSession
    types = dict(df.dtypes)
    base = df.where(F.col(key).isNotNull()).select(*by, sample_unit(key, seed).alias("_u"), F.col(key).alias("_k"))
    groups = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()
    found: dict[tuple, tuple] = {}
    width = 8.0
    while True:
        rows = []
        for g in groups:
            own = tuple(g[c] for c in by)
            for j, rank in enumerate(targets(g["n"])):
                if (own, j) in found or not 1 <= rank <= g["n"]:
                    continue
                p = rank / g["n"]
                d = width * (math.sqrt(p * (1 - p) / g["n"]) + 1 / g["n"])
                rows.append((*own, j, rank, p - d, p + d))
        if not rows:
            break
        if by:
            schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "_j int", "_rank long", "_lo double", "_hi double"])
            want = F.broadcast(spark.createDataFrame(rows, schema))  # a row per class and target
            met = base.alias("_b").join(want.alias("_w"), _same("_b", "_w", by)).select(
                *[F.col(f"_w.{c}") for c in by], "_u", "_k", "_j", "_rank", "_lo", "_hi")
        else:
            want = [F.struct(F.lit(j).alias("_j"), F.lit(rank).cast("long").alias("_rank"), F.lit(lo).alias("_lo"), F.lit(hi).alias("_hi"))
                    for j, rank, lo, hi in rows]
            met = base.select("_u", "_k", F.explode(F.array(*want)).alias("_w")).select("_u", "_k", "_w.*")
        below = met.where("_u < _lo").groupBy(*by, "_j").agg(F.count(F.lit(1)).alias("_below"))
        order = Window.partitionBy(*by, "_j").orderBy("_u", "_k")
        band = met.where("_u >= _lo and _u <= _hi").groupBy(*by, "_j", "_rank", "_u", "_k").agg(F.count(F.lit(1)).alias("_c"))
        band = band.withColumn("_in", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        hit = (band.alias("_x").join(below.alias("_y"), [*_same("_x", "_y", by), F.col("_x._j") == F.col("_y._j")], "left")
               .withColumn("_to", F.col("_in") + F.coalesce("_below", F.lit(0)))
               .where((F.col("_to") >= F.col("_rank")) & (F.col("_to") - F.col("_c") < F.col("_rank")))
               .select(*[F.col(f"_x.{c}") for c in by], F.col("_x._j").alias("_j"), "_u", "_k"))
        for r in hit.collect():
            found[(tuple(r[c] for c in by), r["_j"])] = (r["_u"], r["_k"])
        width *= 16
    kind = f"array<struct<u:double,k:{types[key]}>>"
    tagged = df.withColumn("_at", F.when(F.col(key).isNotNull(), F.struct(sample_unit(key, seed).alias("u"), F.col(key).alias("k"))))
    bounds = [(*(g[c] for c in by), [found.get((tuple(g[c] for c in by), j)) for j in range(len(targets(g["n"])))]) for g in groups]
    if not by:
        ends = [F.struct(F.lit(x[0]).alias("u"), F.lit(x[1]).alias("k")) if x else F.lit(None) for x in (bounds[0][0] if bounds else [])]
        return tagged.withColumn("_bounds", F.array(*ends).cast(kind))
    side = F.broadcast(spark.createDataFrame(bounds, ", ".join([*(f"`{c}` {types[c]}" for c in by), f"_bounds {kind}"])))  # a row per class
    return tagged.alias("_t").join(side.alias("_s"), _same("_t", "_s", by)).select("_t.*", "_s._bounds")


def split_column(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 1729,
                 by: Sequence[str] | str | None = None, exact: bool = True, out: str = "split") -> DataFrame:
    """Tag rows 'train' / 'test'.

    ``exact``: per group (``by``) the first ceil(f·n) rows in hash order are
    test (like a shuffled split of exact size); otherwise a hash threshold.
    Rows that share a key stay together.
    """
    if not exact:
        return df.withColumn(out, F.when(sample_unit(key, seed) < test_fraction, "test").otherwise("train"))
    bounded = _with_bounds(df, key, seed, _as_list(by), lambda n: [math.ceil(n * test_fraction)])
    return bounded.withColumn(out, F.when(F.col("_at") <= F.col("_bounds")[0], "test").otherwise("train")).drop("_at", "_bounds")


def split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 1729,
          exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(train, test) of exact sizes n - ceil(f·n) and ceil(f·n)."""
    s = split_column(df, key, test_fraction, seed, exact=exact)
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


def stratified_split(df: DataFrame, key: str, label: str, test_fraction: float = 0.2,
                     seed: int = 1729) -> tuple[DataFrame, DataFrame]:
    """Class shares preserved (ceil(f·n_c) test rows per class)."""
    s = split_column(df, key, test_fraction, seed, by=[label])
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 1729,
                     out: str = "fold") -> DataFrame:
    """Fold id 0..k-1: floor((r - 1)·k / n_c) of the row's rank r in its
    class's hash order, so every fold holds floor or ceil of n_c/k rows of
    each class."""
    bounded = _with_bounds(df, key, seed, [label], lambda n: [-(-j * n // k) for j in range(1, k)])
    above = F.filter("_bounds", lambda b: b.isNotNull() & (F.col("_at") > b))
    return bounded.withColumn(out, F.size(above).cast("int")).drop("_at", "_bounds")


def smote(df: DataFrame, label: str, features: str | Sequence[str], key: str, k: int = 5, seed: int = 1729,
          minority=None, out: str = "features") -> DataFrame:
    """T4: oversample the minority class to parity.

    Synthetic row j: a base minority row chosen by hash, one of its k
    nearest minority neighbours chosen by hash, and a hash-uniform gap g:
    x = base + g·(neighbour - base). Output (key, label, features array,
    synthetic flag): original rows keep their key, synthetic rows get NULL.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if len(counts) < 2:
        raise ValueError("smote needs at least two classes")
    if minority is None:
        minority = min(counts, key=lambda c: (counts[c], c))
    n_min = counts[minority]
    need = max(counts.values()) - n_min
    base = df.select(F.col(key).cast("long").alias("_id"), F.col(label).alias("_lab"),
                     vector_column(df, features).alias(out))
    orig = base.select(F.col("_id").alias(key), F.col("_lab").alias(label), out, F.lit(False).alias("synthetic"))
    if need == 0 or n_min < 2:
        return orig
    mino = base.where(F.col("_lab") == F.lit(minority))
    kk = min(k, n_min - 1)
    nn = knn(mino, None, kk, out, "_id", exclude_self=True)          # minority self-kNN
    idx = global_rank(mino.select("_id"), ["_id"], rank_col="_pos")   # 1..n_min
    idx_small, _ = broadcast_if_small(idx)
    j = df.sparkSession.range(need).select(F.col("id").alias("_j"))
    j = j.select("_j",
                 (F.pmod(F.xxhash64("_j", F.lit(seed)), F.lit(n_min)) + 1).alias("_pos"),
                 (F.pmod(F.xxhash64("_j", F.lit(seed + 1)), F.lit(kk)) + 1).cast("int").alias("rank"),
                 (F.pmod(F.xxhash64("_j", F.lit(seed + 2)), F.lit(1 << 30)).cast("double") / float(1 << 30)).alias("_g"))
    vec = mino.select(F.col("_id"), F.col(out).alias("_v"))
    syn = (j.join(idx_small, "_pos")
           .join(nn.select(F.col("qid").alias("_id"), "rank", F.col("tid").alias("_nid")), ["_id", "rank"])
           .join(vec, "_id")
           .join(vec.select(F.col("_id").alias("_nid"), F.col("_v").alias("_nv")), "_nid"))
    syn = syn.select(F.lit(None).cast("long").alias(key), F.lit(minority).alias(label),
                     F.zip_with("_v", "_nv", lambda a, b: a + F.col("_g") * (b - a)).alias(out),
                     F.lit(True).alias("synthetic"))
    return orig.unionByName(syn)
