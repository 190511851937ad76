"""Operator 5: exact top-k inner products by multi-resolution segment statistics.

A vector is cut into S equal segments at each resolution S = 1, 2, 4, ...
For two vectors the squared distance is at least

    sum over segments of  len * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2),

and the inner product (|q|^2 + |x|^2 - d^2) / 2 is therefore at most the inner
product of the vectors' segment statistics (mean and deviation, times the root
of the length). Each finer resolution gives a bound at least as tight.

Work goes block by block: the queries in blocks of QUERIES, all rows in blocks
of ROWS. One task holds one pair of blocks. It bounds every pair at the
coarsest resolution, keeps the rows whose bound reaches some query's
threshold, goes on to the next finer one, and computes exact integer products
for the survivors. A query's threshold starts at its k-th best product with
the longest SEED rows (any k rows give a valid one) and rises with what the
task finds. A task gives each query's k best rows of its block that reach the
threshold; the best k of those are the result. The bounds only skip work.

Defined results: components become floor(64 * x) in double; vectors that are
null or hold null or non-finite components take no part; vectors of different
lengths are compared as if the shorter ended in zeros; repeated rows count as
rows, but rows with a query's own id are not its candidates; rows with a null
id take no part; ties go to the smaller id; fewer than k candidates give fewer
rows; an empty table gives an empty result. Scores must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabstat.llm.common import prepare, written

QUERIES, ROWS, SEED = 512, 4096, 1024
#: Slack of the bounds against rounding, relative to their size.
SLACK = 1e-9


def levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine, below the dimension."""
    return [s for s in (2, 8, 16) if s * 2 <= dim]


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, times the root of their length."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    length = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / length
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / length
    return np.hstack([mean, np.sqrt(np.maximum(square - mean ** 2, 0))]) * np.sqrt(np.tile(length, 2))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2 ** 53:  # every partial sum is an exact double
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return np.einsum("id,jd->ij", q, x)


def best(query_ids, q, row_ids, x, threshold, k: int):
    """(query, row, score) of each query's k best rows that reach its threshold."""
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    rows = np.arange(len(x))
    for s in levels(q.shape[1]):
        if not len(rows):
            break
        bound = statistics(qf, s) @ statistics(xf[rows], s).T
        bound += np.abs(bound) * SLACK + SLACK
        rows = rows[(bound >= threshold[:, None]).any(axis=0)]
    if not len(rows):
        return []
    score = products(q, x[rows])
    ids = row_ids[rows]
    own = ids[None, :] == query_ids[:, None]
    out = []
    for i in range(len(q)):
        s = score[i]
        keep = np.flatnonzero((s >= threshold[i]) & ~own[i])
        if len(keep) > k:
            floor = np.partition(s[keep], len(keep) - k)[len(keep) - k]
            keep = keep[s[keep] >= floor]
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out += [(query_ids[i], ids[keep[j]], s[keep[j]]) for j in order]
    return out


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>, norm): the vectors that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    plain = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | F.abs(x).eqNullSafe(F.lit(float("inf"))))
    return (vectors.where(F.col("vec_id").isNotNull() & plain).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
            .withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def packed(v: list[int]) -> bytes:
    """The integers in the narrowest width that holds them, the width first."""
    x = np.array(v, np.int64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or max(-int(x.min()) - 1, int(x.max())) < 1 << (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _matrix(values: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(values), dim), np.int64)
    for k, v in enumerate(values):
        own = np.frombuffer(v, f"<i{v[0]}", offset=1)
        out[k, :len(own)] = own
    return out


def _blocks(size: int):
    """Rows of a partition as blocks: ids and vectors as bytes."""
    def run(batches):
        ids, vectors = [], []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([vectors], pa.list_(pa.binary()))], ["ids", "vectors"])

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            vectors += [packed(v) for v in batch.column("v").to_pylist()]
            while len(ids) >= size:
                ids, rest_ids, vectors, rest = ids[:size], ids[size:], vectors[:size], vectors[size:]
                yield block()
                ids, vectors = rest_ids, rest
        if ids:
            yield block()

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``is_query`` holds."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = written(quantised(vectors, scale), "vectors")
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    seed = rows.orderBy(F.desc("norm"), "vec_id").limit(SEED).select("vec_id", "v").collect()
    seed_ids = np.array([r.vec_id for r in seed], np.int64)
    seeds = spark.sparkContext.broadcast((seed_ids, _matrix([packed(r.v) for r in seed], dim)))

    queries = written(rows.where(is_query).select("vec_id", "v").mapInArrow(_blocks(QUERIES), "ids binary, vectors array<binary>")
                      .withColumn("q", F.monotonically_increasing_id()), "queries")

    def thresholds(batches):
        ids, x = seeds.value
        for batch in batches:
            out = []
            for own, vectors in zip(batch.column("ids").to_pylist(), batch.column("vectors").to_pylist()):
                own = np.frombuffer(own, np.int64)
                score = products(_matrix(vectors, dim), x)
                least = np.full(len(own), np.iinfo(np.int64).min)
                for i in range(len(own)):
                    s = score[i][ids != own[i]]
                    if len(s) >= k:
                        least[i] = np.partition(s, len(s) - k)[len(s) - k]
                out.append(least.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("ids"), batch.column("vectors"), pa.array(out, pa.binary())], ["q", "q_ids", "q_vectors", "threshold"])

    asked = written(queries.mapInArrow(thresholds, "q long, q_ids binary, q_vectors array<binary>, threshold binary"), "asked")
    blocks = rows.select("vec_id", "v").mapInArrow(_blocks(ROWS), "ids binary, vectors array<binary>")
    # every block of rows meets every block of queries, each pair in its own row
    numbers = asked.select("q").sort("q").toPandas()["q"].tolist()  # one number for each QUERIES queries of a partition
    met = blocks.withColumn("q", F.explode(F.lit(numbers) if numbers else F.lit(None).cast("array<long>"))).join(asked, "q")

    def search(batches):
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_vectors", "threshold", "ids", "vectors"))):
                q_ids, threshold, ids = (np.frombuffer(row[c], np.int64) for c in (0, 2, 3))
                found = best(q_ids, _matrix(row[1], dim), ids, _matrix(row[4], dim), threshold, k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["query_id", "vec_id", "score"])

    found = met.select("q_ids", "q_vectors", "threshold", "ids", "vectors").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
