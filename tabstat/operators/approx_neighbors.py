"""K1, approximate: Euclidean nearest neighbours by multi-probe random projections.

Method. ``tables`` sets of ``bits`` orthonormal directions cut the space
around the mean vector; the signs of a row's projections are its bucket. A
reference row stands in one bucket a table. A query also visits the buckets
that differ in the signs it is surest to get wrong: of all sets of flipped
signs (among its PROBED smallest margins) the ``probes`` with the least sum of
squared margins, its own bucket first. Distances to the rows of the visited
buckets are exact, and the k best over all tables are the result.

Plan. Buckets with a common prefix are a cell of about ``block_rows`` reference
rows, so a query is sent to a cell once with the list of buckets it visits
there; reference and query rows meet by the key (table, cell). There is no
all-pairs stage: rows that share no cell never meet, and inside a cell only
visited buckets are compared. Cells with more rows than a block, on either
side, are cut into blocks by hash (both sides counted first; a table of these
cells, at most tables * rows / block_rows, is broadcast). Equal vectors are
one reference row with their k + 1 smallest ids and one query row, so copies
cost nothing; their results go back to the ids by a join in which vectors of
more than a block of queries are cut the same way. A task holds two blocks; a
query keeps k + 1 rows a cell. Only counts are sent to find the cells to cut;
arrays of floats are sent as floats, and lists as Arrow buffers.

Recall. ``bits`` follows the number of different rows (four in a bucket on
average) up to MOST_BITS and ``probes`` is the square root of the number of
buckets, which visits about half of 500 structureless vectors of 64 dimensions
and 40 % of 2,000 or more. Such vectors need that share: with more bits, whose
visited share falls, recall fell below 0.9 at 10,000. Where the vectors are
clustered, more ``bits`` do less work. On structureless vectors this finds 0.9
of the neighbours (``recall`` measures it); near ones are found more surely. A bucket
of h different rows is still compared in full, in blocks.

Rows whose vector is null, or has null or non-finite components, take no
part: they are no one's neighbours and have none.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabstat.operators.neighbors import BLOCK_ROWS, vector_column
from tabstat.session import materialize, ship_package

TABLES = 14
#: Bits beyond which buckets hold more rows instead of being visited in a lesser share.
MOST_BITS = 9
#: Margins among which signs are flipped.
PROBED = 12
QUERY_ROWS = 512  # query rows hashed at once


def directions(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    """(tables, dim, bits): orthonormal as far as the dimension allows."""
    rng = np.random.default_rng(seed)
    blocks = [[np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-bits // dim))] for _ in range(tables)]
    return np.stack([np.hstack(b)[:, :bits] for b in blocks])


def _finite(column: str):
    return F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _vectors(df: DataFrame, features, key: str) -> DataFrame:
    """(id, v, h1, h2): finite vectors and a 128-bit hash of each. Arrays of
    floats stay floats on the way: half the bytes of the same numbers."""
    kind = "float" if isinstance(features, str) and dict(df.dtypes)[features] == "array<float>" else "double"
    v = F.transform(vector_column(df, features), lambda x: x + F.lit(0.0)).cast(f"array<{kind}>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(_finite("v"))
    return rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def _matrix(column, dim: int) -> np.ndarray:
    """(rows, dim) of an Arrow column of lists, in its own type."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if (np.asarray(column.value_lengths()) != dim).any():
        raise ValueError(f"vectors of other than {dim} components")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """Lists of ``values`` that begin at ``starts``; the last ends with them."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values))


def _visits(margins: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Own bucket of each row, and the sets of flipped signs it visits."""
    bits = margins.shape[1]
    own = ((margins > 0) * (1 << np.arange(bits))).sum(1)
    near = min(bits, PROBED)
    at = np.argsort(np.abs(margins), axis=1)[:, :near]
    least = np.take_along_axis(np.abs(margins), at, 1) ** 2
    sets = (np.arange(1 << near)[:, None] >> np.arange(near)) & 1
    cost = least @ sets.T
    n = min(probes, 1 << near)
    chosen = np.argpartition(cost, n - 1, axis=1)[:, :n] if n < 1 << near else np.broadcast_to(np.arange(1 << near), cost.shape)
    flips = (sets[chosen] * (1 << at)[:, None, :]).sum(2)
    return own, own[:, None] ^ flips


def _split(counts: DataFrame, block_rows: int, out: str) -> DataFrame:
    """(t, cell, out): the number of blocks of each cell that has over one."""
    return counts.groupBy("t", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > block_rows).select(
        "t", "cell", F.ceil(F.col("n") / block_rows).cast("int").alias(out))


def approx_knn(reference: DataFrame, query: DataFrame | None, k: int, features: str | Sequence[str], ref_id: str,
               query_id: str | None = None, exclude_self: bool = False, tables: int = TABLES, bits: int | None = None,
               probes: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = 17) -> DataFrame:
    """The nearest reference rows of every query row among those it visits.

    Output as of ``knn``: (qid, tid, rank, distance), ties by reference id. A
    query that finds fewer than k rows has fewer.
    """
    spark = reference.sparkSession
    ship_package(spark)
    refs = _vectors(reference, features, ref_id)
    asked = refs if query is None else _vectors(query, features, query_id or ref_id)
    first = Window.partitionBy("v").orderBy("id")
    refs = materialize(refs.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
                       .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "checkpoint")
    n = refs.count()
    if not n:
        return spark.createDataFrame([], "qid long, tid long, rank int, distance double")
    mean = refs.agg(Summarizer.mean(array_to_vector(F.col("v").cast("array<double>")))).first()[0].toArray()
    bits = bits or min(MOST_BITS, max(4, round(math.log2(n)) - 2))
    probes = probes or math.ceil(2 ** (bits / 2))
    low = bits - min(bits, max(0, math.ceil(math.log2(n / block_rows))))  # signs inside a cell
    dim = len(mean)
    axes = directions(dim, bits, tables, seed)

    def buckets(batches):
        for b in batches:
            x = _matrix(b["v"], dim) - mean
            for t in range(tables):
                yield b, t, ((x @ axes[t] > 0) * (1 << np.arange(bits))).sum(1)

    def hashed(batches):
        for b, t, own in buckets(batches):
            yield pa.record_batch({"t": pa.array(np.full(len(own), t), pa.int32()), "cell": own >> low, "bucket": own, "v": b["v"], "ids": b["ids"]})

    def visits(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, QUERY_ROWS):
                b = whole.slice(i, QUERY_ROWS)
                x = _matrix(b["v"], dim)
                for t in range(tables):
                    seen = np.sort(_visits((x - mean) @ axes[t], probes)[1], axis=1)
                    cell = seen >> low
                    new = np.concatenate([np.ones((len(x), 1), bool), cell[:, 1:] != cell[:, :-1]], axis=1)
                    yield b, x, t, seen, cell, new

    def visiting(batches):
        for b, x, t, seen, cell, new in visits(batches):
            row, at = np.nonzero(new)
            v = _lists(x[row].ravel(), np.arange(len(row)) * dim)
            yield pa.record_batch({"t": pa.array(np.full(len(row), t), pa.int32()), "cell": cell[row, at], "visits": _lists(seen.ravel(), np.flatnonzero(new.ravel())), "v": v,
                                   "h1": b["h1"].take(pa.array(row)), "h2": b["h2"].take(pa.array(row))})

    def counted(cells):
        def run(batches):
            for t, cell in cells(batches):
                names, n = np.unique(cell, return_counts=True)
                yield pa.record_batch({"t": pa.array(np.full(len(names), t), pa.int32()), "cell": names, "n": n})
        return run

    v_type = dict(refs.dtypes)["v"], dict(asked.dtypes)["v"]
    left = refs.mapInArrow(hashed, f"t int, cell long, bucket long, v {v_type[0]}, ids array<long>")
    single = asked.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"))
    single = materialize(single, "checkpoint")
    right = single.select("v", "h1", "h2").mapInArrow(visiting, f"t int, cell long, visits array<long>, v {v_type[1]}, h1 long, h2 long")
    # counts alone: no vector is sent for them
    in_left = refs.select("v").mapInArrow(counted(lambda batches: ((t, own >> low) for _, t, own in buckets(batches))), "t int, cell long, n long")
    in_right = single.select("v").mapInArrow(counted(lambda batches: ((t, cell[new]) for _, _, t, _, cell, new in visits(batches))), "t int, cell long, n long")
    cuts = _split(in_left, block_rows, "lc").join(_split(in_right, block_rows, "rc"), ["t", "cell"], "full").na.fill(1, ["lc", "rc"])
    cuts = F.broadcast(materialize(cuts, "checkpoint"))
    one = F.lit(1)
    left = left.join(cuts, ["t", "cell"], "left").withColumns({"lc": F.coalesce("lc", one), "rc": F.coalesce("rc", one)})
    left = left.withColumns({"lb": F.pmod(F.xxhash64(F.col("ids")[0]), "lc"), "rb": F.explode(F.sequence(F.lit(0), F.col("rc") - 1))})
    right = right.join(cuts, ["t", "cell"], "left").withColumns({"lc": F.coalesce("lc", one), "rc": F.coalesce("rc", one)})
    right = right.withColumns({"rb": F.pmod("h1", "rc"), "lb": F.explode(F.sequence(F.lit(0), F.col("lc") - 1))})
    key = ["t", "cell", "lb", "rb"]
    found = (right.select(*(F.col(c).cast("long").alias(c) for c in key), "visits", "v", "h1", "h2").groupBy(*key)
             .cogroup(left.select(*(F.col(c).cast("long").alias(c) for c in key), "bucket", "v", "ids").groupBy(*key))
             .applyInArrow(_cell(k + 1, dim), "h1 long, h2 long, d double, tid long"))
    # at most k + 1 rows a query and cell; copies found in several tables count once
    best = found.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "tid"))), 1, k + 1).alias("near"))
    many = F.broadcast(materialize(single.where(F.col("copies") > block_rows).select(
        "h1", "h2", F.ceil(F.col("copies") / block_rows).cast("int").alias("cuts")), "checkpoint"))
    best = best.join(many, ["h1", "h2"], "left").withColumn("cut", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", one) - 1))).drop("cuts")
    asked = asked.select("id", "h1", "h2").join(many, ["h1", "h2"], "left").withColumn("cut", F.pmod(F.xxhash64("id"), F.coalesce("cuts", one)).cast("int"))
    out = asked.join(best, ["h1", "h2", "cut"])
    near = F.filter("near", lambda x: x["tid"] != F.col("id")) if exclude_self else F.col("near")
    out = out.select(F.col("id").alias("qid"), F.posexplode(F.slice(near, 1, k)).alias("p", "x"))
    return out.select("qid", F.col("x.tid").alias("tid"), (F.col("p") + 1).cast("int").alias("rank"), F.col("x.d").alias("distance"))


def _cell(k: int, dim: int):
    """The k best of each query's visited buckets in one block of a cell."""

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        none = pa.table({"h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "tid": pa.array([], pa.int64())})
        if not q.num_rows or not r.num_rows:
            return none
        bucket, ids = r["bucket"].to_numpy(), r["ids"].combine_chunks()
        copies = np.asarray(ids.value_lengths())
        by = np.argsort(bucket, kind="stable")
        bucket, rv = bucket[by], _matrix(r["v"], dim)[by].astype(np.float64)
        first, copies, ids = (np.cumsum(copies) - copies)[by], copies[by], ids.flatten().to_numpy()
        qv = _matrix(q["v"], dim).astype(np.float64)
        visits = q["visits"].combine_chunks()
        visited, who = visits.flatten().to_numpy(), np.repeat(np.arange(len(qv)), np.asarray(visits.value_lengths()))
        order = np.argsort(visited, kind="stable")
        visited, who = visited[order], who[order]
        edges = np.flatnonzero(np.concatenate(([True], visited[1:] != visited[:-1], [True])))
        norm = (rv * rv).sum(1)
        slack = 1e-9 * (norm.max() + (qv * qv).sum(1)) + 1e-300
        most = np.full(len(qv), np.inf)  # no more than this the k-th best of a query is, less the square of its own norm
        qi, ri, rough = [], [], []
        for a, b in zip(edges[:-1], edges[1:]):
            low, high = np.searchsorted(bucket, visited[a]), np.searchsorted(bucket, visited[a], "right")
            for c in range(a, b, 1024) if high > low else ():
                own = who[c:min(c + 1024, b)]
                near = norm[None, low:high] - 2.0 * (qv[own] @ rv[low:high].T)
                if high - low >= k:
                    most[own] = np.fmin(most[own], np.partition(near, k - 1, axis=1)[:, k - 1] + slack[own])
                x, y = np.nonzero(near <= most[own][:, None])
                qi.append(own[x])
                ri.append(low + y)
                rough.append(near[x, y])
        if not qi:
            return none
        qi, ri = np.concatenate(qi), np.concatenate(ri)
        left = np.concatenate(rough) <= most[qi]
        qi, ri = qi[left], ri[left]
        dist = np.empty(len(qi))
        for c in range(0, len(qi), 1 << 16):
            diff = rv[ri[c:c + (1 << 16)]] - qv[qi[c:c + (1 << 16)]]
            dist[c:c + (1 << 16)] = np.sqrt((diff * diff).sum(1))
        n = copies[ri]
        tid = ids[np.repeat(first[ri] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        qi, dist = np.repeat(qi, n), np.repeat(dist, n)
        order = np.lexsort((tid, dist, qi))
        qi, tid, dist = qi[order], tid[order], dist[order]
        start = np.concatenate(([True], qi[1:] != qi[:-1]))
        place = np.arange(len(qi)) - np.maximum.accumulate(np.where(start, np.arange(len(qi)), 0))
        keep = place < k
        at = pa.array(qi[keep])
        return pa.table({"h1": q["h1"].combine_chunks().take(at), "h2": q["h2"].combine_chunks().take(at), "d": dist[keep], "tid": tid[keep]})

    return run


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(rank, pairs, hits, recall): of the exact neighbours of each rank, how
    many the other search found at any rank."""
    hit = found.select("qid", "tid", F.lit(1).alias("hit"))
    rows = exact.join(hit, ["qid", "tid"], "left")
    return rows.groupBy("rank").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("hits")).withColumn("recall", F.col("hits") / F.col("pairs"))
