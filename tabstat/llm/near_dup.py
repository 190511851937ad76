"""Operator 7: near-duplicate classes by BagMinHash, banding and verification.

A document is the multiset of its five-word shingles (lower case, words parted
by white space; a text of one to four words is one shingle). Likeness is the
weighted Jaccard of two multisets; texts of likeness 0.8 or more are linked,
and a class is a connected component of the links.

1. Signature. The weights of a shingle (its count) are discretised into the
   dyadic intervals (0,1], (1,2], (2,4], ... Each interval is a Poisson
   process with the interval's length as its rate, derived from a hash of the
   shingle and the interval alone; a point carries a time, a weight level in
   the interval and one of the M signature components, and counts where its
   level is at most the shingle's count. Component c keeps the earliest time
   of its points, so two signatures agree in a component with a probability
   equal to the weighted Jaccard. Points are drawn in order of time and a
   process stops as soon as it is past the latest component of its document,
   so long documents cost about one point a shingle. Times are integers, so
   sums do not depend on the order of the work.
2. Equal word sequences are one node; copies are never paired.
3. Bands of ROWS components put nodes into buckets; buckets with the same
   members count once. A bucket of more than BLOCK nodes is compared block by
   block, each pair of blocks its own group.
4. In a group, pairs whose signatures agree enough are verified by the exact
   multiset overlap, unless the group has joined them already; a group gives
   a spanning forest of its links, never its pairs.
5. Components by repeated minimum labels with pointer jumping.

A link of likeness 0.8 fails to share a band with probability 3e-6 (less for
higher likeness), and the agreement filter is six standard deviations wide.
Shingles are compared by 32-bit hashes in step 4.

Defined results: null text is the empty text; texts without words are equal to
each other and like nothing else; repeated rows are copies; rows with a null
id belong to their text's class and are never the kept one while another has
an id; other columns pass untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.llm.common import in_groups, int_lists, prepare, strings, text_or_empty, written

WORDS, LIKENESS = 5, 0.8
BANDS, ROWS = 32, 5
M = BANDS * ROWS
#: Nodes of a bucket that one task compares at once.
BLOCK = 1024
#: Six standard deviations of the estimate at the threshold.
AGREE = LIKENESS - 6 * (LIKENESS * (1 - LIKENESS) / M) ** 0.5

_U = np.uint64
_TICK = float(1 << 32)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class WordHashes:
    """64-bit word hashes, the frequent ones kept between batches."""

    def __init__(self, limit: int = 500_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def __call__(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.known
        if len(known) > self.limit:
            known.clear()
        out = np.empty(len(words), np.uint64)
        for k, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = xxh3_64_intdigest(w)
                if len(w) <= 32:
                    known[w] = h
            out[k] = h
        return out


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the k-word shingles; fewer words are one shingle."""
    if not len(words):
        return words
    span = min(k, len(words))
    n = len(words) - span + 1
    with np.errstate(over="ignore"):
        h = np.full(n, span, np.uint64)
        for i in range(span):
            h = _mix(h * _U(0x9E3779B97F4A7C15) + words[i:i + n])
    return h


def signatures(items: list[np.ndarray], m: int = M) -> np.ndarray:
    """Signatures (uint32, documents x m) of multisets of 64-bit items.

    An empty multiset has only zeros.
    """
    keys, docs, lengths, least, counts = [], [], [], [], []
    for d, x in enumerate(items):
        item, count = np.unique(x, return_counts=True)
        level = 0
        while len(item):
            lo, hi = (0, 1) if level == 0 else (1 << (level - 1), 1 << level)
            keys.append(_mix(item + _U(level)))
            docs.append(np.full(len(item), d))
            lengths.append(np.full(len(item), hi - lo))
            least.append(np.full(len(item), lo))
            counts.append(count)
            item, count = item[count > hi], count[count > hi]
            level += 1
    best = np.full(len(items) * m, np.iinfo(np.int64).max)
    if keys:
        key, doc, length, low, count = map(np.concatenate, (keys, docs, lengths, least, counts))
        time, step = np.zeros(len(key), np.int64), np.zeros(len(key), np.uint64)
        while len(key):
            many = int(np.clip(30_000 // len(key), 1, 64))  # points drawn at once
            with np.errstate(over="ignore"):
                draw = _mix(key[:, None] + (step[:, None] + np.arange(1, many + 1, dtype=np.uint64)) * _U(0xD1342543DE82EF95))
                other = _mix(draw + _U(0x2545F4914F6CDD1D))
            gap = (-np.log(((draw >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)) * _TICK / length[:, None]).astype(np.int64) + 1
            at = time[:, None] + np.cumsum(gap, axis=1)
            component = ((other & _U(0xFFFFFFFF)) * _U(m) >> _U(32)).astype(np.int64)
            level = low[:, None] + 1 + ((other >> _U(32)) * length[:, None].astype(np.uint64) >> _U(32)).astype(np.int64)
            counted = level <= count[:, None]
            np.minimum.at(best, (doc[:, None] * m + component)[counted], at[counted])
            time, step = at[:, -1], step + _U(many)
            latest = best.reshape(-1, m).max(axis=1)
            on = time < latest[doc]
            key, doc, length, low, count, time, step = (x[on] for x in (key, doc, length, low, count, time, step))
    values = (_mix(best.astype(np.uint64)) >> _U(32)).astype(np.uint32).reshape(len(items), m)
    values[[not len(x) for x in items]] = 0
    return values


def _of_texts(batches, make):
    """One record batch for every group of texts; ``make`` gives its columns."""
    hashes = WordHashes()
    for batch in batches:
        start = 0
        for texts in in_groups(strings(batch, "text"), 1 << 20):
            words = [t.lower().split() for t in texts]
            items = [shingles(hashes(w)) for w in words]
            yield make(batch.slice(start, len(texts)), words, items)
            start += len(texts)


def _node(words: list[str]) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest("\n".join(words))


def _profile(batches):
    """Node and band hashes of each text."""
    seeds = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def make(rows, words, items):
        sig = signatures(items)
        with np.errstate(over="ignore"):
            band = np.zeros((len(items), BANDS), np.uint64) + seeds
            for r in range(ROWS):
                band = _mix(band * _U(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
        bands = [b if len(x) else b[:0] for b, x in zip(band.view(np.int64), items)]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(map(_node, words), pa.binary()), int_lists(bands, pa.int64())], ["doc_id", "node", "bands"])

    return _of_texts(batches, make)


def _details(batches):
    """Node, signature (its low bytes) and sorted shingle hashes of each text."""
    def make(rows, words, items):
        sig = signatures(items).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [pa.array(map(_node, words), pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary()),
             pa.array([np.sort((x >> _U(32)).astype(np.uint32)).tobytes() for x in items], pa.binary())],
            ["node", "sig", "items"])

    return _of_texts(batches, make)


def overlap(a: tuple, b: tuple) -> float:
    """Weighted Jaccard of two multisets given as (items, counts, size)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (a[2] + b[2] - both)


def _links(nodes: list, sigs: list, items: list, sides: list):
    """A spanning forest of the links inside one group, as (node, root)."""
    n = len(nodes)
    sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(n, -1)
    bag = {}
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def bag_of(x):
        if x not in bag:
            v, c = np.unique(np.frombuffer(items[x], np.uint32), return_counts=True)
            bag[x] = (v, c, int(c.sum()))
        return bag[x]

    side = np.array(sides)
    two = side.max() > 0  # a pair of different blocks: only pairs across
    for x in range(n):
        others = np.arange(x + 1, n)
        if two:
            others = others[side[others] != side[x]]
        if not len(others):
            continue
        agree = np.empty(len(others))
        for at in range(0, len(others), 4096):
            agree[at:at + 4096] = (sig[others[at:at + 4096]] == sig[x]).mean(axis=1)
        for k in np.argsort(-agree, kind="stable"):
            if agree[k] < AGREE:
                break
            y = int(others[k])
            if find(x) != find(y) and overlap(bag_of(x), bag_of(y)) >= LIKENESS:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    for x in range(n):
        if find(x) != x:
            yield nodes[x], nodes[find(x)]


def _forests(batches):
    """Rows arrive sorted by group; one group is held at a time."""
    columns = ("bucket", "left", "right", "side", "node", "sig", "items")
    held, key = [], None

    def close():
        return list(_links(*([r[k] for r in held] for k in (4, 5, 6, 3)))) if len(held) > 1 else []

    def out(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

    found = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if row[:3] != key:
                found += close()
                held, key = [], row[:3]
            if not held or held[-1][4] != row[4]:  # a repeated row is the same node
                held.append(row)
        if found:
            yield out(found)
            found = []
    found += close()
    yield out(found)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component.

    Minimum labels of the neighbours, then the label's own label, until
    nothing changes; each round is a written table.
    """
    both = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("l")).select("node", F.least("node", "l").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = written(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(step.join(jump, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("was")).alias("changed")), "labels")
        if not new.where("changed").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): a forest of the links between different texts.

    ``nodes`` has a row per text: node, short (a 64-bit hash of it), least
    (an id of a row with that text) and bands. Only the texts of nodes that
    share a bucket are read again for the comparison.
    """
    member = nodes.select(F.explode("bands").alias("bucket"), "short")
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = written(member.join(shared, "bucket"), "members")
    bucket = (placed.groupBy("bucket", "size").agg(F.bit_xor(F.xxhash64("short")).alias("who"), F.min("short").alias("first"))
              .groupBy("size", "who", "first").agg(F.min("bucket").alias("bucket"))  # the same members: one bucket
              .select("bucket"))
    chosen = written(placed.join(bucket, "bucket").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "buckets")
    block = F.pmod(F.xxhash64("short", F.lit(7)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = (chosen.withColumn("block", block).withColumn("other", other)
            .select("bucket", "short", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
                    F.when((F.col("block") > F.col("other")), 1).otherwise(0).alias("side")))
    wanted = nodes.join(chosen.select("short").distinct(), "short", "left_semi").select("least")
    data = (docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi").select("text")
            .mapInArrow(_details, "node binary, sig binary, items binary").withColumn("short", F.xxhash64("node")))
    groups = rows.join(data, "short").repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "node")
    return groups.select("bucket", "left", "right", "side", "node", "sig", "items").mapInArrow(_forests, "a binary, b binary")


def _classified(docs: DataFrame) -> DataFrame:
    """(doc_id, node, label, class_id, class_size) for every row."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    profiles = written(docs.mapInArrow(_profile, f"doc_id {kind}, node binary, bands array<long>"), "profiles")
    nodes = written(profiles.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
                    .withColumn("short", F.xxhash64("node")), "nodes")
    labels = components(links(docs, nodes))
    labelled = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least", "n")
    totals = labelled.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    by_node = labelled.select("node", "label").join(totals, "label")
    return profiles.select("doc_id", "node").join(by_node, "node").select("doc_id", "node", "label", "class_id", "class_size")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, kept) for every row.

    ``class_id`` is the smallest doc_id of the class; ``kept`` marks one row
    of each class (of repeated rows with that id, all of them).
    """
    return _classified(docs).select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each class, columns unchanged.

    Rows go by their id. The ids that go, and the ids that several rows share,
    are written tables, so Spark joins by their real size. Rows that share an
    id are told apart by their text, and one row of their class stays.
    """
    found = written(_classified(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id"))), "classes")
    repeated = written(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id")), "repeated")
    gone = written(found.where(~F.col("kept")).select(F.col("doc_id").alias("id")).union(repeated).distinct(), "gone")
    single = docs.join(gone, docs["doc_id"].eqNullSafe(gone["id"]), "left_anti")
    shared = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["id"]), "left_semi")
    place = docs.columns.index("text")

    def with_node(batches):
        for batch in batches:
            nodes = [_node((t or "").lower().split()) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], [*batch.schema.names, "own node"])

    rows = shared.mapInArrow(with_node, _with(docs.schema, "own node"))
    kept = found.where("kept").select(F.col("doc_id").alias("kept id"), F.col("node").alias("kept node"), F.col("label").alias("kept label")).distinct()
    one = (rows.join(kept, rows["doc_id"].eqNullSafe(kept["kept id"]) & (rows["own node"] == kept["kept node"]))
           .dropDuplicates(["kept label"]).select(*(F.col(f"`{c}`") for c in docs.columns)))
    return single.unionByName(one)


def _with(schema, name: str):
    """The schema with one more binary column."""
    from pyspark.sql import types as T

    return T.StructType([*schema.fields, T.StructField(name, T.BinaryType())])
