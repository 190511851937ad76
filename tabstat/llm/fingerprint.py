"""Operator 8: document fingerprints from prefix polynomial hashes.

For each of two primes p the prefix array of a text with code points c is
P[i] = sum of (c_j + 1) * B^j for j < i, modulo p. The hash of any span
[i, i + k) is (P[i + k] - P[i]) * B^-i, so spans anywhere, in one text or in
two, are compared in one step, and the longest common extension of two
positions is found by binary search.

A fingerprint holds the length and hash of the whole text and two sketches: the
SKETCH smallest mixed hashes of its spans of SHORT_GRAM code points, and of those
of GRAM. Likeness of two fingerprints is 1 for equal whole hashes and lengths;
else it estimates the share of common spans from the smallest hashes of both,
by the long spans where both texts have four times GRAM code points, by the
short ones (of all of a shorter text) where either has fewer. Every text has
both sketches, so like is compared with like at any two lengths.

The next document. Documents are range-partitioned and sorted by doc_id; a
partition streams through once, each row with the one after it. The first and
last row of every partition (bounded by the number of partitions) go on to
meet the row of the neighbouring partition.

Defined results: null text is the empty text; two empty texts have likeness 1,
an empty and another text 0; documents are ordered by doc_id (nulls first),
repeated ids by a hash of their text; a single document is its own next; equal texts have
equal fingerprints; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.llm.common import prepare, strings, text_or_empty, written

PRIMES, BASE = (2_147_483_647, 2_147_483_629), 1_000_003
GRAM, SHORT_GRAM, SKETCH = 12, 3, 32
#: Documents of a range partition, on average.
PART = 5_000

_U = np.uint64
_HEAD = struct.Struct("<QQB")


class _Powers:
    """Powers of the base and of its inverse modulo a prime, grown on demand."""

    def __init__(self, prime: int):
        self.prime = prime
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size, p = len(self.up), self.prime
            up, down = pow(BASE, size, p), pow(BASE, -size, p)
            self.up = np.concatenate([self.up, self.up * _U(up) % _U(p)])
            self.down = np.concatenate([self.down, self.down * _U(down) % _U(p)])
        return self.up, self.down


_POWERS = [_Powers(p) for p in PRIMES]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class PrefixHashes:
    """Prefix arrays of a text; span hashes, equality, longest extensions."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.prefix = []
        for powers in _POWERS:
            up, _ = powers.upto(self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum((codes + _U(1)) * up[:self.n] % _U(powers.prime), out=sums[1:])
            self.prefix.append(sums % _U(powers.prime))

    def spans(self, start, length) -> np.ndarray:
        """62-bit hashes of the spans at ``start`` (arrays or numbers)."""
        start, stop = np.asarray(start), np.asarray(start) + np.asarray(length)
        both = []
        for prefix, powers in zip(self.prefix, _POWERS):
            p = _U(powers.prime)
            both.append((prefix[stop] + p - prefix[start]) % p * powers.down[start] % p)
        return both[0] << _U(31) | both[1]

    def whole(self) -> int:
        return int(self.spans(0, self.n))

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common span at i here and j in ``other``."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.spans(i, mid) == other.spans(j, mid):
                low = mid
            else:
                high = mid - 1
        return low


def _sketch(hashes: PrefixHashes, gram: int) -> np.ndarray:
    """The smallest different mixed span hashes, 32 bits each."""
    if not hashes.n:
        return np.empty(0, np.uint32)
    gram = min(gram, hashes.n)
    x = hashes.spans(np.arange(hashes.n - gram + 1), gram)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    x = ((x ^ (x >> _U(32))) >> _U(16)).astype(np.uint32)
    most = 4 * SKETCH
    while len(x) > most:  # repeated spans may take more than one place
        least = np.unique(np.partition(x, most)[:most])
        if len(least) >= SKETCH or most >= len(x):
            return least[:SKETCH]
        most *= 4
    return np.unique(x)[:SKETCH]


def _packed(hashes: PrefixHashes) -> bytes:
    """Length, whole hash, size of the short sketch, both sketches."""
    short, long = (_sketch(hashes, gram).astype("<u4") for gram in (SHORT_GRAM, GRAM))
    return _HEAD.pack(hashes.n, hashes.whole(), len(short)) + short.tobytes() + long.tobytes()


def _likeness(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    (n, _, k), (m, _, j) = _HEAD.unpack_from(a), _HEAD.unpack_from(b)
    x, y = (np.frombuffer(f, "<u4", offset=_HEAD.size) for f in (a, b))
    x, y = (x[k:], y[j:]) if min(n, m) >= 4 * GRAM else (x[:k], y[:j])
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x, y)
    if SKETCH in (len(x), len(y)):  # a full sketch knows nothing beyond its largest hash
        union = union[:SKETCH]
    both = np.intersect1d(x, y, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).mean())


def fingerprint(hashes: PrefixHashes) -> str:
    """The fingerprint as text."""
    return base64.b64encode(_packed(hashes)).decode()


def likeness(a: str, b: str) -> float:
    """0 to 1 from two fingerprints alone."""
    return _likeness(base64.b64decode(a), base64.b64decode(b))


def edited(text: str, after: str) -> str:
    """The last half of the text replaced by the start of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def _pair(text: str, own: tuple, after: str, after_print: str) -> tuple:
    hashes, mark = own
    changed = edited(text, after)
    other = PrefixHashes(code_points(changed))
    changed_mark = _packed(other)
    return (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), mark, changed_mark,
            _likeness(mark, changed_mark), _likeness(mark, after_print), hashes.extension(0, other, 0))


def _prints(text: str) -> tuple:
    hashes = PrefixHashes(code_points(text))
    return hashes, _packed(hashes)


# digests and fingerprints stay bytes in what is written on the way
_FIELDS = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, common_prefix long"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]
_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64()]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, common_prefix) of every whole text."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))  # bounds are sampled from the keys: no texts
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() / PART))
    ordered = docs.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches):
        number = TaskContext.get().partitionId()
        last = None  # id, text and prints of the row before
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            ids, rows, edge = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch, "text")):
                prints = _prints(text)
                if last is None:
                    ids.append(None)
                    rows.append((None,) * len(_NAMES))
                    edge.append(("first", text))
                else:
                    ids.append(last[0])
                    rows.append(_pair(last[1], last[2], text, prints[1]))
                    edge.append((None, None))
                last = (doc_id, text, prints)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)), pa.array([e[0] for e in edge], pa.string()), pa.array([e[1] for e in edge], pa.string()), pa.array([number] * len(rows), pa.int32())],
                                                 ["doc_id", *_NAMES, "edge", "text", "number"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], id_type), *(pa.array([None], t) for t in _TYPES), pa.array(["last"]), pa.array([last[1]], pa.string()), pa.array([number], pa.int32())],
                                             ["doc_id", *_NAMES, "edge", "text", "number"])

    # one run of the job for all rows, so that every row sees the same ranges
    done = written(ordered.mapInArrow(run, f"doc_id {kind}, {_FIELDS}, edge string, text string, number int"), "prints")
    numbers = sorted(r.number for r in done.where("edge = 'first'").select("number").collect())  # one per partition
    follows = spark.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1])), "number int, next int")
    heads = done.where("edge = 'first'").select(F.col("number").alias("next"), F.col("text").alias("after"))
    edges = done.where("edge = 'last'").select("doc_id", "text", "number").join(follows, "number").join(heads, "next").select("doc_id", "text", "after")

    def close(batches):
        for batch in batches:
            rows = [_pair(text, _prints(text), after, _prints(after)[1]) for text, after in zip(strings(batch, "text"), strings(batch, "after"))]
            columns = zip(*rows) if rows else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _TYPES))], ["doc_id", *_NAMES])

    rows = done.where("edge is null").select("doc_id", *_NAMES).unionByName(edges.mapInArrow(close, f"doc_id {kind}, {_FIELDS}"))
    return rows.withColumns({"edited_sha256": F.lower(F.hex("edited_sha256")), **{c: F.translate(F.base64(c), "\r\n", "") for c in ("fingerprint", "edited_fingerprint")}})
