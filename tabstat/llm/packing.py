"""Operator 3: best-fit packing by a linear grouping scheme.

Tokenising. Each text is encoded whole, as ``encode(text,
add_special_tokens=False)`` of the tokenizers library does it: strings of the
file's added tokens in a text are those tokens. An end token follows, and a document
longer than CAPACITY is cut into CAPACITY-token pieces of which the first may
be shorter. A row per piece (id, place, length, digest of its ids) is written
once; everything after works on those rows.

Planning. Lengths are integers up to CAPACITY, so the counts per length are a
table of at most CAPACITY rows whatever the input: only that table reaches the
driver. There, lengths above SMALL are put into GROUPS groups of equal
cardinality and rounded up to the longest of their group. The few sizes that
remain form a cutting-stock problem, solved by column generation: a linear
program over configurations (multisets of sizes that fill a sequence), a
knapsack for the next configuration. Its configurations are used as often as
the program says, rounded down; actual lengths then take the places of their
group, longest first; lengths without a place are placed best-fit, longest
first, then the small ones. All of it is done on runs of equal sequences, so
the work depends on the number of lengths and not on the number of documents.

Placing. Pieces of a length are numbered without putting them in one place:
a hash splits each length into parts of about PART pieces, the parts get their
offsets from their counts, pieces are numbered inside their part. The number
of a piece gives its run, sequence and offset in the plan.

Defined results: null text is the empty text (only the end token); repeated
rows are pieces of their own; other columns are not read; an empty table gives
an empty result; pieces with equal (doc_id, piece) may swap places.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabstat.llm.common import UnitCache, in_groups, prepare, split_units, strings, text_or_empty, written

CAPACITY = 2048
#: Lengths up to SMALL fill gaps at the end; longer ones are grouped.
SMALL, GROUPS = 512, 48
#: Fixed value: the pattern of byte-level pre-tokenisation.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of one length that are numbered together.
PART = 20_000


# ---- tokenising -----------------------------------------------------------

@lru_cache(maxsize=2)
def _tokenizer(path: str) -> UnitCache:
    """The worker's encoder of units.

    Where the file is a byte-level BPE whose ids follow the order of its
    merges, merging by rank gives the ids of the tokenizers library several
    times faster (the tests hold both against each other); any other file is
    encoded by the library itself.
    """
    ranks = _ranks(path)
    if ranks is not None:
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        added = {t["content"]: [t["id"]] for t in _spec(path).get("added_tokens") or ()}
        return UnitCache(lambda units: (added.get(u) or coder.encode_ordinary(u) for u in units))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return UnitCache(lambda units: [e.ids for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)])


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _whole(spec: dict) -> bool:
    """Added tokens take in text beside them or match a normalised text, so
    that a text cannot be cut at their strings alone."""
    return any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") and spec.get("normalizer") for t in spec.get("added_tokens") or ())


@lru_cache(maxsize=2)
def _units(path: str) -> Callable[[str], list[str]]:
    """The worker's cut of a text into units; an added token is a unit."""
    spec = _spec(path)
    if _whole(spec):
        return lambda text: [text]
    added = sorted((t["content"] for t in spec.get("added_tokens") or () if t["content"]), key=len, reverse=True)
    if not added:
        return split_units
    pattern = re.compile(f"({'|'.join(map(re.escape, added))})")  # the leftmost, then the longest, as in the library

    def cut(text: str) -> list[str]:
        if not any(a in text for a in added):
            return split_units(text)
        units: list[str] = []
        for k, part in enumerate(pattern.split(text)):
            units += [part] if k % 2 else split_units(part) if part else []
        return units

    return cut


def _ranks(path: str) -> dict[bytes, int] | None:
    """Bytes of each token by id, None where ranks cannot stand for merges."""
    spec = _spec(path)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer")
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges") or ()]
    if model.get("type") != "BPE" or not plain or _whole(spec) or any(model["vocab"].get(m) != 256 + k for k, m in enumerate(merges)):
        return None
    # byte-level vocabularies write each byte as a printable character
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {t["content"] for t in spec.get("added_tokens") or ()}
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]) of every document."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        cache, cut, last = _tokenizer(path), _units(path), end.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            at = 0
            doc_ids = batch.column("doc_id").to_pylist()
            for group in in_groups(strings(batch, "text")):
                for ids in cache.packed([cut(t) if t else [] for t in group]):
                    ids += last
                    for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        raw = ids[4 * start:4 * (start + length)]
                        rows.append((doc_ids[at], piece, start, length, zlib.crc32(raw), raw)[:len(names)])
                    at += 1
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return (docs.select("doc_id", text_or_empty().alias("text"))
            .mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids))


# ---- planning -------------------------------------------------------------

def grouped(counts: np.ndarray, small: int = SMALL, groups: int = GROUPS) -> list[tuple[int, int, int]]:
    """(shortest, longest, pieces) of about equal-cardinality groups of the
    lengths above ``small``; a length is never split between groups."""
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > small]
    if not len(lengths):
        return []
    total = counts[lengths].cumsum()
    share = np.minimum((total - 1) * groups // total[-1], groups - 1)
    return [(int(own[0]), int(own[-1]), int(counts[own].sum())) for own in (lengths[share == g] for g in np.unique(share))]


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the largest value, sizes used any number of times."""
    worth = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for c in range(min(sizes), capacity + 1):
        options = [(worth[c - s] + values[k], k) for k, s in enumerate(sizes) if s <= c]
        top, k = max(options)
        if top > worth[c - 1] + 1e-12:
            worth[c], last[c] = top, k
        else:
            worth[c] = worth[c - 1]
    used, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
            continue
        used[last[c]] += 1
        c -= sizes[last[c]]
    return worth[capacity], used


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 300) -> list[tuple[np.ndarray, int]]:
    """(uses of each size, times) by column generation, times rounded down.

    The basis holds one configuration per size; the knapsack prices the next
    one, the ratio test chooses the one it replaces.
    """
    m = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)  # the dual values: every configuration costs one sequence
        value, new = _knapsack(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        amount, direction = inverse @ need, inverse @ new
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    times = np.floor(np.linalg.solve(basis, need) + 1e-9).astype(int)
    return [(basis[:, k].astype(int), int(times[k])) for k in range(m) if times[k] > 0]


def plan(counts: np.ndarray, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """Runs (sequences, lengths in each) that hold ``counts[length]`` pieces of
    every length."""
    left = counts.astype(np.int64).copy()
    runs: list[tuple[int, list[int]]] = []
    if left[capacity]:
        runs.append((int(left[capacity]), [capacity]))
        left[capacity] = 0
    kinds = grouped(left, small, groups)
    if kinds:
        for used, times in configurations([high for _, high, _ in kinds], [n for *_, n in kinds], capacity):
            slots = [g for g in range(len(kinds) - 1, -1, -1) for _ in range(used[g])]
            while times:
                own = _substitute(slots, kinds, left, capacity, small)
                if not own:
                    break
                asked = {length: own.count(length) for length in own}
                n = min(times, *(int(left[length]) // k for length, k in asked.items()))
                for length, k in asked.items():
                    left[length] -= n * k
                runs.append((n, own))
                times -= n
    return _best_fit(runs, left, capacity)


def _substitute(slots: list[int], kinds: list, left: np.ndarray, capacity: int, small: int) -> list[int]:
    """Actual lengths for the places of a configuration: the longest left of
    each group; the last place takes the longest large length that still fits,
    which uses up what the rounding kept free."""
    own: list[int] = []
    room = capacity
    for place, g in enumerate(slots):
        low, high, _ = kinds[g]
        if place == len(slots) - 1:
            low, high = small + 1, capacity
        lengths = np.flatnonzero(left[low:min(high, room) + 1]) + low
        length = next((int(x) for x in lengths[::-1] if left[x] > own.count(x)), 0)
        if length:
            own.append(length)
            room -= length
    return own


def _best_fit(runs: list, left: np.ndarray, capacity: int) -> list:
    """Put the lengths that are left, longest first, into the fullest
    sequences that still have room, whole runs at a time."""
    room: list[list] = [[] for _ in range(capacity + 1)]  # runs by free tokens
    for n, own in runs:
        room[capacity - sum(own)].append((n, own))
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            free = next((r for r in range(length, capacity) if room[r]), None)
            if free is None:  # new sequences, each with as many as fit
                each = max(1, min(capacity // length, n))
                room[capacity - each * length].append((n // each, [length] * each))
                n -= n // each * each
                continue
            times, own = room[free].pop()
            each = min(free // length, n)
            use = min(times, n // each)
            if use < times:
                room[free].append((times - use, own))
            room[free - each * length].append((use, own + [length] * each))
            n -= use * each
    return [run for runs in room for run in runs]


def places(runs: list) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first number, sequence, offset, step of its places.

    Piece number k of a length belongs to the last entry whose first number is
    at most k; its sequence is the entry's plus (k - first number).
    """
    out: dict[int, list] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for n, own in runs:
        offset = 0
        for length in own:
            first = seen.get(length, 0)
            out.setdefault(length, []).append((first, sequence, offset))
            seen[length] = first + n
            offset += length
        sequence += n
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows)) for length, rows in out.items()}


# ---- placing --------------------------------------------------------------

def pack(pieces: DataFrame, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    ``pieces`` must be stored rows (doc_id, piece, length, ...): it is read
    several times.
    """
    spark = pieces.sparkSession
    prepare(spark)
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    table = spark.sparkContext.broadcast(places(plan(counts, capacity, small, groups)))
    parts = np.maximum(1, -(-counts // PART))
    split = F.element_at(F.lit(parts.tolist()).cast("array<long>"), (F.col("length") + 1).cast("int"))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), split))
    size = salted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = size.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("k", F.row_number().over(inside) - 1).join(ahead, ["length", "part"]).withColumn("k", F.col("k") + F.col("ahead")).drop("ahead", "part")

    def place(batches):
        at = table.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            k = batch.column("k").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
            for own in np.unique(length):
                rows = np.flatnonzero(length == own)
                first, base, off = at[int(own)]
                e = np.searchsorted(first, k[rows], "right") - 1
                sequence[rows], offset[rows] = base[e] + k[rows] - first[e], off[e]
            names = [c for c in batch.schema.names if c != "k"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "k")
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = written(tokenise(docs, path, end, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
