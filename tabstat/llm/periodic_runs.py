"""Operator 12: periodic runs of words, found by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), at least ``LEAST`` words and ``POWER`` periods long, that no
neighbouring word extends.

Method. The words of a batch of texts are numbered, and the numbers stand in
one array with a different mark after every text, so that no run leaves its
text. Then

* periods below ``LAGS`` are scanned directly: the array is compared with
  itself shifted by the period, and long stretches of equality are runs;
* periods in [w, 2w), for w = LAGS, 2 LAGS, ..., are seeded. Every position
  gets a hash of the w/2 words from there; positions that hold the minimum of
  a window of w/2 hashes are minimizers. Inside a run a minimizer repeats at
  the distance of the period. Minimizers are sorted by (hash, position); one
  whose predecessor with the same hash is at most w/4 words away is left out,
  as there a shorter period repeats, which makes at most seven equal ones
  within 2w words. Each pair of equal ones at a distance in [w, 2w) is a seed.
  A run of period q holds at least 4q words, so a stretch of q starts has its
  windows and those one period on inside the run, and at least one start in q
  is a minimizer that stays: all of them would only be left out if the run had
  a period of w/4 or less. So every run has a seed. (Hashes have 64 bits and
  are sums of mixed word numbers; a collision within w/4 words could hide a
  seed, chance about 1e-19 a pair.)
* Seeds are extended over the words themselves, a seed inside the last stretch
  of its period being passed over. Stretches too short for a run are dropped;
  of stretches at the same place the one of smallest period is the run, the
  others have a multiple of it.

A scale works on the texts of at least 4w words only, so a batch costs
O(words * log(words)) in numpy, whatever it repeats.

Words are separated by ASCII white space (space, and U+0009 to U+000D). A
batch is bounded by Arrow's batch settings; a single text is held by one task
at about 100 bytes a word.

Defined results: a null text is empty; an empty text has no runs and collapses
to the empty text; ties for the longest run go to the smallest start, then
period; repeated rows repeat; all columns are kept, those named like the
results (``runs``, ``collapsed``) are replaced; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.llm.common import prepare, text_or_empty

#: A run has at least so many words, and so many periods.
LEAST, POWER = 6, 4
#: Periods below are scanned directly; a power of two.
LAGS = 16
#: Words compared at once while a seed is extended; doubles as it goes.
CHUNK = 64

RUNS = "array<struct<start:long,length:long,period:long>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix), so that sums and minima of the values are
    spread evenly."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def scan_lags(a: np.ndarray, lags) -> list[np.ndarray]:
    """(start, end, period) of every maximal stretch long enough for a run."""
    found = []
    for q in lags:
        if q >= len(a):
            break
        start, end = _stretches(a[q:] == a[:-q])
        end = end + q
        keep = end - start >= max(LEAST, POWER * q)
        found.append(np.column_stack([start[keep], end[keep], np.full(keep.sum(), q)]))
    return found


def seeds(a: np.ndarray, w: int) -> np.ndarray:
    """(period, position) of equal minimizers whose distance is in [w, 2w)."""
    half = w // 2
    gram = _mixed(a)
    width = 1
    while width < half:  # hash of 2 * width words from two of width words
        gram = _mixed(gram[:-width] + np.uint64(3) * gram[width:])
        width *= 2
    low = gram
    width = 1
    while width < half:  # minimum of a window of ``half`` hashes
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    most = np.concatenate([np.zeros(half - 1, np.uint64), low, np.zeros(half - 1, np.uint64)])
    width = 1
    while width < half:  # largest of the minima of the windows over a position
        most = np.maximum(most[:-width], most[width:])
        width *= 2
    at = np.flatnonzero(most == gram)
    at = at[np.lexsort((at, gram[at]))]
    value = gram[at]
    chained = np.concatenate(([False], (value[1:] == value[:-1]) & (at[1:] - at[:-1] <= half // 2)))
    at, value = at[~chained], value[~chained]
    out = [np.empty((0, 2), np.int64)]
    for t in range(1, 8):
        if t >= len(at):
            break
        far = at[t:] - at[:-t]
        hit = np.flatnonzero((value[t:] == value[:-t]) & (far >= w) & (far < 2 * w))
        out.append(np.column_stack([far[hit], at[hit]]))
    return np.concatenate(out)


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    at, chunk, most = 0, CHUNK, min(len(a), len(b))
    while at < most:
        differ = np.flatnonzero(a[at:min(at + chunk, most)] != b[at:min(at + chunk, most)])
        if len(differ):
            return at + int(differ[0])
        at, chunk = at + chunk, min(chunk * 2, 1 << 16)
    return most


def extend(a: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of the stretches around the seeds that are long
    enough for a run. Seeds come sorted by period, then position."""
    out, of, reach = [], -1, -1
    for q, p in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
        if q == of and p < reach:
            continue
        right = p + _same(a[p:], a[p + q:])
        left = p - _same(a[:p][::-1], a[:p + q][::-1])
        of, reach = q, right
        if right + q - left >= max(LEAST, POWER * q):
            out.append((left, right + q, q))
    return out


def runs_of(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Runs (start, length, period), by start then period, of each row of word
    numbers; the numbers are 0 and above."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    found = [np.empty((0, 4), np.int64)]  # row, start, end, period
    w = 1
    while True:
        own = np.flatnonzero(sizes >= max(LEAST, POWER * w))
        if not len(own):
            break
        parts = []
        for k, r in enumerate(own.tolist()):
            parts += [rows[r], np.array([-1 - k])]
        a = np.concatenate(parts)
        first = np.concatenate(([0], np.cumsum(sizes[own] + 1)))
        stretches = np.concatenate([np.empty((0, 3), np.int64), *scan_lags(a, range(1, LAGS))]) if w == 1 else \
            np.array(extend(a, seeds(a, w)), np.int64).reshape(-1, 3)
        of = np.searchsorted(first, stretches[:, 0], "right") - 1
        found.append(np.column_stack([own[of], stretches[:, :2] - first[of][:, None], stretches[:, 2]]))
        w = LAGS if w == 1 else 2 * w
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 3], every[:, 2], every[:, 1], every[:, 0]))]
    again = np.concatenate(([False], (every[1:, :3] == every[:-1, :3]).all(1))) if len(every) else np.empty(0, bool)
    every = every[~again]
    every = every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]
    bounds = np.searchsorted(every[:, 0], np.arange(len(rows) + 1))
    every[:, 2] -= every[:, 1]
    return [every[bounds[k]:bounds[k + 1], 1:] for k in range(len(rows))]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run is cut to its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:n]) == 0


def _find(at: int):
    def run(batches):
        for batch in batches:
            code = defaultdict(count().__next__)
            words = [(t or b"").split() for t in batch.column(at).to_pylist()]
            rows = [np.fromiter(map(code.__getitem__, row), np.int64, len(row)) for row in words]
            runs = runs_of(rows)
            text = []
            for row, own in zip(words, runs):
                if len(own):
                    row = [row[i] for i in np.flatnonzero(kept(len(row), own)).tolist()]
                text.append(b" ".join(row))
            ends = pa.array(np.cumsum([0, *map(len, runs)], dtype=np.int32))
            flat = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
            items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            columns = [batch.column(k) for k in range(batch.num_columns) if k != at]
            names = [f"c{k}" for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.ListArray.from_arrays(ends, items), pa.array(text, pa.binary()).cast(pa.string())], [*names, "runs", "collapsed"])
    return run


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows with ``runs`` (by start, then period) and ``collapsed``: the
    words that stay, joined by one space. ``keep`` names the columns carried
    through, all but ``text`` by default."""
    prepare(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, "runs", "collapsed")] if keep is None else keep
    rows = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(keep)), text_or_empty(text).cast("binary").alias("text_bytes"))
    schema = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    out = rows.mapInArrow(_find(len(keep)), f"{schema}{', ' if keep else ''}runs {RUNS}, collapsed string")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(keep)), "runs", "collapsed")


def planted(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and text, the words of every tenth document (by hash of its id)
    made periodic from some word on; others and null ids are left as they are.

    With h = crc32(id), g = floor(h / 10), n words: from word a = g % n on they
    repeat with period p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", text_or_empty(text).alias("text"), h.alias("h"), g.alias("g"))
    picked = F.col("h") % 10 == 0
    words = F.when(picked, F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != ""))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")
    rows = rows.withColumn("a", a)
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    again = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(picked & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """The longest run; ties go to the smallest start, then period."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(order)


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of the rows of ``find``."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = found.withColumn("best", longest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.length")).alias("length"),
        F.col("best.period").alias("period"), F.floor(-1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
