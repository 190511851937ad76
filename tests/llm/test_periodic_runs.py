import hashlib
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabstat.llm import periodic_runs as P

SF = "/root/testdata/sf0.001"


def brute(a):
    """Runs by comparing every lag, smallest periods only."""
    n, found = len(a), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if a[i] != a[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and a[j] == a[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def check(rows):
    got = P.runs_of([np.array(r, np.int64) for r in rows])
    for r, own in zip(rows, got):
        assert [tuple(x) for x in own.tolist()] == brute(r)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 12)), max_size=6), st.lists(st.integers(0, 1), max_size=40))
def test_runs_equal_brute_force(parts, other):
    check([[w for block, times in parts for w in block * times], other, []])


def test_long_periods_nested_runs_and_hot_words():
    rng = np.random.default_rng(5)
    rows = []
    for q in (15, 16, 17, 31, 32, 33, 63, 64, 100, 127, 128, 250):
        for alphabet in (2, 1000):
            block = rng.integers(0, alphabet, q).tolist()
            rows.append(rng.integers(0, 1000, 37).tolist() + block * 4 + block[:3] + rng.integers(0, 1000, 11).tolist())
            rows.append(block * 4)  # no neighbour on either side
            rows.append((block * 4)[:-1])  # one word short
        inner = [7] * (q - 1) + [8]  # a run of period 1 in every period
        rows.append(inner * 5)
        block = ([1, 2] * (q // 2 + 1))[:q] + [9]
        rows.append(block * 6 + [1, 2] * 40)
    rows.append([0] * 2000)
    rows.append([0, 1, 2] * 700)
    check(rows)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_query_equals_brute_force(spark):
    from tabstat.llm.queries import QUERIES
    from tabstat.sources.io import read_table

    docs = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = QUERIES["op12_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert rows_of(got) == sorted(expected(*d) for d in docs)


def test_odd_rows(spark, odd_docs):
    got = rows_of(P.digests(P.find(P.planted(odd_docs))))
    want = [expected(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect() if len((r.text or "").split()) < 5000]
    assert [r for r in got if r[0] not in (4, 5)] == sorted(want, key=lambda r: (r[0] is None, r))
    assert len(got) == odd_docs.count()
    out = P.find(odd_docs.withColumn("runs", odd_docs.k))
    assert set(odd_docs.columns) - {"text"} <= set(out.columns) and out.columns.count("runs") == 1
    assert P.digests(P.find(P.planted(odd_docs.limit(0)))).count() == 0


@pytest.mark.parametrize("text,runs", [
    ("a a a a a a", [(0, 6, 1)]), ("a a a a a", []), ("a b a b a b a b", [(0, 8, 2)]), ("a b a b a b a", []),
    ("x a\tb\na b a b\x0ba b a y", [(1, 9, 2)]), (" ".join(["a\u00a0b"] * 6), [(0, 6, 1)]),
])
def test_hand_worked(spark, text, runs):
    row = P.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert [tuple(r) for r in row.runs] == runs
