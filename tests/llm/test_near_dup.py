"""Operator 7: unbiased signatures, classes against brute force."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tabstat.llm import near_dup


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(12):
        items = rng.integers(0, 2 ** 63, 150).astype(np.uint64)
        a, b = (np.repeat(items, rng.integers(0, 6, 150)) for _ in range(2))
        x, y = Counter(a.tolist()), Counter(b.tolist())
        s = near_dup.signatures([a, b], 1024)
        errors.append((s[0] == s[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.04
    s = near_dup.signatures([np.empty(0, np.uint64), a], 64)
    assert not s[0].any() and s[1].any()


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (either == 0) or both / either >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def corpus():
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for g in range(12):
        base = [f"v{x}" for x in rng.integers(0, 500, int(rng.integers(60, 300)))]
        for c in range(1 + 4 * (g % 3)):
            words = list(base)
            for _ in range(int(rng.integers(0, 5))):
                words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 9999)}"
            rows.append((n, " ".join(words)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "ONE  two"), (n + 4, "a b " * 200), (n + 5, "a b " * 201), (0, rows[0][1])]


def test_classes_match_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "bands": F.lit(2)}).repartition(5)
    got = near_dup.classes(frame).collect()
    roots = brute(rows)
    least = {r: min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in set(roots)}
    want = sorted((rows[i][0], least[roots[i]], roots.count(roots[i])) for i in range(len(rows)))
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == want
    kept = near_dup.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_many_blocks(spark, monkeypatch):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted((r.doc_id, r.class_id) for r in near_dup.classes(frame).collect())
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    assert sorted((r.doc_id, r.class_id) for r in near_dup.classes(frame).collect()) == whole


def test_odd_rows(spark, odd_docs):
    got = near_dup.classes(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r.class_id for r in got}
    assert by_id[9] == 1 and by_id[5] == 4 and by_id[3] == 2 and by_id[7] == 2
    assert near_dup.classes(odd_docs.limit(0)).collect() == []
