"""Operator 6: the kernel against its definition, and held-out accuracy."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tabstat.llm import toxicity


def plain_kernel(a, b):
    def feats(w):
        w, out = toxicity.START + w + toxicity.END, {}
        for at in combinations(range(len(w)), 4):
            if at[-1] - at[0] < toxicity.SPAN:
                s = "".join(w[i] for i in at)
                out[s] = out.get(s, 0) + toxicity.DECAY ** (at[-1] - at[0] - 3)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {s: v / norm for s, v in out.items()} if norm else {}
    x, y = feats(a), feats(b)
    return sum(v * y.get(s, 0) for s, v in x.items())


def test_kernel():
    words = ["idiot", "idxiot", "editor", "the", "a", "disgusting", "worthless"]
    got = toxicity.kernel(words, words)
    want = np.array([[plain_kernel(a, b) for b in words] for a in words])
    assert np.allclose(got, want, atol=1e-9)


def test_tokens():
    assert toxicity.tokens("You i d i o t, an i.d-i.o.t!") == ["you", "idiot", "an", "idiot"]
    long = toxicity.tokens("q" * 100)
    assert all(len(w) <= toxicity.WINDOW for w in long) and sum(map(len, long)) >= 100


def corpus(spark):
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(["the", "re", "in", "on", "ti", "ha", "or"], 3)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choice(plain, 30).tolist()
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            words.insert(int(rng.integers(0, 30)), str(rng.choice(["moron", "scumbag"])) + str(rng.choice(["", "s", "ish", "ly"])))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows += [(1000, "you m o r o n there"), (1001, "what a mxoron they are, m.o.r.o.n and scxumbags"), (1002, None), (1003, ""), (1004, "the re in on"), (1004, "the re in on"), (None, "some text")]
    return (spark.createDataFrame(rows, "doc_id long, text string").withColumns({"toxic": F.lit(9), "label": F.lit(0)}),
            spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("x")))


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in scored if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean(held) >= 0.97
    by_id = {r.doc_id: r.score for r in scored}
    assert by_id[1001] >= 0.5 and max(by_id[1002], by_id[1003], by_id[1004]) < 0.5 and len(scored) == docs.count()
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored if r.score < 0.5}


def test_one_kind_of_label(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert {r.score < 1e-6 for r in toxicity.score(docs, model).collect()} == {True}
    assert toxicity.score(docs.limit(0), model).collect() == []
