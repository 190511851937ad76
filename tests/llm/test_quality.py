import math

import pytest
from pyspark.sql import functions as F

from tabstat.llm import quality as Q
from tabstat.sources.io import read_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    return docs, labels, Q.train(docs, labels, ~Q.held_out(F.col("doc_id")))


def test_held_out_accuracy(spark, fitted):
    docs, labels, model = fitted
    rows = Q.score(docs, model).join(labels, "doc_id").where(Q.held_out(F.col("doc_id")))
    right, junk, n = rows.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("double")),
                              F.avg(F.when(F.col("quality") == 0, (F.col("score") < 0.5).cast("double"))), F.count(F.lit(1))).first()
    assert n > 100 and right >= 0.97 and junk >= 0.85


def test_model_is_a_sparse_set_of_conjunctions(fitted):
    model = fitted[2]
    assert 3 <= len(model.rules) <= 150 and len({r.bounds for r in model.rules}) == len(model.rules)
    assert all(1 <= len(r.bounds) <= Q.DEPTH and r.weight != 0 for r in model.rules)


def test_expression_equals_the_rules_by_hand(spark, fitted):
    docs, _, model = fitted
    rows = Q.statistics(docs.limit(60)).select("stats", model.expression().alias("score")).collect()
    for r in rows:
        values = dict(zip(Q.STATISTICS, r.stats))
        total = model.bias + sum(x.weight for x in model.rules if x.holds(values))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)


def test_paths_are_those_of_the_trees(spark):
    """The leaves' rules of a tree part the rows as the tree does."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    k = len(Q.STATISTICS)
    rows = spark.range(400).select(F.array(*(F.pmod(F.xxhash64("id", F.lit(j)), F.lit(17)).cast("double") for j in range(k))).alias("stats"))
    rows = rows.withColumn("label", ((F.col("stats")[0] > 8) != (F.col("stats")[3] > 5)).cast("double")).withColumn("features", array_to_vector("stats"))
    forest = RandomForestClassifier(labelCol="label", numTrees=3, maxDepth=3, seed=1, leafCol="leaf").fit(rows)
    for t, tree in enumerate(forest.trees):
        own = list(Q.paths(tree._call_java("rootNode")))
        leaves = [b for b in own if not any(b != c and all(x in c and c[x][0] >= b[x][0] and c[x][1] <= b[x][1] for x in b) for c in own)]
        rules = [Q.Rule(tuple((n, *x) for n, x in b.items())) for b in leaves]
        held = F.expr(f"array({', '.join(r.condition() for r in rules)})")
        seen = forest.transform(rows).select(held.alias("held"), "leaf").collect()
        which = {tuple(r.held): set() for r in seen}
        for r in seen:
            assert sum(r.held) == 1
            which[tuple(r.held)].add(r.leaf[t])
        assert all(len(v) == 1 for v in which.values()) and len(which) == len(set().union(*which.values()))


def test_statistics_by_hand(spark):
    text = "Ab ab!! CD\n###  x1 Ab"
    row = Q.statistics(spark.createDataFrame([(text,), (None,), ("",), ("   \n ",)], "text string")).collect()
    got = dict(zip(Q.STATISTICS, row[0].stats))
    n, words = len(text), 6
    want = {"log_chars": math.log1p(n), "log_words": math.log1p(words), "word_chars": (n - words) / words, "letters": 9 / n, "upper": 4 / n, "digits": 1 / n,
            "stops": 2 / words, "commas": 0, "symbols": 3 / n, "doubled": 5 / words, "long_words": 0, "distinct_words": 5 / words,
            "distinct_lines": 1, "line_words": 3, "first_word": 2 / words}
    assert got == pytest.approx(want)
    assert row[1].stats == row[2].stats == [0.0] * len(want)
    assert all(math.isfinite(v) for v in row[3].stats)


def test_odd_rows(spark, odd_docs, fitted):
    model = fitted[2]
    out = Q.score(odd_docs, model)
    assert out.columns == [c for c in odd_docs.columns if c != "score"] + ["score"] and out.count() == odd_docs.count()
    rows = out.select("doc_id", "text", "score").collect()
    by_text = {}
    for r in rows:
        assert 0 <= r.score <= 1 and by_text.setdefault(r.text or "", r.score) == r.score
    assert Q.score(odd_docs.limit(0), model).count() == 0


def test_without_labels_of_both_kinds(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (9, 1, 0), (6, 1, 0), (3, None, 0), (4, 0, 0), (4, 1, 0), (None, 0, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(odd_docs, labels, F.lit(True))
    assert model.rules == []  # 1 and 9 have equal texts; 4 is contrary, 77 no document
    score = Q.score(odd_docs, model).select("score").distinct().collect()
    assert len(score) == 1 and score[0].score == pytest.approx(3 / 4)
    assert Q.score(odd_docs, Q.train(odd_docs.limit(0), labels.limit(0), F.lit(True))).first().score == pytest.approx(0.5)


def test_lasso_is_at_the_optimum():
    """The conditions of the minimum: slopes within the penalty, equal to it where a weight is not 0."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = (rng.random((400, 12)) < 0.3).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * x[:, 1])))).astype(float)
    bias, w = Q.lasso(x, y, np.ones(400), 0.02, rounds=5000)
    slope = x.T @ (1 / (1 + np.exp(-(bias + x @ w))) - y) / 400
    assert abs(np.mean(1 / (1 + np.exp(-(bias + x @ w))) - y)) < 1e-6
    assert np.all(np.abs(slope) <= 0.02 + 1e-6) and np.allclose(slope[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-6)
    assert 0 < (w != 0).sum() < 12
