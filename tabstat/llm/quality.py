"""Operator 11: quality by a sparse rule ensemble over text statistics.

Statistics. Counts and shares of a text's characters, words and lines, all
DataFrame functions (``STATISTICS``); nothing else of a row is read.

Rules. A random forest of shallow trees is fitted on the statistics of a
bounded sample of labelled documents. Every path from a root to a node is a
conjunction of bounds (low < statistic <= high, at most one pair a statistic);
equal ones count once, and so does a rule and its complement at a root. Rules
that hold for nearly no or nearly all rows of the sample are dropped.

Weights. A logistic regression with an L1 penalty on the rules leaves a few
dozen of them with a weight. Each penalty is fitted in a task of its own, on
the bounded sample; the one taken is judged by the log loss on a part of the
sample (by a hash of the text) that its trial fit did not see.

Scoring. The rules with a weight are compiled into one Column expression, the
logistic function of the weighted sum of conjunctions, so a table is scored by
a projection in the JVM: no shuffle, no Python, whole texts.

Defined results: null and empty texts have all statistics 0 and get the score
of that row; equal texts score equal; repeated rows repeat; labels other than
0 and 1 are not learnt from, nor are ids with contrary labels; equal texts
count once in the sample, with the mean of their labels as majority; without
labels of both kinds every text scores (n1 + 1) / (n + 2), n1 of the n sampled
texts having label 1; an empty table gives an empty result; other columns are
kept, one named ``score`` is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.llm.common import text_or_empty, written
from tabstat.session import remove_path, ship_package

#: Bound of the training sample (labelled documents, about).
SAMPLE_DOCS = 8_000
#: The forest whose paths are the rules.
TREES, DEPTH, SEED = 40, 3, 11
#: A rule holds for at least this share of the sample, and at most the rest.
SUPPORT = 0.005
#: L1 penalties tried, by log loss on a fourth of the sample; the largest
#: within one per cent of the best.
PENALTIES = (0.0003, 0.001, 0.003)
#: Steps of a fit.
ROUNDS = 1_500


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from: crc32 of the id as text, mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _removed(pattern: str) -> Column:
    """Characters that matches of the pattern hold."""
    return F.col("n") - F.char_length(F.regexp_replace("t", pattern, ""))


#: Statistic -> what it counts, and the count it is divided by (None: as is).
STATISTICS: dict[str, tuple[str | None, str | None]] = {
    "log_chars": (None, None),
    "log_words": (None, None),
    "word_chars": (None, None),
    "letters": (r"\p{L}+", "n"),
    "upper": (r"\p{Lu}+", "n"),
    "digits": (r"[0-9]+", "n"),
    "stops": (r"[.!?]+", "words"),
    "commas": (r"[,;:]+", "words"),
    "symbols": (r"[^\p{L}\p{N}\s.,;:!?'\"()-]+", "n"),
    "doubled": (r"([^\p{L}\p{N}\s])\1+", "words"),
    "long_words": (r"[^\s]{25,}", "n"),
    "distinct_words": (None, None),
    "distinct_lines": (None, None),
    "line_words": (None, None),
    "first_word": (None, None),
}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a column ``stats``, the statistics as an array of doubles
    in the order of STATISTICS."""
    # three projections: what a later one reads more than once is not computed twice
    rows = docs.withColumns({"t": text_or_empty(text)})
    rows = rows.withColumns({"n": F.char_length("t"), "w": F.array_remove(F.split("t", r"\s+"), ""), "l": F.array_remove(F.split("t", r"\n+"), "")})
    rows = rows.withColumns({"words": F.size("w"), "lines": F.size("l")})
    one = F.lit(1.0)
    own = {
        "log_chars": F.log1p("n"), "log_words": F.log1p("words"),
        "word_chars": (F.col("n") - F.col("words")) / F.greatest(F.col("words"), one),
        "distinct_words": F.size(F.array_distinct("w")) / F.greatest(F.col("words"), one),
        "distinct_lines": F.size(F.array_distinct("l")) / F.greatest(F.col("lines"), one),
        "line_words": F.col("words") / F.greatest(F.col("lines"), one),
        "first_word": (F.col("words") - F.size(F.array_remove("w", F.coalesce(F.get("w", F.lit(0)), F.lit(""))))) / F.greatest(F.col("words"), one),
    }
    values = [own[k] if p is None else _removed(p) / F.greatest(F.col(by), one) for k, (p, by) in STATISTICS.items()]
    return rows.withColumn("stats", F.array(*(v.cast("double") for v in values)))


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, low, high) means low < value <= high."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def condition(self, stats: str = "stats") -> str:
        """The conjunction as SQL over the array of statistics."""
        names, out = list(STATISTICS), []
        for name, low, high in self.bounds:
            value = f"{stats}[{names.index(name)}]"
            out += [f"{value} > {low!r}D"] * (low > -math.inf) + [f"{value} <= {high!r}D"] * (high < math.inf)
        return " AND ".join(out)

    def holds(self, values: dict[str, float]) -> bool:
        return all(low < values[name] <= high for name, low, high in self.bounds)


@dataclass
class Model:
    bias: float
    rules: list[Rule] = field(default_factory=list)

    def expression(self, stats: str = "stats") -> Column:
        """The score as a Column of the array of statistics."""
        total = " + ".join([f"{self.bias!r}D", *(f"IF({r.condition(stats)}, {r.weight!r}D, 0.0D)" for r in self.rules)])
        return F.expr(f"1.0D / (1.0D + exp(-({total})))")


def paths(node, bounds: dict[str, tuple[float, float]] | None = None):
    """The bounds at every node below a JVM tree node."""
    if node.subtreeDepth() == 0:
        return
    name, cut = list(STATISTICS)[node.split().featureIndex()], node.split().threshold()
    for child, side in ((node.leftChild(), (-math.inf, cut)), (node.rightChild(), (cut, math.inf))):
        own = dict(bounds or {})
        low, high = own.get(name, (-math.inf, math.inf))
        own[name] = (max(low, side[0]), min(high, side[1]))
        yield own
        yield from paths(child, own)


def rules_of(forest) -> list[Rule]:
    """The different rules of a fitted forest, in a fixed order."""
    found = set()
    for tree in forest.trees:
        for own in paths(tree._call_java("rootNode")):
            rule = tuple(sorted((name, *b) for name, b in own.items()))
            if len(rule) == 1 and rule[0][1] > -math.inf and rule[0][2] == math.inf:
                rule = ((rule[0][0], -math.inf, rule[0][1]),)  # the complement says the same
            found.add(rule)
    return [Rule(r) for r in sorted(found)]


def sample(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = SAMPLE_DOCS) -> DataFrame:
    """(key, label, stats) of about ``most`` labelled documents, chosen by a
    hash of the id, equal texts once. ``allowed`` is the condition on doc_id
    for labels that may be learnt from."""
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(allowed)
             .groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("label")).where("low = label").select("doc_id", "label"))
    share = min(1.0, most / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    return (rows.select(F.sha2("t", 256).alias("key"), "label", "stats").groupBy("key")
            .agg((F.avg("label") >= 0.5).cast("double").alias("label"), F.first("stats").alias("stats")))


def lasso(x: np.ndarray, y: np.ndarray, count: np.ndarray, penalty: float, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise the mean logistic loss of rows (each
    ``count`` times) plus ``penalty`` times the sum of absolute weights; the
    intercept is free. Accelerated proximal steps."""
    share = count / count.sum()
    x = np.hstack([np.ones((len(x), 1)), x])
    limit = np.full(x.shape[1], penalty)
    limit[0] = 0.0
    step = 4.0 / np.linalg.eigvalsh((x * share[:, None]).T @ x)[-1]
    w = v = np.zeros(x.shape[1])
    for t in range(rounds):
        slope = x.T @ (share * (1 / (1 + np.exp(-np.clip(x @ v, -500, 500))) - y))
        new = v - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * limit, 0)
        v = new + t / (t + 3) * (new - w)
        w = new
    return float(w[0]), w[1:]


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    """Weights for one penalty from the whole sample, and the log loss on its
    fourth part of weights fitted on the others. Equal rows are one, weighted."""
    penalty = float(rows["penalty"].iloc[0])
    x = np.vstack(rows["rules"].to_numpy()).astype(float)
    y, part = rows["label"].to_numpy(), rows["part"].to_numpy()

    def fit(own):
        each, count = np.unique(np.hstack([x[own], y[own, None]]), axis=0, return_counts=True)
        return lasso(each[:, :-1], each[:, -1], count, penalty)

    rest, loss = part == 0, math.nan
    if rest.any() and 0 < y[~rest].sum() < (~rest).sum():
        bias, w = fit(~rest)
        p = np.clip(1 / (1 + np.exp(-(bias + x[rest] @ w))), 1e-9, 1 - 1e-9)
        loss = float(-np.mean(np.where(y[rest] == 1, np.log(p), np.log(1 - p))))
    bias, w = fit(np.ones(len(y), bool))
    return pd.DataFrame({"penalty": [penalty], "loss": [loss], "bias": [bias], "weights": [w]})


def train(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = SAMPLE_DOCS, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Rules with their weights, learnt from the labels that ``allowed`` admits."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = written(sample(docs, labels, allowed, most).repartition(8, "key").sortWithinPartitions("key"), "quality-sample")
    rows = rows.repartition(8, "key").sortWithinPartitions("key").withColumn("features", array_to_vector("stats")).persist()
    try:
        n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        if not 0 < ones < n:
            share = (ones + 1) / (n + 2)
            return Model(math.log(share / (1 - share)))
        forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.5,
                                        minInstancesPerNode=max(2, int(SUPPORT * n / 2)), seed=SEED).fit(rows)
        rules = rules_of(forest)
        if not rules:
            return Model(math.log(ones / (n - ones)))
        held = rows.withColumn("rules", F.expr(f"array({', '.join(f'double({r.condition()})' for r in rules)})")).select("key", "label", "rules").persist()
        counts = held.select(F.posexplode("rules").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("s")).collect()
        support = {r.k: r.s / n for r in counts}
        keep = [k for k in range(len(rules)) if SUPPORT <= support[k] <= 1 - SUPPORT]
        if not keep:
            return Model(math.log(ones / (n - ones)))
        rules = [rules[k] for k in keep]
        picked = held.select("label", F.pmod(F.xxhash64("key"), F.lit(4)).alias("part"),
                             F.expr(f"array({', '.join(f'CAST(rules[{k}] AS TINYINT)' for k in keep)})").alias("rules"),
                             F.explode(F.array(*map(F.lit, PENALTIES))).alias("penalty"))
        fits = picked.groupBy("penalty").applyInPandas(_fitted, "penalty double, loss double, bias double, weights array<double>").collect()
        held.unpersist()
        least = min((f.loss for f in fits if not math.isnan(f.loss)), default=math.inf)
        best = max((f for f in fits if f.loss <= least * 1.01), key=lambda f: f.penalty, default=min(fits, key=lambda f: f.penalty))
        return Model(best.bias, [Rule(r.bounds, w) for r, w in zip(rules, best.weights) if w != 0.0])
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with their ``score``."""
    keep = [c for c in docs.columns if c != "score"]
    rows = statistics(docs.select(F.struct(*keep).alias("row"), F.col(text)), text)
    return rows.select("row", model.expression().alias("score")).select("row.*", "score")
