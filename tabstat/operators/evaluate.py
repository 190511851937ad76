"""E1-E6 classification evaluation and the distributed prefix sum.

ROC points need cumulative counts over distinct scores in descending
order. ``prefix_sums`` does that without an unpartitioned window: range
partition on the order key, sort inside partitions, pin, total each
partition (P rows to the driver), then one Arrow-batched pass adds the
running sum of each partition to the offsets of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstat.functions.exprs import safe_div
from tabstat.operators.rank import _as_list
from tabstat.session import materialize


def prefix_sums(df: DataFrame, order_cols, value_cols: Sequence[str], descending: bool = False,
                suffix: str = "_cum", num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in a total order of ``order_cols``.

    ``order_cols`` must identify rows uniquely (e.g. an aggregated key).
    """
    order = _as_list(order_cols)
    vals = list(value_cols)
    keys = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order]
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    tagged = ranged.sortWithinPartitions(*keys).withColumn("_ts_pid", F.spark_partition_id())
    tagged = materialize(tagged, "checkpoint")  # placement becomes stored data
    totals = tagged.groupBy("_ts_pid").agg(*[F.sum(F.col(v).cast("double")).alias(v) for v in vals]).collect()
    totals = sorted(totals, key=lambda r: r["_ts_pid"])
    offsets, running = {}, np.zeros(len(vals))
    for r in totals:
        offsets[int(r["_ts_pid"])] = running.copy()
        running = running + np.array([float(r[v] or 0.0) for v in vals])

    out_fields = list(df.schema.fields) + [T.StructField(f"{v}{suffix}", T.DoubleType()) for v in vals]
    schema = T.StructType(out_fields + [T.StructField("_ts_pid", T.IntegerType())])

    def scan(batches):
        # running sums per stored partition id; rows of one id arrive in order
        carry = {}
        for pdf in batches:
            if pdf.empty:
                continue
            x = pdf[vals].astype("float64").fillna(0.0).to_numpy()
            pid = pdf["_ts_pid"].to_numpy()
            out = np.empty_like(x)
            starts = np.r_[0, np.nonzero(pid[1:] != pid[:-1])[0] + 1, len(pid)]
            for a, b in zip(starts[:-1], starts[1:]):
                key = int(pid[a])
                base = carry.get(key, offsets.get(key, np.zeros(len(vals))))
                seg = x[a:b].cumsum(axis=0) + base
                out[a:b] = seg
                carry[key] = seg[-1]
            for j, v in enumerate(vals):
                pdf[f"{v}{suffix}"] = out[:, j]
            yield pdf

    out = tagged.mapInPandas(scan, schema)
    return out.drop("_ts_pid")


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(label, pred, count) over the full 2×2 grid, zero cells included."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    row = df.agg(*[F.sum(F.when((y == a) & (p == b), 1).otherwise(0)).cast("long").alias(f"c{a}{b}")
                   for a in (0, 1) for b in (0, 1)])
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("pred"), F.col(f"c{a}{b}").alias("count"))
                      for a in (0, 1) for b in (0, 1)])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def classification_metrics(df: DataFrame, label: str, pred: str, model: str = "model",
                           decimals: int | None = 2) -> DataFrame:
    """Accuracy, precision, recall, f1, specificity and the four counts.

    Zero denominators give 0 (never NaN). One aggregate.
    """
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    c = df.agg(F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).cast("long").alias("tn"),
               F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).cast("long").alias("fp"),
               F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).cast("long").alias("fn"),
               F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).cast("long").alias("tp"))
    tn, fp, fn, tp = (F.col(k).cast("double") for k in ("tn", "fp", "fn", "tp"))
    prec = safe_div(tp, tp + fp, 0.0)
    rec = safe_div(tp, tp + fn, 0.0)
    f1 = safe_div(2 * prec * rec, prec + rec, 0.0)
    metrics = {"accuracy": safe_div(tp + tn, tp + tn + fp + fn, 0.0), "precision": prec, "recall": rec,
               "f1": f1, "specificity": safe_div(tn, tn + fp, 0.0)}
    rnd = (lambda e: F.round(e, decimals)) if decimals is not None else (lambda e: e)
    return c.select(F.lit(model).alias("model"), *[rnd(v).alias(k) for k, v in metrics.items()],
                    "tn", "fp", "fn", "tp")


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg) per distinct score (partial aggregation)."""
    y = F.col(label).cast("int")
    return (df.where(F.col(score).isNotNull() & y.isNotNull())
            .groupBy(F.col(score).cast("double").alias("threshold"))
            .agg(F.sum(y).cast("double").alias("pos"), F.sum(1 - y).cast("double").alias("neg")))


def _roc_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, pos, neg, pos_cum, neg_cum) at every distinct score."""
    return prefix_sums(score_counts(df, label, score), ["threshold"], ["pos", "neg"], descending=True)


def roc_curve(df: DataFrame, label: str, score: str, model: str | None = None) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, descending.

    A row is "predicted positive" at threshold t when score >= t, so tied
    scores move together. The start point (0, 0) has threshold inf and no
    counts; a score of inf has a point of its own.
    """
    cum = _roc_counts(df, label, score)
    tot = cum.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = float(tot["P"] or 0.0), float(tot["N"] or 0.0)
    pts = cum.select("threshold", (F.col("neg_cum") / F.lit(N if N else float("nan"))).alias("fpr"),
                     (F.col("pos_cum") / F.lit(P if P else float("nan"))).alias("tpr"),
                     "pos", "neg", "pos_cum", "neg_cum")
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], pts.schema)
    out = start.unionByName(pts)
    if model is not None:
        out = out.select(F.lit(model).alias("model"), *out.columns)
    return out


def roc_auc(df: DataFrame, label: str, score: str) -> float:
    """Exact area under the ROC curve (ties count one half)."""
    return float(roc_auc_frame(df, label, score).first()["auc"])


def roc_auc_frame(df: DataFrame, label: str, score: str) -> DataFrame:
    """AUC = Σ_t neg_t · (tp_t - pos_t/2) / (P·N), tp_t inclusive at t."""
    cum = _roc_counts(df, label, score)
    return cum.agg((F.sum(F.col("neg") * (F.col("pos_cum") - F.col("pos") / 2.0))
                    / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def apply_threshold(df: DataFrame, score: str, t: float, out: str = "pred") -> DataFrame:
    """E5: 0/1 prediction, score > t (strict)."""
    return df.withColumn(out, (F.col(score) > F.lit(float(t))).cast("int"))


def compare_models(scored: Mapping[str, DataFrame], label: str, pred: str = "pred",
                   decimals: int | None = 2) -> DataFrame:
    """One metrics row per model (union of E2)."""
    out = None
    for name, d in scored.items():
        m = classification_metrics(d, label, pred, model=name, decimals=decimals)
        out = m if out is None else out.unionByName(m)
    return out


def compare_roc(scored: Mapping[str, DataFrame], label: str, score: str = "score") -> DataFrame:
    """All ROC curves in one long table (model, threshold, fpr, tpr)."""
    out = None
    for name, d in scored.items():
        c = roc_curve(d, label, score, model=name).select("model", "threshold", "fpr", "tpr")
        out = c if out is None else out.unionByName(c)
    return out


def compare_scored(scored: DataFrame, model: str = "model", label: str = "label", score: str = "score",
                   pred: str = "pred", decimals: int | None = 4) -> DataFrame:
    """E6 from one long frame: a row per model with metrics and exact AUC.

    One aggregate for the counts of all models, one prefix sum over
    (model, score) for all AUCs.
    """
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    c = scored.groupBy(model).agg(*[F.sum(F.when((y == a) & (p == b), 1).otherwise(0)).cast("long").alias(k) for k, (a, b) in cells.items()])
    tn, fp, fn, tp = (F.col(k).cast("double") for k in cells)
    prec, rec = safe_div(tp, tp + fp, 0.0), safe_div(tp, tp + fn, 0.0)
    values = {"accuracy": safe_div(tp + tn, tp + tn + fp + fn, 0.0), "precision": prec, "recall": rec,
              "f1": safe_div(2 * prec * rec, prec + rec, 0.0), "specificity": safe_div(tn, tn + fp, 0.0)}
    counts = (scored.where(F.col(score).isNotNull() & y.isNotNull())
              .groupBy(F.col(model), F.col(score).cast("double").alias("threshold"))
              .agg(F.sum(y).cast("double").alias("pos"), F.sum(1 - y).cast("double").alias("neg")))
    cum = prefix_sums(counts, [model, "threshold"], ["pos"], descending=True)
    area = cum.groupBy(F.col(model).alias("_m")).agg(
        F.sum(F.col("neg") * (F.col("pos_cum") - F.col("pos") / 2.0)).alias("a"), F.min(F.col("pos_cum") - F.col("pos")).alias("s"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    auc = area.select("_m", safe_div(F.col("a") - F.col("s") * F.col("n"), F.col("p") * F.col("n")).alias("auc"))
    rnd = (lambda e: F.round(e, decimals)) if decimals is not None else (lambda e: e)
    return (c.join(auc, F.col(model).eqNullSafe(F.col("_m")))
            .select(model, *[rnd(v).alias(k) for k, v in values.items()], *cells, rnd(F.col("auc")).alias("auc")))


def roc_long(scored: DataFrame, model: str = "model", label: str = "label", score: str = "score") -> DataFrame:
    """(model, threshold, fpr, tpr) of all models and the chance line.

    Every curve has its start point (threshold inf); ``baseline`` is the
    diagonal of a score that knows nothing.
    """
    y = F.col(label).cast("int")
    counts = (scored.where(F.col(score).isNotNull() & y.isNotNull())
              .groupBy(F.col(model).alias("model"), F.col(score).cast("double").alias("threshold"))
              .agg(F.sum(y).cast("double").alias("pos"), F.sum(1 - y).cast("double").alias("neg")))
    cum = prefix_sums(counts, ["model", "threshold"], ["pos", "neg"], descending=True)
    total = cum.groupBy(F.col("model").alias("_m")).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.min(F.col("pos_cum") - F.col("pos")).alias("p0"),
        F.min(F.col("neg_cum") - F.col("neg")).alias("n0"))
    points = cum.join(total, F.col("model") == F.col("_m")).select(
        "model", "threshold", safe_div(F.col("neg_cum") - F.col("n0"), F.col("n")).alias("fpr"),
        safe_div(F.col("pos_cum") - F.col("p0"), F.col("p")).alias("tpr"))
    inf, zero = F.lit(float("inf")), F.lit(0.0)
    starts = total.select(F.col("_m").alias("model"), inf.alias("threshold"), zero.alias("fpr"), zero.alias("tpr"))
    ends = scored.sparkSession.createDataFrame([("baseline", float("inf"), 0.0, 0.0), ("baseline", 0.0, 1.0, 1.0)], points.schema)
    return starts.unionByName(points).unionByName(ends)
