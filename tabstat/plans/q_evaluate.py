"""Registry entries: evaluation (E1-E6) on events (label: purchase,
score: value) and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabstat.operators import evaluate as ev
from tabstat.plans.registry import T, query, r6, rounded


def _scored(spark, sf):
    e = T(spark, sf, "events")
    return e.select("event_id", (F.col("event_type") == "purchase").cast("int").alias("label"),
                    F.col("value").alias("score"), F.col("user_id").cast("double").alias("score_user"))


_LAB = "CAST(event_type = 'purchase' AS INTEGER)"


@query("threshold", "SELECT event_id, CAST(value > 100.0 AS INTEGER) AS pred FROM events")
def q_threshold(spark, sf):
    return ev.apply_threshold(_scored(spark, sf), "score", 100.0).select("event_id", "pred")


@query("confusion", f"""
SELECT l AS label, p AS pred, CAST(count(e.event_id) AS BIGINT) AS count
FROM (SELECT unnest([0, 1]) AS l) a CROSS JOIN (SELECT unnest([0, 1]) AS p) b
LEFT JOIN events e ON {_LAB} = l AND CAST(e.value > 100.0 AS INTEGER) = p
GROUP BY l, p
""")
def q_confusion(spark, sf):
    d = ev.apply_threshold(_scored(spark, sf), "score", 100.0)
    return ev.confusion_matrix(d, "label", "pred")


def _metrics_sql(t: float, name: str) -> str:
    return f"""
SELECT '{name}' AS model,
  round(CASE WHEN tp + tn + fp + fn = 0 THEN 0 ELSE (tp + tn) / (tp + tn + fp + fn) END, 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1,
  round(CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END, 6) AS specificity,
  CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp
FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr,
             CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS rc
      FROM (SELECT CAST(sum(CASE WHEN l = 0 AND p = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn,
                   CAST(sum(CASE WHEN l = 0 AND p = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
                   CAST(sum(CASE WHEN l = 1 AND p = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
                   CAST(sum(CASE WHEN l = 1 AND p = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp
            FROM (SELECT {_LAB} AS l, CAST(value > {t} AS INTEGER) AS p FROM events)))"""


@query("metrics", _metrics_sql(100.0, "value>100"))
def q_metrics(spark, sf):
    d = ev.apply_threshold(_scored(spark, sf), "score", 100.0)
    return rounded(ev.classification_metrics(d, "label", "pred", model="value>100", decimals=None))


@query("compare_models", "\nUNION ALL ".join(_metrics_sql(t, f"value>{int(t)}") for t in (50.0, 100.0, 200.0)))
def q_compare_models(spark, sf):
    base = _scored(spark, sf)
    return rounded(ev.compare_models({f"value>{int(t)}": ev.apply_threshold(base, "score", t)
                                      for t in (50.0, 100.0, 200.0)}, "label", decimals=None))


def _roc_sql(score: str, model: str | None = None) -> str:
    m = f"'{model}' AS model, " if model else ""
    return f"""
SELECT {m}CAST('inf' AS DOUBLE) AS threshold, CAST(0.0 AS DOUBLE) AS fpr, CAST(0.0 AS DOUBLE) AS tpr
UNION ALL
SELECT {m}{r6("s")} AS threshold, {r6("cn / tn")} AS fpr, {r6("cp / tp")} AS tpr FROM (
  SELECT s, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(neg) OVER (ORDER BY s DESC) AS cn,
         sum(pos) OVER () AS tp, sum(neg) OVER () AS tn
  FROM (SELECT CAST({score} AS DOUBLE) AS s, sum({_LAB}) AS pos, sum(1 - {_LAB}) AS neg FROM events GROUP BY 1))"""


@query("roc_points", _roc_sql("value"))
def q_roc_points(spark, sf):
    return rounded(ev.roc_curve(_scored(spark, sf), "label", "score").select("threshold", "fpr", "tpr"))


@query("roc_auc", f"""
SELECT {r6("sum(neg * (cp - pos / 2.0)) / (sum(pos) * sum(neg))")} AS auc FROM (
  SELECT pos, neg, sum(pos) OVER (ORDER BY s DESC) AS cp
  FROM (SELECT CAST(value AS DOUBLE) AS s, CAST(sum({_LAB}) AS DOUBLE) AS pos,
               CAST(sum(1 - {_LAB}) AS DOUBLE) AS neg FROM events GROUP BY 1))
""")
def q_roc_auc(spark, sf):
    return rounded(ev.roc_auc_frame(_scored(spark, sf), "label", "score"))


@query("compare_roc", _roc_sql("value", "value") + "\nUNION ALL " + _roc_sql("user_id", "user_id"))
def q_compare_roc(spark, sf):
    d = _scored(spark, sf)
    return rounded(ev.compare_roc({"value": d, "user_id": d.withColumn("score", F.col("score_user"))}, "label"))
