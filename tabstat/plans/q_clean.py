"""Registry entries: sources (S3) and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabstat.operators import clean
from tabstat.plans.registry import EV_NULLS, DIGITS, T, events_with_nulls, query, r6, rounded
from tabstat.sources.io import select_numeric

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("select_numeric", "SELECT l_discount, l_extendedprice, l_quantity, l_tax FROM lineitem")
def q_select_numeric(spark, sf):
    li = T(spark, sf, "lineitem")
    return select_numeric(li, exclude=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@query("null_profile", f"""
SELECT 'event_type' AS "column", {r6("avg(CASE WHEN event_type IS NULL THEN 1.0 ELSE 0.0 END) * 100")} AS pct_null
FROM {EV_NULLS}
UNION ALL SELECT 'value', {r6("avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) * 100")} FROM {EV_NULLS}
UNION ALL SELECT 'user_id', {r6("avg(CASE WHEN user_id IS NULL THEN 1.0 ELSE 0.0 END) * 100")} FROM {EV_NULLS}
""")
def q_null_profile(spark, sf):
    return rounded(clean.null_profile(events_with_nulls(spark, sf), ["event_type", "value", "user_id"]))


@query("impute_median", f"""
SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {EV_NULLS})) AS value
FROM {EV_NULLS}
""")
def q_impute_median(spark, sf):
    ev = events_with_nulls(spark, sf)
    return clean.impute_median(ev, ["value"]).select("event_id", "value")


_MODE_SQL = f"""(SELECT event_type FROM {EV_NULLS} WHERE event_type IS NOT NULL
GROUP BY event_type ORDER BY count(*) DESC, event_type ASC LIMIT 1)"""


@query("impute_mode", f"""
SELECT event_id, coalesce(event_type, {_MODE_SQL}) AS event_type FROM {EV_NULLS}
""")
def q_impute_mode(spark, sf):
    ev = events_with_nulls(spark, sf)
    return clean.impute_mode(ev, ["event_type"]).select("event_id", "event_type")


@query("drop_null_rows", f"""
SELECT event_id, event_type, value FROM {EV_NULLS}
WHERE event_type IS NOT NULL AND value IS NOT NULL
""")
def q_drop_null_rows(spark, sf):
    ev = events_with_nulls(spark, sf).select("event_id", "event_type", "value")
    return clean.drop_null_rows(ev)


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_drop_columns(spark, sf):
    o = T(spark, sf, "orders")
    return clean.drop_columns(o, ["o_orderstatus", "o_orderdate", "o_orderpriority"])


def _iqr_sql(cols, table):
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.25), 6) AS q1, "
            f"round(quantile_cont({c}, 0.75), 6) AS q3, "
            f"round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr FROM {table}")
    return "\nUNION ALL ".join(parts)


@query("iqr_table", _iqr_sql(LINE_NUM, "lineitem"))
def q_iqr_table(spark, sf):
    return clean.iqr_table(T(spark, sf, "lineitem"), LINE_NUM, decimals=6)


_OUT_COLS = ["value", "user_id"]


def _seq_outlier_sql(k: float) -> str:
    return f"""
WITH s0 AS (SELECT event_id, value, user_id FROM events),
b1 AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s0),
s1 AS (SELECT s0.* FROM s0, b1 WHERE value >= q1 - {k} * (q3 - q1) AND value <= q3 + {k} * (q3 - q1)),
b2 AS (SELECT quantile_cont(user_id, 0.25) AS q1, quantile_cont(user_id, 0.75) AS q3 FROM s1),
s2 AS (SELECT s1.* FROM s1, b2 WHERE user_id >= q1 - {k} * (q3 - q1) AND user_id <= q3 + {k} * (q3 - q1))
SELECT event_id, value, user_id FROM s2"""


@query("remove_outliers_seq", _seq_outlier_sql(1.5))
def q_remove_outliers_seq(spark, sf):
    ev = T(spark, sf, "events").select("event_id", "value", "user_id")
    return clean.remove_outliers_iqr(ev, _OUT_COLS, k=1.5, sequential=True)


@query("remove_outliers_once", """
WITH b AS (SELECT quantile_cont(value, 0.25) AS a1, quantile_cont(value, 0.75) AS a3,
                  quantile_cont(user_id, 0.25) AS b1, quantile_cont(user_id, 0.75) AS b3 FROM events)
SELECT event_id, value, user_id FROM events, b
WHERE value >= a1 - 1.5 * (a3 - a1) AND value <= a3 + 1.5 * (a3 - a1)
  AND user_id >= b1 - 1.5 * (b3 - b1) AND user_id <= b3 + 1.5 * (b3 - b1)
""")
def q_remove_outliers_once(spark, sf):
    ev = T(spark, sf, "events").select("event_id", "value", "user_id")
    return clean.remove_outliers_iqr(ev, _OUT_COLS, k=1.5, sequential=False)


@query("positive_shift", f"""
SELECT c_custkey, {r6("c_acctbal + CASE WHEN m <= 0 THEN abs(m) + 1 ELSE 0 END")} AS c_acctbal
FROM customer, (SELECT min(c_acctbal) AS m FROM customer)
""")
def q_positive_shift(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(clean.positive_shift(c, ["c_acctbal"]))


@query("boxcox_fixed", f"""
WITH s AS (SELECT c_custkey, c_acctbal + CASE WHEN m <= 0 THEN abs(m) + 1 ELSE 0 END AS x
           FROM customer, (SELECT min(c_acctbal) AS m FROM customer))
SELECT c_custkey, {r6("(pow(x, 0.5) - 1) / 0.5")} AS bc_half, {r6("ln(x)")} AS bc_log FROM s
""")
def q_boxcox_fixed(spark, sf):
    c = clean.positive_shift(T(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    two = c.select("c_custkey", F.col("c_acctbal").alias("bc_half"), F.col("c_acctbal").alias("bc_log"))
    out, _ = clean.boxcox(two, ["bc_half", "bc_log"], {"bc_half": 0.5, "bc_log": 0.0})
    return rounded(out, DIGITS)


@query("boxcox_mle")
def q_boxcox_mle(spark, sf):
    """MLE λ for shifted account balances (rows-only check;
    pytest checks llf(λ̂) >= llf(λ̂ ± δ))."""
    c = clean.positive_shift(T(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    lam = clean.boxcox_lambdas(c, ["c_acctbal"])
    return spark.createDataFrame([(k, float(v)) for k, v in lam.items()], "column string, lambda double")


@query("csv_roundtrip", f"SELECT event_id, event_type, value FROM {EV_NULLS}")
def q_csv_roundtrip(spark, sf):
    """Write events as header CSV (NULLs as 'NA') into the shared
    checkpoint folder, read them back with the NA-token reader and schema."""
    import uuid

    from pyspark.sql import types as T_

    from tabstat.session import checkpoint_dir
    from tabstat.sources.io import read_csv, write_csv

    ev = events_with_nulls(spark, sf).select("event_id", "event_type", "value")
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    write_csv(ev.select("event_id", "event_type", F.coalesce(F.col("value").cast("string"), F.lit("NA")).alias("value")),
              path)
    schema = T_.StructType([T_.StructField("event_id", T_.LongType()), T_.StructField("event_type", T_.StringType()),
                            T_.StructField("value", T_.DoubleType())])
    return read_csv(spark, path, schema)
