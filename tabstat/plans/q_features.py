"""Registry entries: projections and features (P1-P12), sort / top-k /
global rank (L1-L3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabstat.operators import features as fe
from tabstat.operators.rank import global_rank, head
from tabstat.plans.registry import EV_NULLS, T, events_with_nulls, query, r6, rounded

SPLIT_DATE = "1999-01-01"


@query("derive", f"""
SELECT l_orderkey, l_linenumber,
       {r6("l_extendedprice * (1 - l_discount)")} AS revenue,
       {r6("l_tax - l_discount")} AS tax_minus_discount,
       {r6("l_quantity * l_discount")} AS qty_x_discount
FROM lineitem
""")
def q_derive(spark, sf):
    li = T(spark, sf, "lineitem")
    out = fe.derive(li, {
        "revenue": F.col("l_extendedprice") * (1 - F.col("l_discount")),
        "tax_minus_discount": "l_tax - l_discount",
        "qty_x_discount": F.col("l_quantity") * F.col("l_discount"),
    })
    return rounded(out.select("l_orderkey", "l_linenumber", "revenue", "tax_minus_discount", "qty_x_discount"))


@query("map_labels", """
SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS INTEGER) AS status_code
FROM orders
""")
def q_map_labels(spark, sf):
    o = T(spark, sf, "orders")
    return fe.map_labels(o, "o_orderstatus", {"F": 1, "O": 0}, out="status_code").select("o_orderkey", "status_code")


@query("one_hot", """
SELECT c_custkey,
  CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS INTEGER) AS c_mktsegment_BUILDING,
  CAST(CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS INTEGER) AS c_mktsegment_FURNITURE,
  CAST(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS INTEGER) AS c_mktsegment_HOUSEHOLD,
  CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS INTEGER) AS c_mktsegment_MACHINERY
FROM customer
""")
def q_one_hot(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return fe.one_hot(c, ["c_mktsegment"], drop_first=True)


def _scale_sql(shift_fn: str, scale_fn: str) -> str:
    cols = ["l_quantity", "l_extendedprice"]
    stats = ", ".join(f"{shift_fn.format(c=c)} AS s_{c}, {scale_fn.format(c=c)} AS k_{c}" for c in cols)
    outs = ", ".join(
        f"{r6(f'(t.{c} - s_{c}) / CASE WHEN k_{c} = 0 OR k_{c} IS NULL THEN 1 ELSE k_{c} END')} AS {c}"
        for c in cols)
    return f"""
WITH p AS (SELECT {stats} FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT_DATE}')
SELECT t.l_orderkey, t.l_linenumber, {outs}
FROM lineitem t, p WHERE t.l_shipdate >= TIMESTAMP '{SPLIT_DATE}'"""


def _train_test(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    train = li.where(F.col("l_shipdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz"))
    test = li.where(F.col("l_shipdate") >= F.lit(SPLIT_DATE).cast("timestamp_ntz"))
    return train, test


@query("minmax_scale", _scale_sql("min({c})", "max({c}) - min({c})"))
def q_minmax_scale(spark, sf):
    train, test = _train_test(spark, sf)
    _, te, _ = fe.minmax_scale(train, test, ["l_quantity", "l_extendedprice"])
    return rounded(te.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))


@query("standard_scale", _scale_sql("avg({c})", "stddev_pop({c})"))
def q_standard_scale(spark, sf):
    train, test = _train_test(spark, sf)
    _, te, _ = fe.standard_scale(train, test, ["l_quantity", "l_extendedprice"])
    return rounded(te.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))


VALUE_EDGES = [0.0, 10.0, 25.0, 100.0, 400.0]
VALUE_LABELS = ["q1", "q2", "q3", "q4"]


@query("bin_labels", """
SELECT CASE WHEN value IS NULL OR value < 0.0 OR value > 400.0 THEN NULL
            WHEN value <= 10.0 THEN 'q1' WHEN value <= 25.0 THEN 'q2'
            WHEN value <= 100.0 THEN 'q3' WHEN value <= 400.0 THEN 'q4' END AS bin,
       count(*) AS count
FROM events GROUP BY 1
""")
def q_bin_labels(spark, sf):
    ev = T(spark, sf, "events")
    b = fe.bin_labels(ev, "value", VALUE_EDGES, VALUE_LABELS, out="bin")
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))


@query("date_parts", """
SELECT o_orderkey, CAST(month(o_orderdate) AS BIGINT) AS month, CAST(year(o_orderdate) AS BIGINT) AS year,
       CAST(year(o_orderdate) AS VARCHAR) AS year_str
FROM orders
""")
def q_date_parts(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return fe.date_parts(o, "o_orderdate").select("o_orderkey", "month", "year", "year_str")


@query("melt", """
SELECT l_orderkey, l_linenumber, measurement, value FROM (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount
  FROM lineitem)
UNPIVOT (value FOR measurement IN (l_quantity, l_discount))
""")
def q_melt(spark, sf):
    li = T(spark, sf, "lineitem")
    return fe.melt(li, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"])


@query("filter_range", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderstatus = 'F'
""")
def q_filter_range(spark, sf):
    o = fe.filter_eq(T(spark, sf, "orders"), "o_orderstatus", "F")
    return fe.filter_years(o, "o_orderdate", 1996, 1998).select("o_orderkey", "o_totalprice")


@query("distinct_values", "SELECT DISTINCT o_orderpriority FROM orders")
def q_distinct_values(spark, sf):
    return fe.distinct_values(T(spark, sf, "orders"), "o_orderpriority")


@query("point_sample", f"""
SELECT event_id, event_type, value FROM events WHERE {fe.sample_unit_sql("event_id", 1729)} < 0.1
""")
def q_point_sample(spark, sf):
    return fe.point_sample(T(spark, sf, "events"), ["value"], key="event_id", fraction=0.1, seed=1729,
                           by=["event_type"])


@query("bounded_points", f"""
SELECT event_id, event_type, value, n FROM (
  SELECT event_id, event_type, value, count(*) OVER (PARTITION BY event_type) AS n,
         row_number() OVER (PARTITION BY event_type ORDER BY {fe.sample_unit_sql("event_id", 1729)}, event_id) AS r
  FROM {EV_NULLS})
WHERE r <= 500
""")
def q_bounded_points(spark, sf):
    """500 points of each event type (null is one) for a scatter plot."""
    return fe.bounded_points(events_with_nulls(spark, sf), ["value"], key="event_id", most=500, by=["event_type"])


@query("head", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 100
""")
def q_head(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return head(o, 100, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


@query("global_rank", """
SELECT event_id, value, CAST(row_number() OVER (ORDER BY value, event_id) AS BIGINT) AS rank FROM events
""")
def q_global_rank(spark, sf):
    ev = T(spark, sf, "events").select("event_id", "value")
    return global_rank(ev, ["value"], tiebreak=["event_id"])


@query("group_rank", """
SELECT event_id, event_type, value,
       CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS BIGINT) AS rank
FROM events
""")
def q_group_rank(spark, sf):
    ev = T(spark, sf, "events").select("event_id", "event_type", "value")
    return global_rank(ev, ["value"], by=["event_type"], tiebreak=["event_id"], descending=True)


@query("sort_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def q_sort_by(spark, sf):
    """L1: descending sort (a range-partitioned global sort)."""
    from tabstat.operators.rank import sort_by

    o = T(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sort_by(o, ["o_totalprice", "o_orderkey"], ascending=[False, True])
