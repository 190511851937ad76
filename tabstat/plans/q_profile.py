"""Registry entries: aggregations and profiling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabstat.operators import profile as pr
from tabstat.plans.registry import T, query, r6, rounded

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("monthly_sum", f"""
SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
       {r6("sum(o_totalprice)")} AS total
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2
""")
def q_monthly_sum(spark, sf):
    o = T(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    o = o.select(F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month"),
                 "o_totalprice")
    return rounded(pr.group_sum(o, ["year", "month"], "o_totalprice", out="total"))


@query("monthly_mean", f"""
SELECT * FROM (
  SELECT l_returnflag, CAST(year(l_shipdate) AS BIGINT) AS year, CAST(month(l_shipdate) AS BIGINT) AS month,
         {r6("avg(l_quantity)")} AS mean_l_quantity, {r6("avg(l_extendedprice)")} AS mean_l_extendedprice
  FROM lineitem GROUP BY 1, 2, 3) WHERE l_returnflag = 'R'
""")
def q_monthly_mean(spark, sf):
    li = T(spark, sf, "lineitem").select(
        "l_returnflag", F.year("l_shipdate").cast("long").alias("year"),
        F.month("l_shipdate").cast("long").alias("month"), "l_quantity", "l_extendedprice")
    g = pr.group_mean(li, ["l_returnflag", "year", "month"], ["l_quantity", "l_extendedprice"])
    # filter on the key after grouping; Catalyst pushes it below the aggregate
    return rounded(g.where(F.col("l_returnflag") == "R"))


@query("group_multi_agg", f"""
SELECT l_linestatus, {r6("avg(l_quantity)")} AS mean_l_quantity, {r6("avg(l_discount)")} AS mean_l_discount,
       {r6("avg(l_tax)")} AS mean_l_tax
FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 1998 GROUP BY 1
""")
def q_group_multi_agg(spark, sf):
    from tabstat.operators.features import filter_years
    li = filter_years(T(spark, sf, "lineitem"), "l_shipdate", 1996, 1998)
    return rounded(pr.group_mean(li, ["l_linestatus"], ["l_quantity", "l_discount", "l_tax"]))


@query("value_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def q_value_counts(spark, sf):
    return pr.value_counts(T(spark, sf, "events"), "event_type")


@query("share_of_total", f"""
SELECT event_type, {r6("total")} AS total, {r6("total / sum(total) OVER ()")} AS share
FROM (SELECT event_type, CAST(sum(value) AS DOUBLE) AS total FROM events GROUP BY 1)
""")
def q_share_of_total(spark, sf):
    return rounded(pr.share_of_total(T(spark, sf, "events"), "event_type", "value"))


@query("resample_year", f"""
WITH a AS (SELECT date_trunc('year', o_orderdate) AS p, avg(o_totalprice) AS mean_price,
                  sum(o_totalprice) AS total_price, count(o_orderkey) AS n_orders
           FROM orders GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(p) FROM a), (SELECT max(p) FROM a), INTERVAL 1 YEAR)) AS p)
SELECT strftime(CAST(s.p + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE), '%Y-%m-%d') AS period,
       {r6("a.mean_price")} AS mean_price, {r6("coalesce(a.total_price, 0)")} AS total_price,
       CAST(coalesce(a.n_orders, 0) AS BIGINT) AS n_orders
FROM s LEFT JOIN a ON s.p = a.p
""")
def q_resample_year(spark, sf):
    o = T(spark, sf, "orders")
    out = pr.resample(o, "o_orderdate", "year", {"mean_price": ("o_totalprice", "mean"),
                                                 "total_price": ("o_totalprice", "sum"),
                                                 "n_orders": ("o_orderkey", "count")})
    return rounded(out)


@query("resample_day", f"""
WITH a AS (SELECT date_trunc('day', ts) AS p, sum(value) AS total_value, count(event_id) AS n_events,
                  max(value) AS max_value
           FROM events GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(p) FROM a), (SELECT max(p) FROM a), INTERVAL 1 DAY)) AS p)
SELECT strftime(CAST(s.p AS DATE), '%Y-%m-%d') AS period, {r6("coalesce(a.total_value, 0)")} AS total_value,
       CAST(coalesce(a.n_events, 0) AS BIGINT) AS n_events, {r6("a.max_value")} AS max_value
FROM s LEFT JOIN a ON s.p = a.p
""")
def q_resample_day(spark, sf):
    ev = T(spark, sf, "events")
    out = pr.resample(ev, "ts", "day", {"total_value": ("value", "sum"), "n_events": ("event_id", "count"),
                                         "max_value": ("value", "max")})
    return rounded(out)


def _describe_sql(cols):
    parts = []
    for c in cols:
        mode = (f"(SELECT {c} FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)")
        parts.append(
            f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, "
            f"round(CAST({mode} AS DOUBLE), 6) AS mode, round(stddev_samp({c}), 6) AS stddev, "
            f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem")
    return "\nUNION ALL ".join(parts)


@query("describe_table", _describe_sql(LINE_NUM))
def q_describe_table(spark, sf):
    return pr.describe_table(T(spark, sf, "lineitem"), LINE_NUM, decimals=6)


def _pair_sql(fn, name, cols, diagonal_value=None):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if a == b and diagonal_value is not None:
                parts.append(f"SELECT '{a}' AS x, '{b}' AS y, CAST({diagonal_value} AS DOUBLE) AS {name}")
            else:
                parts.append(f"SELECT '{a}' AS x, '{b}' AS y, {r6(f'{fn}({a}, {b})')} AS {name} FROM lineitem")
    return "\nUNION ALL ".join(parts)


@query("corr_matrix", _pair_sql("corr", "corr", LINE_NUM, diagonal_value=1.0))
def q_corr_matrix(spark, sf):
    return rounded(pr.corr_matrix(T(spark, sf, "lineitem"), LINE_NUM))


@query("cov_matrix", _pair_sql("covar_samp", "cov", LINE_NUM))
def q_cov_matrix(spark, sf):
    return rounded(pr.cov_matrix(T(spark, sf, "lineitem"), LINE_NUM))


@query("trendline", f"""
SELECT l_returnflag, {r6("regr_slope(l_extendedprice, l_quantity)")} AS slope,
       {r6("regr_intercept(l_extendedprice, l_quantity)")} AS intercept,
       {r6("regr_r2(l_extendedprice, l_quantity)")} AS r2,
       CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n
FROM lineitem GROUP BY 1
""")
def q_trendline(spark, sf):
    return rounded(pr.trendline(T(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", by=["l_returnflag"]))


def _hist_sql(cols, nbins):
    parts = []
    for c in cols:
        w = f"((hi - lo) / {nbins})"
        b = f"CAST(least(floor(({c} - lo) / {w}), {nbins - 1}) AS BIGINT)"
        parts.append(
            f"SELECT '{c}' AS \"column\", bin, {r6(f'lo + bin * {w}')} AS lo, {r6(f'lo + (bin + 1) * {w}')} AS hi, "
            f"count FROM (SELECT {b} AS bin, count(*) AS count, any_value(lo) AS lo, any_value(hi) AS hi "
            f"FROM lineitem, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM lineitem) "
            f"GROUP BY 1)")
    return "\nUNION ALL ".join(parts)


@query("histogram", _hist_sql(["l_extendedprice", "l_quantity"], 20))
def q_histogram(spark, sf):
    return rounded(pr.histogram(T(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], nbins=20))


@query("histogram_density", f"""
SELECT event_type, bin, {r6("bin * 10.0")} AS lo, {r6("(bin + 1) * 10.0")} AS hi, count,
       {r6("count / (sum(count) OVER (PARTITION BY event_type) * 10.0)")} AS density
FROM (SELECT event_type, CAST(floor((value - 0.0) / 10.0) AS BIGINT) AS bin, count(*) AS count
      FROM events GROUP BY 1, 2)
""")
def q_histogram_density(spark, sf):
    return rounded(pr.histogram_density(T(spark, sf, "events"), "value", width=10.0, origin=0.0, by=["event_type"]))


@query("histogram_2d", """
WITH b AS (SELECT CAST(min(l_quantity) AS DOUBLE) AS xl, CAST(max(l_quantity) AS DOUBLE) AS xh,
                  CAST(min(l_discount) AS DOUBLE) AS yl, CAST(max(l_discount) AS DOUBLE) AS yh FROM lineitem)
SELECT CAST(least(floor((l_quantity - xl) / ((xh - xl) / 40)), 39) AS BIGINT) AS bx,
       CAST(least(floor((l_discount - yl) / ((yh - yl) / 40)), 39) AS BIGINT) AS "by",
       count(*) AS count
FROM lineitem, b GROUP BY 1, 2
""")
def q_histogram_2d(spark, sf):
    return pr.histogram_2d(T(spark, sf, "lineitem"), "l_quantity", "l_discount", 40, 40)


def _kde_sql(grid: int, by: str | None) -> str:
    g = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON TRUE"
    return f"""
WITH d AS (SELECT {g}CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL),
s AS (SELECT {g}count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi,
             pow(CAST(count(*) AS DOUBLE), -0.2) * stddev_samp(v) AS h FROM d {"GROUP BY " + by if by else ""}),
c AS (SELECT {g}v, count(*) AS cnt FROM d GROUP BY {g}v),
gr AS (SELECT {g}i, lo + i * (hi - lo) / {float(grid)} AS x, n, h FROM s,
       (SELECT unnest(generate_series(0, {grid - 1})) AS i))
SELECT {g}CAST(i AS BIGINT) AS i, {r6("any_value(x)")} AS x,
       {r6(f"sum(cnt * exp(-0.5 * ((x - v) / h) * ((x - v) / h))) / (any_value(n) * any_value(h) * {math.sqrt(2 * math.pi)!r})")} AS density
FROM gr JOIN c {on} GROUP BY {g}i
"""


@query("kde", _kde_sql(500, None))
def q_kde(spark, sf):
    return rounded(pr.kde(T(spark, sf, "events"), "value", grid=500))


@query("kde_by_group", _kde_sql(200, "event_type"))
def q_kde_by_group(spark, sf):
    return rounded(pr.kde(T(spark, sf, "events"), "value", by=["event_type"], grid=200))


@query("kde_2d", f"""
WITH d AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS y FROM lineitem),
s AS (SELECT l_returnflag, count(*) AS n, var_samp(x) * pow(CAST(count(*) AS DOUBLE), -1.0/3.0) AS a,
             covar_samp(x, y) * pow(CAST(count(*) AS DOUBLE), -1.0/3.0) AS b,
             var_samp(y) * pow(CAST(count(*) AS DOUBLE), -1.0/3.0) AS c,
             min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM d GROUP BY 1),
s2 AS (SELECT *, a * c - b * b AS det FROM s),
c AS (SELECT l_returnflag, x, y, count(*) AS cnt FROM d GROUP BY 1, 2, 3),
gr AS (SELECT l_returnflag, k, CAST(floor(k / 20) AS BIGINT) AS ix, k % 20 AS iy, n, det, a, b, c,
              xl + floor(k / 20) * (xh - xl) / 20.0 AS gx, yl + (k % 20) * (yh - yl) / 20.0 AS gy
       FROM s2, (SELECT unnest(generate_series(0, 399)) AS k))
SELECT gr.l_returnflag, CAST(any_value(ix) AS BIGINT) AS ix, CAST(any_value(iy) AS BIGINT) AS iy,
       {r6("any_value(gx)")} AS x, {r6("any_value(gy)")} AS y,
       {r6("sum(cnt * exp(-0.5 * ((c / det) * (gx - x) * (gx - x) + 2 * (-b / det) * (gx - x) * (gy - y) + (a / det) * (gy - y) * (gy - y)))) / (any_value(n) * 2 * pi() * sqrt(any_value(det)))")} AS density
FROM gr JOIN c ON gr.l_returnflag = c.l_returnflag GROUP BY gr.l_returnflag, k
""")
def q_kde_2d(spark, sf):
    return rounded(pr.kde_2d(T(spark, sf, "lineitem"), "l_quantity", "l_discount", by=["l_returnflag"], grid=20))


@query("box_stats", f"""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT e.event_type, {r6("any_value(q1)")} AS q1, {r6("any_value(median)")} AS median, {r6("any_value(q3)")} AS q3,
       {r6("min(CASE WHEN value >= lf AND value <= uf THEN value END)")} AS whisker_lo,
       {r6("max(CASE WHEN value >= lf AND value <= uf THEN value END)")} AS whisker_hi,
       CAST(sum(CASE WHEN value >= lf AND value <= uf THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM events e JOIN f ON e.event_type = f.event_type GROUP BY e.event_type
""")
def q_box_stats(spark, sf):
    return rounded(pr.box_stats(T(spark, sf, "events"), "value", by=["event_type"]))


@query("class_weights", f"""
SELECT toxic, count, {r6("n / (k * count)")} AS balanced_weight, {r6("neg / pos")} AS pos_weight
FROM (SELECT toxic, count(*) AS count FROM labels GROUP BY 1),
     (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT toxic) AS DOUBLE) AS k,
             CAST(sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS neg,
             CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos FROM labels)
""")
def q_class_weights(spark, sf):
    return rounded(pr.class_weights(T(spark, sf, "labels"), "toxic"))


@query("kde_binned")
def q_kde_binned(spark, sf):
    """A13 at scale: linear-binned KDE (work independent of the row count)."""
    return pr.kde(T(spark, sf, "events"), "value", by=["event_type"], grid=200, bins=2048)


@query("violin")
def q_violin(spark, sf):
    """Density per event type with its inner box statistics."""
    return pr.violin(T(spark, sf, "events"), "value", by=["event_type"], grid=100)


@query("kde_2d_binned")
def q_kde_2d_binned(spark, sf):
    """A16 at scale: lattice-binned 2-D KDE of order price against quantity."""
    return pr.kde_2d(T(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", by=["l_returnflag"], grid=20,
                     bins=128)
