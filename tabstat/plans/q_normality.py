"""Registry entries: Q-Q points and normality tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabstat.functions.dist import norm_cdf_sql, norm_ppf_sql
from tabstat.operators import clean
from tabstat.operators import normality as nm
from tabstat.plans.registry import T, query, r6, rounded


@query("qq_points", f"""
SELECT event_type, i, {r6("value")} AS sample, {r6(norm_ppf_sql("(i - 0.5) / n"))} AS theoretical
FROM (SELECT event_type, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value) AS BIGINT) AS i,
             count(*) OVER (PARTITION BY event_type) AS n FROM events)
""")
def q_qq_points(spark, sf):
    return rounded(nm.qq_points(T(spark, sf, "events"), "value", by=["event_type"]))


_KS_BODY = ("SELECT {g}n, max(greatest(i / n - cdf, cdf - (i - 1) / n)) AS d FROM ("
            "SELECT {g}CAST(row_number() OVER ({pw}ORDER BY x) AS DOUBLE) AS i, "
            "CAST(count(*) OVER ({pw2}) AS DOUBLE) AS n, {cdf} AS cdf FROM ({src})) GROUP BY {g}n")


def _ks_sql(src: str, by: str | None) -> str:
    g = f"{by}, " if by else ""
    pw = f"PARTITION BY {by} " if by else ""
    pw2 = f"PARTITION BY {by}" if by else ""
    body = _KS_BODY.format(g=g, pw=pw, pw2=pw2, cdf=norm_cdf_sql("x"), src=src)
    return f"SELECT {g}'value' AS \"column\", CAST(n AS BIGINT) AS n, {r6('d')} AS statistic FROM ({body})"


@query("ks_statistic", _ks_sql("SELECT event_type, value AS x FROM events", "event_type"))
def q_ks_statistic(spark, sf):
    return rounded(nm.ks_statistic(T(spark, sf, "events"), ["value"], by=["event_type"]))


@query("ks_standardized", _ks_sql(
    "SELECT (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS x FROM events", None))
def q_ks_standardized(spark, sf):
    return rounded(nm.ks_statistic(T(spark, sf, "events"), ["value"], standardize=True))


def _k2_sql():
    zs, zk, k2 = nm.dagostino_sql()
    return f"""
WITH m AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS mu FROM events),
mom AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n,
               avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5) AS b1,
               avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) AS b2 FROM m GROUP BY 1)
SELECT event_type, 'value' AS "column", {r6(zs)} AS z_skew, {r6(zk)} AS z_kurt, {r6(k2)} AS k2,
       {r6(f"exp(-({k2}) / 2.0)")} AS p_value FROM mom"""


@query("dagostino_k2", _k2_sql())
def q_dagostino_k2(spark, sf):
    return rounded(nm.dagostino_k2(T(spark, sf, "events"), ["value"], by=["event_type"]))


@query("shapiro")
def q_shapiro(spark, sf):
    """W and p per event type (rows-only; pytest checks W against numpy)."""
    return nm.shapiro_test(T(spark, sf, "events"), ["value"], by=["event_type"])


@query("ks_test")
def q_ks_test(spark, sf):
    return nm.ks_test(T(spark, sf, "events"), ["value"], by=["event_type"])


@query("normality_report")
def q_normality_report(spark, sf):
    """Three tests on raw and Box-Cox-transformed columns (rows-only)."""
    li = T(spark, sf, "lineitem").select("l_extendedprice", "l_quantity")
    cols = ["l_extendedprice", "l_quantity"]
    shifted = clean.positive_shift(li, cols)
    transformed, _ = clean.boxcox(shifted, cols)
    return nm.normality_report(li, cols, transform=transformed)


@query("qq_line")
def q_qq_line(spark, sf):
    pts = nm.qq_points(T(spark, sf, "events"), "value", by=["event_type"], plotting="i/n")
    return nm.qq_line(pts.where(F.col("theoretical").isNotNull()), by=["event_type"])
