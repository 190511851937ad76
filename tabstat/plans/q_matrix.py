"""Registry entries: matrix operators and regression (M1-M5, R1-R9) on
lineitem (price ~ quantity [+ discount])."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabstat.operators import matrix as mx
from tabstat.operators import regress as rg
from tabstat.plans.registry import T, query, r6, rounded

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SPLIT = "1999-01-01"


def _li(spark, sf):
    return T(spark, sf, "lineitem")


def _r4(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 4)"


def _frame(spark, rows, schema, digits=6):
    return rounded(spark.createDataFrame(rows, schema), digits)


@query("gramian", "\nUNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {r6(f'sum(CAST({a} AS DOUBLE) * {b})')} AS value FROM lineitem"
    for a in LINE_NUM for b in LINE_NUM) + "\nUNION ALL SELECT 'n', 'n', CAST(count(*) AS DOUBLE) FROM lineitem")
def q_gramian(spark, sf):
    return rounded(mx.cross_products(_li(spark, sf), LINE_NUM))


_RAW2 = ("(SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_discount) AS b, "
         "sum(l_discount * l_discount) AS c FROM lineitem)")
_EIG_HI = "((a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b))"
_EIG_LO = f"((a * c - b * b) / {_EIG_HI})"


@query("singular_values_2", f"""
SELECT CAST(1 AS BIGINT) AS k, {_r4(f"sqrt({_EIG_HI})")} AS value FROM {_RAW2}
UNION ALL SELECT CAST(2 AS BIGINT), {_r4(f"sqrt({_EIG_LO})")} FROM {_RAW2}
""")
def q_singular_values_2(spark, sf):
    s = mx.singular_values(mx.triangle(_li(spark, sf), ["l_quantity", "l_discount"]))
    return _frame(spark, [(i + 1, float(v)) for i, v in enumerate(s)], "k long, value double", 4)


@query("condition_number_2", f"SELECT {_r4(f'sqrt({_EIG_HI} / {_EIG_LO})')} AS condition_number FROM {_RAW2}")
def q_condition_number_2(spark, sf):
    c = mx.condition_number(mx.triangle(_li(spark, sf), ["l_quantity", "l_discount"]))
    return _frame(spark, [(c,)], "condition_number double", 4)


_COV2 = ("(SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount) AS b, "
         "var_samp(l_discount) AS c FROM lineitem)")


@query("pca_ratio_2", f"""
SELECT CAST(1 AS BIGINT) AS k, {r6(f"{_EIG_HI} / (a + c)")} AS ratio, {r6(f"{_EIG_HI} / (a + c)")} AS cumulative
FROM {_COV2}
UNION ALL SELECT CAST(2 AS BIGINT), {r6(f"{_EIG_LO} / (a + c)")}, CAST(1.0 AS DOUBLE) FROM {_COV2}
""")
def q_pca_ratio_2(spark, sf):
    cv = mx.cumulative_variance(_li(spark, sf), ["l_quantity", "l_discount"])
    rows = [(int(k), float(r), float(c)) for k, r, c in cv.itertuples(index=False)]
    return _frame(spark, rows, "k long, ratio double, cumulative double")


@query("vif_2", f"""
SELECT 'l_quantity' AS variable, {_r4("1 / (1 - b * b / (a * c))")} AS vif FROM {_RAW2}
UNION ALL SELECT 'l_discount', {_r4("1 / (1 - b * b / (a * c))")} FROM {_RAW2}
""")
def q_vif_2(spark, sf):
    return rounded(rg.vif(_li(spark, sf), ["l_quantity", "l_discount"]), 4)


_OLS1 = """(SELECT regr_count(l_extendedprice, l_quantity) AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx,
        regr_sxy(l_extendedprice, l_quantity) AS sxy, regr_syy(l_extendedprice, l_quantity) AS syy,
        regr_avgx(l_extendedprice, l_quantity) AS mx, regr_avgy(l_extendedprice, l_quantity) AS my FROM lineitem)"""
_S2 = "((syy - sxy / sxx * sxy) / (n - 2))"


@query("ols_1", f"""
SELECT 'const' AS term, {_r4("my - sxy / sxx * mx")} AS coef, {_r4(f"sqrt({_S2} * (1.0 / n + mx * mx / sxx))")} AS se,
       {_r4(f"(my - sxy / sxx * mx) / sqrt({_S2} * (1.0 / n + mx * mx / sxx))")} AS t FROM {_OLS1}
UNION ALL
SELECT 'l_quantity', {_r4("sxy / sxx")}, {_r4(f"sqrt({_S2} / sxx)")}, {_r4(f"(sxy / sxx) / sqrt({_S2} / sxx)")} FROM {_OLS1}
""")
def q_ols_1(spark, sf):
    m = rg.ols_fit(_li(spark, sf), "l_extendedprice", ["l_quantity"])
    rows = [(nm, b, se, t) for nm, b, se, t, *_ in m.summary_rows()]
    return _frame(spark, rows, "term string, coef double, se double, t double", 4)


_OLS2 = """(SELECT *, s11 * s22 - s12 * s12 AS det,
        (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
        (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM (
  SELECT CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my,
         var_pop(l_quantity) * count(*) AS s11, var_pop(l_discount) * count(*) AS s22,
         covar_pop(l_quantity, l_discount) * count(*) AS s12, covar_pop(l_quantity, l_extendedprice) * count(*) AS s1y,
         covar_pop(l_discount, l_extendedprice) * count(*) AS s2y, var_pop(l_extendedprice) * count(*) AS syy
  FROM lineitem))"""
_SSR2 = "(syy - b1 * s1y - b2 * s2y)"
_LLF2 = f"(-n / 2 * (ln(2 * pi()) + ln({_SSR2} / n) + 1))"


@query("ols_2", f"""
SELECT 'const' AS name, {_r4("my - b1 * m1 - b2 * m2")} AS value FROM {_OLS2}
UNION ALL SELECT 'l_quantity', {_r4("b1")} FROM {_OLS2}
UNION ALL SELECT 'l_discount', {_r4("b2")} FROM {_OLS2}
UNION ALL SELECT 'r2', {_r4(f"1 - {_SSR2} / syy")} FROM {_OLS2}
UNION ALL SELECT 'adj_r2', {_r4(f"1 - (n - 1) / (n - 3) * ({_SSR2} / syy)")} FROM {_OLS2}
UNION ALL SELECT 'aic', {_r4(f"-2 * {_LLF2} + 6")} FROM {_OLS2}
UNION ALL SELECT 'bic', {_r4(f"-2 * {_LLF2} + 3 * ln(n)")} FROM {_OLS2}
UNION ALL SELECT 'f', {_r4(f"((syy - {_SSR2}) / 2) / ({_SSR2} / (n - 3))")} FROM {_OLS2}
""")
def q_ols_2(spark, sf):
    m = rg.ols_fit(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"])
    rows = [(nm, float(b)) for nm, b in zip(m.names, m.params)]
    rows += [("r2", m.r2), ("adj_r2", m.adj_r2), ("aic", m.aic), ("bic", m.bic), ("f", m.fvalue)]
    return _frame(spark, rows, "name string, value double", 4)


@query("ols_predict_mse", f"""
WITH p AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
           FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT}'),
t AS (SELECT l_extendedprice AS y, a + b * l_quantity AS yhat FROM lineitem, p WHERE l_shipdate >= TIMESTAMP '{SPLIT}')
SELECT {_r4("avg((y - yhat) * (y - yhat))")} AS mse,
       {r6("1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(y))")} AS r2 FROM t
""")
def q_ols_predict_mse(spark, sf):
    li = _li(spark, sf)
    split = F.lit(SPLIT).cast("timestamp_ntz")
    m = rg.ols_fit(li.where(F.col("l_shipdate") < split), "l_extendedprice", ["l_quantity"])
    out = rg.mse(li.where(F.col("l_shipdate") >= split), "l_extendedprice", m.predict_column())
    return out.select(F.round("mse", 4).alias("mse"), F.round("r2", 6).alias("r2"))


@query("residual_moments", f"""
WITH p AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
           FROM lineitem),
e AS (SELECT l_extendedprice - (a + b * l_quantity) AS e FROM lineitem, p),
c AS (SELECT e - avg(e) OVER () AS d FROM e),
m AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(d * d * d) / pow(avg(d * d), 1.5) AS s,
             avg(d * d * d * d) / pow(avg(d * d), 2) AS k FROM c)
SELECT CAST(n AS BIGINT) AS n, {r6("s")} AS skew, {r6("k")} AS kurtosis,
       {r6("n / 6 * (s * s + (k - 3) * (k - 3) / 4)")} AS jarque_bera FROM m
""")
def q_residual_moments(spark, sf):
    li = _li(spark, sf)
    m = rg.ols_fit(li, "l_extendedprice", ["l_quantity"])
    d = rg.ols_diagnostics(li, m)
    return _frame(spark, [(int(d["n"]), d["skew"], d["kurtosis"], d["jarque_bera"])],
                  "n long, skew double, kurtosis double, jarque_bera double")


@query("backward_2", f"""
SELECT CAST(1 AS INTEGER) AS step, 'l_discount' AS dropped, {_r4(f"1 - {_SSR2} / syy")} AS r2,
       {_r4(f"1 - (n - 1) / (n - 3) * ({_SSR2} / syy)")} AS adj_r2, {_r4(f"-2 * {_LLF2} + 6")} AS aic,
       {_r4(f"-2 * {_LLF2} + 3 * ln(n)")} AS bic,
       {_r4(f"b2 / sqrt({_SSR2} / (n - 3) * s11 / det)")} AS t FROM {_OLS2}
""")
def q_backward_2(spark, sf):
    log, _ = rg.backward_elimination(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount"],
                                     drops=["l_discount"])
    rows = [(s, d, r2, ar2, aic, bic, t) for s, d, r2, ar2, aic, bic, _f, _fp, t, _tp in log]
    return _frame(spark, rows, "step int, dropped string, r2 double, adj_r2 double, aic double, bic double, t double",
                  4)


# --- rows-only: full inference tables and model-based operators -------------

@query("ols_summary")
def q_ols_summary(spark, sf):
    m = rg.ols_fit(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame(m.summary_rows(), "term string, coef double, se double, t double, p double, "
                                                   "ci_lo double, ci_hi double")


@query("ols_diagnostics")
def q_ols_diagnostics(spark, sf):
    li = _li(spark, sf)
    m = rg.ols_fit(li, "l_extendedprice", ["l_quantity", "l_discount"])
    d = rg.ols_diagnostics(li.withColumn("_k", F.col("l_orderkey") * 100 + F.col("l_linenumber")), m,
                           order_col="_k")
    return spark.createDataFrame([(k, float(v)) for k, v in d.items()], "statistic string, value double")


@query("prediction_interval_1")
def q_prediction_interval_1(spark, sf):
    li = _li(spark, sf)
    split = F.lit(SPLIT).cast("timestamp_ntz")
    m = rg.ols_fit(li.where(F.col("l_shipdate") < split), "l_extendedprice", ["l_quantity"])
    return m.prediction_interval(li.where(F.col("l_shipdate") >= split), keep=["l_orderkey", "l_linenumber"])


# the t quantile of v degrees of freedom from the normal one, to v^-3 (v is thousands here)
_T975 = ("(1.959963984540054 + (z3 + z) / (4 * v) + (5 * z5 + 16 * z3 + 3 * z) / (96 * v * v) "
         "+ (3 * z7 + 19 * z5 + 17 * z3 - 15 * z) / (384 * v * v * v))")
_UNITS = {"mean": "", "mean_lo": " - t * sqrt(s2 * lever)", "mean_hi": " + t * sqrt(s2 * lever)",
          "obs_lo": " - t * sqrt(s2 * (1 + lever))", "obs_hi": " + t * sqrt(s2 * (1 + lever))"}


@query("prediction_interval_units", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_shipdate < TIMESTAMP '{SPLIT}' AS train, CAST(l_quantity AS DOUBLE) AS x,
                  CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
c AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my FROM r WHERE train AND x IS NOT NULL AND y IS NOT NULL),
s AS (SELECT sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy
      FROM r, c WHERE train AND x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT *, sxy / sxx AS b, (syy - sxy * sxy / sxx) / (n - 2) AS s2, CAST(n - 2 AS DOUBLE) AS v, 1.959963984540054 AS z FROM c, s),
q AS (SELECT *, pow(z, 3) AS z3, pow(z, 5) AS z5, pow(z, 7) AS z7 FROM k),
m AS (SELECT *, {_T975} AS t FROM q),
o AS (SELECT r.*, m.*, 1.0 / n + (x - mx) * (x - mx) / sxx AS lever FROM r, m WHERE NOT train)
SELECT l_orderkey, l_linenumber, {", ".join(f"round(my + b * (x - mx){e}, 4) AS {c}" for c, e in _UNITS.items())} FROM o
""")
def q_prediction_interval_units(spark, sf):
    """R7 on standardised columns, turned back into prices."""
    li = _li(spark, sf)
    split = F.lit(SPLIT).cast("timestamp_ntz")
    out = rg.interval_in_units(li.where(F.col("l_shipdate") < split), li.where(F.col("l_shipdate") >= split), "l_extendedprice", ["l_quantity"],
                               keep=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 4).alias(c) for c in _UNITS))


@query("backward_elimination")
def q_backward_elimination(spark, sf):
    log, _ = rg.backward_elimination(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"],
                                     drops="auto")
    return spark.createDataFrame(log, rg.ELIMINATION_SCHEMA)


@query("vif")
def q_vif(spark, sf):
    return rg.vif(_li(spark, sf), LINE_NUM)


@query("vif_3", """
WITH m AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_discount) AS b, sum(l_quantity * l_tax) AS c,
                  sum(l_discount * l_discount) AS d, sum(l_discount * l_tax) AS e, sum(l_tax * l_tax) AS f FROM lineitem),
t AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM m)
SELECT 'l_quantity' AS variable, round(a * (d * f - e * e) / det, 6) AS vif FROM t
UNION ALL SELECT 'l_discount', round(d * (a * f - c * c) / det, 6) FROM t
UNION ALL SELECT 'l_tax', round(f * (a * d - b * b) / det, 6) FROM t""")
def q_vif_3(spark, sf):
    return rounded(rg.vif(_li(spark, sf), ["l_quantity", "l_discount", "l_tax"]))


@query("pca_transform")
def q_pca_transform(spark, sf):
    li = _li(spark, sf)
    split = F.lit(SPLIT).cast("timestamp_ntz")
    model = mx.pca_fit(li.where(F.col("l_shipdate") < split), LINE_NUM, variance=0.95)
    return model.transform(li.where(F.col("l_shipdate") >= split), keep=["l_orderkey", "l_linenumber"])


@query("cumulative_variance")
def q_cumulative_variance(spark, sf):
    cv = mx.cumulative_variance(_li(spark, sf), LINE_NUM)
    return spark.createDataFrame([(int(k), float(r), float(c)) for k, r, c in cv.itertuples(index=False)],
                                 "k long, ratio double, cumulative double")


@query("importance")
def q_importance(spark, sf):
    """R8 with 20 trees of depth 8 instead of the default 100 of depth 30, to
    keep the query short."""
    return rg.forest_importance(_li(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"],
                                num_trees=20, max_depth=8)


@query("drop_correlated", """
SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem
WHERE (SELECT greatest(abs(corr(l_quantity, l_extendedprice)), abs(corr(l_quantity, l_discount)), abs(corr(l_quantity, l_tax)),
                       abs(corr(l_extendedprice, l_discount)), abs(corr(l_extendedprice, l_tax)), abs(corr(l_discount, l_tax)))
       FROM lineitem) <= 0.5""")
def q_drop_correlated(spark, sf):
    out, _ = rg.drop_correlated(_li(spark, sf).select(*LINE_NUM), LINE_NUM, threshold=0.5)
    return out


@query("compare_regressions")
def q_compare_regressions(spark, sf):
    li = _li(spark, sf)
    split = F.lit(SPLIT).cast("timestamp_ntz")
    train, test = li.where(F.col("l_shipdate") < split), li.where(F.col("l_shipdate") >= split)
    feats = ["l_quantity", "l_discount", "l_tax"]
    g = mx.gramian(train, [*feats, "l_extendedprice"])
    full = rg.ols_from_gram(g, "l_extendedprice", feats)
    _, back = rg.backward_elimination(train, "l_extendedprice", feats, g=g)
    # PCA fitted on train (centred, first k above 95 % variance), OLS on scores
    pca = mx.pca_fit(g.sub(feats), variance=0.95)
    pcs = [f"pc{i + 1}" for i in range(pca.k)]
    tr_p = pca.transform(train, keep=["l_extendedprice"])
    te_p = pca.transform(test, keep=["l_extendedprice"])
    on_pca = rg.ols_fit(tr_p, "l_extendedprice", pcs)
    # the features that a small forest finds important
    imp = rg.forest_importance(train, "l_extendedprice", feats, num_trees=10, max_depth=6, min_importance=0.05)
    picked = sorted(r["feature"] for r in imp.collect()) or feats
    by_importance = rg.ols_from_gram(g, "l_extendedprice", picked)
    rows = rg.compare_regressions({"full": full, "backward": back, "importance": by_importance, "pca": on_pca},
                                  {"full": test, "backward": test, "importance": test, "pca": te_p})
    return spark.createDataFrame(rows, "model string, r2 double, adj_r2 double, aic double, bic double, mse double")

