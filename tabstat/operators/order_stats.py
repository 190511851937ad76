"""Exact quantiles and modes that stay bounded per task.

Quantiles use linear interpolation at h = (n-1)p (numpy's default, DuckDB's
``quantile_cont``). One plan at every size: values are collapsed to
(group, column, value, count) with map-side partial aggregation, a distributed
prefix sum over the distinct values gives each value's range of ranks, and the
values whose ranges hold the wanted ranks are picked by one aggregate. No
value list is held in one task or on the driver. NaN counts as missing; a
column or group without values has NULL quantiles.

``approx`` uses ``percentile_approx`` (GK sketch, bounded memory, one pass).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.operators.rank import _as_list


def melt_values(df: DataFrame, cols: Sequence[str], by=None, var: str = "column",
                val: str = "value", dropna: bool = True) -> DataFrame:
    """Numeric columns to long (by..., column, value double)."""
    by = _as_list(by)
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    long = wide.unpivot(by or [], list(cols), var, val)
    if dropna:
        long = long.where(F.col(val).isNotNull() & ~F.isnan(val))
    return long


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by=None,
              method: str = "exact", accuracy: int = 100_000) -> DataFrame:
    """Long table (by..., column, prob, value) of per-column quantiles."""
    cols = list(cols)
    by = _as_list(by)
    probs = [float(p) for p in probs]
    if method == "approx":
        aggs = [F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), probs, accuracy).alias(c) for c in cols]
        wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
        long = wide.unpivot(by or [], cols, "column", "_q")
    elif method == "exact":
        long = _exact(df, cols, probs, by)
    else:
        raise ValueError(f"unknown quantile method {method!r}")
    probabilities = F.array(*[F.lit(p) for p in probs])
    return long.select(*by, "column", F.posexplode(probabilities).alias("_j", "prob"), "_q").select(
        *by, "column", "prob", F.get("_q", F.col("_j")).alias("value"))


def _exact(df: DataFrame, cols, probs, by) -> DataFrame:
    """(by..., column, _q array) from collapsed values (module docstring)."""
    from tabstat.operators.evaluate import prefix_sums

    keys = [*by, "column"]
    counted = melt_values(df, cols, by).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_c"))
    cum = prefix_sums(counted, [*keys, "value"], ["_c"])
    totals = cum.groupBy(*keys).agg(F.min(F.col("_c_cum") - F.col("_c")).alias("_before"), F.sum("_c").alias("_n"))
    # every group and column has a row, also those without values
    groups = (df.select(*by).distinct() if by else df.sparkSession.range(1)).select(
        *by, F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    same = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
    placed = cum.alias("_l").join(totals.alias("_r"), same).select(
        *[F.col(f"_l.{k}") for k in keys], "value", (F.col("_c_cum") - F.col("_before")).alias("_to"), "_n")
    picks = []
    for j, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(p)
        low = F.floor(h) + 1
        picks += [F.min(F.when(F.col("_to") >= low, F.col("value"))).alias(f"_a{j}"),
                  F.min(F.when(F.col("_to") >= F.least(low + 1, F.col("_n")), F.col("value"))).alias(f"_b{j}"),
                  F.first(h - F.floor(h)).alias(f"_f{j}")]
    picked = placed.groupBy(*keys).agg(*picks)
    value = [F.when(F.col(f"_f{j}") == 0, F.col(f"_a{j}")).otherwise(
        F.col(f"_a{j}") + F.col(f"_f{j}") * (F.col(f"_b{j}") - F.col(f"_a{j}"))) for j in range(len(probs))]
    return groups.alias("_l").join(picked.alias("_r"), same, "left").select(*[F.col(f"_l.{k}") for k in keys], F.array(*value).alias("_q"))


def quantile_wide(df: DataFrame, cols: Sequence[str], probs: dict[str, float], by=None,
                  method: str = "exact") -> DataFrame:
    """One row per (by..., column) with a column per named probability."""
    by = _as_list(by)
    names = list(probs)
    long = quantiles(df, cols, [probs[n] for n in names], by=by, method=method)
    aggs = [F.max(F.when(F.col("prob") == float(probs[n]), F.col("value"))).alias(n) for n in names]
    return long.groupBy(*by, "column").agg(*aggs)


def modes(df: DataFrame, cols: Sequence[str], by=None) -> DataFrame:
    """Most frequent value per column (NULL and NaN aside); ties -> smallest.

    One shuffle for all columns: melt to (column, value in its own kind),
    count each value (partial aggregation absorbs hot values), keep the first
    of (count desc, value asc) with a ``min(struct)`` aggregate. Output:
    (by..., column, num_value double, int_value decimal, str_value string,
    count long); ``int_value`` is exact for integers of any size.
    """
    by = _as_list(by)
    types = dict(df.dtypes)
    whole = "decimal(38,0)"
    parts = []
    for c in cols:
        kind = "txt" if types[c] == "string" else "int" if types[c] in ("tinyint", "smallint", "int", "bigint") else "num"
        value = F.col(c) if kind == "txt" else F.col(c).cast(whole if kind == "int" else "double")
        if kind == "num":
            value = F.when(~F.isnan(value), value)
        own = {"num": F.lit(None).cast("double"), "int": F.lit(None).cast(whole), "txt": F.lit(None).cast("string"), kind: value}
        parts.append(F.struct(F.lit(c).alias("column"), *[v.alias(k) for k, v in own.items()], value.isNull().alias("isnull")))
    long = df.select(*by, F.explode(F.array(*parts)).alias("_m")).select(*by, "_m.*").where(~F.col("isnull"))
    counted = long.groupBy(*by, "column", "num", "int", "txt").agg(F.count(F.lit(1)).alias("cnt"))
    best = counted.groupBy(*by, "column").agg(
        F.min(F.struct((-F.col("cnt")).alias("neg"), "num", "int", "txt")).alias("_b"))
    return best.select(*by, "column", F.coalesce("_b.num", F.col("_b.int").cast("double")).alias("num_value"),
                       F.col("_b.int").alias("int_value"), F.col("_b.txt").alias("str_value"), (-F.col("_b.neg")).alias("count"))
