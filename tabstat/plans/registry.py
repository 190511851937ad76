"""Query registry on the test tables: one Spark plan and one DuckDB oracle
per operator.

Every query reads whole tables (``{sf_dir}/{table}.parquet``); nothing is
subset by id, prefix or row cap. Nulls are injected identically in both
engines where an operator needs them (the test tables have none). Doubles
that come out of floating arithmetic are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabstat.sources.io import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (presentation step shared with the oracle)."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def events_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = T(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"))


EV_NULLS = ("(SELECT event_id, ts, user_id, "
            "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type, "
            "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)")


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {DIGITS})"


# importing the query modules fills QUERIES / ORACLE
from tabstat.plans import (  # noqa: E402,F401
    q_clean,
    q_evaluate,
    q_features,
    q_matrix,
    q_models,
    q_neighbors,
    q_normality,
    q_profile,
)
