"""Splits and folds against a full ranking by the portable hash."""

import math

import pytest
from pyspark.sql import functions as F

from tabstat.operators import sample as sm
from tabstat.operators.features import sample_unit


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(0, 9000, 3).select(F.col("id").alias("k"), F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 2).alias("y"))


def ranked(frame):
    rows = sorted((r.u, r.k, r.y) for r in frame.withColumn("u", sample_unit("k", 1729)).collect())
    return rows


def test_exact_split(frame):
    rows = ranked(frame)
    want = {k for _, k, _ in rows[:math.ceil(0.2 * len(rows))]}
    got = {r.k for r in sm.split_column(frame, "k", 0.2).where("split = 'test'").collect()}
    assert got == want
    assert {r.k for r in sm.split(frame.repartition(7), "k", 0.2)[1].collect()} == want


def test_strata_with_a_null_class(frame):
    rows = ranked(frame)
    got = {r.k: r.split for r in sm.split_column(frame, "k", 0.3, by=["y"]).collect()}
    folds = {r.k: r.fold for r in sm.stratified_folds(frame, "k", "y", k=4).collect()}
    assert len(got) == len(folds) == len(rows)
    for y in (None, 0, 1):
        own = [k for _, k, c in rows if c == y]
        n = math.ceil(0.3 * len(own))
        assert [got[k] for k in own] == ["test"] * n + ["train"] * (len(own) - n)
        assert [folds[k] for k in own] == [i * 4 // len(own) for i in range(len(own))]


def test_small_and_empty(spark, frame):
    assert sm.split_column(frame.limit(0), "k").collect() == []
    three = frame.limit(3)
    assert sm.split_column(three, "k", 0.2).where("split = 'test'").count() == 1
    assert sorted(r.fold for r in sm.stratified_folds(three.withColumn("y", F.lit(1)), "k", "y", k=5).collect()) == [0, 1, 3]
