"""Bounded point samples: size, uniform bottom-m, partitions, odd rows."""

import pytest
from pyspark.sql import functions as F

from tabstat.operators import features as fe


def points(spark, n=4000, parts=5):
    group = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).when(F.col("id") % 2 == 0, "a").otherwise(F.concat(F.lit("g"), F.col("id") % 90))
    return spark.range(n).select("id", group.alias("g"), (F.col("id") * 0.5).alias("x"), F.array("id").alias("v")).repartition(parts)


def unit(k, seed=1729):
    return ((k % 2147483647) * 2654435761 + seed * 40503) % 2 ** 32 / 2 ** 32


def brute(rows, most):
    groups = {}
    for r in rows:
        groups.setdefault(r.g, []).append(r)
    return sorted(((r.id, r.g, r.x, len(v)) for v in groups.values() for r in sorted(v, key=lambda r: (unit(r.id), r.id))[:most]), key=str)


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_equals_the_least_of_each_group(spark, most):
    df = points(spark)
    got = fe.bounded_points(df, ["x"], "id", most, by=["g"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((g, i, x, n) for i, g, x, n in brute(df.collect(), most)), key=str)
    sizes = {}
    for r in got:
        sizes[r.g] = sizes.get(r.g, 0) + 1
    assert None in sizes and all(s == min(most, r.n) for r in got for s in [sizes[r.g]])


def test_same_at_any_partitioning_and_batch(spark):
    a = sorted(map(str, fe.bounded_points(points(spark, parts=1), ["x", "v"], "id", 20, by=["g"]).collect()))
    b = sorted(map(str, fe.bounded_points(points(spark, parts=8), ["x", "v"], "id", 20, by=["g"]).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        c = sorted(map(str, fe.bounded_points(points(spark, parts=3), ["x", "v"], "id", 20, by=["g"]).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert a == b == c


def test_a_part_holds_the_sample_of_the_whole(spark):
    """Mergeable: the sample of two parts' samples is that of the whole."""
    df = points(spark)
    half = [fe.bounded_points(df.where(F.col("id") % 2 == k), ["x"], "id", 30, by=["g"]).drop("n") for k in (0, 1)]
    again = fe.bounded_points(half[0].unionByName(half[1]), ["x"], "id", 30, by=["g"]).drop("n")
    assert sorted(map(str, again.collect())) == sorted(map(str, fe.bounded_points(df, ["x"], "id", 30, by=["g"]).drop("n").collect()))


def test_without_groups_null_keys_repeated_and_empty(spark):
    df = points(spark, 300).unionByName(points(spark, 10).withColumn("id", F.lit(None).cast("long")))
    got = fe.bounded_points(df, ["x", "id"], "id", 9).collect()
    assert {r.id for r in got} == set(sorted(range(300), key=lambda k: (unit(k), k))[:9]) and {r.n for r in got} == {300}
    twice = points(spark, 5).unionByName(points(spark, 5))
    assert fe.bounded_points(twice, ["x"], "id", 100, by=["g"]).count() == 10
    assert fe.bounded_points(df.limit(0), ["x"], "id", 9, by=["g"]).count() == 0
    assert fe.bounded_points(df.limit(0), ["x"], "id", 9).count() == 0


def test_a_task_sends_at_most_the_bound(spark):
    """What leaves the first partials: at most ``most`` rows per task and group."""
    df = points(spark, parts=4).select(F.col("g").alias("_g0"), "id", fe.sample_unit("id", 1729).alias("_u"), F.col("id").alias("_k"), F.xxhash64("id").alias("_h"))
    sent = df.mapInArrow(fe._least(1, 6), df.schema).groupBy("_g0", F.spark_partition_id().alias("p")).count()
    assert sent.agg(F.max("count")).first()[0] <= 6
