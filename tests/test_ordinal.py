"""Two-phase ordinals, bucketed running sums and carries against plain windows."""

import pytest
from pyspark.sql import Window, functions as F

from tessera.operators.ordinal import carry_forward, global_ordinal, prefix_sum


def test_global_ordinal_dense_and_partition_independent(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g"))
    for parts in (1, 17):
        o = global_ordinal(df.repartition(parts), ["k"], name="o").collect()
        assert sorted(r.o for r in o) == list(range(5000))
        assert all(r.o == r.k for r in o)
        per = global_ordinal(df.repartition(parts), ["k"], ["g"], "o")
        w = Window.partitionBy("g").orderBy("k")
        ref = per.withColumn("r", F.row_number().over(w) - 1)
        assert ref.where(F.col("r") != F.col("o")).count() == 0


def test_prefix_sum_bucketed_matches_window(spark):
    df = spark.range(0, 3000).select((F.col("id") % 2).alias("key"), F.col("id").alias("pos"),
                                     (F.col("id") % 5).alias("v"))
    got = prefix_sum(df, ["key"], ["pos"], {"s": F.col("v")}, bucket=F.floor(F.col("pos") / 64))
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ref = got.withColumn("r", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert ref.where(F.col("r") != F.col("s")).count() == 0


def test_carry_forward_bucketed_matches_window(spark):
    df = spark.range(0, 2000).select((F.col("id") % 3).alias("key"), F.col("id").alias("pos"),
                                     F.when(F.col("id") % 97 == 0, F.col("id")).alias("h"))
    got = carry_forward(df, ["key"], ["pos"], F.col("h"), "c", bucket=F.floor(F.col("pos") / 50))
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ref = got.withColumn("r", F.last("h", ignorenulls=True).over(w))
    assert ref.where(~F.col("r").eqNullSafe(F.col("c"))).count() == 0


def test_null_keys_stay(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), (None, 0, 5), (None, 1, 7)], "k string, pos long, v long")
    for bucket in (None, F.floor(F.col("pos") / 1)):
        got = {(r.k, r.pos): r.s for r in prefix_sum(df, ["k"], ["pos"], {"s": F.col("v")}, bucket=bucket).collect()}
        assert got == {("a", 0): 0, ("a", 1): 1, (None, 0): 0, (None, 1): 5}
        c = carry_forward(df, ["k"], ["pos"], F.when(F.col("pos") == 0, F.col("v")), "c", bucket=bucket)
        assert {(r.k, r.pos): r.c for r in c.collect()} == {("a", 0): 1, ("a", 1): 1, (None, 0): 5, (None, 1): 5}


def test_order_expressions_are_refused(spark):
    df = spark.range(5).withColumn("v", F.col("id"))
    with pytest.raises(TypeError):
        global_ordinal(df, ["id", F.desc("v")])
    got = global_ordinal(df, ["id"], name="o", total="n").collect()
    assert {r.n for r in got} == {5}
