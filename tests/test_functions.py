"""Limits that are errors, and functions of lists and fractions."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import more as X
from tessera.operators import graphs as G
from tessera.operators import relations as rel


def test_a_long_cycle_is_found(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 70) for i in range(70)], "src long, dst long")
    assert G.girth(ring) == 70
    assert G.girth(ring.where("src <> 69")) == 0
    assert G.girth(ring.where("src < 0")) == 0


def test_powers_beyond_the_bound_are_errors(spark):
    a, b = F.lit(2).cast("long"), F.lit(41)
    with pytest.raises(Exception, match="power"):
        spark.range(1).select(X.hyperoperation(3, a, b)).collect()


def test_convolutions_beyond_the_bound_are_errors(spark, monkeypatch):
    monkeypatch.setattr(rel, "PAIRS", 10)
    with pytest.raises(ValueError, match="pairs"):
        rel.convolution(spark.range(4), spark.range(4), lambda x, y: x + y)
    assert rel.convolution(spark.range(3), spark.range(3), lambda x, y: x + y).count() == 5


def test_running_totals(spark):
    df = spark.range(200).select(F.pmod(F.col("id") * 7919, F.lit(211)).alias("k"), F.col("id").alias("v")).repartition(5)
    rows = sorted(df.collect())
    found = {r["k"]: r["t"] for r in rel.running_total(df, "k", "v", "t").collect()}
    total = 0
    for k, v in rows:
        total += v
        assert found[k] == total


def test_shrinking_and_permuting(spark):
    row = spark.range(1).select(
        X.shrunk_natural(F.lit(9)).alias("n"),
        X.shrunk_natural(F.lit(0)).alias("z"),
        X.shrunk_fraction(F.lit(-3).cast("long"), F.lit(5).cast("long")).alias("f"),
        X.permuted(F.array(*map(F.lit, "abc")), X.sorting(F.array(F.lit(3), F.lit(1), F.lit(1)))).alias("p"),
    ).first()
    assert row["n"] == [4, 2, 1, 0] and row["z"] == []
    assert [tuple(x) for x in row["f"]] == [(1, 2), (1, 1), (-1, 2), (-1, 1), (0, 2), (0, 1), (0, 2), (0, 1)]
    assert row["p"] == ["b", "c", "a"]


def test_each_join_hint_makes_its_own_join(spark, folder):
    a = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey")
    b = spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"))
    for hint, kind in (("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("broadcast", "BroadcastHashJoin")):
        assert kind in a.join(b.hint(hint), "l_orderkey")._jdf.queryExecution().executedPlan().toString()
