"""Tables of a database, on the one that comes with Spark."""

import uuid

import pytest

from tessera.sources.files import read_jdbc, write_jdbc


@pytest.fixture
def url():
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def test_round_trip_by_ranges_of_a_key(spark, folder, url):
    part = spark.read.parquet(f"{folder}/part.parquet").selectExpr("CAST(p_partkey AS LONG) AS k", "CAST(p_size AS INT) AS size", "p_name AS name")
    rows = part.unionByName(spark.createDataFrame([(None, 7, "no key"), (10**12, None, "far away")], part.schema))
    write_jdbc(rows, url, "part", createTableColumnTypes="name VARCHAR(200)")
    back = read_jdbc(spark, url, "part", "k", 5)
    assert back.rdd.getNumPartitions() == 5
    by = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, back.collect()), key=by) == sorted(map(tuple, rows.collect()), key=by)


def test_filters_and_columns_reach_the_database(spark, url):
    rows = spark.range(100).selectExpr("id AS k", "CAST(id % 7 AS INT) AS size")
    write_jdbc(rows, url, "t")
    some = read_jdbc(spark, url, "t", "k", 3).where("size = 3").select("k")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(size,3)" in plan and "ReadSchema: struct<k:bigint>" in plan
    assert sorted(r.k for r in some.collect()) == [x for x in range(100) if x % 7 == 3]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_table_and_single_key(spark, url, n):
    write_jdbc(spark.range(n).selectExpr("id AS k"), url, "t")
    assert [r.k for r in read_jdbc(spark, url, "t", "k").collect()] == list(range(n))
