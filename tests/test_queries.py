"""Every query of the algebra against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

import tessera.queries  # noqa: F401
from tessera import registry
from tessera.sources import files
from tessera.tables import COLUMNS


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for name in COLUMNS:
        path = f"{folder}/{name}.parquet"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, folder, name):
    df = registry.QUERIES[name](spark, folder)
    found = duck.execute(registry.SQL[name])
    columns = [d[0] for d in found.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, folder, name):
    assert registry.QUERIES[name](spark, folder).columns


def test_every_query_has_an_origin():
    assert set(registry.ORIGIN) == set(registry.QUERIES)
    assert set(registry.ORIGIN.values()) == {"algebra", "driver"}


def test_entourage_shuffles_no_pairs(spark, folder):
    """Pairs come from one join by all three cells and go nowhere after it."""
    plan = registry.QUERIES["dynamical_entourage"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan.split("Join")[0]


def test_markdown_table(spark, folder):
    rows = spark.createDataFrame([("a|b", "big", 1), ("c", "little", 22)], "name string, size string, n int")
    table = files.table_text(rows, {"name": "left", "size": "center", "n": "right"}).orderBy("ord", "line")
    lines = [r["line"] for r in table.collect()]
    assert lines == ["| name |  size  |   n |", "| :--- | :----: | --: |", "| a\\|b |  big   |   1 |", "| c    | little |  22 |"]


def test_wrapped_lines_keep_words(spark, folder):
    rows = registry.QUERIES["wrap_long_lines"](spark, folder).collect()
    texts = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    for r in rows:
        assert r["text"].split() == texts[r["item_id"]].split()
        assert all(len(x) <= 60 or " " not in x for x in r["text"].split("\n"))
