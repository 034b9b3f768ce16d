"""Laws of the algebra on bags with NULLs and duplicates, and the plans of the rewrites."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import bags, graphs, relations
from tessera.plans import folds, laws

values = st.lists(st.one_of(st.none(), st.integers(0, 4)), max_size=12)
few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "k int")


def bag(df):
    return sorted((r[0] for r in df.collect()), key=lambda x: (x is not None, x))


def counts(xs):
    return {x: xs.count(x) for x in xs}


@given(values, values)
@few
def test_union_and_intersection_make_the_sum(spark, a, b):
    x, y = frame(spark, a), frame(spark, b)
    both = bags.union_max(x, y).unionAll(bags.intersect_min(x, y))
    assert bag(both) == sorted(a + b, key=lambda v: (v is not None, v))


@given(values, values)
@few
def test_difference_of_bags(spark, a, b):
    out = counts(bag(bags.difference(frame(spark, a), frame(spark, b))))
    assert out == {k: n - b.count(k) for k, n in counts(a).items() if n > b.count(k)}


@given(values, values)
@few
def test_sets(spark, a, b):
    x, y = frame(spark, a), frame(spark, b)
    s, t = set(a), set(b)
    order = lambda z: sorted(z, key=lambda v: (v is not None, v))
    assert bag(bags.symmetric_difference(x, y)) == order(s ^ t)
    assert bag(bags.big_intersection([x, y])) == order(s & t)
    assert bag(laws.double_difference(x, y)) == order(s & t)


def test_distinct_before_injective(spark):
    df = frame(spark, [1, 1, None, 3])
    assert bag(laws.distinct_before_injective(df, F.col("k") * 2, "k")) == bag(df.select((F.col("k") * 2).alias("k")).distinct())


def test_eager_sum_shrinks_before_the_join(spark):
    facts = spark.range(1000).select((F.col("id") % 10).alias("j"), F.lit(1).cast("long").alias("v"))
    dims = spark.range(10).select(F.col("id").alias("j"), (F.col("id") % 2).alias("g"))
    out = laws.eager_sum(facts, dims, "j", "v", ["g"])
    assert {r["g"]: r["v"] for r in out.collect()} == {0: 500, 1: 500}
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Aggregate [g") < text.index("Join") < text.rindex("Aggregate [j")


def test_inferred_bounds_reach_the_scan(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_tax", "l_discount", "l_quantity")
    out = laws.with_inferred_bounds(df, [("l_tax", "l_discount"), ("l_discount", "l_quantity")], {"l_quantity": 5.0})
    assert out._jdf.queryExecution().optimizedPlan().toString().count("<= 5.0") == 3
    assert laws.equal_columns([("a", "b"), ("b", "a"), ("b", "c")]) == {frozenset("ab")}


def test_division_by_nothing_is_everything(spark):
    r = spark.createDataFrame([(1, 10), (2, 10), (1, 20)], "a int, b int")
    universe = spark.createDataFrame([(10,), (20,), (30,)], "b int")
    none = r.where("a > 5").select("a")
    assert sorted(x[0] for x in relations.divide(r, "a", "b", none, universe).collect()) == [10, 20, 30]
    assert [x[0] for x in relations.divide(r, "a", "b", r.select("a"), universe).collect()] == [10]


def test_overwrite_keeps_null_values(spark):
    base = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int")
    change = spark.createDataFrame([(2, None)], "k int, v int")
    assert sorted(relations.overwrite(base, change, "k", "v").collect()) == [(1, 1), (2, None)]


def test_cycle_is_an_error(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int")
    try:
        graphs.levels(edges)
    except ValueError as e:
        assert "cycle" in str(e)
    else:
        raise AssertionError


def test_merkle_ignores_line_ends_and_follows_needs(spark):
    edges = spark.createDataFrame([(2, 1)], "src int, dst int")
    digest = lambda *rows: {r["id"]: r["digest"] for r in graphs.merkle(spark.createDataFrame(rows, "id int, content string"), edges).collect()}
    a, b, c = digest((1, "x\r\n"), (2, "y")), digest((1, "x\n"), (2, "y")), digest((1, "z"), (2, "y"))
    assert a == b and a[2] != c[2]


def test_guarded_map_keeps_good_rows(spark):
    df = spark.createDataFrame([("1",), ("x",), ("3",)], "s string")
    rows = folds.guarded_map(df, lambda b: b["s"].astype(int), "long").collect()
    assert sorted((r["value"], r["error"] is None) for r in rows if r["value"] is not None) == [(1, True), (3, True)]
    assert sum(r["error"] is not None for r in rows) == 1


def test_rules_by_priority():
    rules = folds.Rules()
    rules.add(1, "low", lambda x: "low")
    rules.add(5, "high", lambda x: "high" if x else None)
    assert rules.names() == ["high", "low"] and rules.first(True) == "high" and rules.first(False) == "low"


def test_empty_inputs(spark):
    none = frame(spark, [])
    assert bag(bags.union_max(none, none)) == []
    assert bag(bags.powerset(none, "k").select("mask")) == [0]
    assert relations.positional_zip(none, none, "k", "k").count() == 0
