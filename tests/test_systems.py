"""Elimination, feasibility, ordered folds and chains against plain versions."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest

from tessera.operators import graphs as G
from tessera.plans import folds, linear


def test_elimination_keeps_rank_and_solutions():
    random.seed(3)
    for _ in range(60):
        m, n = random.randint(1, 4), random.randint(1, 5)
        a = [[Fraction(random.randint(-2, 2)) for _ in range(n)] for _ in range(m)]
        rows, pivots = linear.reduced(a)
        assert len(pivots) == np.linalg.matrix_rank(np.array(a, float))
        both = np.array([*a, *rows[: len(pivots)]], float)
        assert np.linalg.matrix_rank(both) == len(pivots)
        for i, p in enumerate(pivots):
            assert [r[p] for r in rows] == [int(i == j) for j in range(m)]


def brute_feasible(a):
    """Whether 0 is a convex combination of the columns: by one of at most m + 1 columns (Caratheodory), solved exactly."""
    m, n = len(a), len(a[0])
    for k in range(1, min(n, m + 1) + 1):
        for chosen in itertools.combinations(range(n), k):
            system = [[r[j] for j in chosen] + [Fraction(0)] for r in a] + [[Fraction(1)] * k + [Fraction(1)]]
            rows, pivots = linear.reduced(system)
            if pivots == list(range(k)) and all(rows[i][-1] >= 0 for i in range(k)):
                return True
    return False


def test_positive_vectors_equal_brute_force():
    random.seed(4)
    seen = set()
    for _ in range(150):
        m, n = random.randint(1, 3), random.randint(1, 5)
        a = [[Fraction(random.randint(-3, 3)) for _ in range(n)] for _ in range(m)]
        found = linear.positive_vector(a)
        assert (found is not None) == brute_feasible(a)
        seen.add(found is not None)
        if found is not None:
            assert min(found) >= 0 and sum(found) == 1
            assert all(sum(x * y for x, y in zip(r, found, strict=True)) == 0 for r in a)
    assert seen == {True, False}
    assert linear.positive_vector([]) is None


def test_entries_are_exact(spark):
    """Whole numbers beyond 2^53 and decimals are not rounded to doubles on their way in."""
    big = 2**53
    whole = spark.createDataFrame([(1, 0, big + 1, 1), (1, 1, big, 1)], "k int, i int, a long, b long")
    assert sorted(r["values"] for r in linear.eliminated(whole, "k", "i", ["a", "b"]).collect()) == [[0.0, 1.0], [1.0, 0.0]]
    decimals = whole.selectExpr("k", "i", "cast(a as decimal(30, 10)) + 0.1 AS a", "cast(b as decimal(30, 10)) AS b")
    assert linear.eliminated(decimals, "k", "i", ["a", "b"]).count() == 2
    with pytest.raises(Exception, match="no NULL entries"):
        linear.eliminated(whole.selectExpr("k", "i", "nullif(a, b - 1 + i) AS a", "nullif(b, 1) AS b"), "k", "i", ["a", "b"]).collect()


def test_systems_that_are_too_large_or_empty(spark, monkeypatch):
    rows = spark.createDataFrame([(1, i, 1.0) for i in range(5)] + [(None, 0, 2.0)], "k int, i int, x double")
    assert {r["k"]: r["values"] for r in linear.eliminated(rows, "k", "i", ["x"]).collect()} == {1: [1.0], None: [1.0]}
    assert linear.positive_combinations(rows.limit(0), "k", "i", ["x"]).count() == 0
    monkeypatch.setattr(linear, "LARGEST", 4)
    with pytest.raises(ValueError):
        linear.eliminated(rows, "k", "i", ["x"])


def test_fold_in_order_equals_a_loop(spark):
    random.seed(5)
    rows = [(random.randint(1, 6), i, random.randint(0, 99)) for i in range(500)] + [(None, 1, 1), (1, 1000, None)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i long, x long")
    step = lambda a, x: (a * 31 + x) % 1009
    expected = {}
    for k, _, x in sorted((r for r in rows if r[2] is not None), key=lambda r: r[1]):
        expected[k] = step(expected.get(k, 7), x)
    assert {r["k"]: r["state"] for r in folds.fold_in_order(df, "k", ["i"], "x", 7, step).collect()} == expected
    assert folds.fold_in_order(df.limit(0), "k", ["i"], "x", 7, step).count() == 0


def test_heights_and_orders(spark):
    edges = spark.createDataFrame([(1, 2), (2, 4), (4, 8), (1, 3), (3, 6), (2, 6)], "src int, dst int")
    assert G.height(edges).first()["height"] == 4
    assert G.height(edges.limit(0)).first()["height"] == 0
    listed = {r["id"]: r["pos"] for r in G.in_dependency_order(edges).collect()}
    assert sorted(listed.values()) == list(range(6))
    assert all(listed[r["src"]] > listed[r["dst"]] for r in edges.collect())
    with pytest.raises(ValueError):
        G.height(edges.union(spark.createDataFrame([(8, 1)], edges.schema)))


def test_intersections(spark):
    sets = spark.createDataFrame([([1, 2, 3],), ([2, 3, 4],), ([1, 3, 4],), ([1, 2, 3],)], "members array<int>")
    found = sorted(r["members"] for r in G.intersections(sets).collect())
    assert found == [[1, 2, 3], [1, 3], [1, 3, 4], [2, 3], [2, 3, 4], [3], [3, 4]]


def test_many_systems_go_to_python_at_a_time(spark):
    """Systems travel as rows of batches, not group by group; a NULL key is a group, and a group may have no pivot."""
    rows = [(k, i, a, b) for k, m in ((1, [(2, 4), (1, 3)]), (2, [(0, 0), (0, 0)]), (None, [(0, 5), (3, 1)])) for i, (a, b) in enumerate(m)]
    df = linear.eliminated(spark.createDataFrame(rows, "k int, i int, a long, b long"), "k", "i", ["a", "b"])
    assert "InPandas" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, ((r["k"], r["row"], r["values"]) for r in df.collect()))) == sorted(map(str, ((k, i, v) for k in (1, None) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0]]))))
    for bad in ([(1, 0, 1, 1), (1, 0, 2, 2)], [(1, 0, None, 1)]):
        with pytest.raises(Exception, match="without ties|no NULL"):
            linear.eliminated(spark.createDataFrame(bad, "k int, i int, a long, b long"), "k", "i", ["a", "b"]).collect()
