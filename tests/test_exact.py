"""Ranks, bitmaps, rounded numbers and collecting folds against plain Python and numpy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import floats as X
from tessera.operators import bitmaps as B
from tessera.operators import ranking as R
from tessera.plans import folds


def lists(spark, items):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], "id long, l array<string>")


@pytest.mark.parametrize("size", [5, 4096])
def test_permutations_and_subsets_by_rank(spark, size):
    items = [[], ["a"], list("abcd"), list("abcde"), ["x", "x", "y"], None]
    df = lists(spark, items)
    found = R.enumerated(df, R.n_permutations(F.col("l")), lambda r: R.permutation(F.col("l"), r), size=size).collect()
    for i, l in enumerate(items[:-1]):
        mine = [tuple(r["made"]) for r in sorted((r for r in found if r["id"] == i), key=lambda r: r["rank"])]
        assert mine == list(itertools.permutations(l))
    for k in (0, 1, 2, 4):
        found = R.enumerated(df.where("l IS NOT NULL"), R.n_subsets(F.col("l"), k), lambda r, k=k: R.subset(F.col("l"), k, r), size=size).collect()
        for i, l in enumerate(items[:-1]):
            mine = [tuple(r["made"]) for r in sorted((r for r in found if r["id"] == i), key=lambda r: r["rank"])]
            assert mine == list(itertools.combinations(l, k))


def test_single_ranks_of_long_lists(spark):
    l = [f"{i:02d}" for i in range(40)]
    df = spark.createDataFrame([(l, l[:20])], "l array<string>, s array<string>")
    n = math.comb(40, 7)
    row = df.select(R.subset(F.col("l"), 7, F.lit(n - 1)).alias("a"), R.n_subsets(F.col("l"), 7).alias("n"), R.permutation(F.col("s"), F.lit(math.factorial(20) - 1)).alias("p")).first()
    assert row["n"] == n and row["a"] == l[-7:] and row["p"] == l[:20][::-1]
    with pytest.raises(Exception, match="64 bits"):
        df.select(R.n_permutations(F.col("l"))).collect()


def test_subsets_of_lists_from_tables(spark):
    """Binomials of fewer members may leave 64 bits where the asked ones do not."""
    l = [f"{i:02d}" for i in range(70)]
    df = lists(spark, [l[:9], [], ["a"], l[:5]])
    for k in (0, 1, 2, 3, 5):
        found = R.subsets(df, "l", k, size=7).collect()
        for i, items in enumerate([l[:9], [], ["a"], l[:5]]):
            mine = [tuple(r["made"]) for r in sorted((r for r in found if r["id"] == i), key=lambda r: r["rank"])]
            assert mine == list(itertools.combinations(items, k))
    one = spark.createDataFrame([(l,)], "l array<string>")
    first, last = one.select(R.subset(F.col("l"), 65, F.lit(0)), R.subset(F.col("l"), 65, F.lit(math.comb(70, 65) - 1))).first()
    assert first == l[:65] and last == l[5:]


def test_choices_from_radices(spark):
    rows = [(0, [["a", "b"], ["x"], ["1", "2", "3"]]), (1, [["a"], []]), (2, [])]
    found = R.choices(spark.createDataFrame(rows, "id long, l array<array<string>>"), "l", size=4).collect()
    for i, l in rows:
        assert [tuple(r["made"]) for r in sorted((r for r in found if r["id"] == i), key=lambda r: r["rank"])] == list(itertools.product(*l))


def test_choices_by_rank(spark):
    rows = [(0, [["a", "b"], ["x"], ["1", "2", "3"]]), (1, [["a"], []]), (2, [])]
    df = spark.createDataFrame(rows, "id long, l array<array<string>>")
    found = R.enumerated(df, R.n_choices(F.col("l")), lambda r: R.choice(F.col("l"), r), size=4).collect()
    for i, l in rows:
        mine = [tuple(r["made"]) for r in sorted((r for r in found if r["id"] == i), key=lambda r: r["rank"])]
        assert mine == list(itertools.product(*l))


def test_running_bitmaps(spark):
    rng = random.Random(2)
    rows = [(k, t, w) for k in range(4) for t in range(6) for w in ({f"w{rng.randrange(300)}" for _ in range(150)} | {"all"} if (k, t) != (3, 2) else [])]
    places = spark.createDataFrame([(k, t) for k in range(4) for t in range(6)], "k long, t long")
    sets = B.packed(B.numbered(spark.createDataFrame([*rows, (0, 0, None)], "k long, t long, w string"), "w"), ["k", "t"])
    found = {(r["k"], r["t"]): (r["n_union"], r["n_common"]) for r in B.running_sizes(sets, places, "k", "t").collect()}
    for k in range(4):
        held = [{w for a, b, w in rows if (a, b) == (k, t)} for t in range(6)]
        for t in range(6):
            assert found[k, t] == (len(set.union(*held[: t + 1])), len(set.intersection(*held[: t + 1])))
    assert B.members(sets).count() == len(rows)
    assert sum(r["n"] for r in B.sizes(sets, ["k"]).collect()) == len(rows)


def pairs(seed, n):
    rng = random.Random(seed)
    special = [0.0, -0.0, float("inf"), float("-inf"), float("nan"), 1.0, -1.0, 2.0**-149, 3 * 2.0**-150, 2.0**-126, 3.4028234663852886e38, 3.4028235677973366e38, 65504.0, 65519.9, 65520.0, 2.0**-24, 2.0**-25, 6.1e-5]
    made = [math.ldexp(rng.choice([-1, 1]) * rng.getrandbits(rng.choice([3, 24, 25, 53])), rng.randint(-160, 60)) for _ in range(n)]
    return special + made


@pytest.mark.parametrize(("kind", "f"), [(np.float32, X.SINGLE), (np.float16, X.HALF)])
def test_rounded_numbers_equal_the_machine_s(spark, kind, f):
    xs = pairs(1, 800)
    rng = random.Random(3)
    rows = [(x, rng.choice(xs) if i % 3 else -x) for i, x in enumerate(xs)]
    a, b = X.from_double(F.col("x"), f), X.from_double(F.col("y"), f)
    df = spark.createDataFrame(rows, "x double, y double").repartition(1)
    found = df.select("x", "y", X.to_double(a).alias("a"), X.to_double(X.add(a, b, f)).alias("s")).collect()
    with np.errstate(all="ignore"):
        for r in found:
            for mine, theirs in ((r["a"], kind(r["x"])), (r["s"], kind(r["x"]) + kind(r["y"]))):
                if np.isnan(theirs):
                    assert mine is None
                else:
                    assert (mine, math.copysign(1, mine)) == (float(theirs), math.copysign(1, float(theirs))), (r["x"], r["y"])


def test_decimals_round_once(spark):
    from fractions import Fraction

    rng = random.Random(4)
    cents = [rng.randrange(-(10**rng.randint(1, 15)), 10**15) for _ in range(300)] + [0, 1, -1, 16777217 * 100, 16777219 * 100]
    df = spark.createDataFrame([(c,) for c in cents], "c long").select("c", (F.col("c").cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("d"))
    for r in df.select("c", X.from_decimal(F.col("d"), 2, X.SINGLE).alias("n")).collect():
        exact = abs(Fraction(r["c"], 100))
        value = Fraction(r["n"]["m"]) * Fraction(2) ** r["n"]["e"]
        step = Fraction(2) ** r["n"]["e"]
        error = abs(value - exact)
        assert r["n"]["m"] < 1 << 24 and r["n"]["neg"] == (r["c"] < 0)
        assert error < step / 2 or (error == step / 2 and r["n"]["m"] % 2 == 0)
        assert error == 0 or r["n"]["m"] >= 1 << 23


def test_fold_keeps_what_failed(spark):
    df = spark.range(0, 1000, 1, 40).select("id", (F.col("id") % 7).alias("x"))

    def step(state, row):
        return {"n": state["n"] + 1, "t": state["t"] + 42 // row["x"]}

    state, failures = folds.fold_collecting(df, "id", {"n": 0, "t": 0}, step, lambda a, b: {k: a[k] + b[k] for k in a})
    good = [i for i in range(1000) if i % 7]
    assert state == {"n": len(good), "t": sum(42 // (i % 7) for i in good)}
    rows = failures.collect()
    assert sorted(int(r["row_id"]) for r in rows) == [i for i in range(1000) if i % 7 == 0]
    assert all(r["reason"].startswith("ZeroDivisionError") for r in rows)
    none, failed = folds.fold_collecting(df.limit(0), "id", {"n": 0}, step, lambda a, b: a)
    assert none == {"n": 0} and failed.count() == 0


def test_fold_in_order_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, None), (None, 1, 7), (None, 2, 8), (2, 1, None)], "k long, o long, x long")
    found = {r["k"]: r["state"] for r in folds.fold_in_order(df, "k", ["o"], "x", 0, lambda a, x: a * 10 + x).collect()}
    assert found == {1: 5, None: 78, 2: 0}


def test_totals_equal_sums_one_by_one(spark):
    """The machine's sums of 24 digits and those on whole numbers, subnormals, ties and infinities included."""
    rng = random.Random(8)
    items = [[rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-44, 38) for _ in range(rng.randint(0, 6))] for _ in range(60)]
    items += [[16777216.0, 1.0, 1.0], [1.5, None], [float("nan"), 1.0], [3e38, 3e38], [float("inf"), float("-inf")], [1e-45, 1e-45, -1e-45], []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "id long, l array<double>")
    start = X.number(F.lit(False), F.lit(0), F.lit(X.SINGLE.emin))
    slow = F.aggregate(F.transform("l", lambda x: X.from_double(x, X.SINGLE)), start, lambda a, x: X.add(a, x, X.SINGLE))
    rows = df.select(X.total(F.col("l"), X.SINGLE).alias("fast"), X.to_double(slow).alias("slow")).collect()
    assert [r["fast"] for r in rows] == [r["slow"] for r in rows]
    half = df.where("id = 60").select(X.total(F.col("l"), X.HALF)).first()[0]
    assert half == float("inf")
