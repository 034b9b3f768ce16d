"""Enumeration by rank: permutations, choices and subsets of a row's own list, each computed from its number alone.

A list's results are numbered from 0 in lexicographic order of places, so a range of ranks is a piece of work:
ranges are dealt over the cluster and unfolded there, and no join of elements with elements is needed. Counts
are exact below 2^63; a list with more results is an error, as nobody could list them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks of a piece of work.
RANGE = 4096
#: Longest list whose permutations can be numbered in 64 bits.
PERMUTED = 20


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def n_permutations(items: Column) -> Column:
    """The factorial of a list's length; NULL for a NULL list."""
    return F.when(items.isNotNull() & (F.size(items) > PERMUTED), F.raise_error("the permutations of more than 20 items leave 64 bits").cast("long")).otherwise(F.factorial(F.size(items)))


def permutation(items: Column, rank: Column) -> Column:
    """The permutation of a rank by its Lehmer digits: each digit takes an item out of what is left."""
    n = F.size(items)

    def step(acc: Column, i: Column) -> Column:
        left = F.size(acc["left"])
        block = F.factorial(left - 1)
        at = F.call_function("div", acc["rank"], block).cast("int")
        return F.struct(
            F.concat(acc["done"], F.slice(acc["left"], at + 1, F.lit(1))).alias("done"),
            F.concat(F.slice(acc["left"], F.lit(1), at), F.slice(acc["left"], at + 2, left)).alias("left"),
            (acc["rank"] % block).alias("rank"),
        )

    start = F.struct(F.slice(items, F.lit(1), F.lit(0)).alias("done"), items.alias("left"), rank.cast("long").alias("rank"))
    return F.when(n == 0, items).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step)["done"])


def n_choices(lists: Column) -> Column:
    """How many ways there are to take one item from each list; 1 for no lists, and an error beyond 64 bits."""
    return F.aggregate(lists, _long(1), lambda acc, x: acc * F.size(x))


def radices(lists: Column) -> Column:
    """For each list, how many choices the lists after it have."""
    return F.reverse(F.slice(F.aggregate(F.reverse(lists), F.array(_long(1)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) * F.size(x))), F.lit(1), F.size(lists)))


def choice(lists: Column, rank: Column, weights: Column | None = None) -> Column:
    """The choice of a rank by mixed-radix digits, the last list's the fastest; weights: the lists' radices, if they are known."""
    return F.zip_with(lists, radices(lists) if weights is None else weights, lambda x, w: F.get(x, (F.call_function("div", rank.cast("long"), w) % F.size(x)).cast("int")))


def n_subsets(items: Column, k: int) -> Column:
    """Binomial of a list's length over k."""
    return binomial(F.size(items), k)


def binomial(n: Column, k: int) -> Column:
    """n over k, exactly: each step multiplies and divides without a rest, in decimals until the end."""
    if k < 0:
        raise ValueError("a subset has 0 members or more")
    out = F.lit(1).cast("decimal(38,0)")
    for i in range(k):
        out = F.call_function("div", (out * (n - i).cast("decimal(10,0)")).cast("decimal(38,0)"), F.lit(i + 1).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.when(n >= k, out.cast("long")).otherwise(_long(0))


#: Numbers of subsets beyond this are kept as this; no rank reaches it.
MOST = (1 << 63) - 1


def subset_tables(items: Column, k: int) -> Column:
    """For j from k down to 2, the binomials of 0 to the list's length over j: each table is the one of j - 1 added up."""
    n = F.size(items)

    def added_up(table: Column) -> Column:
        step = lambda acc, x: F.array_append(acc, F.when(F.element_at(acc, -1) > MOST - x, _long(MOST)).otherwise(F.element_at(acc, -1) + x))
        return F.aggregate(F.slice(table, F.lit(1), n), F.array(_long(0)), step)

    ones = F.array(F.sequence(_long(0), n.cast("long")))
    if k < 2:
        return F.slice(ones, F.lit(1), F.lit(0))
    tables = F.aggregate(F.sequence(F.lit(2), F.lit(k)), ones, lambda acc, _: F.array_append(acc, added_up(F.element_at(acc, -1))))
    return F.reverse(F.slice(tables, F.lit(2), F.lit(k - 1)))


def subset(items: Column, k: int, rank: Column, tables: Column | None = None) -> Column:
    """The k-subset of a rank, in the combinatorial number system: counted from the last subset, each digit is the largest binomial that is left.

    tables: the list's subset_tables, if they are known.
    """
    none = F.slice(items, F.lit(1), F.lit(0))
    if k == 0:
        return none
    n = F.size(items)
    item = lambda c: F.slice(items, n - c.cast("int"), F.lit(1))
    if k == 1:
        return F.slice(items, rank.cast("int") + 1, F.lit(1))
    tables = subset_tables(items, k) if tables is None else tables

    def step(acc: Column, table: Column) -> Column:
        below = F.array(F.filter(table, lambda x: x <= acc["rank"]))
        return F.get(F.transform(below, lambda b: F.struct(F.concat(acc["done"], item(F.size(b) - 1)).alias("done"), (acc["rank"] - F.element_at(b, -1)).alias("rank"))), F.lit(0))

    start = F.struct(none.alias("done"), (F.element_at(F.get(tables, F.lit(0)), -1) - 1 - rank.cast("long")).alias("rank"))
    return F.when(n < k, none).otherwise(F.aggregate(tables, start, step, lambda acc: F.concat(acc["done"], item(acc["rank"]))))


def enumerated(df: DataFrame, count: Column, make: Callable[[Column], Column], name: str = "made", size: int = RANGE) -> DataFrame:
    """df's rows with (rank, name) for each rank below count: make(rank) is computed where the range of ranks was dealt."""
    first, n = F.col("__first"), F.col("__n")
    ranges = df.withColumn("__n", count.cast("long")).where(n > 0).withColumn("__first", F.explode(F.sequence(_long(0), n - 1, _long(size))))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.repartition(parts, F.xxhash64(*df.columns, "__first")) if df.columns else ranges
    # a range's results are made from one copy of its row
    made = F.transform(F.sequence(first, F.least(first + size, n) - 1), lambda rank: F.struct(rank.alias("rank"), make(rank).alias(name)))
    return dealt.select(*df.columns, F.inline(made))


def subsets(df: DataFrame, items: str, k: int, name: str = "made", size: int = RANGE) -> DataFrame:
    """df's rows with (rank, name) for each k-subset of their list; a list's binomials are made once, not for each rank."""
    held = df.withColumn("__tables", subset_tables(F.col(items), k))
    return enumerated(held, n_subsets(F.col(items), k), lambda rank: subset(F.col(items), k, rank, F.col("__tables")), name, size).drop("__tables")


def choices(df: DataFrame, lists: str, name: str = "made", size: int = RANGE) -> DataFrame:
    """df's rows with (rank, name) for each choice of one item from each of their lists; the radices are made once for a row."""
    held = df.withColumn("__radices", radices(F.col(lists)))
    return enumerated(held, n_choices(F.col(lists)), lambda rank: choice(F.col(lists), rank, F.col("__radices")), name, size).drop("__radices")
