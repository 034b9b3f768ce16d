"""Bags and sets: a DataFrame's rows with their multiplicities; NULL is an ordinary member, equal to itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiplicities(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each distinct row of either side with its number in each, by one shuffle of partial counts."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).cast("long").alias("__a"), F.lit(0).cast("long").alias("__b")).unionAll(b.select(*cols, F.lit(0).cast("long").alias("__a"), F.lit(1).cast("long").alias("__b")))
    return both.groupBy(*cols).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))


def repeated(counted: DataFrame, n: Column, cols: list[str]) -> DataFrame:
    """Each row as often as n says."""
    return counted.where(n > 0).select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("__i")).select(*cols)


def union_max(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of bags: the larger multiplicity of each row."""
    return repeated(multiplicities(a, b), F.greatest("__a", "__b"), a.columns)


def intersect_min(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersection of bags: the smaller multiplicity."""
    return a.intersectAll(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference of bags: multiplicities subtract, down to none."""
    return a.exceptAll(b)


def bind(a: DataFrame, f: Column, name: str) -> DataFrame:
    """Flat-map: the elements of an array for each row, duplicates kept."""
    return a.select(F.explode(f).alias(name))


def big_union(sets: list[DataFrame]) -> DataFrame:
    """Union of a family of sets."""
    return reduce(DataFrame.unionAll, sets).distinct()


def big_intersection(sets: list[DataFrame]) -> DataFrame:
    """Intersection of a family of sets, one shuffle whatever the number of sets."""
    n, cols = len(sets), sets[0].columns
    tagged = reduce(DataFrame.unionAll, [s.distinct().withColumn("__s", F.lit(i)) for i, s in enumerate(sets)])
    return tagged.groupBy(*cols).agg(F.count("__s").alias("__n")).where(F.col("__n") == n).select(*cols)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in exactly one of two sets, by one aggregation instead of two anti-joins."""
    counted = multiplicities(a, b)
    return counted.where((F.col("__a") > 0) != (F.col("__b") > 0)).select(*a.columns)


def tagged_union(a: DataFrame, b: DataFrame, side: str = "side") -> DataFrame:
    """Disjoint sum: every row with the side it comes from."""
    return a.withColumn(side, F.lit("left")).unionByName(b.withColumn(side, F.lit("right")))


def insert(a: DataFrame, **values) -> DataFrame:
    """A set with one more member; NULLs are members."""
    row = a.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in a.schema])
    return a.unionAll(row).distinct()


def erase(a: DataFrame, column: str, value) -> DataFrame:
    """A set without one value."""
    return a.where(~F.col(column).eqNullSafe(F.lit(value)))


def unique_match(a: DataFrame, p: Column) -> DataFrame:
    """The one row that fits, or none; more than one is an error."""
    found = a.where(p)
    n = found.limit(2).count()
    if n > 1:
        raise ValueError("more than one row fits")
    return found


def powerset(a: DataFrame, column: str, limit: int = 16) -> DataFrame:
    """All subsets of a small set as arrays in order; exponential, so the set's size is checked."""
    members = sorted((r[0] for r in a.select(column).distinct().limit(limit + 1).collect()), key=lambda x: (x is not None, x))
    if len(members) > limit:
        raise ValueError(f"a set of more than {limit} members")
    kind = a.schema[column].dataType
    array = F.array(*[F.lit(x).cast(kind) for x in members]) if members else F.array().cast(f"array<{kind.simpleString()}>")
    masks = a.sparkSession.range(1 << len(members)).withColumnRenamed("id", "mask")
    return masks.select("mask", F.filter(array, lambda x, i: F.col("mask").bitwiseAND(F.pow(F.lit(2), i).cast("long")) > 0).alias("subset"))


def antidiagonal(a: DataFrame, column: str, limit: int = 16) -> DataFrame:
    """All ways to split a small bag in two parts: (left, right) for each subset of its positions."""
    members = sorted((r[0] for r in a.select(column).limit(limit + 1).collect()), key=lambda x: (x is not None, x))
    if len(members) > limit:
        raise ValueError(f"a bag of more than {limit} members")
    kind = a.schema[column].dataType
    array = F.array(*[F.lit(x).cast(kind) for x in members]) if members else F.array().cast(f"array<{kind.simpleString()}>")
    bit = lambda i: F.col("mask").bitwiseAND(F.pow(F.lit(2), i).cast("long")) > 0
    masks = a.sparkSession.range(1 << len(members)).withColumnRenamed("id", "mask")
    return masks.select(F.filter(array, lambda x, i: bit(i)).alias("left"), F.filter(array, lambda x, i: ~bit(i)).alias("right"))


def subset_sums(a: DataFrame, column: str, limit: int = 24) -> DataFrame:
    """The set of all sums of subsets, doubling a set of sums by each member; the set's size is checked."""
    members = [r[0] for r in a.select(column).distinct().limit(limit + 1).collect()]
    if len(members) > limit:
        raise ValueError(f"a set of more than {limit} members")
    sums = a.sparkSession.range(1).select(F.lit(0).cast("long").alias("total"))
    for x in members:
        sums = sums.select(F.explode(F.array("total", F.col("total") + F.lit(x))).alias("total")).distinct()
    return sums


def partition_cells(a: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Rows per cell of the partition by the truth values of n predicates, empty cells included."""
    truth = [F.coalesce(p, F.lit(False)).alias(name) for name, p in predicates.items()]
    counted = a.select(*truth).groupBy(*predicates).agg(F.count(F.lit(1)).alias("n"))
    cells = a.sparkSession.range(1 << len(predicates)).select(*[(F.col("id").bitwiseAND(F.lit(1 << i)) > 0).alias(name) for i, name in enumerate(predicates)])
    return cells.join(F.broadcast(counted), list(predicates), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def traverse(a: DataFrame, f: Column, name: str) -> DataFrame:
    """Map all or nothing: every row mapped, or no row where one maps to NULL."""
    mapped = a.select(f.alias(name))
    failed = mapped.where(F.col(name).isNull()).limit(1).count()
    return mapped.limit(0) if failed else mapped


def partial_image(a: DataFrame, f: Column, name: str) -> DataFrame:
    """Image under a partial function: what is undefined drops out, then equal values are one."""
    return a.select(f.alias(name)).where(F.col(name).isNotNull()).distinct()
