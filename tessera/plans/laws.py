"""Rewrites that the algebra's laws justify and that Catalyst does not find by itself, each as a function that builds the better plan.

Every one states its law; tests compare both sides on bags with NULLs and duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_before_injective(df: DataFrame, f: Column, name: str) -> DataFrame:
    """distinct(map f s) = map f (distinct s) for an injective f: the shuffle carries the narrow rows, f runs once for each."""
    return df.distinct().select(f.alias(name))


def sum_over_union(parts: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """sum(s + t) = sum s + sum t: each part is added up by itself, so only groups are shuffled twice."""
    sums = [p.groupBy(*keys).agg(F.sum(value).alias(value)) for p in parts]
    out = sums[0]
    for s in sums[1:]:
        out = out.unionByName(s)
    return out.groupBy(*keys).agg(F.sum(value).alias(value))


def eager_sum(facts: DataFrame, dims: DataFrame, on: str, value: str, group: list[str]) -> DataFrame:
    """A sum above an N-1 join is a sum of sums per join key: facts shrink to one row per key before the join."""
    small = facts.groupBy(on).agg(F.sum(value).alias(value))
    return small.join(dims.select(on, *group), on).groupBy(*group).agg(F.sum(value).alias(value))


def count_complement(df: DataFrame, p: Column) -> DataFrame:
    """|s| = |s where p| + |s where not p|: one scan gives both; what p is NULL on counts as not p."""
    return df.agg(F.count_if(p).alias("yes"), (F.count(F.lit(1)) - F.count_if(p)).alias("no"))


def double_difference(s: DataFrame, t: DataFrame) -> DataFrame:
    """s \\ (s \\ t) = s and t: one semi-join, equal NULLs included, instead of two anti-joins."""
    a, b = s.distinct().alias("a"), t.distinct().alias("b")
    same = F.lit(True)
    for c in s.columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left_semi")


def difference_of_union(s: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """s \\ (t or u) = (s \\ t) and (s \\ u): one anti-join with the union."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    return s.subtract(union)


def sum_of_scaled(df: DataFrame, keys: list[str], value: Column, factor: float, name: str) -> DataFrame:
    """sum(c x) = c sum(x): the product is taken once per group."""
    return df.groupBy(*keys).agg((F.sum(value) * factor).alias(name))


def transitive_bounds(pairs: list[tuple[str, str]]) -> set[tuple[str, str]]:
    """All a <= c that follow from a <= b and b <= c."""
    known = set(pairs)
    while True:
        more = {(a, d) for a, b in known for c, d in known if b == c} - known
        if not more:
            return known
        known |= more


def with_inferred_bounds(df: DataFrame, pairs: list[tuple[str, str]], limits: dict[str, float]) -> DataFrame:
    """Filters of columns a <= b, and what follows from limits on b for each a, so that a scan can use them."""
    out = df
    for a, b in pairs:
        out = out.where(F.col(a) <= F.col(b))
    for a, b in sorted(transitive_bounds(pairs)):
        if b in limits:
            out = out.where(F.col(a) <= limits[b])
    for c, x in limits.items():
        out = out.where(F.col(c) <= x)
    return out


def equal_columns(pairs: list[tuple[str, str]]) -> set[frozenset[str]]:
    """Columns that a cycle of <= makes equal."""
    known = transitive_bounds(pairs)
    return {frozenset((a, b)) for a, b in known if a != b and (b, a) in known}
