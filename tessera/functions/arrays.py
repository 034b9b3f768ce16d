"""Functions on arrays and maps as Column expressions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F


def zip_shorter(a: Column, b: Column, f) -> Column:
    """Element by element to the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), f)


def distinct_keep_last(a: Column) -> Column:
    """Without duplicates, the last of each kept."""
    return F.reverse(F.array_distinct(F.reverse(a)))


def destutter(a: Column) -> Column:
    """Without equal neighbours."""
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def replace_first(a: Column, p, f) -> Column:
    """The first element that fits replaced."""
    at = F.array_position(F.transform(a, p), True)
    return F.transform(a, lambda x, i: F.when(i + 1 == at, f(x)).otherwise(x))


def take(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def drop_right(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))


def take_right(a: Column, n: int) -> Column:
    k = F.least(F.size(a), F.lit(n))
    return F.slice(a, F.size(a) - k + 1, k)


def suffix_length(a: Column, p) -> Column:
    """How many elements at the end fit, without a gap."""
    return F.aggregate(a, F.lit(0), lambda n, x: F.when(p(x), n + 1).otherwise(0))


def drop_right_while(a: Column, p) -> Column:
    return F.slice(a, F.lit(1), F.size(a) - suffix_length(a, p))


def take_right_while(a: Column, p) -> Column:
    k = suffix_length(a, p)
    return F.slice(a, F.size(a) - k + 1, k)


def split_lengths(lengths: Column, a: Column) -> Column:
    """Chunks of the given lengths; the last ones are shorter where the array ends."""
    offset = lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda s, x: s + x)
    return F.transform(lengths, lambda n, i: F.slice(a, offset(i) + 1, n))


def all_equivalent(a: Column) -> Column:
    """Whether all truth values agree."""
    return F.size(F.array_distinct(a)) <= 1


def is_palindrome(a: Column) -> Column:
    return a == F.reverse(a)


def cyclic_permute(a: Column, places: list[int]) -> Column:
    """Each element at a place of the cycle moves to the next place."""
    n = len(places)
    moves = {places[(i + 1) % n]: places[i] for i in range(n)}
    return F.transform(a, lambda x, i: F.coalesce(*[F.when(i == to, F.get(a, F.lit(f))) for to, f in moves.items()], x) if moves else x)


def permutations_of(a: Column, n: int) -> Column:
    """All orders of an array of n elements, n up to 7."""
    if n > 7:
        raise ValueError("more than 7 elements")
    return F.array(*[F.array(*[F.get(a, F.lit(i)) for i in p]) for p in itertools.permutations(range(n))])


def unordered_pairs(a: Column) -> Column:
    """Pairs of positions i <= j as struct(x, y)."""
    return F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 1, F.size(a) - i), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def off_diagonal(a: Column) -> Column:
    """Ordered pairs of different positions."""
    return F.flatten(F.transform(a, lambda x, i: F.transform(F.filter(a, lambda y, j: j != i), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def to_sparse(a: Column) -> Column:
    """The map from index to value, zeros left out."""
    return F.map_from_entries(F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda z: z["x"] != 0))


def sparse_entries(m: Column) -> Column:
    return F.map_entries(F.map_filter(m, lambda k, v: v != 0))


def restricted(m: Column, keys: Column) -> Column:
    return F.map_filter(m, lambda k, v: F.array_contains(keys, k))


def sign_changes(a: Column) -> Column:
    """Changes of sign after the zeros are left out."""
    signs = F.transform(F.filter(a, lambda x: x != 0), lambda x: F.signum(x.cast("double")))
    return F.size(F.filter(signs, lambda x, i: (i > 0) & (x != F.get(signs, i - 1))))


def running_lengths(lengths: Column) -> Column:
    """[1, 2, 3] to [[0], [1, 2], [3, 4, 5]]."""
    offset = lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda s, x: s + x)
    return F.transform(lengths, lambda n, i: F.when(n > 0, F.sequence(offset(i), offset(i) + n - 1)).otherwise(F.array().cast("array<int>")))


def folded(a: Column, zero: Column, f) -> Column:
    """Left fold of any step."""
    return F.aggregate(a, zero, f)


def map_accumulate(a: Column, zero: Column, f, kind: str) -> Column:
    """Left to right with a state: f(state, x) -> (state, y); struct(state, out)."""
    start = F.struct(zero.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        state, y = f(s["state"], x)
        return F.struct(state.alias("state"), F.array_append(s["out"], y.cast(kind)).alias("out"))

    return F.aggregate(a, start, step)


def dershowitz_manna_less(m: Column, n: Column) -> Column:
    """Whether m is less than n: they differ, and each element that m has more of is less than one that n has more of."""
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    more = lambda a, b: F.filter(F.array_distinct(a), lambda x: count(a, x) > count(b, x))
    return (F.size(more(n, m)) > 0) & F.forall(more(m, n), lambda x: F.exists(more(n, m), lambda y: x < y))
