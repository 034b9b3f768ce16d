"""Scalar functions that lists, numbers and small matrices need besides."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest matrix whose permanent is written out: as many products as permutations.
LARGEST = 6


def extended_exp(x: Column) -> Column:
    """exp over the extended line: 0 at minus infinity, infinity at infinity; NULL stays."""
    return F.when(x == F.lit(float("-inf")), F.lit(0.0)).when(x == F.lit(float("inf")), x).otherwise(F.exp(x))


def map_accum_right(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """struct(state, items) of a stateful map from right to left; step(item, state) -> (state, new item)."""

    def merge(acc: Column, x: Column) -> Column:
        state, made = step(x, acc["state"])
        return F.struct(state.alias("state"), F.concat(F.array(made), acc["items"]).alias("items"))

    first = F.struct(start.alias("state"), F.filter(F.transform(items, lambda x: step(x, start)[1]), lambda x: F.lit(False)).alias("items"))
    return F.aggregate(F.reverse(items), first, merge)


def hyperoperation(n: int, a: Column, b: Column, most: int = 40) -> Column:
    """The n-th hyperoperation for n up to 3: successor, sum, product, power, on numbers from 0. A power's b above `most` is an error, as is a value of more than 38 digits."""
    if n == 0:
        return b + 1
    if n == 1:
        return a + b
    if n == 2:
        return a * b
    if n == 3:
        beyond = F.raise_error(F.lit(f"a power of more than {most}")).cast("decimal(38,0)")
        return F.when(b > most, beyond).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(most)), F.lit(1).cast("decimal(38,0)"), lambda acc, i: F.when(i < b, (acc * a).cast("decimal(38,0)")).otherwise(acc)))
    raise ValueError("beyond powers the values leave every number type")


def permuted(items: Column, places: Column) -> Column:
    """A list rearranged by any permutation: the i-th item is the one at the i-th of the places, which are 0 and up."""
    return F.transform(places, lambda i: F.get(items, i))


def sorting(keys: Column) -> Column:
    """The permutation that sorts a list, of equal keys the first place first."""
    placed = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    return F.transform(F.array_sort(placed), lambda x: x["i"])


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) with 32 digits of base 2 that seed and keys alone decide."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def sampled(sampler: Callable[..., Column], draws: int, seed: int, *keys: Column) -> Column:
    """A user's sampler: a function of so many uniform numbers, each of its own seed."""
    return sampler(*[uniform(seed + i, *keys) for i in range(draws)])


def shrunk_natural(n: Column) -> Column:
    """Simpler naturals to try instead: n / 2, n / 4 and so on down to 0; none for 0."""
    steps = F.sequence(F.lit(1), F.length(F.bin(n)))
    return F.when(n > 0, F.transform(steps, lambda i: F.call_function("shiftright", n.cast("long"), i.cast("int")))).otherwise(F.array().cast("array<bigint>"))


def shrunk_fraction(num: Column, den: Column) -> Column:
    """Simpler fractions (num, den) to try instead of num / den, in least terms: each simpler numerator of either sign over each simpler denominator of 1 or more.

    Fractions come in the order of their numerators, then of their denominators.
    """
    tops = F.flatten(F.transform(shrunk_natural(F.abs(num)), lambda x: F.array(x, -x)))
    bottoms = F.filter(shrunk_natural(den), lambda d: d > 0)
    return F.flatten(F.transform(tops, lambda a: F.transform(bottoms, lambda b: F.struct(a.alias("num"), b.alias("den")))))


def permanent(matrix: Column, size: int) -> Column:
    """The permanent of a matrix as an array of rows: the sum over permutations, without signs."""
    if size > LARGEST:
        raise ValueError(f"a permanent of size {size} has too many terms; the most is {LARGEST}")
    total = F.lit(0).cast("long")
    for p in permutations(range(size)):
        term = F.lit(1).cast("long")
        for i, j in enumerate(p):
            term = term * F.get(F.get(matrix, F.lit(i)), F.lit(j))
        total = total + term
    return total


def snoc(items: Column, x: Column) -> Column:
    """A list with one more item at its end."""
    return F.concat(items, F.array(x))


def apply_each(fs: list[Callable[[Column], Column]], items: Column) -> Column:
    """The i-th function of a list applied to the i-th item, up to the shorter."""
    made = F.array(*[f(F.get(items, F.lit(i))) for i, f in enumerate(fs)])
    return F.slice(made, F.lit(1), F.least(F.lit(len(fs)), F.size(items)))
