"""Operators on columns of whole numbers: their prime divisors by a sieve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maths as M

#: Numbers of a block of the sieve.
BLOCK = 1 << 16
#: Largest number that the sieve takes; the primes up to its root are some 3,400, sent to every task.
LARGEST = 1 << 30


def small_primes(most: int) -> list[int]:
    """The primes up to a small bound."""
    out: list[int] = []
    for n in range(2, most + 1):
        if all(n % p for p in out if p * p <= n):
            out.append(n)
    return out


def factored(df: DataFrame, n: str) -> DataFrame:
    """df's rows with (primes): the prime divisors of their number in order; none of NULL and of what is below 2.

    Only blocks with a number are sieved: each block lists the multiples of the primes up to the root of the greatest number, and
    what is left of a number after these is 1 or one more prime. A block costs its numbers and one look at each of
    those primes. Numbers beyond `LARGEST` are divided one by one.
    """
    distinct = df.select(F.col(n).cast("long").alias("__v")).where("__v > 1").distinct()
    top = distinct.where(F.col("__v") <= LARGEST).agg(F.max("__v")).first()[0] or 1
    primes = F.lit(small_primes(int(top**0.5) + 1)).cast("array<bigint>")
    first = F.col("block") * BLOCK
    multiples = F.sequence(F.col("p") * F.ceil(first / F.col("p")), F.col("p") * F.floor((first + BLOCK - 1) / F.col("p")), F.col("p"))
    blocks = distinct.where(F.col("__v") <= LARGEST).select(F.floor(F.col("__v") / BLOCK).alias("block")).distinct()
    met = blocks.withColumn("p", F.explode(primes)).where(F.ceil(first / F.col("p")) * F.col("p") < first + BLOCK)
    listed = met.select(F.explode(multiples).alias("__v"), "p").join(distinct, "__v", "left_semi").groupBy("__v").agg(F.array_sort(F.collect_list("p")).alias("small"))
    # each prime goes out as often as it divides
    strip = lambda rest, p: F.aggregate(F.sequence(F.lit(1), F.lit(30)), rest, lambda r, _: F.when(r % p == 0, F.call_function("div", r, p)).otherwise(r))
    few = distinct.where(F.col("__v") <= LARGEST).join(listed, "__v", "left").withColumn("small", F.coalesce("small", F.array().cast("array<bigint>")))
    few = few.withColumn("rest", F.aggregate("small", F.col("__v"), strip))
    few = few.select("__v", F.when(F.col("rest") > 1, F.array_append("small", F.col("rest"))).otherwise(F.col("small")).alias("primes"))
    many = distinct.where(F.col("__v") > LARGEST).select("__v", M.prime_factors(F.col("__v")).alias("primes"))
    found = df.join(few.unionByName(many), F.col(n) == F.col("__v"), "left").drop("__v")
    return found.withColumn("primes", F.coalesce("primes", F.array().cast("array<bigint>")))
