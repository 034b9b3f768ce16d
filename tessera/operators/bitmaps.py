"""Sets as bitmaps: 64 members to a word, and words without a member are not stored.

A set is some rows (chunk, bits). Members are numbered first, so that sets of one kind share their chunks. Unions
and intersections are bitwise sums over chunks, running ones a window per chunk; no list of members is held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relations import ordinal


def numbered(df: DataFrame, member: str, name: str = "number") -> DataFrame:
    """df with its members numbered from 0 in their order; NULL is no member."""
    names = ordinal(df.select(member).where(F.col(member).isNotNull()).distinct(), member, name=name)
    return df.join(names, member)


def packed(df: DataFrame, keys: list[str], number: str = "number") -> DataFrame:
    """(keys, chunk, bits): the set of numbers of each key."""
    bit = F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST({number} % 64 AS INT))")
    return df.groupBy(*keys, F.expr(f"{number} div 64").alias("chunk")).agg(F.bit_or(bit).alias("bits"))


def members(bitmaps: DataFrame, number: str = "number") -> DataFrame:
    """(other columns, number): the members of each set."""
    others = [c for c in bitmaps.columns if c not in ("chunk", "bits")]
    on = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    return bitmaps.select(*others, "chunk", F.explode(on).alias("__i")).select(*others, (F.col("chunk") * 64 + F.col("__i")).alias(number))


def sizes(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): how many members each set has; a set without a chunk has no row."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("long").alias("n"))


def running(bitmaps: DataFrame, places: DataFrame, key: str, place: str) -> DataFrame:
    """(key, place, chunk, union, common): per chunk, the union of the sets up to a place and their intersection.

    places lists every (key, place) that has a set, the empty ones included. A chunk has rows from the first
    place on that has it, at the places where it is stored; common is 0 once an earlier place lacked it.
    """
    order = Window.partitionBy(key).orderBy(place)
    turns = places.select(key, place).distinct().withColumn("__turn", F.row_number().over(order))
    w = Window.partitionBy(key, "chunk").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    rows = bitmaps.join(turns, [key, place]).withColumn("__seen", F.count(F.lit(1)).over(w))
    common = F.when(F.col("__seen") == F.col("__turn"), F.bit_and("bits").over(w)).otherwise(F.lit(0).cast("long"))
    return rows.select(key, place, "chunk", F.bit_or("bits").over(w).alias("union"), common.alias("common"))


def running_sizes(bitmaps: DataFrame, places: DataFrame, key: str, place: str) -> DataFrame:
    """(key, place, n_union, n_common) at each place: members of any set up to it, and of all of them."""
    made = running(bitmaps, places, key, place)
    before = F.coalesce(F.lag(F.bit_count("union")).over(Window.partitionBy(key, "chunk").orderBy(place)), F.lit(0))
    per = made.withColumn("__new", F.bit_count("union") - before).groupBy(key, place).agg(F.sum("__new").alias("__new"), F.sum(F.bit_count("common")).alias("n_common"))
    order = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    filled = places.select(key, place).distinct().join(per, [key, place], "left")
    total = F.sum(F.coalesce("__new", F.lit(0))).over(order)
    return filled.select(key, place, total.cast("long").alias("n_union"), F.coalesce("n_common", F.lit(0)).cast("long").alias("n_common"))
