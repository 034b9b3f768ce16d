"""Relations: two-column DataFrames (a, b) and joins that the algebra has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Most pairs of values that a convolution takes.
PAIRS = 10**11


def positional_zip(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """The i-th row of one side with the i-th of the other, to the shorter length.

    Positions come from a range sort and the sizes of its partitions, so no window sees all rows.
    """
    return ordinal(a, order_a).join(ordinal(b, order_b), "pos")


def ordinal(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Rows numbered from 0 by a total order: a range sort, then each partition's rows after those before it.

    The partitions' sizes are as many numbers as there are partitions.
    """
    from ..plans.tables import write_once

    ordered = write_once(df.sort(*order).withColumn("__i", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__i"), 33)
    sizes = ordered.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    over = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("__p", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__base"))
    rows = ordered.withColumn("__p", part).join(F.broadcast(base), "__p")
    return rows.withColumn(name, F.col("__base") + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__i", "__base")


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of a value over the rows up to each one: a range sort, sums within its partitions, and what the partitions before hold."""
    from ..plans.tables import write_once

    ordered = write_once(df.sort(order).withColumn("__i", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__i"), 33)
    sums = ordered.groupBy(part.alias("__p")).agg(F.sum(value).alias("__s"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__p", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    rows = ordered.withColumn("__p", part).join(F.broadcast(base), "__p")
    return rows.withColumn(name, F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("__p", "__i", "__base")


def divide(r: DataFrame, a: str, b: str, divisor: DataFrame, universe: DataFrame) -> DataFrame:
    """Relational division: the b's of the universe related to every a of the divisor; an empty divisor yields all of them."""
    wanted = divisor.select(F.col(divisor.columns[0]).alias(a)).distinct()
    n = wanted.count()
    if n == 0:
        return universe.distinct()
    held = r.select(a, b).distinct().join(wanted, a, "left_semi").groupBy(b).agg(F.count(F.lit(1)).alias("__n"))
    return universe.distinct().join(held.where(F.col("__n") == n).select(b), b, "left_semi")


def functional(r: DataFrame, a: str, b: str) -> DataFrame:
    """Violations of a functional dependency a -> b: each a with more than one b."""
    return r.select(a, b).distinct().groupBy(a).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def uncovered(left: DataFrame, right: DataFrame, on: Column | str) -> DataFrame:
    """What is related to nothing: empty where the relation is total."""
    return left.join(right, on, "left_anti")


def differing_keys(f: DataFrame, g: DataFrame, key: str, value: str) -> DataFrame:
    """Keys where two sparse maps differ, a missing key being 0."""
    x, y = f.select(key, F.col(value).alias("__f")), g.select(key, F.col(value).alias("__g"))
    return x.join(y, key, "full").where(F.coalesce("__f", F.lit(0)) != F.coalesce("__g", F.lit(0))).select(key)


def lookup_or_zero(keys: DataFrame, f: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key, 0 where there is none."""
    return keys.join(f.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def convolution(a: DataFrame, b: DataFrame, op) -> DataFrame:
    """How many pairs of two sets combine to each value: counts per value first, so that equal values pair once.

    The pairs are the operator's nature, so more than PAIRS of them are an error, as nobody could wait for them.
    """
    from ..plans.tables import write_once

    x = write_once(a.select(F.col(a.columns[0]).alias("x")).distinct())
    y = write_once(b.select(F.col(b.columns[0]).alias("y")).distinct())
    if (pairs := x.count() * y.count()) > PAIRS:
        raise ValueError(f"{pairs} pairs of values; the most is {PAIRS}")
    return x.join(y, F.lit(True)).groupBy(op(F.col("x"), F.col("y")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def overwrite(base: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """A map with the values of some keys replaced; a NULL in the changes is a value, too."""
    new = changes.select(key, F.col(value).alias("__new"), F.lit(True).alias("__hit"))
    return base.join(new, key, "left").withColumn(value, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(value))).drop("__new", "__hit")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str) -> DataFrame:
    """The last right row of the same key at or before each left row's time, by one sorted union instead of a range join."""
    values = [c for c in right.columns if c not in (key, right_at)]
    packed = F.struct(F.col(right_at).alias("__at"), *values)
    lefts = left.withColumns({"__time": F.col(at), "__last": F.lit(2), "__row": F.lit(None).cast(right.select(packed.alias("s")).schema["s"].dataType)})
    rights = right.select(F.col(key), F.col(right_at).alias("__time"), F.lit(1).alias("__last"), packed.alias("__row"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__time", "__last").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__row", ignorenulls=True).over(w)).where("__last = 2")
    return found.select(*left.columns, F.col("__found.__at").alias(right_at), *[F.col(f"__found.{v}").alias(v) for v in values])
