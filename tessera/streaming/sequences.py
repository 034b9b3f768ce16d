"""Sequences with an explicit place `seq`, as batches and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.tables import shared_path


def naturals(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    """The endless sequence 0, 1, 2, ...: paced by time, so only the values are the sequence's."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias("seq"), F.col("value").alias("x"), "timestamp")


def constant(spark: SparkSession, value) -> DataFrame:
    return naturals(spark).withColumn("x", F.lit(value))


def cycle(spark: SparkSession, values: list) -> DataFrame:
    """A finite list over and over."""
    return naturals(spark).withColumn("x", F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("seq") % len(values) + 1).cast("int")))


def mapped(s: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return s.withColumn("x", f(F.col("x")))


def even(s: DataFrame) -> DataFrame:
    """Elements at even places, renumbered."""
    return s.where("seq % 2 = 0").withColumn("seq", F.expr("seq div 2"))


def odd(s: DataFrame) -> DataFrame:
    return s.where("seq % 2 = 1").withColumn("seq", F.expr("seq div 2"))


def interleave(a: DataFrame, b: DataFrame) -> DataFrame:
    """Strict alternation: places say the order, whatever the order of arrival."""
    return a.withColumn("seq", F.col("seq") * 2).unionByName(b.withColumn("seq", F.col("seq") * 2 + 1))


def prepend(values: list, s: DataFrame) -> DataFrame:
    """A finite list before a sequence (batch)."""
    first = s.sparkSession.createDataFrame(list(enumerate(values)), s.select("seq", "x").schema) if values else s.select("seq", "x").limit(0)
    return first.unionByName(s.select((F.col("seq") + len(values)).alias("seq"), "x"))


def without_pauses(s: DataFrame) -> DataFrame:
    """Elements of a sequence that may stall: pauses are NULLs."""
    return s.where(F.col("x").isNotNull())


def iterate(spark: SparkSession, f: Callable[[Column], Column], start: Column, n: int) -> DataFrame:
    """(seq, x): start, f(start), ... n of them, one fold."""
    states = F.aggregate(F.sequence(F.lit(2), F.lit(n)), F.array(start), lambda a, _: F.array_append(a, f(F.element_at(a, -1)))) if n > 1 else F.array(start)
    return spark.range(1).select(F.posexplode(states).alias("seq", "x"))


def unfold(s: DataFrame, key: str, schema: str, state_schema: str, step: Callable[[tuple, pd.DataFrame], tuple[tuple, pd.DataFrame]], start: tuple) -> DataFrame:
    """An unfold with state per key: step(state, rows) -> (state, rows out), called for each micro-batch of a key."""

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get if state.exists else start
        for frame in frames:
            current, out = step(current, frame)
            yield out
        state.update(current)

    return s.groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def windowed_totals(s: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Totals per key and tumbling window, with a bound on lateness."""
    return s.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def run_to_end(s: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return its rows, which are written to the shared folder.

    Each micro-batch overwrites a folder of its own, so a batch that runs again leaves no row twice. In
    complete mode a batch has all rows, and the last one counts. Offsets and state are kept in the shared
    folder as well.
    """
    spark = s.sparkSession
    path, last = shared_path(spark, name), []

    def keep(batch: DataFrame, number: int) -> None:
        where = f"{path}/batch={number}" if mode == "append" else f"{path}/all={number}"
        batch.write.mode("overwrite").parquet(where)
        last[:] = [where]

    query = s.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], s.schema)
    rows = spark.read.schema(s.schema).parquet(path if mode == "append" else last[0])
    return rows.select(*s.columns)
