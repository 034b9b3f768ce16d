"""Endless sequences as a streaming source with places of its own, and tables replayed by place.

The rate source's values depend on the clock. Here a micro-batch is the next `rows` places, whatever the time, so
that values and batches are the same in every run, and a query that is started again goes on at the place that
its checkpoint holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..plans.tables import shared_path


class Places(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class PlacesReader(DataSourceStreamReader):
    """Batches of `rows` places dealt to `parts` tasks, up to the place `until` if there is one."""

    def __init__(self, rows: int, parts: int, until: int | None) -> None:
        self.rows, self.parts, self.until, self.at = rows, parts, until, 0

    def initialOffset(self) -> dict:
        return {"place": 0}

    def latestOffset(self) -> dict:
        following = self.at + self.rows
        self.at = following if self.until is None else max(self.at, min(following, self.until))
        return {"place": self.at}

    def partitions(self, start: dict, end: dict) -> list[Places]:
        # a query that goes on plans its last batch first, which says where it is
        self.at = max(self.at, end["place"])
        first, last = start["place"], end["place"]
        size = max(1, -(-(last - first) // self.parts))
        return [Places(x, min(x + size, last)) for x in range(first, last, size)]

    def read(self, partition: Places) -> Iterator[pa.RecordBatch]:
        for x in range(partition.first, partition.last, 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(range(x, min(x + (1 << 16), partition.last)), pa.int64())], names=["seq"])


class PlacesSource(DataSource):
    """Options: rows, parts, until (left out: endless)."""

    @classmethod
    def name(cls) -> str:
        return "tessera-places"

    def schema(self) -> str:
        return "seq long"

    def streamReader(self, schema) -> PlacesReader:
        until = self.options.get("until")
        return PlacesReader(int(self.options.get("rows", 1000)), int(self.options.get("parts", 4)), None if until is None else int(until))


def places(spark: SparkSession, rows: int = 1000, until: int | None = None) -> DataFrame:
    """0, 1, 2, ... as a stream (seq)."""
    spark.dataSource.register(PlacesSource)
    reader = spark.readStream.format("tessera-places").option("rows", rows)
    return (reader if until is None else reader.option("until", until)).load()


def naturals(spark: SparkSession, rows: int = 1000, until: int | None = None) -> DataFrame:
    return places(spark, rows, until).withColumn("x", F.col("seq"))


def constant(spark: SparkSession, value, rows: int = 1000, until: int | None = None) -> DataFrame:
    return places(spark, rows, until).withColumn("x", F.lit(value))


def cycle(spark: SparkSession, values: list, rows: int = 1000, until: int | None = None) -> DataFrame:
    """A finite list over and over."""
    if not values:
        raise ValueError("a cycle has a value at least")
    return places(spark, rows, until).withColumn("x", F.get(F.array(*[F.lit(v) for v in values]), (F.col("seq") % len(values)).cast("int")))


def replayed(table: DataFrame, rows: int = 1000, until: int | None = None) -> DataFrame:
    """A finite table (seq, ...) as a stream in the order of its places: the stream ends where the table does, or at `until`.

    The table is read with each batch, whose places select its rows; keep it sorted by seq.
    """
    n = (table.agg(F.max("seq")).first()[0] or -1) + 1 if until is None else until
    return places(table.sparkSession, rows, n).join(table, "seq")


class Run:
    """A stream that can be stopped and started again: its checkpoint and its rows are kept in the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.rows, self.state = spark, shared_path(spark, name), shared_path(spark, f"{name}-state")
        self.batches, self.progress = set(), []

    def until_read(self, s: DataFrame) -> Run:
        """Run until the source has no more places; a batch that runs again replaces its rows."""

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.rows}/batch={number}")
            self.batches.add(number)

        query = s.writeStream.foreachBatch(keep).option("checkpointLocation", self.state).start()
        try:
            query.processAllAvailable()
            self.progress = [p for p in query.recentProgress]
        finally:
            query.stop()
        self.schema = s.schema
        return self

    def read(self) -> DataFrame:
        if not self.batches:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.rows}/batch={n}" for n in sorted(self.batches)])
