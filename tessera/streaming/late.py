"""Event time: stalls that timers report, late rows kept beside the totals, and a join of two streams within an interval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from ..plans.tables import shared_path


def stalls(s: DataFrame, key: str, time: str, bound_ms: int, delay: str = "1 second", buckets: int = 512) -> DataFrame:
    """(key, since_ms, resumed): each wait of a key that is longer than the bound, when it is known.

    A wait is reported by the key's next row, or by a timer once event time has passed the bound without one
    (resumed is then false). A key that a timer has reported keeps no state; its next row begins anew. Rows of a
    key arrive in order, as from a replay. The delay is above 0, as Spark takes a row at the watermark itself for late.

    State is kept per bucket of keys, which are plain values: a call of Python per bucket and batch sorts a bucket's rows,
    whatever the number of keys. More keys or longer batches want more buckets; keys that are NULL have one of their own.
    """
    kind = dict(s.dtypes)[key]
    rows = s.withColumn("__at", F.unix_millis(time)).withWatermark(time, delay)

    def run(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, null = state.getCurrentWatermarkMs(), bucket[0] < 0
        parts = [] if state.hasTimedOut else [f[["key", "__at"]] for f in frames]
        held = 0
        if state.exists:
            keys, lasts = state.get
            held = len(keys)
            parts.insert(0, pd.DataFrame({"key": keys, "__at": lasts}))
        both = pd.concat(parts, ignore_index=True)
        if null:
            both["key"] = 0
        code, names = pd.factorize(both["key"], use_na_sentinel=False)
        at, old = both["__at"].to_numpy("int64"), np.arange(len(both)) < held
        order = np.lexsort((at, ~old, code))
        code, at, old = code[order], at[order], old[order]
        same = code[1:] == code[:-1]
        wait = np.append(same & (at[1:] - at[:-1] > bound_ms), False)
        end = np.append(~same, True)
        due = old & end & (at + bound_ms + 1 < mark)
        told, kept = wait | due, end & ~due
        if told.any():
            yield pd.DataFrame({"key": [None] * int(told.sum()) if null else names.take(code[told]), "since_ms": at[told], "resumed": wait[told]})
        if kept.any():
            state.update(([None] if null else names.take(code[kept]).tolist(), at[kept].tolist()))
            state.setTimeoutTimestamp(max(int(at[kept].min()) + bound_ms + 1, mark + 1))
        elif state.exists:
            state.remove()

    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    narrow = rows.select(bucket.alias("bucket"), F.col(key).alias("key"), "__at", time)
    return narrow.groupBy("bucket").applyInPandasWithState(run, f"key {kind}, since_ms long, resumed boolean", f"keys array<{kind}>, lasts array<long>", "append", GroupStateTimeout.EventTimeTimeout).withColumnRenamed("key", key)


class TotalsAndLate:
    """Totals per tumbling window of event time, and the rows that come too late for them as a second output.

    Spark's own watermark drops late rows unseen, so the micro-batches are split here. The mark of a batch is the
    greatest time of earlier batches less the delay. Rows before it are late: they go to `late` with all their
    columns and are in no total. The others are added up per window, a partial sum per batch. A window
    is closed by the first batch whose mark has passed its end, when no row can reach it any more; its partial sums are then
    added and written to `windows`. Everything is written per batch and overwritten by a batch that runs again, the
    marks included, so a query that is started again goes on as it would have.
    """

    def __init__(self, spark: SparkSession, time: str, value: str, width_ms: int, delay_ms: int) -> None:
        self.spark, self.time, self.value, self.width, self.delay = spark, time, value, width_ms, delay_ms
        self.path, self.state = shared_path(spark, "late"), shared_path(spark, "late-state")
        self.tops: dict[int, int | None] = {}

    def _mark(self, batch: int) -> int | None:
        """The mark of a batch, None before any time is known."""
        tops = [x for n, x in self.tops.items() if n < batch and x is not None]
        return max(tops) - self.delay if tops else None

    def _close(self, batch: int) -> None:
        """The windows that end between the mark of the batch before and that of this one."""
        mark, before = self._mark(batch), self._mark(batch - 1)
        if mark is None:
            return
        end = F.col("start_ms") + self.width
        parts = self.spark.read.schema(self.PARTS).parquet(*[f"{self.path}/parts/batch={n}" for n in sorted(self.tops) if n < batch])
        due = parts.where((end <= mark) if before is None else (end <= mark) & (end > before))
        due.groupBy("start_ms").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).write.mode("overwrite").parquet(f"{self.path}/windows/batch={batch}")
        self.closed.add(batch)

    PARTS = "start_ms long, n long, total long"

    def run(self, s: DataFrame) -> TotalsAndLate:
        """Run until the source has no more rows; what is open then is closed as far as the last mark says. Values are added as exact cents."""
        self.schema, self.closed = s.schema, set()
        ms = F.unix_millis(self.time)

        def keep(batch: DataFrame, n: int) -> None:
            mark = self._mark(n)
            self._close(n)
            rows = batch.withColumn("__ms", ms)
            late = F.coalesce(F.col("__ms") < mark, F.lit(False)) if mark is not None else F.lit(False)
            path = f"{self.path}/split/batch={n}"
            rows.withColumn("__late", late).write.mode("overwrite").partitionBy("__late").parquet(path)
            split = self.spark.read.schema(StructType([*rows.schema.fields, StructField("__late", BooleanType())])).parquet(path)
            start = F.col("__ms") - F.pmod(F.col("__ms"), F.lit(self.width))
            sums = split.where("NOT __late AND __ms IS NOT NULL").groupBy(start.alias("start_ms")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col(self.value) * 100).cast("long")).alias("total"))
            sums.write.mode("overwrite").parquet(f"{self.path}/parts/batch={n}")
            self.tops[n] = split.agg(F.max("__ms")).first()[0]

        query = s.writeStream.foreachBatch(keep).option("checkpointLocation", self.state).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        if self.tops:
            self._close(max(self.tops) + 1)
        return self

    def windows(self) -> DataFrame:
        """(start_ms, n, total) of each closed window."""
        if not self.closed:
            return self.spark.createDataFrame([], self.PARTS)
        return self.spark.read.schema(self.PARTS).parquet(*[f"{self.path}/windows/batch={n}" for n in sorted(self.closed)])

    def late(self) -> DataFrame:
        """The late rows, with the stream's columns."""
        if not self.tops:
            return self.spark.createDataFrame([], self.schema)
        schema = StructType([*self.schema.fields, StructField("__late", BooleanType())])
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/split/batch={n}") for n in sorted(self.tops)]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionAll(x)
        return out.where("__late").drop("__late")


def joined_within(a: DataFrame, b: DataFrame, key: str, time_a: str, time_b: str, before: str, delay: str) -> DataFrame:
    """Rows of b with the rows of a that share the key and came at most `before` earlier; both streams keep only what an interval can still reach.

    Times have other names on each side, and b's key is called other_key in the result.
    """
    left, right = a.withWatermark(time_a, delay), b.withColumnRenamed(key, "other_key").withWatermark(time_b, delay)
    on = (F.col(key) == F.col("other_key")) & (F.col(time_a) <= F.col(time_b)) & (F.col(time_a) >= F.col(time_b) - F.expr(f"INTERVAL {before}"))
    return left.join(right, on)
