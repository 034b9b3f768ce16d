"""User-defined folds and maps over partitions, with errors kept beside the values."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import write_once


def guarded_map(df: DataFrame, f: Callable[[pd.DataFrame], pd.Series], schema: str) -> DataFrame:
    """(value, error) of each row: f maps a batch of rows; where the batch fails, row by row, so that only bad rows are lost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield pd.DataFrame({"value": f(batch), "error": None})
            except Exception:  # the row at fault is found below, and its message is kept
                rows = []
                for i in range(len(batch)):
                    try:
                        rows.append((f(batch.iloc[i : i + 1]).iloc[0], None))
                    except Exception as e:
                        rows.append((None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["value", "error"])

    return df.mapInPandas(run, f"value {schema}, error string")


def fold_partitions(df: DataFrame, start: float, step: Callable[[float, pd.DataFrame], float], combine) -> DataFrame:
    """A fold of each partition in parallel and one combination of their results: combine(Column) -> Column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = start
        for batch in batches:
            state = step(state, batch)
        yield pd.DataFrame({"state": [state]})

    return df.mapInPandas(run, "state double").agg(F.coalesce(combine(F.col("state")), F.lit(float(start))).alias("state"))


#: Partial states that are merged in one step of a tree.
FAN = 16


def fold_collecting(df: DataFrame, row_id: str, start: dict, step: Callable[[dict, dict], dict], merge: Callable[[dict, dict], dict]) -> tuple[dict, DataFrame]:
    """(state, failures): a fold over all rows that goes on where a row fails, and (row_id, reason) of the rows that did.

    One pass makes both: each partition puts out its state, of which a failed row is no part, and its failed
    rows, under one schema. States are JSON objects; they are merged FAN at a time in a tree of tasks, so that no
    task and not the driver sees all of them. step(state, row) returns a new state or raises; merge is
    associative with start as its unit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state, names = start, ["part", "state", "row_id", "reason"]
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids, reasons = [], []
            for row in batch.to_pylist():
                name = row.pop("__id")
                try:
                    state = step(state, row)
                except Exception as e:  # kept as the row's reason
                    ids.append(name)
                    reasons.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array([None] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(reasons, pa.string())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([json.dumps(state)], pa.string()), pa.array([None], pa.string()), pa.array([None], pa.string())], names=names)

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        state = start
        for x in frame.sort_values("part")["state"]:
            state = merge(state, json.loads(x))
        return pd.DataFrame({"part": [int(frame["part"].min()) // FAN], "state": [json.dumps(state)]})

    tagged = write_once(df.select(F.col(row_id).cast("string").alias("__id"), "*").mapInArrow(run, "part int, state string, row_id string, reason string"))
    states = tagged.where("state IS NOT NULL").select("part", "state")
    n = states.count()
    while n > 1:
        states = write_once(states.groupBy(F.expr(f"part div {FAN}")).applyInPandas(merged, "part int, state string"))
        # numbers of partitions shrink by FAN with each step, however few of them had rows
        n = states.count()
    found = states.first()
    failures = tagged.where("reason IS NOT NULL").select(F.col("row_id"), "reason")
    return (json.loads(found["state"]) if found else start), failures


class Rules:
    """Named plug-ins by priority."""

    def __init__(self) -> None:
        self.rules: list[tuple[int, str, Callable]] = []

    def add(self, priority: int, name: str, f: Callable) -> None:
        self.rules.append((priority, name, f))
        self.rules.sort(key=lambda r: (-r[0], r[1]))

    def names(self) -> list[str]:
        return [name for _, name, _ in self.rules]

    def column(self) -> Column:
        """struct(rule, value) of the first rule whose column has a value for a row; rules are functions without arguments that make columns of one type."""
        cases = [F.when(f().isNotNull(), F.struct(F.lit(name).alias("rule"), f().alias("value"))) for _, name, f in self.rules]
        return F.coalesce(*cases) if cases else F.lit(None)

    def first(self, *args):
        """The result of the first rule that has one."""
        for _, _, f in self.rules:
            if (out := f(*args)) is not None:
                return out
        return None


def fold_in_order(df: DataFrame, key: str, order: list[str], value: str, start: int, step: Callable[[int, int], int]) -> DataFrame:
    """(key, state): a fold over each key's rows one after another, in order; state and value are of type long.

    A key's rows stay in one task but are never held together: partitions are sorted, and only the state goes on.
    NULL is a key like others. Rows with a NULL value take no step, and a key with such rows only has the start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, start
        schema = pa.schema([("k", pa.int64()), ("state", pa.int64())])
        for batch in batches:
            done = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held != (k,):
                    if held is not None:
                        done.append({"k": held[0], "state": state})
                    held, state = (k,), start
                if x is not None:
                    state = step(state, x)
            yield pa.RecordBatch.from_pylist(done, schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"k": held[0], "state": state}], schema)

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(value).cast("long").alias("x"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    rows = rows.repartition("k").sortWithinPartitions("k", *[f"o{i}" for i in range(len(order))]).select("k", "x")
    return rows.mapInArrow(run, "k long, state long").withColumnRenamed("k", key)
