"""Small exact linear algebra, a system per group: elimination, and feasibility by the simplex method.

A group is one system; its rows meet in one task, so their number is checked against `LARGEST` and a larger
group is an error, not a cut. Numbers are exact fractions inside and doubles outside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Most rows of a system.
LARGEST = 256


def reduced(rows: list[list[Fraction]]) -> tuple[list[list[Fraction]], list[int]]:
    """The reduced row echelon form and its pivots' columns."""
    rows = [list(r) for r in rows]
    pivots: list[int] = []
    for column in range(len(rows[0]) if rows else 0):
        top = len(pivots)
        found = next((i for i in range(top, len(rows)) if rows[i][column]), None)
        if found is None:
            continue
        rows[top], rows[found] = rows[found], rows[top]
        lead = rows[top][column]
        rows[top] = [x / lead for x in rows[top]]
        for i, row in enumerate(rows):
            if i != top and (by := row[column]):
                rows[i] = [x - by * y for x, y in zip(row, rows[top], strict=True)]
        pivots.append(column)
    return rows, pivots


def positive_vector(matrix: list[list[Fraction]]) -> list[Fraction] | None:
    """x >= 0 with sum 1 and matrix x = 0, None if there is none.

    Phase one of the simplex method on matrix x = 0, sum x = 1 with an artificial variable per row; the
    entering and the leaving variable are the first that serve, which cannot cycle.
    """
    n = len(matrix[0]) if matrix else 0
    if not n:
        return None
    m = len(matrix) + 1
    rows = [[*r, *(Fraction(int(i == j)) for j in range(m)), Fraction(0)] for i, r in enumerate(matrix)]
    rows.append([Fraction(1)] * n + [Fraction(int(j == m - 1)) for j in range(m)] + [Fraction(1)])
    basis = list(range(n, n + m))
    # what is left of the artificial variables' sum, for each column
    cost = [sum(r[j] for r in rows) for j in range(n)] + [Fraction(0)] * m + [sum(r[-1] for r in rows)]
    while (enter := next((j for j in range(n) if cost[j] > 0), None)) is not None:
        limits = [(r[-1] / r[enter], basis[i], i) for i, r in enumerate(rows) if r[enter] > 0]
        if not limits:
            return None
        out = min(limits)[2]
        lead = rows[out][enter]
        rows[out] = [x / lead for x in rows[out]]
        for i, row in enumerate(rows):
            if i != out and (by := row[enter]):
                rows[i] = [x - by * y for x, y in zip(row, rows[out], strict=True)]
        by = cost[enter]
        cost = [x - by * y for x, y in zip(cost, rows[out], strict=True)]
        basis[out] = enter
    if cost[-1]:
        return None
    answer = [Fraction(0)] * n
    for i, j in enumerate(basis):
        if j < n:
            answer[j] = rows[i][-1]
    return answer


def _system(listed: list[dict], columns: list[str]) -> list[list[Fraction]]:
    """The rows of a system by their order; entries are Python's own numbers, so whole numbers beyond 2^53 and decimals stay exact."""
    orders = [r["order"] for r in listed]
    if len(set(orders)) < len(orders):
        raise ValueError("rows of a system need an order without ties")
    if any(r[c] is None or r[c] != r[c] for r in listed for c in columns):
        raise ValueError("a system has no NULL entries")
    listed = [*sorted((r for r in listed if r["order"] is not None), key=lambda r: r["order"]), *(r for r in listed if r["order"] is None)]
    return [[Fraction(r[c]) for c in columns] for r in listed]


def _bounded(df: DataFrame, key: str) -> None:
    most = df.groupBy(key).count().agg(F.max("count")).first()[0]
    if most is not None and most > LARGEST:
        raise ValueError(f"a system of {most} rows; the most is {LARGEST}")


def _solved(df: DataFrame, key: str, order: str, columns: list[str], solve: Callable[[list[list[Fraction]]], list[tuple]], schema: str) -> DataFrame:
    """(key, ...): solve's rows for each group's system. A system is one row with its rows as a list, and many of them go to Python at a time."""
    _bounded(df, key)
    names = [f"c{i}" for i in range(len(columns))]
    row = F.struct(F.col(order).alias("order"), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    systems = df.groupBy(F.col(key).alias("key")).agg(F.collect_list(row).alias("rows"))
    fields = [f.name for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            made: list[dict] = []
            for i, rows in enumerate(batch.column(1).to_pylist()):
                for out in solve(_system(rows, names)):
                    at.append(i)
                    made.append(dict(zip(fields, out, strict=True)))
            table = pa.Table.from_pylist(made, kinds) if made else kinds.empty_table()
            for part in table.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *part.columns], names=[key, *fields])

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return systems.mapInArrow(run, StructType([StructField(key, df.schema[key].dataType), *StructType.fromDDL(schema).fields]))


def eliminated(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, row, values) of each group's reduced row echelon form, rows without a pivot left out; a NULL key is a group.

    The rows of a group are its equations by `order`, `columns` their coefficients and right sides.
    """

    def solve(system: list[list[Fraction]]) -> list[tuple]:
        rows, pivots = reduced(system)
        return [(i, [float(x) for x in r]) for i, r in enumerate(rows[: len(pivots)])]

    return _solved(df, key, order, columns, solve, "row int, values array<double>")


def positive_combinations(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, weights): weights of 0 or more, of sum 1, under which each group's vectors add up to 0; NULL where there are none.

    The rows of a group are its vectors by `order`, `columns` their entries.
    """

    def solve(vectors: list[list[Fraction]]) -> list[tuple]:
        found = positive_vector([list(r) for r in zip(*vectors, strict=True)])
        return [(None if found is None else [float(x) for x in found],)]

    return _solved(df, key, order, columns, solve, "weights array<double>")
