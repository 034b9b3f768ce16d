"""Named queries with their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
#: What a query stands for: "algebra", or "driver" for Spark built-ins exposed for the tables only.
ORIGIN: dict[str, str] = {}


def importable(spark: SparkSession) -> None:
    """Let this session's Python workers import the package from where the driver has it, whatever their folder."""
    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (paths, root) if x)


def query(sql: str | None = None, origin: str = "algebra"):
    """Register a function of Tables under its name, with an equivalent DuckDB statement where there is one."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            importable(spark)
            return f(Tables(spark, folder))

        QUERIES[name] = run
        ORIGIN[name] = origin
        if sql is not None:
            SQL[name] = sql
        return f

    return keep
