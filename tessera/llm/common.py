"""What the operators share: words, tables in the shared folder, and joins with a side of a checked size."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import shared_folder

#: A word is a run of characters other than space and U+0009 to U+000D; bytes.split() cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest table, in rows, that is sent to every executor.
BROADCAST_ROWS = 20_000


def n_words(text: Column) -> Column:
    """Number of words; NULL and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; unset, a local one in local mode and an error on a cluster."""
    return shared_folder(spark)


_written: dict[str, SparkSession] = {}


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whichever it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_written.items()):
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the session has ended; its folder goes with the cluster's clean-up
            _written.pop(path, None)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def sorted_joins(df: DataFrame) -> DataFrame:
    """A written table that Spark never sends to every executor by itself.

    Spark takes a file's bytes for the size of the rows in it. Compressed tables of ids are a tenth of what they
    are in memory, several times over while the driver builds the relation, so a table that grows is joined by a shuffle
    unless join_small() has counted its rows.
    """
    out = df.hint("merge")
    if hasattr(df, "_written_to"):
        out._written_to = df._written_to
    return out


def release(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that nothing will read again."""
    drop_path(df.sparkSession, df._written_to)


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side that is usually small: broadcast only after its rows are counted, a shuffled join beyond `limit`.

    Pass a `small` that is already materialized, as it is counted first.
    """
    fits = small.limit(limit + 1).count() <= limit
    return big.join(F.broadcast(small) if fits else small, on, how)


def free_name(taken: Iterable[str], wish: str) -> str:
    """A column name that clashes with none of `taken`, ignoring case."""
    used = {x.lower() for x in taken}
    while wish.lower() in used:
        wish = f"_{wish}"
    return wish


def components(spark: SparkSession, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges (a, b); ids without an edge are left out.

    Alternates large-star and small-star steps, each one shuffle of the edges; stars shrink the
    diameter, so the number of rounds grows with its logarithm. Every round is written to the shared folder.
    """
    cur = sorted_joins(materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), name))
    old = None
    while True:
        # large star: each larger neighbour links to the smallest id seen from here, itself included
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(sorted_joins(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the smaller neighbours, and the id itself, link to the smallest
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sorted_joins(low), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = sorted_joins(materialize(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), name))
        mark = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == old:
            return sorted_joins(nxt.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionAll(nxt.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
        cur, old = nxt, mark
