"""Operator 10: token counts of documents by a separator scan.

Token files are flat: ids and end-of-document ids, cut into blocks at any place, with no index. Each
block is searched for the end id by one vectorised comparison. What a block knows by itself (its number
of ids, its separators' places) is stitched to the blocks before it by prefix scans: running sums give
the place of each block and the number of documents before it, and a running maximum the last separator
before it, so a document may span any number of blocks and files. Scans run within a file first; only
one row per file meets in a window over all files.

Cases. NULL or empty text: a document of no tokens. Ids after the last separator: a last row that is not
closed. Repeated rows: each is a document. Empty table or files: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path
from .encoder import END_OF_TEXT, encoder, with_ends

#: Ids per block.
BLOCK_IDS = 1 << 17


def _flat(vocabulary: str | None, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, made = TaskContext.get().partitionId(), 0
        enc = encoder(vocabulary, True)
        parts: list[np.ndarray] = []
        keys: list = []
        size = 0

        def block(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            columns = [pa.array([file], pa.int32()), pa.array([made], pa.int32()), pa.array([ids.dtype.itemsize], pa.int32()), pa.array([end_id], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([list(keys)], pa.list_(pa.int64()))]
            made += 1
            keys.clear()
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "width", "end_id", "ids", "manifest"])

        for b in batches:
            listed = b.column(0).to_pylist()
            for at, ids, counts in enc.encode_column(b.column(1)):
                parts.append(with_ends(ids, counts, end_id))
                keys.extend(listed[at : at + len(counts)])
                size += len(parts[-1])
                if size >= block_ids:
                    flat = np.concatenate(parts)
                    whole = size - size % block_ids
                    for x in range(0, whole, block_ids):
                        yield block(flat[x : x + block_ids])
                    parts, size = [flat[whole:]], size - whole
        if size or keys:
            yield block(np.concatenate(parts))

    return run


def write_flat(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_OF_TEXT, block_ids: int = BLOCK_IDS) -> None:
    """Write flat token files: a file per partition, documents in the order of the input.

    Beside the ids, a block has the bytes of an id and the end id, and a manifest: the document ids in the
    order of the files, without places. Scans don't read the manifest.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = narrow.mapInArrow(_flat(vocabulary, end_id, block_ids), "file int, block int, width int, end_id long, ids binary, manifest array<bigint>")
    rows.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, found = [], []
        for width, end_id, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
            ids = np.frombuffer(x.as_buffer() if hasattr(x, "as_buffer") else x.as_py(), f"<u{width}")
            sizes.append(len(ids))
            found.append(np.flatnonzero(ids == end_id))
        places = pa.array(found, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), places], names=["file", "block", "n_ids", "ends"])


def scan(blocks: DataFrame, end_id: int | None = None, width: int | None = None) -> DataFrame:
    """(ordinal, start, n_tokens, closed) of each document in blocks (file, block, ids), the end ids not counted.

    The end id and an id's bytes are read from the blocks' columns `end_id` and `width` where they are not given.
    """
    bytes_of_id = F.col("width") if width is None else F.lit(width)
    separator = F.col("end_id") if end_id is None else F.lit(end_id)
    each = blocks.select("file", "block", bytes_of_id.cast("int").alias("width"), separator.cast("long").alias("end_id"), "ids").mapInArrow(_searched, "file int, block int, n_ids long, ends array<bigint>")
    each = each.withColumn("n_ends", F.size("ends").cast("long")).withColumn("last", F.when(F.col("n_ends") > 0, F.element_at("ends", -1)))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    each = each.withColumn("at", F.coalesce(F.sum("n_ids").over(before), zero)).withColumn("docs", F.coalesce(F.sum("n_ends").over(before), zero))
    each = each.withColumn("open", F.max(F.col("at") + F.col("last")).over(before))
    over = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = each.groupBy("file").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_ends").alias("n_ends"), F.max(F.col("at") + F.col("last")).alias("last"))
    files = files.withColumn("file_at", F.coalesce(F.sum("n_ids").over(over), zero)).withColumn("file_docs", F.coalesce(F.sum("n_ends").over(over), zero))
    files = files.withColumn("file_open", F.coalesce(F.max(F.col("file_at") + F.col("last")).over(over), F.lit(-1).cast("long")))
    found = each.join(files.select("file", "file_at", "file_docs", "file_open"), "file").where("n_ends > 0")
    base = F.col("file_at") + F.col("at")
    found = found.withColumn("prior", F.coalesce(F.col("file_at") + F.col("open"), F.col("file_open"))).select("*", F.posexplode("ends").alias("j", "end"))
    start = F.when(F.col("j") == 0, F.col("prior") + 1).otherwise(base + F.get("ends", F.col("j") - 1) + 1)
    closed = found.select((F.col("file_docs") + F.col("docs") + F.col("j")).alias("ordinal"), start.alias("start"), (base + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = files.agg(F.sum("n_ids").alias("n"), F.sum("n_ends").alias("docs"), F.coalesce(F.max(F.col("file_at") + F.col("last")), F.lit(-1).cast("long")).alias("last"))
    tail = whole.where("n - last > 1").select(F.col("docs").alias("ordinal"), (F.col("last") + 1).alias("start"), (F.col("n") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail)


def manifest(blocks: DataFrame) -> DataFrame:
    """(ordinal, doc_id) of each document, by the order of the files."""
    each = blocks.select("file", "block", "manifest").withColumn("n", F.size("manifest").cast("long"))
    zero = F.lit(0).cast("long")
    each = each.withColumn("docs", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), zero))
    files = each.groupBy("file").agg(F.sum("n").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("file_docs"))
    rows = each.join(files, "file").select("file_docs", "docs", F.posexplode("manifest").alias("j", "doc_id"))
    return rows.select((F.col("file_docs") + F.col("docs") + F.col("j")).alias("ordinal"), "doc_id")


def count_tokens(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, start, n_tokens) of each document, counted in flat files written to the shared folder."""
    spark: SparkSession = docs.sparkSession
    path = new_path(spark, "flat")
    write_flat(docs, path, **options)
    blocks = spark.read.parquet(path)
    return manifest(blocks).join(scan(blocks).where("closed"), "ordinal").select("doc_id", "start", "n_tokens")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
