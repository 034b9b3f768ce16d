"""Operator 8 over time: an index of repeated substrings that outlives a call, grown batch by batch.

The index is a logarithmic family of levels, each a table in a shared folder: the sparse suffix array of what
some batches added, as rows (key, run) in order, where a run is a stretch of neighbouring strings of `LENGTH`
bytes that share a key (see substrings.py). Equal strings have equal keys, so only runs of one key are compared.

`add` takes a batch of documents:

1. its runs are sorted to a suffix array of its own, equal runs once, with the least id that has them;
2. it is merge-scanned against the levels by key, and runs that meet a run of their key, in a level or in
   the batch itself, are taken apart into strings, which one aggregate compares byte by byte;
3. what no level has yet becomes a new level, and levels of about equal size merge, so there are
   logarithmically many and each run is written again a logarithmic number of times;
4. the list of levels is written last, as a new version in one file. A batch that fails before that has
   changed nothing and can be added again, also by another driver.

Every step is a join or an aggregate by key, run or string with partial sums first; equal runs meet as one row, so
a passage that very many documents share is one row per task. Only the last join, of a batch's places with what
goes, meets a hot run in full; adaptive execution splits it, as its other side has one row per run. Nothing is
collected but the list of levels. Levels take some five times the bytes of the distinct text before compression.

Order. Documents of earlier batches come before those of later ones whatever their ids; within a batch a byte
goes if a string that covers it also starts in a document with a smaller id.

Cases. As for repeated_spans: NULL or empty text, texts shorter than LENGTH: nothing removed. NULL id: nothing
removed, not compared, not in the index. Equal ids are not smaller than each other, each row has a result. Empty batch:
empty result, the index stays. Extra columns are ignored. A batch added twice: the second time all of its strings go.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, materialize
from .substrings import BATCH, LENGTH, RESULT, _batched, _cut, opened, packed, runs

ENTRIES = "batch long, doc int, doc_id long, start long, key long, run binary"
LEVEL = "key long, run binary"
VERSION = "place int, level string, n long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each packed batch of texts, with the document and the place that they have."""
    for b in batches:
        for batch, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids, ends, raw, begins = opened(data.as_py())
            key, place, count = runs(raw, ends)
            doc = np.searchsorted(ends, place, "right")
            whole = raw.tobytes()
            found = pa.array([whole[p : p + c + LENGTH - 1] for p, c in zip(place.tolist(), count.tolist(), strict=True)], pa.binary())
            columns = [pa.array(np.full(len(key), batch), pa.int64()), pa.array(doc.astype(np.int32)), pa.array(ids[doc]), pa.array(place - begins[doc]), pa.array(key.view(np.int64)), found]
            yield pa.RecordBatch.from_arrays(columns, names=["batch", "doc", "doc_id", "start", "key", "run"])


def _packed_spans(group: pd.DataFrame) -> pd.DataFrame:
    """The spans of one packed batch as one value; a batch is a few megabytes or one long document."""
    spans = packed(group["doc"].to_numpy(np.int32), group["start"].to_numpy(np.int64), group["stop"].to_numpy(np.int64))
    return pd.DataFrame({"batch": [group["batch"].iloc[0]], "spans": [spans]})


def _strings(rows: DataFrame, *keep: Column | str) -> DataFrame:
    """One row for each string of a run, with its place in the run."""
    at = F.explode(F.sequence(F.lit(0), F.octet_length("run") - LENGTH)).alias("at")
    out = rows.select(*keep, "run", at)
    return out.withColumn("string", F.substring("run", F.col("at") + 1, F.lit(LENGTH)))


class SubstringIndex:
    """The levels under a folder of the shared file system; opened again, it goes on with the last version written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.levels = self._newest()

    def _newest(self) -> tuple[int, list[tuple[str, int]]]:
        """(version, its levels from the largest to the smallest with their number of runs)."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return 0, []
        seen = self.spark.read.schema(f"{VERSION}, version int").parquet(f"{self.path}/versions")
        last = seen.agg(F.max("version")).first()[0]
        if last is None:
            return 0, []
        return last, [(x.level, x.n) for x in seen.where(F.col("version") == last).orderBy("place").collect()]

    def level(self, name: str) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(f"{self.path}/{name}")

    def _runs(self) -> DataFrame:
        """The runs of all levels."""
        out = self.spark.createDataFrame([], LEVEL)
        for name, _ in self.levels:
            out = out.unionByName(self.level(name))
        return out

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row of a new batch, which then is in the index."""
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        zero, none = F.lit(0).cast("long"), F.array().cast("array<struct<start: bigint, stop: bigint>>")
        without = texts.where("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), none.alias("spans"))
        batches = materialize(texts.where("doc_id IS NOT NULL").mapInArrow(_batched(BATCH), "batch long, data binary"), "batches")
        places = materialize(batches.mapInArrow(_entries, ENTRIES), "places")
        array = materialize(places.groupBy("key", "run").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "array")
        scanned = materialize(self._runs().join(array.select("key").distinct().hint("merge"), "key", "left_semi"), "scanned")
        goes = materialize(self._goes(array, scanned), "goes")

        whole = F.array(F.struct(F.lit(0).alias("start"), F.octet_length("run").alias("stop")))
        cut = F.transform("places", lambda p: F.struct(p.alias("start"), (p + LENGTH).alias("stop")))
        span = F.explode(F.when(F.col("doc_id") > F.col("least"), whole).otherwise(F.coalesce(cut, F.slice(whole, 1, 0)))).alias("span")
        spans = places.join(goes, ["key", "run"]).select("batch", "doc", F.col("start").alias("base"), span)
        spans = spans.select("batch", "doc", (F.col("base") + F.col("span.start")).alias("start"), (F.col("base") + F.col("span.stop")).alias("stop"))
        spans = spans.groupBy("batch").applyInPandas(_packed_spans, "batch long, spans binary")
        found = batches.join(spans.select("batch", F.array("spans").alias("spans")), "batch", "left").select("data", "spans").mapInArrow(_cut, RESULT)
        out = materialize(found.unionByName(without), "repeats")
        self._grow(array.select("key", "run").join(scanned, ["key", "run"], "left_anti"))
        return out

    def _goes(self, array: DataFrame, scanned: DataFrame) -> DataFrame:
        """(key, run, least, places) of the batch's runs of which something goes: places in the copies of the least id."""
        several = array.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        met = several.unionByName(scanned.select("key")).distinct()
        mine = _strings(array.join(met, "key", "left_semi"), "key", "least")
        known = _strings(scanned).select("string", F.lit(True).alias("old"), F.lit(None).cast("long").alias("least"))
        every = known.unionByName(mine.select("string", F.lit(False).alias("old"), "least"))
        first = every.groupBy("string").agg(F.max("old").alias("old"), F.min("least").alias("first"), F.max("least").alias("last")).where("old OR first < last")
        hits = mine.join(first, "string").where("old OR first < least").groupBy("key", "run").agg(F.collect_list("at").alias("places"))
        return array.join(hits, ["key", "run"], "left").where("least < most OR places IS NOT NULL").select("key", "run", "least", "places")

    def _grow(self, new: DataFrame) -> None:
        """Write a new level, merged with those that are not more than twice its size, and then the new version."""
        new = materialize(new, "level")
        n = new.count()
        if not n:
            return
        kept, old = list(self.levels), []
        while kept and kept[-1][1] <= 2 * n:
            name, size = kept.pop()
            n += size
            old.append(name)
        for name in old:
            new = new.unionByName(self.level(name))
        name = f"level-{uuid.uuid4().hex}"
        new.dropDuplicates(["key", "run"]).sortWithinPartitions("key", "run").write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        kept.append((name, self.level(name).count()))
        self._commit(kept)
        for gone in old:
            drop_path(self.spark, f"{self.path}/{gone}")

    def _commit(self, levels: list[tuple[str, int]]) -> None:
        rows = [(i, name, n) for i, (name, n) in enumerate(levels)]
        self.spark.createDataFrame(rows, VERSION).coalesce(1).write.parquet(f"{self.path}/versions/version={self.version + 1}")
        self.version, self.levels = self.version + 1, levels
