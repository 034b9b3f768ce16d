"""Operator 13: runs of periodic words, found by comparing a document's words with themselves at every lag.

A run is a stretch of words that are equal to the words one smallest period before, at least `times` periods
and `least` words long, which no neighbouring word extends. Words are numbered and the numbers compared with
themselves shifted by each lag up to n / times in vector operations; the true stretches that are long enough
are runs. A stretch that a divisor of the lag already gave is the same run: by Fine and Wilf's theorem a
period below the lag of so long a stretch divides it, so equal ends are enough to tell.

The work of a document is n * n / times comparisons, so it is cut into (document, range of lags) units. Texts
that cannot have more than one range are scanned where they are read, many of them in one array; the
units of longer ones are dealt over the cluster by a shuffle, and their runs meet again by the text's digest.

Cases. NULL text: no words, collapsed to the empty text. Empty texts and white space: likewise. NULL
and repeated ids: each row has its own result. Empty table: no rows. Columns of other names are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lags of a unit.
LAGS = 4096
#: Words of short documents that are scanned in one array.
WORDS = 1 << 17
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_ALL = np.uint64(0x0101010101010101)


def coded(words: list[bytes]) -> np.ndarray:
    """The number of each word among the list's words."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)


def scan(codes: np.ndarray, sizes: list[int], first: int, last: int, times: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of the runs at the lags from first to last, in documents laid one after the other.

    Sizes descend, so that the documents with room for a lag come first; no two documents have a number in common.
    """
    ends = np.cumsum(sizes)
    # eight flags read as one number: a stretch of 15 holds eight aligned ones
    flags = np.zeros(len(codes) + 24, bool)[: (len(codes) + 24) // 8 * 8]
    eights = flags.view(np.uint64)
    quick = min(max(least - q, (times - 1) * q) for q in range(1, least + 2)) >= 15
    count, out = len(sizes), []
    for lag in range(first, last + 1):
        while count and sizes[count - 1] < times * lag:
            count -= 1
        if not count:
            break
        n = int(ends[count - 1]) - lag
        np.equal(codes[:n], codes[lag : n + lag], out=flags[8 : 8 + n])
        flags[8 + n : 16 + n] = False
        if quick and not (eights[: 2 + n // 8] == _ALL).any():
            continue
        edges = np.flatnonzero(flags[7 : 8 + n] != flags[8 : 9 + n])
        begin, end = edges[::2], edges[1::2] + lag
        long = end - begin >= max(least, times * lag)
        if long.any():
            out.append((begin[long], end[long], np.full(int(long.sum()), lag)))
    if not out:
        return (np.empty(0, np.int64),) * 3
    begin, end, period = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
    # periods ascend, and unique() gives the first of equals
    _, at = np.unique(begin * (len(codes) + 1) + end, return_index=True)
    return begin[at], end[at], period[at]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stay, joined by a space: all but those that a run (start, length, period) has after its first period."""
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()])


def _result(b: pa.RecordBatch, words: list[list[bytes]], runs: list[list[tuple]]) -> pa.RecordBatch:
    rows = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs]
    kept = [collapse(w, r).decode() for w, r in zip(words, runs, strict=True)]
    return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(rows, _RUN), pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def _split(column: pa.Array) -> list[list[bytes]]:
    return [(x or b"").split() for x in column.cast(pa.binary()).to_pylist()]


def _whole(times: int, least: int):
    """Documents whose lags make one range, scanned in groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = _split(b.column(1))
            runs: list[list[tuple]] = [[] for _ in words]
            order = sorted((i for i, w in enumerate(words) if len(w) >= max(least, times)), key=lambda i: -len(words[i]))
            while order:
                group, size = [], 0
                while order and (not group or size + len(words[order[0]]) <= WORDS):
                    size += len(words[order[0]])
                    group.append(order.pop(0))
                sizes = [len(words[i]) for i in group]
                codes = coded([w for i in group for w in words[i]])
                codes = (codes + np.repeat(np.arange(len(group)), sizes) * (int(codes.max()) + 1)).astype(np.int32 if len(group) * (int(codes.max()) + 1) < 1 << 31 else np.int64)
                starts = np.cumsum(sizes) - sizes
                begin, end, period = scan(codes, sizes, 1, sizes[0] // times, times, least)
                doc = np.searchsorted(starts, begin, "right") - 1
                for d, s, n, q in zip(doc.tolist(), (begin - starts[doc]).tolist(), (end - begin).tolist(), period.tolist(), strict=True):
                    runs[group[d]].append((s, n, q))
            yield _result(b, words, [sorted(r, key=lambda x: (x[0], x[2])) for r in runs])

    return run


def _units(times: int, least: int, lags: int):
    """(key, first, last, codes) of each range of lags of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = text.cast(pa.binary()).as_py().split()
                if len(words) < least:
                    continue
                image = coded(words).astype("<i4").tobytes()
                top = len(words) // times
                for first in range(1, top + 1, lags):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([first], pa.int64()), pa.array([min(first + lags - 1, top)], pa.int64()), pa.array([image], pa.binary())], names=["key", "first", "last", "codes"])

    return run


def _scan_units(times: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, first, last, image in zip(*(c.to_pylist() for c in b.columns), strict=True):
                codes = np.frombuffer(image, "<i4")
                begin, end, period = scan(codes, [len(codes)], first, last, times, least)
                if len(begin):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(begin)), pa.array(begin), pa.array(end - begin), pa.array(period)], names=["key", "start", "length", "period"])

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        listed = [sorted(((x["start"], x["length"], x["period"]) for x in r or ()), key=lambda x: (x[0], x[2])) for r in b.column(2).to_pylist()]
        yield _result(b, _split(b.column(1)), listed)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 3, least: int = 24, lags: int = LAGS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: the runs by start and period, and the text without their repeats."""
    if times < 2 or least < times or lags < 1:
        raise ValueError("runs have two periods or more, and not fewer words than periods")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string"
    # n words take 2 n - 1 bytes at least
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < 2 * times * (lags + 1) - 1
    whole = narrow.where(short).mapInArrow(_whole(times, least), schema)
    long = narrow.where(~short).withColumn("key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\x00"), "text"), 256))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = long.select("key", "text").mapInArrow(_units(times, least, lags), "key string, first long, last long, codes binary").repartition(parts, "key", "first")
    found = units.mapInArrow(_scan_units(times, least), "key string, start long, length long, period long")
    runs = found.groupBy("key", "start", "length").agg(F.min("period").alias("period")).groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    return whole.unionByName(long.join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(_finish, schema))


def planted(doc_id: int, words: list[bytes]) -> list[bytes]:
    """Words from a place on repeat those from there, so many at a time, as the id's crc32 says."""
    g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    unit = words[start : start + period]
    return words[:start] + (unit * -(-(n - start) // period))[: n - start]


def _plant(id_at: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [b" ".join(planted(i, w)).decode() if w else None for i, w in zip(b.column(id_at).to_pylist(), _split(b.column(text_at)), strict=True)]
            columns = b.columns
            columns[text_at] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return run


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose texts of one id in ten, by its crc32, end in a periodic stretch; those come back as words joined by a space.

    Rows without an id stay as they are, and texts without words have none.
    """
    chosen = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))
    made = docs.where(chosen).mapInArrow(_plant(docs.columns.index(id_col), docs.columns.index(text_col)), docs.schema)
    return docs.where(~chosen).unionByName(made)


def greatest(runs: Column) -> Column:
    """The run of the greatest exact length / period; of equals the first by start, then by period. NULL where there is none."""
    longer = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]

    def order(x: Column, y: Column) -> Column:
        d = longer(x, y)
        by_place = F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"]))
        return F.when(d > 0, -1).when(d < 0, 1).otherwise(by_place.cast("int"))

    return F.get(F.array_sort(runs, order), F.lit(0))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    best = found.withColumn("best", greatest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
