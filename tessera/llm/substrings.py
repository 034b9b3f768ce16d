"""Operator 8: exact repeated substrings, found by a logarithmic family of sparse suffix arrays.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document with a smaller id.
Documents are packed into batches. Each string of that length has a key, the least hash of its grams of
`GRAM` bytes; neighbouring strings share a key, so a batch is a list of runs, about one for every
fifteen bytes, and equal strings have equal keys wherever they stand.

1. Equal documents are settled by their digest; one of each is packed.
2. The keys of each batch, sorted and Elias-Fano encoded, are dealt by ranges; keys of one document only
   are dropped, and a bit for each of a batch's keys goes back.
3. The runs that are left are dealt by key with their bytes, equal runs of a batch as one. All copies of
   a run but those of its smallest document go at once. Where a key has several runs, the strings in
   them enter the index in ascending order of documents: each new batch of strings is sorted to a
   suffix array, merge-scanned against the existing levels, and what is new becomes a level; levels of
   about equal size merge, so there are logarithmically many. Strings are compared byte by byte.
4. The spans found go back to the batches, where they are cut out.

No bytes are compared between documents of different keys, no list grows with the square of a group, and
every exchange is dealt by ranges of hashes, so a passage that many documents share spreads over tasks.

Cases. NULL or empty text: no bytes, nothing removed. Shorter than LENGTH bytes: nothing removed. NULL
id: neither smaller nor larger than any other, so nothing is removed and nothing is compared with it.
Repeated rows: equal ids are not smaller, both stay. An id with several texts: each row has a result.
Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialize
from .tokens import EliasFano

LENGTH, GRAM = 50, 24
#: Grams in a string.
WIDTH = LENGTH - GRAM + 1
#: Least bytes of a batch, and bytes that are hashed at a time.
BATCH, PIECE = 2 << 20, 1 << 19
#: Bytes of rows that Spark hands to a Python worker at a time.
HANDED = "8m"
#: Least bytes of input for each range of keys.
RANGE = 16 << 20
#: Bits of a key that are compared in step 2; more keys than documents have them by chance only.
KEY_BITS = 44
#: Strings that enter the index at a time.
STRINGS = 1 << 15
#: Most ids of repeated documents that are sent to every executor.
IDS = 500_000
_random = np.random.default_rng(20)
BYTES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = _random.integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place: spans double, and the spans of GRAM's bits are joined."""
    span, size = BYTES[data], 1
    out, done = None, 0
    for bit in range(GRAM.bit_length()):
        if GRAM >> bit & 1:
            if out is None:
                out = span
            else:
                n = len(data) - done - size + 1
                out = out[:n] * ODD[7] + span[done : done + n]
            done += size
        if GRAM >> (bit + 1):
            n = len(span) - size
            span = span[:n] * ODD[bit] + span[size : size + n]
            size *= 2
    out = (out ^ (out >> np.uint64(29))) * ODD[6]
    return out ^ (out >> np.uint64(32))


def keys(data: np.ndarray) -> np.ndarray:
    """The key of the string from each place: a sliding minimum, by spans that double."""
    x, size = grams(data), 1
    while size * 2 <= WIDTH:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == WIDTH else np.minimum(x[: len(x) - (WIDTH - size)], x[WIDTH - size :])


def spread(k: np.ndarray) -> np.ndarray:
    """Keys as evenly spread values: minima crowd at the low end, and ranges of keys are to be of like size."""
    k = (k ^ (k >> np.uint64(31))) * ODD[5]
    return k ^ (k >> np.uint64(30))


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, number of strings) of each run in documents that end at `ends`; no run leaves its document."""
    out: list[tuple[np.ndarray, ...]] = []
    begin, at = 0, 0
    while at < len(ends):
        # whole documents up to PIECE bytes, or a piece of a longer one
        stop = max(int(np.searchsorted(ends, begin + PIECE, "right")), at + 1)
        last = int(ends[stop - 1])
        for low in range(begin, last, PIECE):
            high = min(last, low + PIECE + LENGTH - 1)
            if high - low < LENGTH:
                continue
            k = keys(data[low:high])
            new = np.empty(len(k), bool)
            new[0] = True
            np.not_equal(k[1:], k[:-1], out=new[1:])
            edges = ends[at:stop] - low
            bad = np.zeros(len(k) + 1, np.int32)  # strings that would cross the end of a document
            cuts = edges[(edges > 0) & (edges < high - low)]
            np.add.at(bad, np.clip(cuts - LENGTH + 1, 0, len(k)), 1)
            np.add.at(bad, np.clip(cuts, 0, len(k)), -1)
            bad = np.cumsum(bad[:-1]) > 0
            new[cuts[cuts < len(k)]] = True
            new[1:] |= bad[1:] != bad[:-1]
            place = np.flatnonzero(new)
            count = np.diff(np.append(place, len(k)))
            good = ~bad[place]
            out.append((spread(k[place[good]]), place[good] + low, count[good]))
            if high == last:
                break
        begin, at = last, stop
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(arrays), *[len(x.tobytes()) for x in arrays]], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(x.tobytes() for x in arrays))


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def sizes(total: int) -> tuple[int, int]:
    """(bytes of a batch, number of ranges) for so many bytes of input.

    A batch sends a slice to each range. From about 30 GB on both grow with the root of the input, so
    that slices keep their length and their number grows in proportion to the input.
    """
    root = math.isqrt(total)
    return max(BATCH, 6 * root), max(16, math.ceil(total / max(RANGE, 100 * root)))


def _batched(most: int):
    return lambda batches: _in_batches(batches, most)


def _in_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base, made = TaskContext.get().partitionId() << 32, 0
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0

    def batch() -> pa.RecordBatch:
        lengths = np.array([len(x) for x in texts], np.int64)
        data = packed(np.array(ids, np.int64), lengths, np.frombuffer(b"".join(texts), np.uint8))
        return pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([data], pa.binary())], names=["batch", "data"])

    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            ids.append(key)
            texts.append(raw)
            size += len(raw)
            if size >= most:
                yield batch()
                made, size = made + 1, 0
                ids.clear(), texts.clear()
    if ids:
        yield batch()


def opened(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ends, bytes, runs' documents' starts) of a batch."""
    ids, lengths, raw = unpacked(data, "<i8", "<i8", "u1")
    ends = np.cumsum(lengths)
    return ids, ends, raw, ends - lengths


def short(k: np.ndarray) -> np.ndarray:
    return k >> np.uint64(64 - KEY_BITS)


def range_of(k: np.ndarray, n: int) -> np.ndarray:
    """The range of each short key, of n ranges of equal width; ascending with the key."""
    return ((k * np.uint64(n)) >> np.uint64(KEY_BITS)).astype(np.int64)


def batch_keys(k: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The batch's distinct short keys in order, and whether several of its documents have them."""
    order = np.lexsort((doc, k))
    k, doc = k[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    last = np.append(first[1:], len(k)) - 1
    return k[first], doc[first] != doc[last]


def _keyed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _, ends, raw, _ = opened(data.as_py())
                k, place, _ = runs(raw, ends)
                some, several = batch_keys(short(k), np.searchsorted(ends, place, "right"))
                cuts = np.searchsorted(range_of(some, n), np.arange(n + 1))
                at, sent, flags = [], [], []
                for r in range(n):
                    x, y = int(cuts[r]), int(cuts[r + 1])
                    if x < y:
                        base = (r << KEY_BITS) // n
                        at.append(r)
                        sent.append(EliasFano.of((some[x:y] - np.uint64(base)).astype(np.int64)).pack())
                        flags.append(np.packbits(several[x:y]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([batch] * len(at), pa.int64()), pa.array(sent, pa.binary()), pa.array(flags, pa.binary())], names=["range", "batch", "keys", "several"])

    return run


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(first value, its rows) of batches whose rows come sorted by their first column."""
    key, rows = None, []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if row[0] != key and rows:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch and range a bit per key: whether another document has it."""
    for r, rows in grouped(batches):
        each = [EliasFano.unpack(memoryview(x[2]))[0].all() for x in rows]
        several = [np.unpackbits(np.frombuffer(x[3], np.uint8))[: len(k)].astype(bool) for x, k in zip(rows, each, strict=True)]
        flat = np.concatenate(each)
        order = np.argsort(flat, kind="stable")
        k = flat[order]
        same = k[1:] == k[:-1]
        more = np.zeros(len(flat), bool)
        more[order[1:]] |= same
        more[order[:-1]] |= same
        more |= np.concatenate(several)
        cuts = np.cumsum([0, *map(len, each)]).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in rows], pa.int64()), pa.array([r] * len(rows), pa.int32()), pa.array([np.packbits(more[x:y]).tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["batch", "range", "bits"])


def _run_bytes(n: int):
    """(range, batch, runs): for each range the batch's shared runs, equal ones once, with all places they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, data, bits in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                ids, ends, raw, begins = opened(data.as_py())
                k, place, count = runs(raw, ends)
                s = short(k)
                doc = np.searchsorted(ends, place, "right")
                some, _ = batch_keys(s, doc)
                where = range_of(some, n)
                shared = np.zeros(len(some), bool)
                for r, x in ((x["range"], x["bits"]) for x in bits):
                    low, high = np.searchsorted(where, (r, r + 1))
                    shared[low:high] = np.unpackbits(np.frombuffer(x, np.uint8))[: high - low]
                kept = np.flatnonzero(shared[np.searchsorted(some, s)])
                whole = raw.tobytes()
                found: dict[int, dict[tuple[int, bytes], list[int]]] = {}
                for r, key, p, c, d in zip(range_of(s[kept], n).tolist(), k[kept].tolist(), place[kept].tolist(), count[kept].tolist(), doc[kept].tolist(), strict=True):
                    found.setdefault(r, {}).setdefault((key, whole[p : p + c + LENGTH - 1]), []).extend((d, p))
                at, sent = [], []
                for r, entries in found.items():
                    places = [np.array(x, np.int64) for x in entries.values()]
                    flat = np.concatenate(places)
                    at.append(r)
                    sent.append(packed(np.array([x for x, _ in entries], np.uint64), np.array([len(x) for _, x in entries], np.int64), np.array([len(x) // 2 for x in places], np.int64), ids[flat[::2]], flat[::2].astype(np.int32), flat[1::2] - begins[flat[::2]], np.frombuffer(b"".join(x for _, x in entries), np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([batch] * len(at), pa.int64()), pa.array(sent, pa.binary())], names=["range", "batch", "runs"])

    return run


class Levels:
    """Sorted arrays of strings of geometrically growing sizes; what an array holds came from smaller documents than what is scanned later."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def scan(self, strings: np.ndarray) -> np.ndarray:
        """Which of the sorted strings a level holds."""
        found = np.zeros(len(strings), bool)
        for level in self.levels:
            at = np.searchsorted(level, strings)
            at[at == len(level)] = 0
            found |= level[at] == strings
        return found

    def add(self, strings: np.ndarray) -> None:
        """A new level of sorted strings; equal-sized levels merge."""
        while self.levels and len(self.levels[-1]) <= 2 * len(strings):
            strings = np.sort(np.concatenate((self.levels.pop(), strings)), kind="stable")
        if len(strings):
            self.levels.append(strings)


def known_strings(documents: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs in ascending order of their documents: (run, place in it) of the strings that a smaller document's run has."""
    index = Levels()
    ends = np.cumsum(lengths)
    counts = lengths - LENGTH + 1
    out: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    total = np.cumsum(counts)
    while at < len(documents):
        # whole documents, about STRINGS strings
        stop = int(np.searchsorted(total, (total[at - 1] if at else 0) + STRINGS, "right"))
        stop = int(np.searchsorted(documents, documents[min(max(stop, at + 1), len(documents)) - 1], "right"))
        base = int(ends[at] - lengths[at])
        some = data[base : int(ends[stop - 1])]
        run = np.repeat(np.arange(at, stop), counts[at:stop])
        place = np.arange(len(run)) - np.repeat(np.cumsum(counts[at:stop]) - counts[at:stop], counts[at:stop])
        start = (ends - lengths)[run] - base + place
        strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(some, LENGTH)[start]).view(f"S{LENGTH}").ravel()
        order = np.argsort(strings, kind="stable")  # equal strings stay in the order of their documents
        s, r = strings[order], run[order]
        first = np.concatenate(([True], s[1:] != s[:-1]))
        head = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        hit = documents[r] > documents[r[head]]
        heads = np.flatnonzero(first)
        old = index.scan(s[heads])
        hit |= old[np.cumsum(first) - 1]
        index.add(s[heads][~old])
        out.append((r[hit], place[order][hit]))
        at = stop
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, spans) for each range: (document in the batch, start, stop) of what goes."""
    for _, rows in grouped(batches):
        parts = [unpacked(x[2], "<u8", "<i8", "<i8", "<i8", "<i4", "<i8", "u1") for x in rows]
        key, length, often, ids, doc, start, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        source = np.repeat(np.arange(len(rows)), [int(p[2].sum()) for p in parts])  # of each occurrence
        raw = data.tobytes()
        ends = np.cumsum(length)
        names: dict[bytes, int] = {}
        same = np.fromiter((names.setdefault(raw[e - n : e], len(names)) for e, n in zip(ends.tolist(), length.tolist(), strict=True)), np.int64, len(length))
        run = np.repeat(same, often)  # the distinct run of each occurrence
        size = np.repeat(length, often)
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, run, ids)
        gone = ids > least[run]
        spans = [(source[gone], doc[gone], start[gone], (start + size)[gone])]
        # keys with several distinct runs
        sample = np.zeros(len(names), np.int64)
        sample[same] = np.arange(len(same))
        k = key[sample]
        order = np.lexsort((least, k))
        alike = np.zeros(len(k), bool)
        equal = k[order][1:] == k[order][:-1]
        alike[order[1:]] |= equal
        alike[order[:-1]] |= equal
        some = np.flatnonzero(alike)
        if len(some):
            some = some[np.argsort(least[some], kind="stable")]
            picked = sample[some]
            texts = np.frombuffer(b"".join(raw[int(ends[i] - length[i]) : int(ends[i])] for i in picked), np.uint8)
            which, place = known_strings(least[some], length[picked], texts)
            if len(which):
                # neighbouring strings of a run as one span
                o = np.lexsort((place, which))
                which, place = which[o], place[o]
                new = np.concatenate(([True], (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1)))
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(new)) - 1
                pieces = [some[which[begin]], place[begin], place[last] + LENGTH]
                # each goes in all occurrences of the run's smallest document
                low = np.flatnonzero(~gone)
                low = low[np.argsort(run[low], kind="stable")]
                a, b = np.searchsorted(run[low], pieces[0], "left"), np.searchsorted(run[low], pieces[0], "right")
                n = b - a
                each = low[np.repeat(a, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
                spans.append((source[each], doc[each], start[each] + np.repeat(pieces[1], n), start[each] + np.repeat(pieces[2], n)))
        source, doc, start, stop = (np.concatenate(x) for x in zip(*spans, strict=True))
        found = []
        for i, row in enumerate(rows):
            mine = source == i
            if mine.any():
                found.append((row[1], packed(doc[mine].astype(np.int32), start[mine], stop[mine])))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], names=["batch", "spans"])


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans: overlapping and touching ones of a document joined, in order."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    wide = np.int64(stop.max()) + 1
    reach = np.maximum.accumulate(stop + doc * wide)
    new = np.concatenate(([True], start[1:] + doc[1:] * wide > reach[:-1]))
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(new)) - 1
    return doc[begin], start[begin], reach[last] - doc[begin] * wide


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's spans and what is kept of it."""
    for b in batches:
        for data, lists in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            ids, ends, raw, begins = opened(data.as_py())
            parts = [unpacked(x, "<i4", "<i8", "<i8") for x in lists or ()]
            doc, start, stop = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3
            doc, start, stop = merged(doc, start, stop)
            first, last = np.searchsorted(doc, np.arange(len(ids)), "left"), np.searchsorted(doc, np.arange(len(ids)), "right")
            whole = raw.tobytes()
            rows = []
            for i, (x, y) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
                f, t = int(first[i]), int(last[i])
                digest, gone, at = hashlib.sha256(), 0, x
                for u, v in zip((start[f:t] + x).tolist(), (stop[f:t] + x).tolist(), strict=True):
                    digest.update(whole[at:u])
                    gone, at = gone + v - u, v
                digest.update(whole[at:y])
                rows.append((y - x, gone, t - f, digest.hexdigest(), [{"start": int(u), "stop": int(v)} for u, v in zip(start[f:t], stop[f:t], strict=True)]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(x, pa.int64()) for x in columns[:3]], pa.array(columns[3], pa.string()), pa.array(columns[4], span)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: bigint, stop: bigint>>"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of each row; spans are byte ranges that go."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", HANDED)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = materialize(texts.select("doc_id", F.md5("text").alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.octet_length("text") < LENGTH, F.sha2("text", 256)).alias("sha")), "texts")
    firsts = rows.where(f"doc_id IS NOT NULL AND n_bytes >= {LENGTH}").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("often")).where("often > 1")
    later = materialize(rows.where(f"doc_id IS NOT NULL AND n_bytes >= {LENGTH}").join(firsts, "digest").where("doc_id > first").select("doc_id", "digest", "n_bytes"), "later")
    nothing = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    empty = F.lit(hashlib.sha256().hexdigest())
    whole = later.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), empty.alias("kept_sha256"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))).alias("spans"))
    zero = F.lit(0).cast("long")
    small = rows.where(f"doc_id IS NOT NULL AND n_bytes < {LENGTH}").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), nothing.alias("spans"))
    without = texts.where("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), nothing.alias("spans"))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    most, n = sizes(total)

    long = texts.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    copies = later.select("doc_id", "digest").distinct()
    unique = join_small(long.withColumn("digest", F.md5("text")), copies, ["doc_id", "digest"], "left_anti", IDS).select("doc_id", "text")
    batches = materialize(unique.mapInArrow(_batched(most), "batch long, data binary"), "batches")
    sent = batches.mapInArrow(_keyed(n), "range int, batch long, keys binary, several binary")
    bits = sent.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(_shared, "batch long, range int, bits binary")
    bits = materialize(bits, "bits").groupBy("batch").agg(F.collect_list(F.struct("range", "bits")).alias("bits"))  # at most n of them
    runs_sent = batches.join(bits, "batch").select("batch", "data", "bits").mapInArrow(_run_bytes(n), "range int, batch long, runs binary")
    spans = runs_sent.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(_spans, "batch long, spans binary")
    spans = materialize(spans, "spans").groupBy("batch").agg(F.collect_list("spans").alias("spans"))
    cut = batches.join(spans, "batch", "left").select("data", "spans").mapInArrow(_cut, RESULT)
    return cut.unionByName(whole).unionByName(small).unionByName(without)


def op8_repeated_substrings(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
