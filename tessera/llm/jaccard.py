"""Operator 3: n-gram Jaccard join by universe partitioning, and the components of its links.

A document's set is its distinct shingles of five words. Two sets of similarity t = 0.8 or more differ in
size by a factor 1 / t at most, and if r is the smaller one they differ in at most H = |r| / 4 shingles.
Sets are put in bands by size. A band partitions the universe of shingles into m segments by their hash,
m chosen so that r meets more than H of them; by the pigeonhole principle a set linked to r equals it in
one of these at least. Segments that a set doesn't meet are never indexed. Each set is indexed in its
own band, and in the band below where its size lets it link to sets of that band.

The allocation of the search is by cost. A set that meets c segments needs H + 1 of them, so it leaves
out the c - H - 1 whose signatures are the most frequent. More segments give a set more signatures to
shuffle, but more frequent ones to leave out, which saves far more rows than it costs; so m is chosen six
deviations above what a set needs. A set that meets too few all the same searches as many segments as it
lacks by their one-deletion neighbourhoods, and all sets of its band index theirs for these segments. The
smallest sets are partitioned into single shingles.

Copies and groups. Equal sets are one class, collapsed within each task before anything is shuffled. Each
class is first compared to one class of its buckets only (the smallest id, by most shared signatures);
verified links contract the classes to components, and only pairs between different components are
looked at after that, so that a large group of near copies costs a comparison for each member rather
than each pair. Classes that share a good part of their signatures with a bucket's head are in one hub,
and a hub's members are searched in blocks that put out only what a tight bound leaves; all others by the signatures they share. No pair that could
link two components is left out. Candidates are verified on the whole sets, by 64-bit hashes of the
shingles; among n shingles two are mistaken for one another with a probability of n * n / 2 ** 65 at most.

Cases. NULL or empty text, or one without words: no shingles, linked with nothing, its own component.
Fewer than five words: one shingle of all words. NULL id: in no component. Repeated rows: each has a
result; an id with several texts is linked with all that either text links with. Empty table: empty
result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relations import ordinal
from .common import components, free_name, join_small, release, sorted_joins
from .common import materialize as written

WORDS_PER_SHINGLE = 5
#: Least similarity, in per cent; the bounds below hold for it.
LEAST = 80
#: Sets up to this size are partitioned into single shingles; above it each band is half as large again.
SMALL = 32
GROWTH = 1.5
#: Deviations by which the expected number of segments that a set meets is above what it needs.
MARGIN = 6.0
#: Digests kept per task.
MEMO = 200_000
#: Bytes of texts whose shingles are made at a time; a longer text by itself.
TEXTS = 1 << 22
#: Most sets compared to one in a row, and most ids that are sent to every executor.
RUN, IDS = 300, 500_000
#: Members and bytes of bins in a hub's run, and the share of its signatures, in per cent, that puts a class into the hub of a bucket's head.
BLOCK, RUN_BYTES, HUB = 4000, 4 << 20, 5
ODD = np.uint64(0x9E3779B97F4A7C15)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Tables here have a row for each class, signature or pair: only join_small() sends one to every executor."""
    return sorted_joins(written(df, name))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits: products with odd constants and shifted differences."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def salted(s: np.ndarray, number: int) -> np.ndarray:
    """The shingles' hashes, other ones for each band."""
    return mixed(s + np.uint64((number + 1) * int(ODD) % (1 << 64)))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20  # A to Z only


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted hashes of each whole text's distinct shingles; none for NULL and the empty text.

    Words are cut and numbered by their bytes in vector operations, and distinct ones hashed once for
    each few MB of texts.
    """
    column = pc.fill_null(column, "").cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TEXTS, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[stop])
        data = np.frombuffer(column.buffers()[2], np.uint8, high - low, low) if high > low else np.empty(0, np.uint8)
        yield from _shingles_of(data, offsets[at : stop + 1] - low)
        at = stop


def _shingles_of(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The sets of texts that begin and end at `bounds` in their bytes."""
    black = ~_SPACE[data]
    begin = black.copy()
    begin[1:] &= ~black[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    begin[inner] = black[inner]
    places = np.flatnonzero(begin)
    of_text = np.searchsorted(places, bounds)  # the first word of each text
    letters = _LOWER[data[black]]
    upto = np.cumsum(black)
    starts = np.append(upto[places] - 1, len(letters)).astype(np.int32)
    if len(places):
        coded = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(starts), pa.py_buffer(letters)]).dictionary_encode()
        distinct = np.fromiter((xxhash.xxh3_64_intdigest(w.as_py()) for w in coded.dictionary), np.uint64, len(coded.dictionary))
        h = distinct[coded.indices.to_numpy(zero_copy_only=False)]
    else:
        h = np.empty(0, np.uint64)
    k = WORDS_PER_SHINGLE
    whole = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        whole = mixed(whole * ODD + h[j : len(h) - k + 1 + j]) if len(whole) else whole
    for x, y in zip(of_text.tolist(), of_text[1:].tolist(), strict=False):
        if y - x >= k:
            yield np.unique(whole[x : y - k + 1])
        elif y > x:
            one = np.full(1, y - x, np.uint64)
            for j in range(x, y):
                one = mixed(one * ODD + h[j : j + 1])
            yield one
        else:
            yield np.empty(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The set of one text."""
    return next(shingle_sets(pa.array([text], pa.string())))


@lru_cache(maxsize=None)
def band(n: int) -> tuple[int, int, int]:
    """(number, smallest, largest size) of the band of sets of n shingles."""
    number, low, high = 0, 1, SMALL
    while n > high:
        number, low, high = number + 1, high + 1, int(high * GROWTH)
    return number, low, high


def _highs() -> list[int]:
    out = [SMALL]
    while out[-1] < 1 << 30:
        out.append(int(out[-1] * GROWTH))
    return out


#: The largest size of each band.
HIGHS = _highs()


@lru_cache(maxsize=None)
def segments_of(high: int) -> int:
    """The fewest segments that let a set of the band's largest size meet enough of them."""
    if high <= SMALL:
        return 0
    m = high // 4 + 1
    while True:
        rate = high / m
        met = m * (1 - (1 - 1 / m) ** high)
        if met - MARGIN * math.sqrt(m * math.exp(-rate) * (1 - (1 + rate) * math.exp(-rate))) >= high // 4 + 1:
            return m
        m += max(1, m // 50)


def segment_starts(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment numbers, first places) of the segments that a sorted set meets; segments are ranges of hashes."""
    seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    starts = np.concatenate(([0], np.flatnonzero(seg[1:] != seg[:-1]) + 1))
    return seg[starts], starts


def signatures(s: np.ndarray, number: int, high: int) -> np.ndarray:
    """A signature for each segment that a set meets under a band's partition."""
    f = salted(s, number)
    if not (m := segments_of(high)):
        return f.view(np.int64)
    _, starts = segment_starts(s, m)
    return mixed(np.add.reduceat(f, starts)).view(np.int64)


def neighbourhood(s: np.ndarray, number: int, high: int, chosen: frozenset[int]) -> np.ndarray:
    """The signatures of the chosen segments with one shingle left out."""
    f = salted(s, number)
    seg, starts = segment_starts(s, segments_of(high))
    out = []
    for g, a, b in zip(seg.tolist(), starts.tolist(), [*starts[1:].tolist(), len(s)], strict=True):
        if g in chosen and b - a > 1:
            out.append(mixed(f[a:b].sum() - f[a:b]))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def places(n: int) -> list[tuple[int, int, bool]]:
    """(band, largest size, own) of the bands that a set of n shingles is indexed in."""
    number, low, high = band(n)
    out = [(number, high, True)]
    if number and 4 * n <= 5 * (low - 1):
        below = band(low - 1)
        out.append((below[0], below[2], False))
    return out


def listed_arrays(arrays: list) -> pa.Array:
    """A column of lists of whole numbers."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([np.asarray(x, np.int64) for x in arrays]) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, digest, own, low, chosen): the signatures only once per digest and task, on a row that has an id."""
    seen: set[bytes] = set()
    nothing = np.empty(0, np.int64)
    for b in batches:
        rows: list[list] = [[] for _ in range(5)]
        for listed, s in zip(b.column(0).is_valid().to_pylist(), shingle_sets(b.column(1)), strict=True):
            own = low = nothing
            chosen: list[int] = []
            digest = hashlib.md5(s).digest() if len(s) else None
            if digest and listed and digest not in seen:
                seen.add(digest)
                for number, high, mine in places(len(s)):
                    sigs = signatures(s, number, high)
                    if not mine:
                        low = sigs
                        continue
                    own = sigs
                    if (lack := len(s) // 4 + 1 - len(sigs)) > 0 and segments_of(high):
                        chosen = segment_starts(s, segments_of(high))[0][:lack].astype(np.int64).tolist()
            for column, x in zip(rows, (len(s), digest, own, low, chosen), strict=True):
                column.append(x)
            if len(seen) > MEMO:
                seen.clear()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), *[listed_arrays(x) for x in rows[2:]]], names=["doc_id", "n", "digest", "own", "low", "chosen"])


def _neighbours(chosen: dict[int, frozenset[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, own, sigs = [], [], []
            for key, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1)), strict=True):
                for number, high, mine in places(len(s)) if len(s) else ():
                    if number in chosen:
                        found = neighbourhood(s, number, high, chosen[number]).tolist()
                        ids += [key] * len(found)
                        own += [mine] * len(found)
                        sigs += found
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(ids, pa.int64()), pa.array(own, pa.bool_())], names=["sig", "id", "own"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1))], pa.binary())], names=["id", "elements"])


def similar(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity in per cent; what reaches LEAST is decided on whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return float(LEAST) if 100 * both == LEAST * either else 100 * both / either


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, per cent). Rows come sorted by (a, run, member): first a's own set, then those to compare with it."""
    key, mine = None, np.empty(0, np.uint64)
    for b in batches:
        out: list[tuple[int, int, float]] = []
        for a, run, other, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            s = np.frombuffer(data.as_py(), np.uint64)
            if other is None:
                key, mine = (a, run), s
            elif key == (a, run):
                out.append((a, other, similar(mine, s)))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "percent"])


def bins_of(n: int) -> int:
    """Bins for the sets of a hub whose largest has n shingles: a power of two above n."""
    return 1 << max(6, n.bit_length())


def binned(s: np.ndarray, bins: int) -> bytes:
    """The number of a set's shingles in each bin, in a byte each; larger numbers count as 255."""
    return np.minimum(np.bincount((s % np.uint64(bins)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def _binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [binned(s, bins_of(n)) for n, s in zip(b.column(1).to_pylist(), shingle_sets(b.column(2)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["id", "top", "bins"])


class Run:
    """Members of a hub's run: ids, components, sizes, and their bins in one array that grows by doubling."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.components: list[int] = []
        self.sizes: list[int] = []
        self.bins = np.empty((0, 0), np.uint8)

    def add(self, member: int, component: int, n: int, bins: np.ndarray) -> None:
        k = len(self.ids)
        if k == len(self.bins):
            wider = np.empty((max(16, 2 * k), len(bins)), np.uint8)
            if k:
                wider[:k] = self.bins
            self.bins = wider
        self.bins[k] = bins
        self.ids.append(member)
        self.components.append(component)
        self.sizes.append(n)


#: Bytes of differences of bins that are taken at a time.
AT_ONCE = 1 << 22


def close_pairs(left: Run, right: Run | None) -> list[tuple[int, int]]:
    """Pairs of different components between two runs, or within one, that may be linked.

    The bins' differences bound the difference of two sets from below, tightly, as most bins have one
    shingle or none; a pair beyond the largest difference of linked sets is none.
    """
    other = left if right is None else right
    ids, component, size = np.array(other.ids), np.array(other.components), np.array(other.sizes)
    step = max(1, AT_ONCE // max(1, other.bins.shape[1]))
    out = []
    for i, (key, group, n) in enumerate(zip(left.ids, left.components, left.sizes, strict=True)):
        # sizes first: they bound the difference as well
        some = np.flatnonzero((component != group) & (9 * np.abs(size - n) <= size + n))
        if right is None:
            some = some[some > i]
        mine = left.bins[i]
        for at in range(0, len(some), step):
            part = some[at : at + step]
            theirs = other.bins[part]
            apart = (np.maximum(theirs, mine) - np.minimum(theirs, mine)).sum(axis=1, dtype=np.int64)
            out += [(key, x) for x in ids[part[9 * apart <= size[part] + n]].tolist()]
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) between the components of a hub; rows (hub, i, j, run, id, component, n, bins) come sorted by their block."""
    key, sides = None, (Run(), Run())

    def pairs() -> pa.RecordBatch:
        found = []
        if sides[0].ids and (key[1] == key[2] or sides[1].ids):
            found = close_pairs(sides[0], None if key[1] == key[2] else sides[1])
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for b in batches:
        numbers = [c.to_pylist() for c in b.columns[:-1]]
        for at, (hub, i, j, run, member, component, n) in enumerate(zip(*numbers, strict=True)):
            if key != (hub, i, j):
                if key:
                    yield pairs()
                key, sides = (hub, i, j), (Run(), Run())
            sides[0 if run == i else 1].add(member, component, n, np.frombuffer(b.column(7)[at].as_buffer(), np.uint8))
    if key:
        yield pairs()


def hub_pairs(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of different components of each hub's members (hub, id, component, n) that may be linked, block by block.

    A hub's members are dealt into runs of bounded bytes, and each pair of runs is a block. Members travel
    as bins, a fraction of their sets; pairs live in a block's task only, but for those the bins leave.
    """
    # linked sets share the smaller one's band, as in places(); a hub is searched band by band
    number = F.size(F.filter(F.array(*[F.lit(h) for h in HIGHS]), lambda h: F.col("n") > h))
    below = F.when((F.col("number") > 0) & (4 * F.col("n") <= 5 * F.get(F.array(*[F.lit(h) for h in HIGHS]), F.col("number") - 1)), F.col("number") - 1)
    banded = members.withColumn("number", number).withColumn("band", F.explode(F.array_compact(F.array("number", below))))
    members = materialize(banded.select(F.concat_ws(":", "hub", "band").alias("hub"), "id", "component", "n"), "hub-banded")
    some = members.groupBy("hub").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("top"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    runs = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("k") * F.col("top") * 2 / RUN_BYTES)).cast("int")
    members = materialize(members.join(some.select("hub", "top", runs.alias("runs")), "hub").select("hub", "id", "component", "n", "top", F.pmod(F.xxhash64("id"), F.col("runs")).cast("int").alias("run"), "runs"), "hub-members")
    ids = materialize(members.select("id", F.col("top").cast("int").alias("top")).distinct(), "hub-ids")
    bins = materialize(join_small(texts, ids, "id", "inner", IDS).select("id", "top", "text").mapInArrow(_binned, "id long, top int, bins binary"), "hub-bins")
    placed = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)))
    placed = placed.select("hub", F.least("run", "other").alias("i"), F.greatest("run", "other").alias("j"), "run", "id", "component", "n", "top").join(bins, ["id", "top"])
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.select("hub", "i", "j", "run", "id", "component", "n", "bins").repartition(parts, "hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return materialize(ordered.mapInArrow(_blocks, "a long, b long"), "hub-pairs").distinct()


def verify(texts: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(a, b, percent) of the pairs (a, b) of ids, written. Each b travels once per pair, each a once per run of b's."""
    pairs = materialize(pairs, f"{name}-pairs")
    ids = materialize(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), f"{name}-ids")
    sets = materialize(join_small(texts, ids, "id", "inner", IDS).select("id", "text").mapInArrow(_sets, "id long, elements binary"), f"{name}-sets")
    runs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs"))
    members = pairs.join(runs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("run"), F.col("b").alias("id"))
    members = members.join(sets, "id").select("a", "run", F.col("id").alias("b"), "elements")
    heads = runs.select(F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run")).join(sets, "id")
    both = members.unionAll(heads.select(F.col("id").alias("a"), "run", F.lit(None).cast("long").alias("b"), "elements"))
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(n, "a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())
    return materialize(ordered.mapInArrow(_verified, "a long, b long, percent double"), f"{name}-links")


def index(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest, own, low, chosen) of each row of docs (doc_id, text), written."""
    return materialize(docs.mapInArrow(_indexed, "doc_id long, n int, digest binary, own array<bigint>, low array<bigint>, chosen array<bigint>"), "index")


def shared_signatures(texts: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, id, own, often): signatures that several classes have, by the classes' smallest ids, written.

    One shuffle of all signatures; a signature of one class is dropped there.
    """
    listed = rows.where("doc_id IS NOT NULL")
    flat = listed.select(F.explode("own").alias("sig"), F.col("doc_id").alias("id"), F.lit(True).alias("own")).unionAll(listed.select(F.explode("low").alias("sig"), F.col("doc_id").alias("id"), F.lit(False).alias("own")))
    lacking = rows.where(F.size("chosen") > 0).select("n", F.explode("chosen").alias("g")).distinct()
    chosen: dict[int, set[int]] = {}
    for r in lacking.groupBy("n").agg(F.collect_set("g").alias("g")).collect():  # a few segments of a few bands
        chosen.setdefault(band(r["n"])[0], set()).update(r["g"])
    if chosen:
        flat = flat.unionAll(texts.mapInArrow(_neighbours({k: frozenset(v) for k, v in chosen.items()}), "sig long, id long, own boolean"))
    each = Window.partitionBy("sig")
    some = flat.withColumn("least", F.min("id").over(each)).withColumn("most", F.max("id").over(each)).where("least < most").select("sig", "id", "own")
    some = materialize(some, "signatures")
    # from here on a class stands for its copies
    some = some.join(classes.select(F.col("doc_id").alias("id"), "rep"), "id").groupBy("sig", F.col("rep").alias("id")).agg(F.max("own").alias("own"))
    often = some.groupBy("sig").agg(F.count(F.lit(1)).alias("often"), F.min("id").alias("head")).where("often > 1")
    return materialize(some.join(sorted_joins(often), "sig"), "buckets")


#: Ids beyond this are too near the ends of 64 bits for new ones after them.
ROOM = 1 << 62


def link_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n, rep, component) for each row of docs (doc_id, text); rep is the smallest id of an equal set."""
    spark = docs.sparkSession
    listed = index(docs)
    rows = materialize(listed.select("doc_id", "n", "digest", F.size("own").alias("c")), "documents")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    full = rows.where("doc_id IS NOT NULL AND digest IS NOT NULL").select("doc_id", "n", "digest")
    clash = full.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    if clash.limit(1).count():
        release(listed)
        return with_own_ids(docs, materialize(clash, "clash"))
    reps = full.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    # distinct comes first, so that nothing above the join keeps a digest's rows together and a hot one can be split
    classes = materialize(full.distinct().join(reps, "digest").select("doc_id", "n", "rep"), "classes")
    buckets = shared_signatures(texts, listed, classes)
    release(listed)

    # what a class needs: of c segments met, H + 1; its most frequent ones are left out
    sizes = rows.where("doc_id IS NOT NULL AND c > 0").groupBy("doc_id", "n").agg(F.max("c").alias("c"))
    sizes = sizes.join(classes.select("doc_id", "rep").distinct(), "doc_id").groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"), F.max("c").alias("c"))
    sizes = sizes.withColumn("spare", F.greatest(F.col("c") - F.floor(F.col("n") / 4) - 1, F.lit(0)))
    known = materialize(buckets.join(sizes, "id"), "known")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("often"), "sig"))
    probes = known.where("own").withColumn("rank", rank).where(F.col("rank") > F.col("spare"))
    probes = materialize(probes.select("sig", "id", "n", (F.col("c") - F.col("spare")).alias("kept")), "probes")

    # one comparison per class, with the head of a bucket
    heads = materialize(known.where("own AND head <> id").groupBy("id", "head").agg(F.count(F.lit(1)).alias("k"), F.first("c").alias("c")), "heads")
    close = heads.where(100 * F.col("k") >= HUB * F.col("c"))
    first = close.groupBy("id").agg(F.max(F.struct("k", (-F.col("head")).alias("minus"))).alias("m")).select((-F.col("m.minus")).alias("a"), F.col("id").alias("b"))
    compared = verify(texts, first, "first")
    one = components(spark, compared.where(F.col("percent") >= LEAST).select("a", "b"), "first")
    hubs = components(spark, close.select(F.col("head").alias("a"), F.col("id").alias("b")), "hubs").select("id", F.col("component").alias("hub"))

    # all that may link two components: within a hub block by block, between hubs by what the classes share
    at = lambda df: df.join(one.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    gathered = materialize(at(sizes.select("id", "n").join(known.select("id").distinct(), "id", "left_semi").join(hubs, "id", "left").withColumn("hub", F.coalesce("hub", "id"))), "hubs")
    inside = hub_pairs(texts, gathered)
    placed = gathered.select("id", "hub", "component")
    indexed = materialize(known.select("sig", "id", "n").join(placed, "id"), "indexed")
    mixed_sigs = indexed.groupBy("sig").agg(F.min(F.struct("component", "hub")).alias("x"), F.max(F.struct("component", "hub")).alias("y")).where("x.component < y.component").select("sig")
    indexed = materialize(indexed.join(mixed_sigs, "sig", "left_semi"), "mixed")
    search = probes.join(mixed_sigs, "sig", "left_semi").select("sig", "id", "n", "kept").join(placed, "id").alias("p")
    groups = indexed.select("sig", "component", "hub").distinct().alias("g")
    across = search.join(groups, (F.col("p.sig") == F.col("g.sig")) & (F.col("p.component") != F.col("g.component")) & (F.col("p.hub") != F.col("g.hub")))
    across = across.select("p.sig", F.col("p.id").alias("a"), F.col("p.n").alias("m"), "p.kept", F.col("g.component").alias("component"), F.col("g.hub").alias("hub")).alias("q")
    fits = (F.col("i.n") > F.col("q.m")) | ((F.col("i.n") == F.col("q.m")) & (F.col("i.id") > F.col("q.a")))
    near = 4 * F.col("i.n") <= 5 * F.col("q.m")
    same = (F.col("q.sig") == F.col("i.sig")) & (F.col("q.component") == F.col("i.component")) & (F.col("q.hub") == F.col("i.hub"))
    pairs = across.join(indexed.alias("i"), same & fits & near)
    pairs = pairs.groupBy("q.a", F.col("i.id").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.first("q.kept").alias("kept"), F.first(F.col("q.m") + F.col("i.n")).alias("both"))
    pairs = pairs.where(F.col("k") >= F.col("kept") - F.floor(F.col("both") / 9)).select("a", "b")
    more = verify(texts, pairs.unionAll(inside), "more").where(F.col("percent") >= LEAST).select("a", "b")
    joined = at(more.select(F.col("a").alias("id"), "b")).select(F.col("component").alias("a"), F.col("b").alias("id"))
    joined = at(joined).select("a", F.col("component").alias("b"))
    two = components(spark, joined, "more").select(F.col("id").alias("component"), F.col("component").alias("final"))
    last = one.join(two, "component", "left").select("id", F.coalesce("final", "component").alias("component"))
    last = last.unionAll(two.join(one, two["component"] == one["id"], "left_anti").select(F.col("component").alias("id"), F.col("final").alias("component")))
    found = classes.join(last.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", "rep", F.coalesce("component", "rep").alias("component"))
    found = materialize(found, "components")
    return rows.select("doc_id", "n").join(found, "doc_id", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("component", "doc_id").alias("component"))


def renumbered(docs: DataFrame, clash: DataFrame) -> DataFrame:
    """The components where ids leave no room for new ones at either end: over ids numbered from 0 in their order, and back."""
    names = materialize(ordinal(docs.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", name="number"), "numbers")
    dense = docs.join(names, "doc_id", "left").select(F.col("number").alias("doc_id"), "text")
    found = with_own_ids(dense, materialize(clash.join(names, "doc_id").select(F.col("number").alias("doc_id")), "clash"))
    for column in ("doc_id", "rep", "component"):
        back = names.select(F.col("number").alias(column), F.col("doc_id").alias("was"))
        found = found.join(back, column, "left").withColumn(column, F.col("was")).drop("was")
    return found


def with_own_ids(docs: DataFrame, clash: DataFrame) -> DataFrame:
    """The components where some ids have several texts: each such text gets an id of its own, beyond all others, for the while."""
    spark = docs.sparkSession
    low, top = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low < -ROOM and top > ROOM:
        return renumbered(docs, clash)
    place = F.monotonically_increasing_id()
    rows = docs.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    own = join_small(rows.select("doc_id", "digest"), clash, "doc_id", "left_semi").distinct()
    # the ids need no order, only to be new; what is written keeps them the same for all that reads them
    own = materialize(own.withColumn("own", F.lit(top) + 1 + place if top <= ROOM else F.lit(low) - 1 - place), "own-ids")
    split = join_small(rows, own, ["doc_id", "digest"]).select(F.coalesce("own", "doc_id").alias("doc_id"), "text")
    found = link_components(split)
    back = own.select("own", "doc_id")
    for column in ("doc_id", "rep", "component"):
        named = back.select(F.col("own").alias(column), F.col("doc_id").alias("was"))
        found = found.join(named, column, "left").withColumn(column, F.coalesce("was", column)).drop("was")
    found = materialize(found, "own-found")
    whole = components(spark, found.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("component").alias("b")), "own-cc")
    return found.drop("component").join(whole.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of each row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return link_components(narrow).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("rep").alias("class_id"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one document of each component, the one of the smallest id, all columns kept.

    Rows that repeat an id within a component are told apart by their text's digest, the least one stays,
    once. Rows of a NULL id all stay.
    """
    mark = free_name(docs.columns, "component_mark")
    found = near_duplicates(docs, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias(mark)).distinct()
    rows = docs.join(found, F.col(id_col) == F.col(mark), "left_semi")
    order = Window.partitionBy(id_col).orderBy(F.md5(F.col(text_col).cast("string")).asc_nulls_last())
    rows = rows.withColumn(mark, F.row_number().over(order)).where(F.col(mark) == 1).drop(mark)
    return rows.unionByName(docs.where(F.col(id_col).isNull()))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, x, x + 4) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS x FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS place FROM s JOIN (SELECT s, count(*) AS f FROM s GROUP BY s) USING (s)),
p AS (SELECT doc_id, s, n FROM r JOIN n USING (doc_id) WHERE place <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total FROM p a JOIN p b ON a.s = b.s AND a.doc_id < b.doc_id AND 4 * a.n <= 5 * b.n AND 4 * b.n <= 5 * a.n),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.s = y.s GROUP BY a, b, total HAVING 100 * count(*) >= 80 * (total - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(g.class_id, d.doc_id) AS class_id, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM t GROUP BY a) m USING (doc_id)
  LEFT JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM (SELECT doc_id, list_sort(list(s)) AS h FROM s GROUP BY doc_id)) g USING (doc_id)
"""
