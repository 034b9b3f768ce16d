"""Breadth-first searches from many roots at once over vertices dealt to buckets; edges stay in their bucket, and rows of arrays go between them.

A bucket is one row of arrays. Its vertices are those with an edge out and the goals, sorted; what a round sends to
another bucket is one row. Ids are 64-bit numbers; roots are bits, 63 in a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import Rounds

#: Roots of one word of bits.
WORD = 63
#: Words that are searched together; more are searched one such slice after another, so that a bucket's state stays small.
SLICE = 16
#: Edges and pairs of a bucket, about, and the fewest buckets.
BUCKET = 200_000
FEWEST = 8

BUCKETS = "p int, ids binary, ptr binary, nbr binary, nbr_p binary, shared boolean, want binary, want_word binary, want_bits binary"
ROUND = "p int, moving boolean, sender int, word int, x binary, y binary, z binary, t binary, at binary, prev binary, prev_p binary, prev_bits binary, hit binary, hit_bits binary, open long, sent long"
BACK = "p int, moving boolean, depth int, x binary, t binary, bit binary, goal binary, home binary"
PATHS = "path array<bigint>"


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (field.split(" ") for field in ddl.split(", "))])


def _table(rows: list[dict], ddl: str) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_schema(ddl))


def _array(table: pa.Table, name: str, kind: type, row: int | None = None) -> np.ndarray:
    """A column's arrays one after another, or that of one row."""
    cells = table.column(name)
    parts = [cells[row]] if row is not None else cells
    return np.frombuffer(b"".join(c.as_buffer() for c in parts if c.is_valid), kind)


def _each(table: pa.Table, names: str) -> np.ndarray:
    """How many entries each row's array of 64-bit numbers has."""
    return np.array([len(c.as_buffer()) // 8 if c.is_valid else 0 for c in table.column(names)], np.int64)


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... of n numbers each, one after another."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - n), n)


def _dealt(to: np.ndarray, columns: dict[str, np.ndarray], rest: dict, ddl: str) -> pa.Table:
    """One row per bucket of `to` with its entries of the columns as arrays."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(to)] if len(to) else starts
    out = []
    for field in _schema(ddl):
        if field.name == "p":
            out.append(pa.array(to[starts], pa.int32()))
        elif field.name in columns:
            data = np.ascontiguousarray(columns[field.name][order])
            offsets = np.r_[starts, ends[-1:] if len(ends) else [0]] * data.itemsize
            out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary()))
        else:
            out.append(pa.array([rest.get(field.name)] * len(starts), field.type))
    return pa.Table.from_arrays(out, schema=_schema(ddl))


def _bits_before(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For entries sorted by key, the bits of the entries of the same key up to each one, itself included."""
    acc, gap = bits.copy(), 1
    while True:
        same = key[gap:] == key[:-gap]
        if not same.any():
            return acc
        acc[gap:] |= np.where(same, acc[:-gap], 0)
        gap *= 2


def _gained(key: np.ndarray, bits: np.ndarray, had: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by key, the bits that no entry of the same key before has and that are not had, and all bits up to each entry."""
    acc = _bits_before(key, bits)
    before = np.zeros_like(acc)
    before[1:] = np.where(key[1:] == key[:-1], acc[:-1], 0)
    return bits & ~had & ~before, acc


def _bucket(p: int, kind: np.ndarray, v: np.ndarray, w: np.ndarray, q: np.ndarray, word: np.ndarray, bits: np.ndarray) -> dict:
    edge = kind == 0
    s, d, dp = v[edge], w[edge], q[edge]
    order = np.lexsort((d, s))
    s, d, dp = s[order], d[order], dp[order]
    once = np.ones(len(s), bool)
    once[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d, dp = s[once], d[once], dp[once]
    ids = np.unique(np.concatenate([s, v[~edge]]))
    want = np.searchsorted(ids, v[~edge])
    order = np.lexsort((want, word[~edge]))
    ptr = np.searchsorted(s, ids), np.searchsorted(s, ids, "right")
    return {
        "p": p, "ids": ids.tobytes(), "ptr": np.concatenate(ptr).tobytes(), "nbr": d.tobytes(), "nbr_p": dp.tobytes(), "shared": 2 * len(np.unique(d)) < len(d),
        "want": want[order].tobytes(), "want_word": word[~edge][order].tobytes(), "want_bits": bits[~edge][order].tobytes(),
    }


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges and goals as one row per bucket."""
    if not (some := [b for b in batches if b.num_rows]):
        return
    rows = pa.Table.from_batches(some)
    columns = [rows.column(c).to_numpy() for c in ("p", "kind", "v", "w", "q", "word", "bits")]
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(columns[0])) + 1
    for parts in zip(*(np.split(c, cuts) for c in columns), strict=True):
        yield from _table([_bucket(int(parts[0][0]), *parts[1:])], BUCKETS).to_batches()


def _turn(still: dict[int, int]):
    """A round of a bucket: what comes in is set against what its vertices have, and what is new is recorded with where it came from and sent on.

    `still` has for each word the roots with pairs that are not found; the others go no further.
    """

    def run(own: pa.Table, come: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _table([], ROUND)
        p = own.column("p")[0].as_py()
        ids, ptr, nbr, nbr_p = (_array(own, c, k) for c, k in (("ids", np.int64), ("ptr", np.int64), ("nbr", np.int64), ("nbr_p", np.int32)))
        want, want_word, want_bits = (_array(own, c, k) for c, k in (("want", np.int64), ("want_word", np.int32), ("want_bits", np.int64)))
        senders = come.column("sender").to_numpy() if come.num_rows else np.zeros(0, np.int32)
        mine = {come.column("word")[int(i)].as_py(): int(i) for i in np.flatnonzero(senders < 0)}
        news = come.filter(pa.array(senders >= 0)) if come.num_rows else come
        w, bits, v, word = (_array(news, c, k) for c, k in (("x", np.int64), ("y", np.int64), ("z", np.int64), ("t", np.int32)))
        v_p = np.repeat(news.column("sender").to_numpy(), _each(news, "x")) if news.num_rows else np.zeros(0, np.int32)
        place = np.searchsorted(ids, w)
        inside = place < len(ids)
        inside[inside] = ids[place[inside]] == w[inside]
        place, bits, v, v_p, word = place[inside], bits[inside], v[inside], v_p[inside], word[inside]
        rows, out = [], []
        for k, live in still.items():
            if not live:
                continue
            here = np.flatnonzero((word == k) & (bits & live != 0))
            low, high = np.searchsorted(want_word, [k, k + 1])
            if not len(here) and k not in mine and low == high:
                continue
            had = np.zeros(len(ids), np.int64)
            if k in mine:
                had[_array(come, "x", np.int32, mine[k])] = _array(come, "y", np.int64, mine[k])
            here = here[np.lexsort((v[here], place[here]))]
            at, got = place[here], bits[here] & live
            gain, acc = _gained(at, got, had[at])
            last = np.ones(len(at), bool)
            last[:-1] = at[1:] != at[:-1]
            fresh = np.zeros(len(ids), np.int64)
            fresh[at[last]] = acc[last] & ~had[at[last]]
            had |= fresh
            kept, goals, sought = gain != 0, want[low:high], want_bits[low:high]
            hits = fresh[goals] & sought
            seen = np.flatnonzero(had)
            new = np.flatnonzero(fresh)
            start, n = ptr[new], ptr[len(ids) + new] - ptr[new]
            edge = _ranges(start, n)
            out.append((nbr[edge], np.repeat(ids[new], n), np.repeat(fresh[new], n), nbr_p[edge], np.full(len(edge), k, np.int32)))
            if len(seen):
                rows.append({"p": p, "moving": True, "sender": -1, "word": k, "x": seen.astype(np.int32).tobytes(), "y": had[seen].tobytes()})
            rows.append({
                "p": p, "moving": False, "word": k,
                "at": ids[at[kept]].tobytes() if kept.any() else None, "prev": v[here][kept].tobytes(), "prev_p": v_p[here][kept].tobytes(), "prev_bits": gain[kept].tobytes(),
                "hit": ids[goals[hits != 0]].tobytes() if hits.any() else None, "hit_bits": hits[hits != 0].tobytes(),
                "open": int(np.bitwise_or.reduce(sought & ~had[goals])), "sent": len(edge),
            })
        if not out:
            return _table(rows, ROUND)
        to, source, sent, to_p, words = (np.concatenate(c) for c in zip(*out, strict=True))
        if own.column("shared")[0].as_py():
            # many edges end in the same vertices: of the roots that come to one, the first edge's source will do
            order = np.lexsort((source, to, words))
            to, source, sent, to_p, words = (c[order] for c in (to, source, sent, to_p, words))
            group = np.r_[0, np.cumsum((to[1:] != to[:-1]) | (words[1:] != words[:-1]))] if len(to) else to
            sent, _ = _gained(group, sent, np.int64(0))
            to, source, sent, to_p, words = (c[sent != 0] for c in (to, source, sent, to_p, words))
        return pa.concat_tables([_table(rows, ROUND), _dealt(to_p, {"x": to, "y": sent, "z": source, "t": words}, {"moving": True, "sender": p}, ROUND)])

    return run


def _back(depth: int):
    """A step back of a bucket: pairs that are at its vertices, or found there, are written down for their goal's bucket and go on to the vertex before."""

    def run(own: pa.Table, come: pa.Table) -> pa.Table:
        p = (own if own.num_rows else come).column("p")[0].as_py()
        pairs = [[_array(come, c, k) for c, k in (("x", np.int64), ("t", np.int32), ("bit", np.int8), ("goal", np.int64), ("home", np.int32))]]
        for i in range(own.num_rows):
            hit, bits, word = _array(own, "hit", np.int64, i), _array(own, "hit_bits", np.int64, i), own.column("word")[i].as_py()
            row, bit = np.nonzero((bits[:, None] >> np.arange(WORD)) & 1)
            pairs.append([hit[row], np.full(len(row), word, np.int32), bit.astype(np.int8), hit[row], np.full(len(row), p, np.int32)])
        at, word, bit, goal, home = (np.concatenate(c) for c in zip(*pairs, strict=True))
        out = [_dealt(home, {"x": at, "t": word, "bit": bit, "goal": goal}, {"moving": False, "depth": depth}, BACK)]
        moved = 0
        for i in range(own.num_rows if depth else 0):
            to, prev, prev_p, bits = (_array(own, c, k, i) for c, k in (("at", np.int64), ("prev", np.int64), ("prev_p", np.int32), ("prev_bits", np.int64)))
            here = np.flatnonzero(word == own.column("word")[i].as_py())
            low, high = np.searchsorted(to, at[here]), np.searchsorted(to, at[here], "right")
            way, pair = _ranges(low, high - low), np.repeat(here, high - low)
            good = (bits[way] >> bit[pair]) & 1 == 1
            way, pair = way[good], pair[good]
            moved += len(pair)
            out.append(_dealt(prev_p[way], {"x": prev[way], "t": word[pair], "bit": bit[pair], "goal": goal[pair], "home": home[pair]}, {"moving": True, "depth": depth - 1}, BACK))
        if depth and moved != len(at):
            raise ValueError(f"{len(at)} pairs in a bucket, {moved} ways back")
        return pa.concat_tables(out)

    return run


def _paths(steps: pa.Table) -> pa.Table:
    """The paths of a bucket's goals from their steps."""
    at, word, bit, goal = (_array(steps, c, k) for c, k in (("x", np.int64), ("t", np.int32), ("bit", np.int8), ("goal", np.int64)))
    depth = np.repeat(steps.column("depth").to_numpy(), _each(steps, "x"))
    order = np.lexsort((depth, bit, word, goal))
    starts = np.flatnonzero(depth[order] == 0)
    path = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)], pa.int32()), pa.array(at[order]))
    return pa.Table.from_arrays([path], schema=_schema(PATHS))


def paths(step: DataFrame, wants: DataFrame, rounds: int) -> DataFrame:
    """(path): for each goal and root of (goal, root, number) with a way along the steps (v, w), the vertices of a shortest one from the root on; all are longs.

    Roots are numbered from 0. Before each vertex stands the smallest one that its root reached in the round before.
    """
    spark = step.sparkSession
    n = step.count() + wants.count()
    parts = max(FEWEST, -(-n // BUCKET))
    where = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    word, bit = F.floor(F.col("number") / WORD).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % WORD).cast("int"))
    wanted = wants.select("goal", "root", word.alias("word"), bit.alias("bit"))
    none = F.lit(0).cast("long")
    edges = step.select(where("v").alias("p"), F.lit(0).alias("kind"), "v", "w", where("w").alias("q"), F.lit(0).alias("word"), none.alias("bits"))
    goals = wanted.groupBy("goal", "word").agg(F.bit_or("bit").alias("bits"))
    goals = goals.select(where("goal").alias("p"), F.lit(1).alias("kind"), F.col("goal").alias("v"), none.alias("w"), F.lit(0).alias("q"), "word", "bits")
    own = edges.unionAll(goals).repartition(parts, "p").mapInArrow(_buckets, BUCKETS).repartition(parts, "p").persist()
    firsts = wanted.select("root", "word", "bit").distinct()
    steps = _Moving(spark, _empty(spark, BACK).schema, "witness-steps")
    last = firsts.agg(F.max("word")).first()[0]
    for first in range(0, -1 if last is None else last + 1, SLICE):
        words = range(first, min(first + SLICE, last + 1))
        sent = firsts.where(F.col("word").between(words[0], words[-1])).select(where("root").alias("p"), "root", "word", "bit")
        went = _searched(own, sent.mapInArrow(_start, ROUND), {k: -1 for k in words}, parts, rounds)
        here = _empty(spark, BACK)
        for depth in range(went.n - 1, -1, -1):
            mine = went.round(depth).where("NOT moving AND at IS NOT NULL").select("p", "word", "at", "prev", "prev_p", "prev_bits", "hit", "hit_bits")
            come = here.where("moving").select("p", "x", "t", "bit", "goal", "home")
            here = steps.add(mine.repartition(parts, "p").groupBy("p").cogroup(come.repartition(parts, "p").groupBy("p")).applyInArrow(_back(depth), BACK))
            steps.drop(steps.n - 2)
    own.unpersist()
    done = steps.all() if steps.n else _empty(spark, BACK)
    return done.where("NOT moving").select("p", "depth", "x", "t", "bit", "goal").repartition(parts, "p").groupBy("p").applyInArrow(_paths, PATHS)


class _Moving(Rounds):
    """Rounds whose moving rows are read by the next round only and can be dropped after it."""

    def add(self, df: DataFrame) -> DataFrame:
        df.write.partitionBy("moving").option("compression", "zstd").parquet(f"{self.path}/round={self.n}")
        self.n += 1
        return self.round(self.n - 1)

    def round(self, i: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={i}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def drop(self, i: int) -> None:
        """Delete a round's moving rows."""
        if i >= 0:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/round={i}/moving=true")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _empty(spark, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots as what a first round sends."""
    for b in batches:
        p, root, word, bit = (b.column(c).to_numpy() for c in ("p", "root", "word", "bit"))
        yield from _dealt(p, {"x": root, "y": bit, "z": root, "t": word}, {"moving": True, "sender": 0}, ROUND).to_batches()


def _searched(own: DataFrame, sent: DataFrame, still: dict[int, int], parts: int, rounds: int) -> _Moving:
    """The rounds of a search, until nothing is sent or every root has its pairs."""
    went = _Moving(own.sparkSession, sent.schema, "witness-rounds")
    for _ in range(rounds):
        come = sent.where("moving").select("p", "sender", "word", "x", "y", "z", "t")
        sent = went.add(own.groupBy("p").cogroup(come.repartition(parts, "p").groupBy("p")).applyInArrow(_turn(still), ROUND))
        went.drop(went.n - 2)
        told = sent.where("NOT moving").groupBy("word").agg(F.bit_or("open").alias("open"), F.sum("sent").alias("sent")).collect()
        still = {r["word"]: r["open"] for r in told if r["open"]}
        if not still or not sum(r["sent"] for r in told if r["open"]):
            return went
    raise ValueError("too many steps")
