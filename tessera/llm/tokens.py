"""Operator 9: token ids as binary files with Elias-Fano encoded document boundaries.

Documents are dealt by ranges of their id and sorted, so that file after file, and block after block in
a file, has them in ascending order. A block is one self-contained image: a header, the documents' ends
and ids as Elias-Fano sequences with select samples, and the concatenated token ids. A boundary costs
2 + log2(ids / documents) bits rather than a 64-bit offset. The blocks are stored as binary values in a
Parquet container, so that writing is atomic, survives retried tasks, and works on any store that Spark
can reach. Documents are never split between blocks.

Cases. NULL or empty text: only the end id. NULL document ids: first in order. Repeated rows and equal
ids: each has its own entry, by the digest of its text, so that reruns agree. Empty table: a container
without blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialize, new_path
from .encoder import encoder, with_ends

#: A block ends once it has so many ids.
BLOCK_IDS = 1 << 16
#: Bytes of input for each range of ids, as the planner knows them.
RANGE = 128 << 20
#: A select sample for every so many entries.
SAMPLE = 256
MAGIC = b"TSEF0001"
HEAD = struct.Struct("<8sIIIqqq")  # magic, width, end id, NULL ids, documents, token ids, first document id


class EliasFano:
    """A non-decreasing sequence of n numbers below u + 1, in about 2 + log2(u / n) bits each.

    Each number's low bits stand in a packed array; its high part is a set bit at (high part + index) of a
    bit vector. To select a number, a sample gives the byte where every `SAMPLE`-th set bit is, and the
    bytes from there are counted.
    """

    HEAD = struct.Struct("<qqiqqq")  # numbers, bound, low bits, bytes of low, high and sample parts

    def __init__(self, n: int, u: int, bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        self.n, self.u, self.bits, self.low, self.high, self.samples = n, u, bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        u = int(values[-1]) if n else 0
        bits = max(0, (u // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        if bits:
            low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        else:
            low = b""
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        flags[at] = 1
        return cls(n, u, bits, low, np.packbits(flags, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes())

    def pack(self) -> bytes:
        return self.HEAD.pack(self.n, self.u, self.bits, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples

    @classmethod
    def unpack(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the start of the data, and the number of bytes it takes."""
        n, u, bits, *sizes = cls.HEAD.unpack_from(data)
        ends = np.cumsum([cls.HEAD.size, *sizes]).tolist()
        return cls(n, u, bits, *(bytes(data[a:b]) for a, b in zip(ends, ends[1:], strict=False))), ends[-1]

    def lows(self, start: int, stop: int) -> np.ndarray:
        if not self.bits:
            return np.zeros(stop - start, np.int64)
        first, last = start * self.bits, stop * self.bits
        flags = np.unpackbits(np.frombuffer(self.low, np.uint8)[first // 8 : -(-last // 8)], bitorder="little")[first % 8 :][: last - first]
        return flags.reshape(-1, self.bits).astype(np.int64) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th number, from one sample and the bytes after it."""
        sample = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left, byte, bit = i % SAMPLE, sample // 8, sample % 8
        word = self.high[byte] >> bit << bit
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        return (high << self.bits) | int(self.lows(i, i + 1)[0])

    def all(self) -> np.ndarray:
        """Every number, in one pass over the bits."""
        at = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        return ((at - np.arange(self.n)) << self.bits) | self.lows(0, self.n)


def pack_block(ids: list[int | None], flat: np.ndarray, counts: np.ndarray, end_id: int) -> bytes:
    """The image of a block; ids ascend, NULLs first, flat has each document's ids with its end id, counts their numbers."""
    known = np.array([x for x in ids if x is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    ends = EliasFano.of(np.cumsum(counts))
    return HEAD.pack(MAGIC, flat.dtype.itemsize, end_id, len(ids) - len(known), len(ids), len(flat), first) + ends.pack() + EliasFano.of(known - first).pack() + flat.tobytes()


class Block:
    """Random access to the documents of a block's image."""

    def __init__(self, image: bytes) -> None:
        view = memoryview(image)
        magic, width, self.end_id, self.nulls, self.n, size, self.first = HEAD.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token block")
        self.ends, a = EliasFano.unpack(view[HEAD.size :])
        self.keys, b = EliasFano.unpack(view[HEAD.size + a :])
        self.flat = np.frombuffer(view[HEAD.size + a + b :], f"<u{width}", size)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, its end id included."""
        return self.flat[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.keys.all() + self.first).tolist()


def ranges_of(docs: DataFrame) -> int:
    """Ranges of ids: the session's number of shuffle partitions, or more where the planner's size of the input asks for them."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n, -(-size // RANGE)) if size < 1 << 50 else n  # larger ones mean that it is unknown


def sorted_by_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) dealt by ranges of the id and sorted, NULL first; equal ids by their texts' digests, so that they can be dealt to several ranges."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = narrow.withColumn("digest", F.md5("text"))
    return keyed.repartitionByRange(ranges_of(docs), "doc_id", "digest").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")


def _blocks(path: str | None, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, made = TaskContext.get().partitionId(), 0
        enc = encoder(path, False)
        keys: list = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal made, size
            image = pack_block(keys, np.concatenate(parts), np.concatenate(sizes), end_id)
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([made], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([size], pa.int64()), pa.array([image], pa.binary())], names=["shard", "block", "n_docs", "n_ids", "image"])
            made, size = made + 1, 0
            keys.clear(), parts.clear(), sizes.clear()
            return out

        for b in batches:
            listed = b.column(0).to_pylist()
            for at, ids, counts in enc.encode_column(b.column(1)):
                flat, counts = with_ends(ids, counts, end_id), counts + 1
                ends = np.cumsum(counts)
                low = done = 0
                while low < len(counts):
                    # documents until the block has enough ids
                    high = min(int(np.searchsorted(ends, done + block_ids - size)) + 1, len(counts))
                    keys.extend(listed[at + low : at + high])
                    parts.append(flat[done : ends[high - 1]])
                    sizes.append(counts[low:high])
                    size += int(ends[high - 1]) - done
                    low, done = high, int(ends[high - 1])
                    if size >= block_ids:
                        yield block()
        if keys:
            yield block()

    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode every document and write the container to a path."""
    rows = sorted_by_id(docs, id_col, text_col).mapInArrow(_blocks(vocabulary, end_id, block_ids), "shard int, block int, n_docs long, n_ids long, image binary")
    rows.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def read_blocks(spark, path: str) -> DataFrame:
    """(shard, block, n_docs, n_ids, start, image) of each block; start: the ids of all blocks before it.

    Sums run within a shard first; only one row per shard meets in a window over all.
    """
    blocks = spark.read.parquet(path)
    sizes = blocks.select("shard", "block", "n_ids")
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    starts = sizes.withColumn("within", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(shards, "shard").select("shard", "block", (F.col("base") + F.col("within")).alias("start"))
    return join_small(blocks, materialize(starts, "starts"), ["shard", "block"], "inner")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start, image in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            block = Block(image.as_py())
            ends = block.ends.all()
            begins = np.concatenate(([0], ends[:-1]))
            wide = block.flat.astype("<u4")
            sums = [zlib.crc32(wide[x:y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids(), pa.int64()), pa.array(begins + start, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    return read_blocks(spark, path).select("start", "image").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return read_documents(docs.sparkSession, path)


def op9_token_ids(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
