"""Operator 12: records in fixed virtual slots, and slots in shards by a versioned map.

A record's slot is a hash of its id (of its text where it has none) into a few thousand slots and never
changes. Bytes and rows are added up per slot. The map from slots to shards is a small table with a version:
the first version deals slots round, and each edit (a rebalancing by the bytes of the slots, or one more
shard) writes the next version and moves only the slots that it has to. Where records of one id or text
make a slot heavier than a sixteenth of a shard's share, its rows are dealt into pieces by their place, so that one
key that holds a third of all rows does not hold a shard.

Only the sums per slot meet on the driver: at most SLOTS rows and 16 pieces per shard more, whatever the input.

Cases. NULL text: no bytes, crc32 of the empty text. NULL id: slot by the text. NULL both: one slot, in
pieces where it is heavy. Repeated rows: each has its own place. Empty table: a map without bytes, no rows.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path

#: Virtual slots; fixed for the life of a map.
SLOTS = 8192
#: A slot is in pieces where it is heavier than a shard's share divided by this.
PIECES = 16
#: Bytes of a record besides its text.
OVERHEAD = 8
SHARDS = 24


@dataclass(frozen=True)
class Load:
    """What a piece of a slot holds."""

    slot: int
    piece: int
    size: int
    rows: int


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, slot, place) of each row, written once; place numbers rows in the order they are read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(text)))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("slot"),
        F.monotonically_increasing_id().alias("place"),
    )
    return materialize(rows, "records")


def in_pieces(rows: DataFrame, shards: int) -> DataFrame:
    """The rows with `piece`: 0, or their part of a heavy slot. At most 16 slots per shard can be heavy."""
    sums = rows.groupBy("slot").agg(F.sum("size").alias("size")).collect()
    share = sum(r["size"] for r in sums) / shards / PIECES
    heavy = [(r["slot"], -(-r["size"] // max(1, int(share)))) for r in sums if r["size"] > share]
    if not heavy:
        return rows.withColumn("piece", F.lit(0))
    pieces = F.broadcast(rows.sparkSession.createDataFrame(heavy, "slot int, pieces long"))
    return rows.join(pieces, "slot", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("place"), "pieces"), F.lit(0)).cast("int")).drop("pieces")


def loads(rows: DataFrame) -> list[Load]:
    """Bytes and rows of each slot's pieces: a few thousand entries by the number of slots."""
    found = rows.groupBy("slot", "piece").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((Load(r["slot"], r["piece"], r["size"], r["n"]) for r in found), key=lambda x: (x.slot, x.piece))


def first_map(held: list[Load], shards: int) -> dict[tuple[int, int], int]:
    """Slots dealt round the shards, without regard to bytes."""
    return {(x.slot, x.piece): (x.slot + x.piece) % shards for x in held}


def rebalanced(held: list[Load], at: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], int]:
    """The map edited until no move from the heaviest to the lightest shard brings the two nearer.

    Each move takes the piece nearest to half of their difference. Pieces that the map does not know go to the
    lightest shard first. Every move lowers the sum of squares, so this ends.
    """
    out = {k: v for k, v in at.items() if v < shards}
    total = [0] * shards
    inside: list[list[tuple[int, int, int]]] = [[] for _ in range(shards)]
    for x in sorted(held, key=lambda x: (-x.size, x.slot, x.piece)):
        k = (x.slot, x.piece)
        if k in out:
            total[out[k]] += x.size
            inside[out[k]].append((x.size, *k))
    for x in sorted(held, key=lambda x: (-x.size, x.slot, x.piece)):
        k = (x.slot, x.piece)
        if k not in out:
            out[k] = min(range(shards), key=lambda s: (total[s], s))
            total[out[k]] += x.size
            inside[out[k]].append((x.size, *k))
    for one in inside:
        one.sort()
    while True:
        order = sorted(range(shards), key=lambda s: (total[s], s))
        low, moved = order[0], False
        for high in reversed(order[1:]):
            gap = total[high] - total[low]
            near = bisect.bisect_left(inside[high], (gap / 2, -1, -1))
            fits = [inside[high][i] for i in (near - 1, near) if 0 <= i < len(inside[high]) and 0 < inside[high][i][0] < gap]
            if fits:
                piece = min(fits, key=lambda x: (abs(2 * x[0] - gap), x))
                inside[high].remove(piece)
                bisect.insort(inside[low], piece)
                total[high] -= piece[0]
                total[low] += piece[0]
                out[piece[1:]] = low
                moved = True
                break
        if not moved:
            return out


def grown(held: list[Load], at: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], int]:
    """The map with one more shard, which alone takes pieces: each from the shard that is heaviest then, until it has its share."""
    out, new = dict(at), shards
    total = [0] * (shards + 1)
    inside: list[list[tuple[int, int, int]]] = [[] for _ in range(shards)]
    for x in held:
        total[out[x.slot, x.piece]] += x.size
        inside[out[x.slot, x.piece]].append((x.size, x.slot, x.piece))
    for one in inside:
        one.sort()
    share = sum(total) / (shards + 1)
    while True:
        for high in sorted(range(shards), key=lambda s: (-total[s], s)):
            fits = bisect.bisect_left(inside[high], (share - total[new] + 1, -1, -1)) - 1
            if total[high] > share and fits >= 0:
                break
        else:
            return out
        piece = inside[high].pop(fits)
        total[high] -= piece[0]
        total[new] += piece[0]
        out[piece[1:]] = new


class SlotMap:
    """The stored map: one folder per version in a shared place, older ones kept. (slot, piece, shard, size, n, base) per piece.

    base is the number of rows in the shard before the piece, so that a row's place in its shard needs no sort of the shard.
    """

    SCHEMA = "slot int, piece int, shard int, size long, n long, base long"

    def __init__(self, spark: SparkSession, path: str, version: int = 0) -> None:
        self.spark, self.path, self.version = spark, path, version

    def edit(self, held: list[Load], at: dict[tuple[int, int], int]) -> SlotMap:
        """Write the next version."""
        filled: dict[int, int] = {}
        rows = []
        for x in held:
            shard = at[x.slot, x.piece]
            rows.append((x.slot, x.piece, shard, x.size, x.rows, filled.get(shard, 0)))
            filled[shard] = filled.get(shard, 0) + x.rows
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.parquet(f"{self.path}/version={self.version + 1}")
        return SlotMap(self.spark, self.path, self.version + 1)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/version={self.version}")

    def shards(self) -> dict[tuple[int, int], int]:
        return {(r["slot"], r["piece"]): r["shard"] for r in self.table().collect()}


def placed(rows: DataFrame, slot_map: SlotMap) -> DataFrame:
    """The rows with their shard and their place in it, 0 and up without gaps, by slot, then id and place.

    Only pieces are sorted, and none is more than a sixteenth of a shard's share or one record; the map is
    sent to every executor, as the number of slots bounds it.
    """
    within = F.row_number().over(Window.partitionBy("slot", "piece").orderBy("doc_id", "text_crc32", "size", "place")) - 1
    numbered = rows.withColumn("within", within.cast("long"))
    return numbered.join(F.broadcast(slot_map.table().select("slot", "piece", "shard", "base")), ["slot", "piece"]).withColumn("position", F.col("base") + F.col("within")).drop("base", "within")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """(doc_id, size, text_crc32, slot, piece, place, shard, position) of each row, and the map it follows: dealt round, then edited by the bytes."""
    spark = docs.sparkSession
    rows = in_pieces(records(docs, id_col, text_col, slots), shards)
    held = loads(rows)
    dealt = SlotMap(spark, new_path(spark, "slot-map")).edit(held, first_map(held, shards))
    balanced = dealt.edit(held, rebalanced(held, dealt.shards(), shards))
    return placed(rows, balanced), balanced


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    rows, _ = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("slot").alias("virtual_slot"))
