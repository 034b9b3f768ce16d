"""Operator 11: the tokens of two tokenizers over the same bytes, matched by the bytes that they cover.

Tokenizer A is byte-level BPE on space + text, B a sentencepiece model that puts the space itself. B's tokens
make a static interval index (their sorted starts and ends); a bisection per A token finds the B tokens that
it overlaps, and a bisection per end of an A token whether a B token spans the gap behind it. Gaps that none
spans bound the groups.

No token of either reaches over a space that follows a character other than white space, so texts are cut
there and each distinct piece is aligned once per worker; a text is the sum of its pieces. Texts with white
space on which tables differ, or with A's special string, are one piece. The first pass adds up the pairs of
ids that links hold, per task and then over the corpus. The second scores links by them: the PAIRS most
frequent pairs are sent to every executor as sorted arrays (17 bytes a pair), and links of rarer pairs,
if there are more, are joined by a shuffle, so the result is the same whatever the number of pairs.

Cases. NULL and empty texts, and texts that the tokens do not give back byte by byte (those with U+2581):
no tokens, no groups, zeros. White space alone is an ordinary text. NULL and repeated ids: each row has its
own result. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialize
from .encoder import _CLASS, SHOWN, SPACE, TEXTS, Encoder, odd_places, values

#: Pairs of ids that are sent to every executor, 34 MB; links of others are joined.
PAIRS = 2_000_000
#: A worker forgets its pieces when they exceed either of these.
PIECES, LINKS = 400_000, 4_000_000
#: An id of B takes so many bits in a pair.
BITS = 24
BLANK = "▁"


def piece_model() -> str:
    """The default model of B."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokens that end at ends_a and ends_b in the same bytes: (first B token, behind the last B token) that each A token overlaps, and whether its end is a boundary.

    Both lists tile the bytes from 0; the B tokens' starts and ends, sorted as they are, are the index.
    """
    starts_a, starts_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    first = np.searchsorted(ends_b, starts_a, "right")
    behind = np.searchsorted(starts_b, ends_a, "left")
    stabbed = np.searchsorted(ends_b, ends_a, "left")
    return first, behind, ends_b[stabbed] == ends_a


class Aligner:
    """Aligns pieces of texts and keeps what it found: numbers of tokens, groups and links, the links' pairs, and the groups as text."""

    def __init__(self, path_a: str | None, path_b: str | None) -> None:
        import sentencepiece

        self.a = Encoder(path_a, True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b or piece_model())
        back = {chr(shown): byte for byte, shown in SHOWN.items()}
        size = self.a.tokenizer.get_vocab_size()
        self.bytes_a = [bytes(back.get(c, 0x3F) for c in self.a.tokenizer.id_to_token(i) or "") for i in range(size)]
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(BLANK, " ").encode())
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        if any(" " in x.lstrip(" ") for x in (y.decode("utf-8", "replace") for y in self.bytes_b)):
            raise ValueError("a token of B reaches over the space behind a word")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.groups: list[str] = []
        self.size = 0
        self.counts = np.zeros((1 << 14, 4), np.int64)  # A tokens, B tokens, groups, links
        self.valid = np.zeros(1 << 14, bool)
        self.links: list[np.ndarray] = []
        self.made = 0  # pieces whose links have been put together
        self.n_links = 0

    def full(self) -> bool:
        return self.size > PIECES or self.n_links > LINKS

    def pairs(self, since: int) -> np.ndarray:
        """The pairs of the links of pieces from the since-th batch of new pieces on."""
        return np.concatenate(self.links[since:] or [np.empty(0, np.int64)])

    def _fresh(self, pieces: list[bytes]) -> None:
        ids_a = self.a.fresh(pieces)
        texts = [p[1:].decode() for p in pieces]
        blank = [self.b.piece_to_id(BLANK)]
        ids_b = [x if t else blank for x, t in zip(self.b.encode(texts, num_threads=1), texts, strict=True)]
        for i, p in enumerate(pieces):
            if b"".join([self.bytes_a[x] for x in ids_a[i]]) != p or b"".join([self.bytes_b[x] for x in ids_b[i]]) != p:
                ids_a[i] = ids_b[i] = []
        n_a, n_b = (np.array([len(x) for x in t], np.int64) for t in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter((x for one in t for x in one), np.int64) for t in (ids_a, ids_b))
        if len(flat_a):
            first, behind, bound = intervals(np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b]))
        else:
            first = behind = np.empty(0, np.int64)
            bound = np.empty(0, bool)
        n = behind - first
        upto = np.cumsum(n)
        links = (np.repeat(flat_a, n) << BITS) | flat_b[np.repeat(first - upto + n, n) + np.arange(int(upto[-1]) if len(n) else 0)]
        edge = np.concatenate(([0], np.cumsum(n_a)))
        per = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[edge])
        new = np.stack([n_a, n_b, per(bound), per(n)], 1)
        at = self.size
        while at + len(pieces) > len(self.valid):
            self.counts, self.valid = np.concatenate((self.counts, np.zeros_like(self.counts))), np.concatenate((self.valid, np.zeros_like(self.valid)))
        self.counts[at : at + len(pieces)] = new
        self.valid[at : at + len(pieces)] = n_a > 0
        self.size += len(pieces)
        self.links.append(links)
        self.n_links += len(links)
        # the groups as text
        shown_a, shown_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        cut_a, cut_b = np.flatnonzero(bound) + 1, behind[bound]
        parts, low_a, low_b = [], 0, 0
        for x, y in zip(cut_a.tolist(), cut_b.tolist(), strict=True):
            parts.append(f"{','.join(shown_a[low_a:x])}|{','.join(shown_b[low_b:y])}")
            low_a, low_b = x, y
        done = 0
        for k in new[:, 2].tolist():
            self.groups.append(";".join(parts[done : done + k]))
            done += k

    def numbered(self, pieces: list[bytes]) -> np.ndarray:
        found = list(map(self.known.get, pieces))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            at = self.size
            self._fresh([pieces[i] for i in new])
            for k, i in enumerate(new, at):
                found[i] = self.known[pieces[i]] = k
        return np.array(found, np.int64)

    def column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, the pieces, where each row's pieces end) by bounded parts of a column of texts; rows without tokens have no pieces."""
        column = pc.fill_null(column, "").cast(pa.string())
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if len(column) else np.zeros(1, np.int64)
        at = 0
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TEXTS, "right")) - 1)
            low, high = int(offsets[at]), int(offsets[stop])
            if high > low:
                data = np.frombuffer(column.buffers()[2], np.uint8, high - low, low)
                sizes = np.diff(offsets[at : stop + 1])
                piece, ends = self._pieces(data, sizes)
            else:
                piece, ends = np.empty(0, np.int64), np.zeros(stop - at, np.int64)
            yield at, piece, ends
            at = stop

    def _pieces(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        has = sizes > 0
        ends = np.cumsum(sizes)
        data = np.insert(data, (ends - sizes)[has], 0x20)
        ends += np.cumsum(has)
        starts = (ends - sizes - 1)[has]
        kind = _CLASS[data]
        begin = np.zeros(len(data), bool)
        begin[1:] = (data[1:] == 0x20) & ((kind[:-1] & SPACE) == 0)
        if odd := odd_places(data, kind):
            stops = np.append(starts[1:], len(data))
            for i in set((np.searchsorted(starts, odd, "right") - 1).tolist()):
                begin[starts[i] : stops[i]] = False
        begin[starts] = True
        begin = np.flatnonzero(begin)
        laid = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        piece = self.numbered(values(laid.dictionary))[laid.indices.to_numpy(zero_copy_only=False)]
        upto = np.searchsorted(begin, ends)
        # a text with a piece that does not come back has no tokens
        wrong = np.diff(np.concatenate(([0], np.cumsum(~self.valid[piece])))[np.concatenate(([0], upto))]) > 0
        if wrong.any():
            of = np.repeat(np.arange(len(ends)), np.diff(upto, prepend=0))
            piece = piece[~wrong[of]]
            upto = np.cumsum(np.where(wrong, 0, np.diff(upto, prepend=0)))
        return piece, upto


_aligners: dict[tuple, Aligner] = {}


def aligner(path_a: str | None, path_b: str | None) -> Aligner:
    """This worker's aligner for two vocabularies."""
    key = (path_a, path_b)
    if key not in _aligners:
        _aligners[key] = Aligner(path_a, path_b)
    return _aligners[key]


def _count(path_a: str | None, path_b: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        uses = np.zeros(1 << 14, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            n = both.counts[: both.size, 3]
            pairs, at = np.unique(both.pairs(0), return_inverse=True)
            total = np.bincount(at, np.repeat(uses[: both.size], n), len(pairs)).astype(np.int64) if len(pairs) else np.empty(0, np.int64)
            for i in range(0, len(pairs), 1 << 16):
                hit = total[i : i + (1 << 16)] > 0
                yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + (1 << 16)][hit]), pa.array(total[i : i + (1 << 16)][hit])], names=["pair", "n"])

        for b in batches:
            for _, piece, _ends in both.column(b.column(0)):
                if both.size > len(uses):
                    uses = np.concatenate((uses, np.zeros(both.size, np.int64)))
                uses += np.bincount(piece, minlength=len(uses))
                if both.full():
                    yield from flush()
                    both.forget()
                    uses[:] = 0
        if uses.any():
            yield from flush()

    return run


def pair_counts(docs: DataFrame, text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(pair, n, best) of each pair of ids with a link, a << 24 | b: how many links hold it, and whether no pair of its B id has more."""
    made = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(path_a, path_b), "pair long, n long")
    total = made.groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << BITS) - 1))
    return total.withColumn("best", F.col("n") == F.max("n").over(of_b))


_PAIR = pa.list_(pa.struct([("pair", pa.int64()), ("links", pa.int64())]))


class Scores:
    """Per piece of an aligner: the sum of its links' counts and its links that are best, as far as the pairs are known here."""

    def __init__(self, both: Aligner, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.both, self.known = both, known
        self.forget()

    def forget(self) -> None:
        self.batches = self.size = 0
        self.sums = np.zeros((0, 2), np.int64)
        self.rare: dict[int, list[int]] = {}  # pairs that are not known here, by piece

    def catch_up(self) -> None:
        if self.size == self.both.size:
            return
        pairs, n, best = self.known
        links = self.both.pairs(self.batches)
        per = self.both.counts[self.size : self.both.size, 3]
        if len(pairs):
            at = np.minimum(np.searchsorted(pairs, links), len(pairs) - 1)
            here = pairs[at] == links
            score, top = np.where(here, n[at], 0), here & best[at]
        else:
            here = top = np.zeros(len(links), bool)
            score = np.zeros(len(links), np.int64)
        edge = np.concatenate(([0], np.cumsum(per)))
        sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[edge]) for x in (score, top)]
        missing = np.flatnonzero(~here)
        for piece, pair in zip((np.searchsorted(edge, missing, "right") - 1 + self.size).tolist(), links[missing].tolist(), strict=True):
            self.rare.setdefault(piece, []).append(pair)
        self.sums = np.concatenate((self.sums, np.stack(sums, 1)))
        self.batches, self.size = len(self.both.links), self.both.size


def _score(path_a: str | None, path_b: str | None, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        both = aligner(path_a, path_b)
        scores = Scores(both, sent.value)
        for b in batches:
            for at, piece, ends in both.column(b.column(1)):
                scores.catch_up()
                edge = np.concatenate(([0], ends))
                # a column at a time, as there are many pieces
                sums = [np.diff(np.concatenate(([0], np.cumsum(table[piece, i])))[edge]) for table, n in ((both.counts, 4), (scores.sums, 2)) for i in range(n)]
                text, listed, rare = [], piece.tolist(), []
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    text.append(";".join([both.groups[i] for i in listed[x:y]]))
                    found = Counter(pair for i in listed[x:y] if i in scores.rare for pair in scores.rare[i]) if scores.rare else {}
                    rare.append([{"pair": k, "links": v} for k, v in found.items()])
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "count_sum", "n_best", "groups", "rare"]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ends)), *map(pa.array, sums), pa.array(text), pa.array(rare, _PAIR)], names=names)
                if both.full():
                    both.forget()
                    scores.forget()

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, sent_pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row; groups as `a1,a2|b1;a3|b2,b3`."""
    spark = docs.sparkSession
    pairs = materialize(pair_counts(docs, text_col, path_a, path_b), "pairs")
    more = pairs.count() > sent_pairs
    frequent = (pairs.orderBy(F.desc("n"), "pair").limit(sent_pairs) if more else pairs).toArrow()
    order = np.argsort(frequent["pair"].to_numpy())
    sent = spark.sparkContext.broadcast(tuple(frequent[c].to_numpy()[order] for c in ("pair", "n", "best")))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    found = narrow.mapInArrow(_score(path_a, path_b, sent), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, count_sum long, n_best long, groups string, rare array<struct<pair:long,links:long>>")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    if not more:
        return found.select(columns)
    found = found.withColumn("digest", F.sha2("groups", 256))
    texts = found.where(F.size("rare") > 0).groupBy("digest").agg(F.first("rare").alias("rare"))
    rest = texts.select("digest", F.inline("rare")).join(pairs, "pair").groupBy("digest").agg(F.sum(F.col("links") * F.col("n")).alias("sum_rest"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("best_rest"))
    summed = join_small(found, materialize(rest, "rare-pairs"), "digest")
    return summed.withColumns({"count_sum": F.col("count_sum") + F.coalesce("sum_rest", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("best_rest", F.lit(0))}).select(columns)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return found.withColumn("groups_sha256", digest).drop("groups")
