"""Token ids of whole texts by a public byte-level BPE vocabulary, for the operators that write tokens."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The vocabulary's end-of-document id, which no ordinary text is encoded to.
END_OF_TEXT = 50256
#: Pieces kept per worker.
MEMO = 600_000
#: Longer pieces, in bytes, are not kept.
LONGEST = 64
#: Bytes of texts that are cut and encoded at a time; a longer text by itself.
TEXTS = 1 << 22
#: Classes of bytes.
SPACE, LETTER, SIGN, LEAD = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] |= SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= LETTER
_CLASS[list(b".,;:!?%&*#$)")] |= SIGN
_CLASS[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF, 0x3C]] |= LEAD
#: Pieces that are one pre-token for sure: letters, digits or signs, after a space or not.
ONE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[.,;:!?%&*#$)]+)").fullmatch
#: The character that stands for each byte in a byte-level vocabulary: itself where it can be printed, else the next one from 256 on.
PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
SHOWN = {b: b if b in PRINTED else 256 + sum(x not in PRINTED for x in range(b)) for b in range(256)}
#: White space on which Unicode tables differ, and the special token's string: a text with one is encoded in one piece.
ODD = (b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", *(chr(c).encode() for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)), b"<|endoftext|>")


def vocabulary() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def odd_places(data: np.ndarray, kind: np.ndarray) -> list[int]:
    """Where a string of ODD begins."""
    leads = np.flatnonzero(kind & LEAD)
    return [i for i in leads.tolist() if data[i : i + 13].tobytes().startswith(ODD)] if len(leads) else []


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts that begin at `starts` begin, ascending; no pre-token crosses such a place.

    A piece begins with white space that follows none, after a line feed that stands alone, at a sign that
    follows a Latin letter, and with each text. What a piece is encoded to does not depend on what stands
    around it. A text with a string of ODD is one piece.
    """
    kind = _CLASS[data]
    space = (kind & SPACE).astype(bool)
    begin = np.zeros(len(data), bool)
    begin[1:] = space[1:] & ~space[:-1]
    begin[2:] |= ~space[2:] & (data[1:-1] == 0x0A) & ~space[:-2]
    letter = (kind & LETTER).astype(bool)
    accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter[1:] |= accented
    begin[1:] |= (kind[1:] & SIGN).astype(bool) & letter[:-1]
    if odd := odd_places(data, kind):
        ends = np.append(starts[1:], len(data))
        for i in set((np.searchsorted(starts, odd, "right") - 1).tolist()):
            begin[starts[i] : ends[i]] = False
    begin[starts[starts < len(data)]] = True
    return np.flatnonzero(begin)


def values(column: pa.Array) -> list[bytes]:
    """A binary column without NULLs as a list."""
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).tolist()
    raw = column.buffers()[2].to_pybytes()
    return [raw[x:y] for x, y in zip(at, at[1:], strict=False)]


class Encoder:
    """Encodes texts; pieces seen before come from a memo of bounded size, as equal pieces have equal ids.

    Texts are cut into pieces and the pieces numbered by their bytes, all in vector operations; only
    distinct pieces of a batch are looked up, and only new ones encoded. New pieces of one pre-token go
    straight to the library's merge model where the vocabulary is byte-level.
    """

    def __init__(self, path: str | None = None, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or vocabulary())
        split = self.tokenizer.pre_tokenizer
        plain = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space and self.tokenizer.normalizer is None
        self.model = self.tokenizer.model if plain and isinstance(self.tokenizer.model, models.BPE) else None
        self.tokenizer.encode_special_tokens = special_as_text
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}  # the number of a piece
        self.ids = np.empty(1 << 16, self.width)  # the pieces' ids, one piece after the other
        self.ends = np.zeros((1 << 14) + 1, np.int64)  # where the ids of piece i end, at i + 1

    def fresh(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        out: list = [None] * len(pieces)
        rest = []
        tokenize = self.model.tokenize if self.model else None
        for i, p in enumerate(pieces):
            if tokenize and ONE(p):
                out[i] = [t.id for t in tokenize(p.decode("latin-1").translate(SHOWN))]
            else:
                rest.append(i)
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False) if rest else (), strict=True):
            out[i] = x.ids
        return out

    def numbered(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece in the memo, new ones added; those too long to keep come last and are not remembered."""
        get = self.known.get
        found = list(map(get, pieces))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            new.sort(key=lambda i: len(pieces[i]) > LONGEST)
            made = self.fresh([pieces[i] for i in new])
            n = len(self.known)
            ends = self.ends[n] + np.cumsum([len(x) for x in made])
            if n + len(new) >= len(self.ends):
                self.ends = np.concatenate((self.ends, np.zeros(n + len(new), np.int64)))
            if ends[-1] > len(self.ids):
                self.ids = np.concatenate((self.ids, np.empty(int(ends[-1]), self.width)))
            self.ends[n + 1 : n + 1 + len(new)] = ends
            self.ids[self.ends[n] : ends[-1]] = np.fromiter(chain.from_iterable(made), self.width, int(ends[-1] - self.ends[n]))
            for at, i in enumerate(new, n):
                found[i] = at
                if len(pieces[i]) <= LONGEST:
                    self.known[pieces[i]] = at
        return np.array(found, np.int64)

    def flat(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts that end at `ends` in their bytes."""
        if not len(data):
            return np.empty(0, self.width), np.zeros(len(ends), np.int64)
        if len(self.known) > MEMO:
            self.forget()
        starts = ends - np.diff(ends, prepend=0)
        begin = cuts(data, starts[starts < ends])
        offsets = pa.py_buffer(np.append(begin, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        piece = self.numbered(values(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
        first, length = self.ends[piece], self.ends[piece + 1] - self.ends[piece]
        done = np.cumsum(length)
        ids = self.ids[np.repeat(first - done + length, length) + np.arange(int(done[-1]))]
        upto = np.concatenate(([0], done))
        return ids, np.diff(upto[np.searchsorted(begin, ends)], prepend=0)

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, number of ids of each row) of a column of texts, by bounded pieces of it; none for NULL and the empty text."""
        column = pc.fill_null(column, "").cast(pa.string())
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if len(column) else np.zeros(1, np.int64)
        at = 0
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TEXTS, "right")) - 1)
            low, high = int(offsets[at]), int(offsets[stop])
            data = np.frombuffer(column.buffers()[2], np.uint8, high - low, low) if high > low else np.empty(0, np.uint8)
            yield at, *self.flat(data, offsets[at + 1 : stop + 1] - low)
            at = stop

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text."""
        out: list[np.ndarray] = []
        for _, ids, counts in self.encode_column(pa.array(texts, pa.string())):
            out += np.split(ids, np.cumsum(counts)[:-1])
        return out


def with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """The ids with the end id after each text."""
    return np.insert(ids, np.cumsum(counts), end_id)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str | None, special_as_text: bool) -> Encoder:
    """This worker's encoder for a vocabulary."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(path, special_as_text)
    return _encoders[key]
