"""Encoding texts with a public byte-pair vocabulary (problem 8).

The encoder never runs the merges. One Aho-Corasick pass finds the longest vocabulary entry that
starts at each byte; the encoder then walks forward with these longest entries and steps back to a
shorter one (or gives up an entry and the position it ended at) whenever two neighbours could not
stand side by side after the merges. Whether a pair can stand is a property of the pair alone: it
can't if some merge across their border would have been made before either of them was complete. No
position is given up twice, so the work is linear in the text, whatever it repeats.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces kept with their ids; the store is emptied when it is full, which changes no result.
MEMO = 200_000
#: Largest vocabulary file sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20


def read_ranks(data: bytes) -> list[bytes]:
    """Entries by id of a rank file (lines of base64 entry and id)."""
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    out: list[bytes] = [b""] * (max(int(i) for _, i in pairs) + 1)
    for entry, i in pairs:
        out[int(i)] = base64.b64decode(entry)
    return out


class PairTable:
    """How each entry is made of two others, and which entries can be neighbours.

    An entry's own parts are the one way to cut it whose halves can be neighbours under the
    merges that come before it; they are found in order of rank.
    """

    def __init__(self, entries: Sequence[bytes]):
        ids = {e: i for i, e in enumerate(entries) if e}
        self.left = list(range(len(entries)))
        self.right = list(range(len(entries)))
        self.merged: dict[tuple[int, int], int] = {}
        for i, e in enumerate(entries):
            for cut in range(1, len(e)):
                a, b = ids.get(e[:cut]), ids.get(e[cut:])
                if a is not None and b is not None and a < i and b < i and self.can_stand(a, b):
                    self.left[i], self.right[i] = a, b
                    self.merged[a, b] = i
                    break

    def can_stand(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b side by side.

        The younger of the two is undone step by step at the border. At each step a merge across
        the border that is older than what was undone would have been made instead.
        """
        left, right, merged = self.left, self.right, self.merged
        bound = 1 << 62
        while True:
            m = merged.get((a, b))
            if m is not None and m < bound:
                return False
            # On equal rank the right one is undone first: merges run from left to right.
            undo_left = a > b
            for _ in range(2):
                if undo_left and right[a] != a:
                    bound, a = a, right[a]
                    break
                if not undo_left and left[b] != b:
                    # A merge of the same rank further left would still come first.
                    bound, b = b + 1, left[b]
                    break
                undo_left = not undo_left
            else:
                return True


class Encoder:
    """byte-pair encoder over entries; pattern splits texts into pieces that don't merge."""

    def __init__(self, entries: Sequence[bytes], pattern: str):
        self.entries = entries
        self.pairs = PairTable(entries)
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}
        ids = {e: i for i, e in enumerate(entries) if e}
        self.size = [len(e) for e in entries]
        self.search = ahocorasick.Automaton()
        for e, i in ids.items():
            self.search.add_word(e.decode("latin-1"), i)
        self.search.make_automaton()
        #: The longest entry that is a proper prefix of each entry, -1 without one.
        self.shorter = [-1] * len(entries)
        for e, i in ids.items():
            for n in range(len(e) - 1, 0, -1):
                if (j := ids.get(e[:n])) is not None:
                    self.shorter[i] = j
                    break

    def encode_piece(self, piece: bytes) -> list[int]:
        size, shorter, can_stand = self.size, self.shorter, self.pairs.can_stand
        end = len(piece)
        longest = [-1] * end
        for last, i in self.search.iter(piece.decode("latin-1")):
            longest[last + 1 - size[i]] = i  # matches come in order of their ends: the last is the longest
        dead = bytearray(end + 1)
        out: list[int] = []
        at = 0
        entry = longest[0] if end else -1
        while at < end:
            before = out[-1] if out else -1
            while entry >= 0:
                to = at + size[entry]
                if not dead[to] and (before < 0 or can_stand(before, entry)):
                    break
                entry = shorter[entry]
            if entry >= 0:
                out.append(entry)
                at += size[entry]
                entry = longest[at] if at < end else -1
            elif out:
                dead[at] = 1
                entry = out.pop()
                at -= size[entry]
                entry = shorter[entry]
            else:
                raise ValueError("the vocabulary doesn't cover all bytes")
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty texts."""
        out: list[int] = []
        memo = self.memo
        for piece in self.split(text) if text else ():
            ids = memo.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode("utf-8")))
                if len(piece) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


class Decoder:
    """All entries in one buffer, and an offset table into it."""

    def __init__(self, entries: Sequence[bytes]):
        self.offsets = np.zeros(len(entries) + 1, np.int64)
        np.cumsum([len(e) for e in entries], out=self.offsets[1:])
        self.buffer = np.frombuffer(b"".join(entries), np.uint8)

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids; bytes that aren't UTF-8 become replacement characters."""
        i = np.asarray(ids, np.int64)
        if not len(i):
            return ""
        start, n = self.offsets[i], self.offsets[i + 1] - self.offsets[i]
        at = np.arange(n.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return self.buffer[at].tobytes().decode("utf-8", "replace")


_tables: dict[tuple[int, str, str], object] = {}


def _cached(kind: type, data: bytes, pattern: str = ""):
    """One table a Python worker."""
    key = (hash(data), pattern, kind.__name__)
    if key not in _tables:
        _tables[key] = kind(read_ranks(data), pattern) if pattern else kind(read_ranks(data))
    return _tables[key]


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to be sent to the executors")
    return data


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids) of each row: the ids of its text by the rank file at ``path``.

    No special tokens are added, and their strings in a text are ordinary text. Null and empty
    texts give an empty list; null ids and repeated rows stay as they are; further columns are
    ignored; an empty table gives no rows. There is no shuffle.
    """
    data = docs.sparkSession.sparkContext.broadcast(_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _cached(Encoder, data.value, pattern)
        for b in batches:
            flat: list[int] = []
            offsets = np.zeros(b.num_rows + 1, np.int32)
            for k, text in enumerate(b.column(1).to_pylist()):
                flat += encoder.encode(text)
                offsets[k + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    key = docs.schema[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([key, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of lists of ids as from encode_texts; a null list gives a null text."""
    data = encoded.sparkSession.sparkContext.broadcast(_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _cached(Decoder, data.value)
        for b in batches:
            texts = [None if ids is None else decoder.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    key = encoded.schema[id_col]
    return encoded.select(id_col, ids_col).mapInArrow(run, T.StructType([key, T.StructField("text", T.StringType())]))
