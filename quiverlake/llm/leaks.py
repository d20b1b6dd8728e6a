"""Evaluation texts that reappear in training texts (problem 9).

The words of all items go into one generalised suffix automaton. A document's words run through
it once; after each word the automaton holds the longest stretch of words, ending there, that
occurs in some item. Where that stretch has min_words words or more, the items that hold its last
min_words words have leaked. The corpus is read once, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Consecutive words of an item that make a leak.
MIN_WORDS = 10
#: A document of which a larger part leaked is to be dropped as a whole.
MAX_COVERAGE = 0.5
#: Characters of item text in one automaton; more items are taken in several passes. An automaton has
#: at most two states and three edges a word, some 250 bytes in all, so one of this size takes 150 MB.
MAX_ITEM_CHARS = 2_000_000

_WORD = re.compile(r"[^\W_]+")
_FORMAT = {c: None for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf"}


def normal(text: str) -> str:
    """Compatibility forms, letter case and invisible format characters removed."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).translate(_FORMAT).casefold()).translate(_FORMAT)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits in normal form."""
    return _WORD.findall(normal(text)) if text else []


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """Words with the stretch of the original text that each stands in."""
    chars: list[str] = []
    at: list[int] = []
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and (unicodedata.combining(text[j]) or ord(text[j]) in _FORMAT):
            j += 1
        for c in normal(text[i:j]):
            chars.append(c)
            at.append(i)
        i = j
    at.append(len(text))
    return [(m[0], at[m.start()], at[m.end()] if at[m.end()] > at[m.end() - 1] else at[m.end() - 1] + 1) for m in _WORD.finditer("".join(chars))]


class ItemAutomaton:
    """Generalised suffix automaton over the words of items.

    States are numbers; links and lengths are arrays, and the edges of all states lie in one table
    by state * width + word. While it is built, each state's own edges are kept, to be copied.
    """

    def __init__(self, items: Iterable[tuple[int, list[str]]], min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.number: dict[str, int] = {}
        sequences = [(i, [self.number.setdefault(w, len(self.number)) for w in ws]) for i, ws in items if len(ws) >= min_words]
        self.width = len(self.number) + 1
        self.link, self.length = array("i", [-1]), array("i", [0])
        outgoing: list[dict[int, int]] = [{}]
        for _, seq in sequences:
            last = 0
            for w in seq:
                last = self._extend(outgoing, last, w)
        self.edges = {}
        for s, own in enumerate(outgoing):
            at = s * self.width
            for w, to in own.items():
                self.edges[at + w] = to
            outgoing[s] = None
        self._note_items(sequences)

    def _state(self, outgoing: list, length: int, edges: dict[int, int], link: int) -> int:
        outgoing.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(outgoing) - 1

    def _split(self, outgoing: list, p: int, w: int, q: int) -> int:
        """A copy of q for the shorter stretches that reach it from p and its suffixes."""
        copy = self._state(outgoing, self.length[p] + 1, dict(outgoing[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and outgoing[p].get(w) == q:
            outgoing[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, outgoing: list, last: int, w: int) -> int:
        q = outgoing[last].get(w)
        if q is not None:  # an earlier item has the same stretch
            return q if self.length[q] == self.length[last] + 1 else self._split(outgoing, last, w, q)
        new = self._state(outgoing, self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in outgoing[p]:
            outgoing[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = outgoing[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(outgoing, p, w, q)
        return new

    def _note_items(self, sequences: list[tuple[int, list[int]]]) -> None:
        n = self.min_words
        #: The state of the last min_words words of a state's stretches, -1 if they are shorter.
        self.short = array("i", [-1]) * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            if self.length[s] >= n:
                up = self.link[s]
                self.short[s] = self.short[up] if self.length[up] >= n else s
        held: dict[int, set[int]] = {}
        for item, seq in sequences:
            for s, size in self._walk(seq):
                if size >= n:
                    held.setdefault(self.short[s], set()).add(item)
        self.items = {s: tuple(sorted(i)) for s, i in held.items()}

    def _walk(self, seq: Iterable[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest known stretch after each word."""
        edge, link, length, width = self.edges.get, self.link, self.length, self.width
        s = size = 0
        for w in seq:
            to = edge(s * width + w)
            while to is None and s:
                s = link[s]
                size = length[s]
                to = edge(s * width + w)
            if to is None:
                size = 0
            else:
                s = to
                size += 1
            yield s, size

    def leaked(self, ws: list[str]) -> set[int]:
        """Items of which the words hold min_words consecutive ones."""
        n, short = self.min_words, self.short
        number, unknown = self.number.get, self.width - 1
        ends = {short[s] for s, size in self._walk([number(w, unknown) for w in ws]) if size >= n}
        return {i for s in ends for i in self.items[s]}

    def spans(self, ws: list[str]) -> list[tuple[int, int]]:
        """Stretches of words that leaked, joined where they touch, in order."""
        number, unknown = self.number.get, self.width - 1
        out: list[list[int]] = []
        for k, (_, size) in enumerate(self._walk([number(w, unknown) for w in ws])):
            if size >= self.min_words:
                start = k + 1 - size
                while out and out[-1][0] >= start:
                    out.pop()
                if out and out[-1][1] >= start:
                    out[-1][1] = k + 1
                else:
                    out.append([start, k + 1])
        return [(a, b) for a, b in out]


def _automata(items: DataFrame, min_words: int, max_chars: int) -> Iterator[ItemAutomaton]:
    """One automaton, or several if the items exceed max_chars; each is collected and built by itself,
    when its turn comes."""
    own = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint"), F.col("text"))
    chars = own.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    parts = max(1, -(-chars // max_chars))
    for k in range(parts):
        part = own if parts == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        rows = sorted((r[0], r[1]) for r in part.collect())
        yield ItemAutomaton([(i, words(t)) for i, t in rows], min_words)


def leaked_items(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_item_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id), one row for each item of which a document's text holds min_words
    consecutive words.

    docs: doc_id, text; items: item_id, text; further columns are ignored. Null and empty texts
    and null item ids leak nothing; items with fewer words can't leak. Repeated documents give
    repeated rows, repeated items none. Empty tables give no rows. The automaton is broadcast; its
    size is bounded by max_item_chars, beyond which the corpus is read once for each part of the
    items.
    """
    spark = docs.sparkSession
    fields = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", T.LongType())])
    out = None
    for automaton in _automata(items, min_words, max_item_chars):
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a = shared.value
            for b in batches:
                rows, found = [], []
                for k, text in enumerate(b.column(1).to_pylist()):
                    for i in sorted(a.leaked(words(text))) if text else ():
                        rows.append(k)
                        found.append(i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

        part = docs.select("doc_id", "text").mapInArrow(run, fields)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_coverage: float = MAX_COVERAGE, max_item_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """(doc_id, n_words, n_leaked, dropped, clean_text), one row per document.

    Stretches that leaked are cut out of the text; a document of which more than max_coverage of
    the words leaked is dropped (clean_text null). Other texts stay as they are. Repeated documents
    are cleaned alike. Items beyond max_item_chars take several passes over the corpus, whose
    stretches are joined by document and text.
    """
    spark = docs.sparkSession
    fields = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_leaked", T.LongType())]
        + [T.StructField("dropped", T.BooleanType()), T.StructField("clean_text", T.StringType())]
    )
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    own = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("q_key"))
    passes = [spark.sparkContext.broadcast(a) for a in _automata(items, min_words, max_item_chars)]

    def found(shared) -> DataFrame:
        """(q_key, q_spans) of the texts of which stretches leaked."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, spans = [], []
                for k, text in enumerate(b.column(1).to_pylist()):
                    if text and shared.value.leaked(words(text)) and (own := shared.value.spans([w for w, _, _ in placed_words(text)])):
                        rows.append(k)
                        spans.append([x for pair in own for x in pair])
                yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(rows, pa.int64())), pa.array(spans, pa.list_(pa.int32()))], names=["q_key", "q_spans"])

        return own.mapInArrow(run, "q_key bigint, q_spans array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
            if b.num_columns < 4:  # a single pass, whose stretches are found here
                a = passes[0].value
                for k, text in enumerate(b.column(1).to_pylist()):
                    if text and a.leaked(words(text)):
                        spans[k] = [x for pair in a.spans([w for w, _, _ in placed_words(text)]) for x in pair]
            cols = list(zip(*(_clean(t, s, max_coverage) for t, s in zip(b.column(1).to_pylist(), spans)))) if b.num_rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=fields.names)

    if len(passes) == 1:
        return own.mapInArrow(cut, fields)
    hits = reduce(DataFrame.unionByName, map(found, passes)).distinct().groupBy("q_key").agg(F.flatten(F.collect_list("q_spans")).alias("q_spans"))
    return own.join(hits, "q_key", "left").select("doc_id", "text", "q_key", "q_spans").mapInArrow(cut, fields)


def _clean(text: str | None, spans: list[int] | None, max_coverage: float) -> tuple[int, int, bool, str | None]:
    """Words, leaked words, whether the text is dropped, and the text without its leaked stretches, of
    which spans has the first words and the words after the last."""
    if not spans:
        return len(words(text)), 0, False, text
    placed = placed_words(text)
    hit = bytearray(len(placed))
    for i, j in zip(spans[::2], spans[1::2]):
        hit[i:j] = b"\1" * (j - i)
    n = sum(hit)
    if n > max_coverage * len(placed):
        return len(placed), n, True, None
    kept, at, k = [], 0, 0
    while k < len(placed):
        if not hit[k]:
            k += 1
            continue
        e = k
        while e < len(placed) and hit[e]:
            e += 1
        kept.append(text[at : placed[k][1]])
        at = placed[e - 1][2]
        k = e
    return len(placed), n, False, "".join([*kept, text[at:]])
