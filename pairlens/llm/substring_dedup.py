"""Substring dedup by recompression.

A round names maximal runs of one symbol, then pairs of a left and a right symbol (a symbol's side is
a hash bit of its name). Within a chunk of documents a name is a hash of what it stands for. With each
symbol goes the span of words that its existence depends on: wherever those words recur, the same
symbol recurs (its "interior" part of a repeat).

Spark round 1 (name): the symbols after ``levels[0]`` rounds are named for all documents: equal ones,
by two independent hashes of 64 bits, get one number, and one that a single chunk holds in a single
document gets none. Further rounds build on these numbers, and a symbol made of parts without number
cannot recur. The same round reveals, of the symbols after ``rounds`` rounds whose span fits in a
window, those that several documents hold.
Spark round 2 (shared high levels): of the symbols after ``levels[0]`` and after ``levels[1]`` rounds,
those made of numbered parts only whose span holds a window are compared by all words of the span;
each learns the smallest document with it. Where that is another, all windows of the span are repeats
at once.
Spark round 3 (verify): of the other windows, those that hold a shared low symbol, and those that hold
no complete one at all, are compared by all their words; each learns the smallest document with that
window. (The smallest document that holds a window never leaves it out: a span that decides it lies
in a smaller one.) Words covered by a window that begins in a smaller document go.

Words are named by 64 bits; named symbols, windows and spans are compared by two independent 64-bit
hashes of all their words, low symbols by the bits that choose their bucket and ``LOW_BITS`` more: two
that agree by chance only add windows to verify. All rounds use ``exchange``: equal keys of a chunk of documents are one entry, so a
passage in a third of all documents is one entry a chunk.

Defined results: null and empty texts have no words; a null id counts as larger than all others;
rows of one id never remove each other's words, though rows of smaller id do; documents of any
length are handled whole; further columns pass through, one that bears the name of an added column
gets ``_`` appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, apart, col, cut, mix, other_window_names, text_buffers, window_names, word_names, word_spans
from .exchange import Combine, aligned, chunked, numbered, receive, reduced, send, shape, slices

_U = np.uint64
LARGEST = 2**63 - 1
OUTSIDE = 2**31 - 1  # beyond the words of a chunk
LOW, NAME, HIGH, WINDOW = 0, 1, 2, 3  # streams of keys
LOW_BITS = 32  # of a low symbol's key that are compared within a bucket, whose mean size is fixed


class Symbols:
    """Consecutive symbols of all documents of a chunk.

    ``start`` is the first word of each, ``low`` and ``high`` bound what it depends on; ``shared``:
    all its parts may recur in other documents.
    """

    def __init__(self, names: np.ndarray, doc: np.ndarray):
        at = np.arange(len(names) + 1, dtype=np.int32)
        self.name, self.doc, self.low, self.high, self.start = names, doc.astype(np.int32), at[:-1], at[1:], at[:-1]
        self.shared = np.ones(len(names), bool)

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """``low`` of each symbol's left and ``high`` of its right neighbour; a missing one (document edge) makes spans reach outside."""
        edge = self.doc[1:] != self.doc[:-1]
        low, high = np.full(len(self.doc), -1, np.int32), np.full(len(self.doc), OUTSIDE, np.int32)
        np.copyto(low[1:], self.low[:-1], where=~edge)
        np.copyto(high[:-1], self.high[1:], where=~edge)
        return low, high

    # Within a document neither ``low`` nor ``high`` ever falls, so the outermost parts of a symbol bound its span.

    def runs(self) -> None:
        """Name maximal runs; that a run ends depends on both neighbours."""
        n = len(self.name)
        if not n:
            return
        new = np.ones(n, bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        long = np.flatnonzero(last > first)
        name = self.name[first]
        name[long] = mix(name[long] * _U(0xE7037ED1A0B428DB) + (last - first + 1)[long].astype(np.uint64))
        low, high = self._neighbours()
        self.shared = np.logical_and.reduceat(self.shared, first)
        self.name, self.doc, self.low, self.high, self.start = name, self.doc[first], low[first], high[last], self.start[first]

    def pairs(self, salt: int) -> None:
        """Name neighbours (left side, right side); that a symbol stays alone depends on one neighbour."""
        n = len(self.name)
        if not n:
            return
        right = (mix(self.name + _U(salt)) & _U(1)).astype(bool)
        joins = np.zeros(n, bool)  # with the next symbol
        joins[:-1] = ~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1])
        head = np.ones(n, bool)
        head[1:] = ~joins[:-1]
        at, two = np.flatnonzero(head), np.flatnonzero(joins)
        name = self.name.copy()
        name[two] = mix(name[two] * _U(0x8EBC6AF09C88C6E3) + name[two + 1] * _U(0x589965CC75374CC3) + _U(salt))
        low, high = self._neighbours()  # of a left one's right neighbour, joined or not; of a right one alone, its left neighbour
        np.copyto(low, self.low, where=~right)
        np.copyto(high, self.high, where=right)
        shared = self.shared.copy()
        shared[two] &= shared[two + 1]
        self.name, self.doc, self.low, self.high, self.start, self.shared = name[at], self.doc[at], low[at], high[at], self.start[at], shared[at]


_STEP, _OTHER_STEP = 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _Contents:
    """Hashes of the words of any spans."""

    def __init__(self, names: np.ndarray, step: int):
        self.sums = np.zeros(len(names) + 1, np.uint64)
        np.cumsum(names * _powers(step, len(names)), out=self.sums[1:])
        self.back = _powers(pow(step, -1, 1 << 64), len(names) + 1)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (self.sums[high] - self.sums[low]) * self.back[low]


def _distinct(names: np.ndarray, others: np.ndarray, ids: np.ndarray):
    """Distinct keys of two halves in order, the key number of each entry, and (other half, smallest id) of each key."""
    of, n = numbered(names, others)
    keys, other, lowest = np.empty(n, np.uint64), np.empty(n, np.int64), np.full(n, LARGEST)
    keys[of], other[of] = names, others
    np.minimum.at(lowest, of, ids)
    return keys, of, np.stack([other, lowest], axis=1)


def _several(of: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Whether several ids hold each of the keys 0 .. n - 1, of which entry i has ``of[i]``."""
    lowest, highest = np.full(n, LARGEST), np.full(n, -LARGEST - 1)
    np.minimum.at(lowest, of, ids)
    np.maximum.at(highest, of, ids)
    return (lowest != highest).astype(np.int64)


class Chunk:
    """Words, windows and complete symbols of a chunk of documents."""

    def __init__(self, docs: pa.RecordBatch, width: int, rounds: int, levels: tuple[int, int]):
        data, at = text_buffers(docs.column(docs.schema.get_field_index("text")))
        starts, ends, self.at = word_spans(data, at, WHITE)
        self.names = word_names(data, starts, ends)
        self.width, n = width, len(self.names)
        size = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(size)), size)
        ids = docs.column(docs.schema.get_field_index("id")).fill_null(LARGEST).to_numpy(zero_copy_only=False)
        self.id_of = ids[self.doc] if n else np.zeros(0, np.int64)
        # starts of whole windows
        begins = np.arange(n) + width <= self.at[1:][self.doc] if n else np.zeros(0, bool)
        self.windows = begins
        content = _Contents(self.names, _STEP)
        s = Symbols(self.names, self.doc)
        self._rounds(s, 0, rounds)
        low, high, doc_low, doc_high, self.keys = self._complete(s, content)
        # windows [first, last] that hold the whole span
        self.first, self.last = np.maximum(high - width, doc_low), np.minimum(low, doc_high - width)
        fits = (high - low <= width) & (self.last >= self.first)
        self.keys, self.first, self.last = self.keys[fits], self.first[fits], self.last[fits]
        # symbols to be named in Spark: two halves of each one's key, from its parts and from its words
        self._rounds(s, rounds, levels[0])
        self.content, self.other = content, _Contents(mix(self.names), _OTHER_STEP)
        end = np.append(s.start[1:], n)[: len(s.name)]
        other = mix(self.other.of(s.start, end)).view(np.int64)
        keys, of, values = _distinct(s.name, other, self.id_of[s.start])
        values[:, 1] = _several(of, self.id_of[s.start], len(keys))
        self.symbols_, self.titles, self.levels = s, (keys, of, values), levels

    def named(self, numbers: np.ndarray) -> None:
        """Go on from the numbers that the distinct symbols got in Spark (0: none) to the spans to compare."""
        s, given = self.symbols_, numbers[self.titles[1]]
        s.shared = given > 0
        s.name = np.where(s.shared, given.view(np.uint64), s.name)
        spans = [self._long(s)]
        self._rounds(s, *self.levels)
        spans.append(self._long(s))
        self.low, self.high = (np.concatenate(x) for x in zip(*spans))
        keys, other = (mix(c.of(self.low, self.high) + (self.high - self.low).astype(np.uint64)) for c in (self.content, self.other))
        self.spans = _distinct(keys, other.view(np.int64), self.id_of[self.low])

    def _long(self, s: Symbols) -> tuple[np.ndarray, np.ndarray]:
        """Spans, of a window at least, of complete symbols whose parts may all recur."""
        own = s.shared & (s.low >= self.at[:-1][s.doc]) & (s.high <= self.at[1:][s.doc]) & (s.high - s.low >= self.width)
        return s.low[own], s.high[own]

    @staticmethod
    def _rounds(s: Symbols, first: int, end: int) -> None:
        for k in range(first, end):
            s.runs()
            s.pairs(2 * k + 1)

    def _complete(self, s: Symbols, content: _Contents):
        """Spans of the symbols that depend on their own document only, its bounds, and keys of name and words."""
        doc_low, doc_high = self.at[:-1][s.doc], self.at[1:][s.doc]
        own = (s.low >= doc_low) & (s.high <= doc_high)
        low, high = s.low[own], s.high[own]
        keys = mix(content.of(low, high) + s.name[own] * _U(0xA24BAED4963EE407) + (high - low).astype(np.uint64))
        return low, high, doc_low[own], doc_high[own], keys

    def decided(self, smallest: np.ndarray) -> np.ndarray:
        """Window starts within spans that a smaller document holds, given the smallest of each distinct span."""
        gone = self.id_of[self.low] > smallest[self.spans[1]]
        edge = np.zeros(len(self.names) + 1, np.int64)
        np.add.at(edge, self.low[gone], 1)
        np.add.at(edge, self.high[gone] - self.width + 1, -1)
        return np.cumsum(edge[:-1]) > 0

    def over(self, chosen: np.ndarray) -> np.ndarray:
        """Window starts that hold one of the chosen symbols."""
        edge = np.zeros(len(self.names) + 1, np.int64)
        np.add.at(edge, self.first[chosen], 1)
        np.add.at(edge, self.last[chosen] + 1, -1)
        return np.cumsum(edge[:-1]) > 0

    def symbols(self, bits: int):
        """Distinct first ``bits`` of symbol keys, the key number of each symbol, and whether several documents hold the key."""
        unsent = _U(max(0, 64 - bits))
        keys, of = np.unique(self.keys >> unsent << unsent, return_inverse=True)
        owner = self.id_of[self.first] if len(self.first) else np.zeros(0, np.int64)
        return keys, of, _several(of, owner, len(keys))[:, None]

    def candidates(self, shared: np.ndarray, decided: np.ndarray):
        """Distinct candidate windows, their occurrences, key numbers, and (other half of the key, smallest id in this chunk)."""
        held = self.over(np.ones(len(self.first), bool))
        at = np.flatnonzero(self.windows & ~decided & (self.over(shared) | ~held))
        none = np.zeros(0, np.uint64)
        names = window_names(self.names, self.width)[at] if len(at) else none
        others = other_window_names(self.names, self.width)[at].view(np.int64) if len(at) else none.view(np.int64)
        keys, of, values = _distinct(names, others, self.id_of[at])
        return keys, at, of, values


class _Rounds(Combine):
    """Low symbols: whether several documents hold them; named ones: their number; spans and windows: the smallest document."""

    def __init__(self, bits: int):
        self.bits = bits

    def paired(self, bucket):
        return bucket >> self.bits != LOW

    def merge(self, bucket, of, values, n):
        if bucket >> self.bits in (LOW, NAME):
            several = (np.bincount(of, minlength=n) > 1) | (np.bincount(of, weights=values[:, 0], minlength=n) > 0)
            return several.astype(np.int64)[:, None]
        lowest = np.full(n, LARGEST)
        np.minimum.at(lowest, of, values[:, 0])
        return lowest[:, None]

    def settle(self, bucket, merged):
        if bucket >> self.bits == NAME:
            place = (bucket & ((1 << self.bits) - 1)) << 32
            merged = merged * (place + np.arange(1, len(merged) + 1))[:, None]
        return merged, [0.0]

    def answer(self, bucket, values, settled):
        # mostly 0, so differences from the chunk's own smallest pack well
        return settled if bucket >> self.bits in (LOW, NAME) else values[:, :1] - settled


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 13, rounds: int = 2, levels: tuple[int, int] = (8, 12), keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) plus n_words, n_removed and kept_text."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    inner = [f"k{i}" for i in range(len(keep))]
    plain = docs.select(*[col(c).alias(n) for c, n in zip(keep, inner)], col(doc_id).cast("long").alias("id"), col(text).alias("text"))
    chunks = chunked(plain, "text")
    bits, groups = shape(chunks)
    combine, sent, sent_bits = _Rounds(bits), "bucket int, chunk long, keys binary, values binary", bits + LOW_BITS

    def name(number: int, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(part, width, rounds, levels)
        keys, _, several = chunk.symbols(sent_bits)
        yield slices(number, LOW, keys, several, bits)
        keys, _, values = chunk.titles
        yield slices(number, NAME, keys, values, bits)

    def named(part: pa.RecordBatch, found: dict) -> Chunk:
        chunk = Chunk(part, width, rounds, levels)
        chunk.named(aligned(found, NAME, chunk.titles[0], bits, 1)[:, 0])
        return chunk

    def compare(number: int, part: pa.RecordBatch, found: dict) -> Iterator[pa.RecordBatch]:
        keys, _, values = named(part, found).spans
        yield slices(number, HIGH, keys, values, bits)

    def open_windows(part: pa.RecordBatch, found: dict):
        """The chunk, its windows that high-level symbols decide, and the candidates among the others."""
        chunk = named(part, found)
        keys, of, _ = chunk.symbols(sent_bits)
        shared = aligned(found, LOW, keys, bits, 1)[of, 0] > 0
        keys, _, values = chunk.spans
        decided = chunk.decided(values[:, 1] - aligned(found, HIGH, keys, bits, 1)[:, 0])
        return chunk, decided, chunk.candidates(shared, decided)

    def verify(number: int, part: pa.RecordBatch, found: dict) -> Iterator[pa.RecordBatch]:
        _, _, (keys, _, _, values) = open_windows(part, found)
        yield slices(number, WINDOW, keys, values, bits)

    schema = T.StructType([*plain.select(*inner).schema.fields, *T.StructType.fromDDL("n_words long, n_removed long, kept_text string").fields])

    def finish(number: int, part: pa.RecordBatch, found: dict) -> Iterator[pa.RecordBatch]:
        chunk, decided, (keys, at, of, values) = open_windows(part, found)
        lowest = values[:, 1] - aligned(found, WINDOW, keys, bits, 1)[:, 0]
        decided[at[chunk.id_of[at] > lowest[of]]] = True
        at = np.flatnonzero(decided)
        edge = np.zeros(len(chunk.names) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[chunk.at])
        kept = []
        for i, value in enumerate(part.column(part.schema.get_field_index("text")).to_pylist()):
            words = (value or "").encode().split()
            if removed[i]:
                words = compress(words, (~gone[chunk.at[i] : chunk.at[i + 1]]).tolist())
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(k)) for k in inner] + [pa.array(np.diff(chunk.at)), pa.array(removed), pa.array(kept, pa.string())], names=schema.names)

    first = cut(reduced(send(chunks, name), combine, groups))
    names = first.where(F.shiftright("bucket", bits) == NAME)
    # not stored: the last query exchanges the chunks once for all that receive them, and what is sent once (ReusedExchange)
    second = reduced(receive(chunks, names, compare, sent), combine, groups)
    known = first.unionByName(second)
    third = reduced(receive(chunks, known, verify, sent), combine, groups)
    out = receive(chunks, known.unionByName(third), finish, schema)
    added = ["n_words", "n_removed", "kept_text"]
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, apart(keep, added))], *added)
