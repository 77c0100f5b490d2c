"""Language-model scoring: interpolated bigrams with deleted-interpolation weights.

p(w | v) = l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1). The weights l depend on the bucket of the
context's count c(v) (its binary order of magnitude) and are learned by expectation-maximisation on
held-out training documents, with counts from the other training documents; the scores then use the
counts of all training documents. A text is its words and one end token; its first context is the
begin mark. For each context p sums to 1 over the V known tokens and one unknown.

Counts come from all training documents through ``exchange``. The held-out tokens reach the driver as
a histogram over (context bucket, p2, p1) with logarithmic cells, whose size does not depend on the
input.

Defined results: a null or empty text is the end token alone. Null training flags count as not in
training. Without training documents every token has probability 1 / (V + 1) = 1. Repeated rows
count and score each on its own; further columns pass through, one that bears the name of an added
column gets ``_`` appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WHITE, apart, col, cut, mix, text_buffers, word_names, word_spans
from .exchange import Combine, aligned, chunked, receive, reduced, send, shape, slices

_U = np.uint64
END, BEGIN = _U(0x9D3F5C1B7A2E4D61), _U(0x1F83D9ABFB41BD6B)
UNIGRAM, BIGRAM = 0, 1
ORDERS = 24  # context buckets: count 0, 1, 2-3, 4-7, ...
CELLS = 4  # histogram cells for each factor of two


def _tokens(docs: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token names, their contexts, and where each document's tokens begin (n + 1 long)."""
    data, at = text_buffers(docs.column(docs.schema.get_field_index("text")))
    data = LOWER[data]
    starts, ends, doc_at = word_spans(data, at, WHITE)
    n = len(at) - 1
    tokens = np.empty(len(starts) + n, np.uint64)
    slot = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(doc_at))
    tokens[slot] = word_names(data, starts, ends)
    token_at = doc_at + np.arange(n + 1)
    tokens[token_at[1:] - 1] = END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[token_at[:-1]] = BEGIN
    return tokens, before, token_at


def _keys(docs: pa.RecordBatch):
    tokens, before, at = _tokens(docs)
    one, of_one = np.unique(tokens, return_inverse=True)
    two, of_two = np.unique(mix(before * _U(0xC2B2AE3D27D4EB4F) + tokens), return_inverse=True)
    return tokens, before, at, one, of_one, two, of_two


def _order(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0), ORDERS - 1).astype(np.int64)


class _Sender:
    def __init__(self, bits: int):
        self.bits = bits

    def __call__(self, chunk: int, docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, _, at, one, of_one, two, of_two = _keys(docs)
        size = np.diff(at)
        part = [np.repeat(docs.column(docs.schema.get_field_index(c)).to_numpy(zero_copy_only=False), size) for c in ("counted", "held")]
        for stream, keys, of in ((UNIGRAM, one, of_one), (BIGRAM, two, of_two)):
            counts = [np.bincount(of[p], minlength=len(keys)) for p in part]
            yield slices(chunk, stream, keys, np.stack(counts, axis=1), self.bits)


class _SumCounts(Combine):
    def __init__(self, bits: int):
        self.bits = bits

    def merge(self, bucket, of, values, n):
        return np.stack([np.bincount(of, weights=values[:, k], minlength=n) for k in (0, 1)], axis=1).astype(np.int64)

    def settle(self, bucket, merged):
        if bucket >> self.bits != UNIGRAM:
            return merged, [0.0, 0.0, 0.0]
        return merged, [float((merged.sum(axis=1) > 0).sum()), float(merged[:, 0].sum()), float(merged.sum())]


def _found(docs: pa.RecordBatch, found: dict, bits: int):
    """Counts (counted part, held-out part) of every token, its context and its bigram."""
    tokens, before, at, one, of_one, two, of_two = _keys(docs)
    uni = aligned(found, UNIGRAM, one, bits, 2)
    bi = aligned(found, BIGRAM, two, bits, 2)[of_two]
    begins = at[:-1]
    own = uni[of_one]
    context = np.zeros_like(own)
    context[1:] = own[:-1]
    return own, context, bi, at, begins


def _cells(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * CELLS), 1).astype(np.int64)  # 1: zero


def learn(cells: list, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (l2, l1, l0) for each context bucket, from (bucket, p2 cell, p1 cell, count) rows."""
    weights = np.tile([0.0, 1 - 1e-3, 1e-3], (ORDERS, 1))
    weights[1:] = [0.4, 0.599, 0.001]
    if not cells:
        return weights
    order, c2, c1, count = np.array(cells, np.float64).T
    value = lambda c: np.where(c == 1, 0.0, 2.0 ** (c / CELLS))
    p = np.stack([value(c2), value(c1), np.full(len(c1), uniform)], axis=1)
    for b in range(ORDERS):
        own = order == b
        if not own.any():
            if b > 1:
                weights[b] = weights[b - 1]
            continue
        q, n, w = p[own], count[own], weights[b].copy()
        for _ in range(rounds):
            share = q * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) / n.sum()
            w = np.maximum(w, [0.0 if b == 0 else 1e-6, 1e-6, 1e-6])
            w /= w.sum()
        weights[b] = w
    return weights


def score(docs: DataFrame, text: str, train, held, keep: list[str]) -> DataFrame:
    """``keep`` columns plus n_tokens, n_known, train_tokens, base_score and score.

    ``train`` and ``held`` are boolean columns: training documents, and those of them that only the
    weights are learned on.
    """
    inner = [f"k{i}" for i in range(len(keep))]
    train = F.coalesce(train, F.lit(False))
    plain = docs.select(
        *[col(c).alias(n) for c, n in zip(keep, inner)], (train & ~held).alias("counted"), (train & held).alias("held"), col(text).alias("text")
    )
    chunks = chunked(plain, "text", apart="held")
    bits, groups = shape(chunks)
    results = cut(reduced(send(chunks, _Sender(bits)), _SumCounts(bits), groups))
    totals = results.where(F.col("stats").isNotNull()).agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0.0)).alias(c) for k, c in enumerate(("v", "na", "n"))]).first()
    rows = plain.agg(F.count_if("counted").alias("a"), F.count_if("held").alias("b")).first()
    v, n_a, n = int(totals.v), int(totals.na), int(totals.n)
    begins_a, begins_all = rows.a, rows.a + rows.b

    def count_cells(chunk: int, part: pa.RecordBatch, found: dict) -> Iterator[pa.RecordBatch]:
        own, context, bi, at, begins = _found(part, found, bits)
        context = context[:, 0].copy()
        context[begins] = begins_a
        p2 = bi[:, 0] / np.maximum(context, 1)
        p1 = own[:, 0] / max(n_a, 1)
        cells, count = np.unique(np.stack([_order(context), _cells(p2), _cells(p1)], axis=1), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cells.T, count)], names=["o", "c2", "c1", "n"])

    some = F.col("apart")
    held_results = results.join(chunks.where(some).select(F.col("chunk").alias("own")), F.col("chunk") == F.col("own"), "left_semi")
    cells = receive(chunks.where(some), held_results, count_cells, "o long, c2 long, c1 long, n long").groupBy("o", "c2", "c1").agg(F.sum("n").alias("n"))
    weights = learn([tuple(r) for r in cells.collect()], 1.0 / (v + 1))  # a cell for each bucket and probability step

    schema = T.StructType([*plain.select(*inner).schema.fields, *T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double").fields])

    def finish(chunk: int, part: pa.RecordBatch, found: dict) -> Iterator[pa.RecordBatch]:
        own, context, bi, at, begins = _found(part, found, bits)
        c, context = own.sum(axis=1), context.sum(axis=1)
        context[begins] = begins_all
        w = weights[_order(context)]
        p = w[:, 0] * bi.sum(axis=1) / np.maximum(context, 1) + w[:, 1] * c / max(n, 1) + w[:, 2] / (v + 1)
        if n == 0:
            p = np.ones(len(c))
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        sums = [np.add.reduceat(x, begins) for x in ((c > 0).astype(np.int64), base, np.log10(p))]
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(k)) for k in inner] + [pa.array(np.diff(at)), *map(pa.array, sums)], names=schema.names)

    out = receive(chunks, results, finish, schema)
    kept = apart(keep, ["n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, kept)], "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
