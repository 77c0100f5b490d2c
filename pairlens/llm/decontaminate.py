"""Benchmark decontamination: an FM-index for each training shard, searched for test phrases.

A phrase is ``width`` consecutive words of a test item (a shorter item is one phrase). Every task
gathers documents into shards of about ``shard_bytes`` of text, indexes the shard's words, searches
all phrases backward, locates their occurrences and merges them into spans of words to remove.
Words are runs of [0-9A-Za-z] and characters above U+007F, with A-Z lower-cased. A run of words that
are in no phrase is one separator in the index; no phrase can cross it.

The items are stored in blocks of about ``block_bytes`` of text. A pass over the documents searches one
block, which alone is broadcast, and is given up after the pass: the driver and every executor hold
one block (or one longer item) at a time, whatever the size of the test set. With several blocks a
pass returns the documents with hits only, and their spans and items are merged at the end.

Defined results: null and empty texts have no words and no spans; items without words do nothing;
rows of equal item id count as one item; a null item id is written as the empty string. Repeated
documents get equal results. Further columns pass through; one that bears the name of an added column
gets ``_`` appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_WORD, apart, col, cut, lean, remove_path, sequence_name, shared_path, sliced, text_buffers, window_names, word_names, word_spans
from .fm_index import SEPARATOR, FMIndex


def _phrases(rows: list, width: int) -> dict | None:
    """Symbols, phrases and the items of each phrase, of one block of items."""
    ids = sorted({r[0] for r in rows})
    of = {k: i for i, k in enumerate(ids)}
    names, lengths, items, keys, words = [], [], [], [], []
    for item, text in rows:
        data, at = text_buffers(pa.array([text], pa.string()))
        data = LOWER[data]
        starts, ends, _ = word_spans(data, at, NOT_WORD)
        own = word_names(data, starts, ends)
        if not len(own):
            continue
        words.append(own)
        w = min(width, len(own))
        found = window_names(own, width) if len(own) >= width else sequence_name(own)
        keys.append(found)
        names.append(np.pad(np.lib.stride_tricks.sliding_window_view(own, w), ((0, 0), (0, width - w))))
        lengths.append(np.full(len(found), w))
        items.append(np.full(len(found), of[item]))
    if not words:
        return None
    vocabulary = np.unique(np.concatenate(words))
    keys, names, lengths, items = (np.concatenate(x) for x in (keys, names, lengths, items))
    _, first, phrase = np.unique(keys, return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([phrase, items], axis=1), axis=0)
    return {
        "ids": ids,
        "vocabulary": vocabulary,
        "patterns": np.searchsorted(vocabulary, names[first]) + 2,
        "lengths": lengths[first],
        "item_at": np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)),
        "items": pairs[:, 1],
    }


def _search(names: np.ndarray, at: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start word, end word) of all occurrences in the shard, and distinct (document, item) pairs."""
    none = np.zeros(0, np.int64)
    vocabulary = block["vocabulary"]
    place = np.searchsorted(vocabulary, names)
    known = vocabulary[np.minimum(place, len(vocabulary) - 1)] == names
    symbols = np.full(len(names) + len(at), SEPARATOR, np.int64)  # and one separator after each document
    origin = np.full(len(symbols), -1, np.int64)
    slot = np.arange(len(names)) + np.repeat(np.arange(len(at) - 1), np.diff(at))
    symbols[slot[known]] = place[known] + 2
    origin[slot] = np.arange(len(names))
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != SEPARATOR) | (symbols[:-1] != SEPARATOR)
    symbols, origin = symbols[keep], origin[keep]
    if len(symbols) < 2:
        return none, none, none, none
    index = FMIndex(symbols, len(vocabulary) + 2)
    low, high = index.search(block["patterns"], block["lengths"])
    count = np.maximum(high - low, 0)
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + low[phrase]
    start = origin[index.locate(rows)]
    doc = np.searchsorted(at, start, side="right") - 1
    of = np.unique(doc * len(count) + phrase)  # distinct (document, phrase)
    doc, phrase_of = of // len(count), of % len(count)
    many = np.diff(block["item_at"])[phrase_of]
    own = np.repeat(block["item_at"][phrase_of] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    pair = np.unique(np.repeat(doc, many) * len(block["ids"]) + block["items"][own])
    return start, start + block["lengths"][phrase], pair // len(block["ids"]), pair % len(block["ids"])


def _scan(block, shard_bytes: int, cleaned: bool, names_out: list[str], only_hits: bool = False):
    def finish(batches: list, words: list, texts: list) -> Iterator[pa.RecordBatch]:
        names = np.concatenate([w[0] for w in words])
        sizes = np.concatenate([w[1] for w in words])
        at = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.zeros(len(names) + 1, np.int32)
        owner, label = np.zeros(0, np.int64), np.zeros(0, object)
        if block is not None:
            b = block.value
            start, end, owner, item = _search(names, at, b)
            np.add.at(edge, start, 1)
            np.add.at(edge, end, -1)
            label = np.array(b["ids"], dtype=object)[item]
        order = np.argsort(owner, kind="stable")
        owner, label = owner[order], label[order]
        hit = np.cumsum(edge[:-1]) > 0
        # runs of hit words, each within one document
        edge_of = np.zeros(len(hit) + 1, bool)
        edge_of[at] = True
        before, after = np.concatenate([[False], hit[:-1]]), np.concatenate([hit[1:], [False]])
        begin = np.flatnonzero(hit & (~before | edge_of[:-1]))
        stop = np.flatnonzero(hit & (~after | edge_of[1:])) + 1
        begin_doc = np.searchsorted(at, begin, side="right") - 1
        cut_at = np.cumsum(np.concatenate([[0], hit]))
        row = 0
        for batch, (_, size, starts, ends, text_at), data in zip(batches, words, texts):
            docs = np.arange(row, row + batch.num_rows + 1)
            span_at = np.searchsorted(begin_doc, docs)
            item_at = np.searchsorted(owner, docs)
            pieces, piece_at = [], [0]
            clean = [] if cleaned else None
            for i in range(batch.num_rows):
                base = at[row + i]
                first = span_at[i]
                spans = [(int(a - base), int(b - base)) for a, b in zip(begin[first : span_at[i + 1]], stop[first : span_at[i + 1]])]
                pieces += spans
                piece_at.append(len(pieces))
                if cleaned:
                    lo, hi = text_at[i], text_at[i + 1]
                    offset = at[row] if len(at) else 0
                    parts, last = [], lo
                    for a, b in spans:
                        parts.append(data[last : starts[base - offset + a]].tobytes())
                        last = ends[base - offset + b - 1]
                    parts.append(data[last:hi].tobytes())
                    clean.append(b"".join(parts).decode("utf-8", "replace") if spans else None)
            flat = np.array(pieces, np.int64).reshape(-1, 2)
            labels = [sorted(set(label[item_at[i] : item_at[i + 1]])) for i in range(batch.num_rows)]
            columns = [
                *batch.columns[:-1],
                pa.array(size, pa.int64()),
                pa.array(cut_at[at[row + 1 : row + 1 + batch.num_rows]] - cut_at[at[row : row + batch.num_rows]], pa.int64()),
                pa.array(labels, pa.list_(pa.string())),
                pa.ListArray.from_arrays(pa.array(piece_at, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "end"])),
            ]
            if cleaned:
                columns.append(pa.array([c if c is not None else t for c, t in zip(clean, batch.column(batch.num_columns - 1).to_pylist())], pa.string()))
            out = pa.RecordBatch.from_arrays(columns, names=names_out)
            yield out.filter(pa.compute.greater(out.column("n_hit"), 0)) if only_hits else out
            row += batch.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, words, texts, held = [], [], [], 0
        for batch in batches:
            for part in sliced(batch, batch.schema.names[-1]):
                data, at = text_buffers(part.column(part.num_columns - 1))
                lower = LOWER[data]
                starts, ends, doc_at = word_spans(lower, at, NOT_WORD)
                kept.append(part)
                words.append((word_names(lower, starts, ends), np.diff(doc_at), starts if cleaned else None, ends if cleaned else None, at))
                texts.append(data if cleaned else None)
                held += len(data)
                if held >= shard_bytes:
                    yield from finish(kept, words, texts)
                    kept, words, texts, held = [], [], [], 0
        if kept:
            yield from finish(kept, words, texts)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch united."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merge(cleaned: bool, names_out: list[str]):
    """Rows of (kept columns, lists of spans and of items by pass, text) to the operator's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, batch.schema.names[-1]):
                text = part.column(part.num_columns - 1)
                data, at = text_buffers(text)
                starts, ends, doc_at = word_spans(LOWER[data], at, NOT_WORD)
                spans = [merged([(s["start"], s["end"]) for some in (found or []) for s in some]) for found in part.column(part.num_columns - 3).to_pylist()]
                labels = [sorted({x for some in (found or []) for x in some}) for found in part.column(part.num_columns - 2).to_pylist()]
                columns = [
                    *part.columns[:-3],
                    pa.array(np.diff(doc_at), pa.int64()),
                    pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                    pa.array(labels, pa.list_(pa.string())),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ]
                if cleaned:
                    clean = text.to_pylist()
                    for i, own in enumerate(spans):
                        if own:
                            pieces, last = [], at[i]
                            for a, b in own:
                                pieces.append(data[last : starts[doc_at[i] + a]].tobytes())
                                last = ends[doc_at[i] + b - 1]
                            clean[i] = b"".join([*pieces, data[last : at[i + 1]].tobytes()]).decode("utf-8", "replace")
                    columns.append(pa.array(clean, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return run


def find_spans(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, keep: list[str] | None = None, cleaned: bool = False, shard_bytes: int = 4 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """``keep`` columns plus n_words, n_hit, items (sorted ids), spans (of words) and, if asked, clean_text."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    inner = [f"__k{i}" for i in range(len(keep))]
    plain = docs.select(*[col(c).alias(n) for c, n in zip(keep, inner)], col(text).alias("__text"))
    added = T._parse_datatype_string("n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>" + (", clean_text string" if cleaned else ""))
    schema = T.StructType([*plain.schema.fields[:-1], *added.fields])

    rows = items.select(F.coalesce(col(item_id).cast("string"), F.lit("")).alias("id"), col(item_text).alias("text")).where(F.octet_length("text") > 0)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    count = max(1, -(-total // block_bytes))
    phrases = lambda some: _phrases([(r.id, r.text) for r in some.collect()], width)  # noqa: E731  one block
    if count == 1:
        block = phrases(rows)
        shared = spark.sparkContext.broadcast(block) if block else None
        out = plain.mapInArrow(lean(_scan(shared, shard_bytes, cleaned, schema.names)), schema)
    else:
        path = shared_path(spark, "items")
        rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(count))).write.partitionBy("block").parquet(path)
        stored = spark.read.parquet(path)
        numbered = cut(plain.withColumn("__row", F.monotonically_increasing_id()))
        found = None
        for k in range(count):
            block = phrases(stored.where(F.col("block") == k))
            if not block:
                continue
            shared = spark.sparkContext.broadcast(block)
            hits = _scan(shared, shard_bytes, False, ["row", *added.names[:4]], only_hits=True)
            hits = cut(numbered.select("__row", "__text").mapInArrow(lean(hits), T.StructType([T.StructField("row", T.LongType()), *added.fields[:4]])).select("row", "items", "spans"))
            shared.destroy()
            found = hits if found is None else found.unionByName(hits)
        remove_path(spark, path)
        if found is None:
            out = plain.mapInArrow(lean(_scan(None, shard_bytes, cleaned, schema.names)), schema)
        else:
            lists = found.groupBy("row").agg(F.collect_list("spans").alias("__spans"), F.collect_list("items").alias("__items"))  # a list for each block at most
            joined = numbered.join(lists, F.col("__row") == F.col("row"), "left").select(*inner, "__spans", "__items", "__text")
            out = joined.mapInArrow(lean(_merge(cleaned, schema.names)), schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(inner, apart(keep, added.names))], *added.names)
