"""Global statistics of word n-grams without a row for each occurrence.

Documents are stored in chunks (one binary row each, some megabytes of text). A chunk sends the
distinct 64-bit keys of its n-grams, sorted and pre-aggregated, in slices by key range ("buckets");
Spark groups the slices of a bucket, the reducer combines equal keys of all chunks, and each chunk
gets back one value for each key it sent. A bucket's mean size is fixed, so as input grows there are
more buckets and fewer keys in a slice. A chunk does work only for the buckets it has keys in, so
slices, bytes and work are bounded by the distinct keys of all chunks, which grow with the input and
are what a plain ``groupBy`` would move as rows. Small slices are stored without a compressor's frame.

A key that every chunk holds costs one entry a chunk, all in one bucket. Beyond ``FAN`` chunks the
chunks are therefore dealt into groups of at most about ``FAN``: the slices of a bucket are combined
for each group, the groups' slices for the bucket, and the values go back the same way. No group of
rows then holds more than about ``FAN`` slices, up to ``FAN`` * ``FAN`` chunks (some 250 TB of text).

Where a key of 64 bits is not enough, its other half is sent as the first value, and equal keys are
those that agree in both halves (buckets that are ``paired``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, pack_sorted, sliced, unpack_sorted

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20  # of text for each bucket, twice that at most
FAN = 8192  # chunks whose slices of a bucket are combined by one call

FRAMED = 64  # bytes from which on compression pays


def _squeeze(data: bytes, level: int = 1) -> bytes:
    """A mark and the data, compressed unless it is small."""
    return b"z" + zstandard.ZstdCompressor(level=level).compress(data) if len(data) >= FRAMED else b"r" + data


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[1:]) if data[:1] == b"z" else data[1:]


def _store(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema) as writer:
        for part in parts:
            writer.write_batch(part)
    return _squeeze(sink.getvalue().to_pybytes(), 3)


def load(payload: bytes) -> pa.RecordBatch:
    """The documents of a chunk as one batch."""
    table = pa.ipc.open_stream(_expand(payload)).read_all().combine_chunks()
    return table.to_batches()[0]


def chunked(docs: DataFrame, text: str, apart: str | None = None) -> DataFrame:
    """(chunk, apart, bytes, payload) rows, stored. Rows whose boolean ``apart`` holds get chunks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held = {False: ([], 0), True: ([], 0)}

        def emit(flag: bool):
            nonlocal number
            parts, size = held[flag]
            held[flag] = ([], 0)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([flag]), pa.array([size], pa.int64()), pa.array([_store(parts)], pa.binary())], names=["chunk", "apart", "bytes", "payload"])

        for batch in batches:
            masks = [(False, None)] if apart is None else [(f, pa.compute.equal(batch.column(batch.schema.get_field_index(apart)), f)) for f in (False, True)]
            for flag, mask in masks:
                for part in sliced(batch if mask is None else batch.filter(mask), text, CHUNK_BYTES // 4):
                    parts, size = held[flag]
                    parts.append(part)
                    held[flag] = (parts, size + part.nbytes)
                    if held[flag][1] >= CHUNK_BYTES:
                        yield emit(flag)
        for flag in (False, True):
            if held[flag][0]:
                yield emit(flag)

    return cut(docs.mapInArrow(lean(run), "chunk long, apart boolean, bytes long, payload binary"))


class Shape(NamedTuple):
    """Number of leading key bits that choose the bucket, and of groups of chunks."""

    bits: int
    groups: int


def shape(chunks: DataFrame) -> Shape:
    total = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n"), F.count("*").alias("chunks")).first()
    return Shape(max(2, int(total.n // BUCKET_BYTES).bit_length()), max(1, -(-total.chunks // FAN)))


SLICES = "bucket int, chunk long, keys binary, values binary"
RESULTS = "chunk long, bucket int, values binary, stats array<double>"


def bounds(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that sorted ``keys`` fall into, and where each one's keys begin, and their end."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), bucket[1:] != bucket[:-1]]))
    return bucket[first], np.append(first, len(keys))


def slices(chunk: int, stream: int, keys: np.ndarray, values: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows to send for sorted distinct keys and their values (n x k int64); streams never mix."""
    used, at = bounds(keys, bits)
    columns = [
        pa.array((used + (stream << bits)).astype(np.int32)),
        pa.array(np.full(len(used), chunk, np.int64)),
        pa.array([_squeeze(pack_sorted(keys[a:b])) for a, b in zip(at[:-1], at[1:])], pa.binary()),
        pa.array([_squeeze(np.ascontiguousarray(values[a:b].T).tobytes()) for a, b in zip(at[:-1], at[1:])], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "keys", "values"])


def send(chunks: DataFrame, make: Callable[[int, pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The slices that ``make(chunk, documents)`` yields for every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0), batch.column(1)):
                yield from make(number.as_py(), load(payload.as_py()))

    return chunks.select("chunk", "payload").mapInArrow(lean(run), SLICES)


def numbered(keys: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The number of each entry's distinct key, and how many there are; ``other`` is the keys' second half."""
    if other is None:
        distinct, inverse = np.unique(keys, return_inverse=True)
        return inverse, len(distinct)
    order = np.argsort(keys)
    new, differ = np.ones(len(keys), bool), other[order][1:] != other[order][:-1]
    new[1:] = keys[order][1:] != keys[order][:-1]
    if (differ & ~new[1:]).any():  # keys that agree in their first half only
        order = np.lexsort((other, keys))
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (other[order][1:] != other[order][:-1])
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return inverse, int(new.sum())


class Combine:
    """How the values (entries x k int64) of equal keys become an answer for each entry."""

    def paired(self, bucket: int) -> bool:
        """Whether the first value is the second half of the key."""
        return False

    def merge(self, bucket: int, of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """The merged values of keys 0 .. n - 1 (n x k), where entry i has key ``of[i]``; may be applied to merged values again."""
        raise NotImplementedError

    def settle(self, bucket: int, merged: np.ndarray) -> tuple[np.ndarray, list[float]]:
        """What all chunks are to know of the keys (n x m), and the bucket's statistics."""
        return merged, [0.0]

    def answer(self, bucket: int, values: np.ndarray, settled: np.ndarray) -> np.ndarray:
        """The answer to each entry, given its own values and what was settled of its key."""
        return settled


def _entries(table: pa.Table, combine: Combine):
    """Bucket, keys, second halves (or none) and values of the slices of a table, and where each slice begins."""
    bucket = table.column("bucket")[0].as_py()
    keys = [unpack_sorted(_expand(k.as_py())) for k in table.column("keys")]
    values = np.concatenate([_numbers(v.as_py(), len(k)) for k, v in zip(keys, table.column("values"))])
    at = np.cumsum([0, *map(len, keys)])
    other, values = (values[:, 0], values[:, 1:]) if combine.paired(bucket) else (None, values)
    return bucket, np.concatenate(keys), other, values, at


def _numbers(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(_expand(blob), np.int64).reshape(-1, n).T


def _blob(values: np.ndarray) -> bytes:
    return _squeeze(np.ascontiguousarray(values.T).tobytes())


def _answers(owner: pa.Array, bucket: int, values: np.ndarray, at: np.ndarray, stats: list[float] | None, name: str = "chunk") -> pa.Table:
    n = len(owner)
    return pa.table({
        name: owner,
        "bucket": pa.array([bucket] * n, pa.int32()),
        "values": pa.array([_blob(values[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary()),
        "stats": pa.array([stats] + [None] * (n - 1), pa.list_(pa.float64())),
    })


def reduced(sent: DataFrame, combine: Combine, groups: int = 1) -> DataFrame:
    """One result row for each slice; one row of each bucket carries the bucket's statistics.

    With more than one group of chunks, what is sent is exchanged once for both ways (ReusedExchange).
    """

    def whole(table: pa.Table) -> pa.Table:
        bucket, keys, other, values, at = _entries(table, combine)
        of, n = numbered(keys, other)
        settled, stats = combine.settle(bucket, combine.merge(bucket, of, values, n))
        return _answers(table.column("chunk").combine_chunks(), bucket, combine.answer(bucket, values, settled[of]), at, stats)

    def up(table: pa.Table) -> pa.Table:
        bucket, keys, other, values, _ = _entries(table, combine)
        of, n = numbered(keys, other)
        first = np.zeros(n, np.int64)
        first[of] = np.arange(len(of))
        merged = combine.merge(bucket, of, values, n)
        if other is not None:
            merged = np.column_stack([other[first], merged])
        columns = [[bucket], [table.column("part")[0].as_py()], [_squeeze(pack_sorted(keys[first]))], [_blob(merged)]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "part", "keys", "values"])

    def top(table: pa.Table) -> pa.Table:
        bucket, keys, other, values, at = _entries(table, combine)
        of, n = numbered(keys, other)
        settled, stats = combine.settle(bucket, combine.merge(bucket, of, values, n))
        return _answers(table.column("part").combine_chunks(), bucket, settled[of], at, stats, "part")

    def down(slices_: pa.Table, settled: pa.Table) -> pa.Table:
        bucket, keys, other, values, at = _entries(slices_, combine)
        of, n = numbered(keys, other)  # the same order of keys as on the way up
        known = _numbers(settled.column("values")[0].as_py(), n)[of]
        return _answers(slices_.column("chunk").combine_chunks(), bucket, combine.answer(bucket, values, known), at, settled.column("stats")[0].as_py())

    if groups == 1:
        return sent.groupBy("bucket").applyInArrow(whole, RESULTS)
    dealt = sent.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int"))
    merged = dealt.groupBy("bucket", "part").applyInArrow(up, "bucket int, part int, keys binary, values binary")
    settled = merged.groupBy("bucket").applyInArrow(top, "part int, bucket int, values binary, stats array<double>")
    return dealt.groupBy("bucket", "part").cogroup(settled.groupBy("bucket", "part")).applyInArrow(down, RESULTS)


def receive(chunks: DataFrame, results: DataFrame, finish: Callable[[int, pa.RecordBatch, dict[int, bytes]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``finish(chunk, documents, {bucket: values})`` for every chunk, with the results for what it sent."""
    names = [x.split()[0] for x in schema.split(",")] if isinstance(schema, str) else schema.names

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = dict(zip(right.column("bucket").to_pylist(), (v.as_py() for v in right.column("values"))))
        batches = list(finish(left.column("chunk")[0].as_py(), load(left.column("payload")[0].as_py()), found))
        return pa.Table.from_batches(batches).select(names)

    left = chunks.select("chunk", "payload").groupBy("chunk")
    # a chunk without documents that send anything has no results; every result has its chunk
    return left.cogroup(results.select("chunk", "bucket", "values").groupBy("chunk")).applyInArrow(run, schema)


def aligned(found: dict[int, bytes], stream: int, keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The results of a stream in the order of the sorted keys that were sent (n x width)."""
    used, at = bounds(keys, bits)
    out = np.zeros((len(keys), width), np.int64)
    for b, first, end in zip(used, at[:-1], at[1:]):
        out[first:end] = np.frombuffer(_expand(found[int(b) + (stream << bits)]), np.int64).reshape(width, -1).T
    return out
