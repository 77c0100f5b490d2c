"""Line dedup: range-partitioned line hashes, streamed in order, returned as keep bitmaps.

A line's key is the line with white space [\\x20\\x09-\\x0D] stripped and A-Z lower-cased. Of a key of
at least ``min_chars`` code points all lines go except those of the smallest document that holds it.
Keys are named by 128-bit hashes (two 64-bit ones). The (hash, document, position) rows are
range-partitioned on all of these columns, so one very common line spreads over many partitions, and
each task streams its sorted rows once: a row is dropped if its document is not the first of its key.
Only the leading key of a partition may have begun in an earlier one; rows of its first document are
settled from the list of partition ends (one row for each partition).

``keep_bitmaps`` returns, per document that loses a line, a zlib-compressed bitmap (bit k of byte
k // 8, from the lowest bit, is set if line k stays; lines beyond the bitmap stay). ``dedup_lines``
joins the bitmaps, not texts, back to the documents and applies them.

Defined results: a null or empty text is one empty line. Null ids sort before all others. Rows of one
id are one document for the choice of the first; each row gets the bitmap of its own text, so
repeated rows get equal results. Documents of any length are cut whole. Further columns pass through;
one that bears the name of an added column gets ``_`` appended.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, col, cut

PARTITION_ROWS = 1_000_000  # lines that one task streams
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIP = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


_OUT = "h1 long, h2 long, d long, tag long, pos int, kind byte"
DROP, OPEN, TAIL = 0, 1, 2  # a dropped line; one to settle; the last key of a partition and its first document


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in; dropped lines, the open lines of the leading key, and the partition's last key out."""
    names = ["h1", "h2", "d", "tag", "pos", "kind"]
    key, first, leading = None, None, True  # of the run that continues from the batch before

    def emit(h1, h2, d, tag, pos, kind):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, d, tag, pos)] + [pa.array(np.full(len(h1), kind, np.int8))], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, d, tag, pos = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "d", "tag", "pos"))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if key == (h1[0], h2[0]):
            new[0] = False
        run = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        begun = run < 0  # rows of the run that began before this batch
        of = np.where(begun, first if first is not None else d[0], d[np.maximum(run, 0)])
        gone = d != of
        if gone.any():
            yield emit(h1[gone], h2[gone], d[gone], tag[gone], pos[gone], DROP)
        lead = np.zeros(len(new), bool)
        if leading:
            starts = np.flatnonzero(new)
            first_end = len(new) if key is None and len(starts) == 1 else (starts[1] if key is None else (starts[0] if len(starts) else len(new)))
            lead[:first_end] = True
            leading = first_end == len(new)
        undecided = lead & ~gone
        if undecided.any():
            yield emit(h1[undecided], h2[undecided], d[undecided], tag[undecided], pos[undecided], OPEN)
        key, first = (h1[-1], h2[-1]), of[-1]
    if key is not None:
        one = np.array([0])
        yield emit(one + key[0], one + key[1], one + first, one, one.astype(np.int32), TAIL)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """(d, tag, n_dropped, keep_bitmap) of every document that loses a line; ``d`` is its id.

    ``tag`` is a hash of the text, so that rows of one id with other texts keep their own bitmaps.
    """
    source = docs.select(col(doc_id).cast("long").alias("d0"), F.xxhash64(col(text)).alias("tag"), F.posexplode(F.transform(_lines(col(text)), line_key)).alias("pos", "key"))
    hashed = source.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7919), "key").alias("h2"), F.coalesce("d0", F.lit(-(2**63))).alias("d"), "tag", "pos"
    )
    hashed = cut(hashed)  # range partitioning reads its input twice; hashes are stored, so lines are cut once
    order = ["h1", "h2", "d", "tag", "pos"]
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hashed.count() // PARTITION_ROWS))
    ranged = hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    streamed = cut(ranged.mapInArrow(_stream, _OUT))
    # one row for each partition: the first document of each key that ends one
    ends = streamed.where(F.col("kind") == TAIL).groupBy(F.col("h1").alias("e1"), F.col("h2").alias("e2")).agg(F.min("d").alias("first"))
    settled = streamed.where(F.col("kind") == OPEN).join(ends, (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2")) & (F.col("first") < F.col("d")), "left_semi")
    dropped = streamed.where(F.col("kind") == DROP).unionByName(settled)
    # a document's own lines: as many as its text holds
    per_doc = dropped.groupBy("d", "tag").agg(F.collect_set("pos").alias("gone"))
    return per_doc.mapInArrow(_bitmaps, "d long, tag long, n_dropped long, keep_bitmap binary")


def pack_bitmap(gone: np.ndarray) -> bytes:
    """Keep bitmap of a document that loses the lines at these positions."""
    keep = np.ones(-(-(int(gone.max()) + 1) // 8) * 8, bool)
    keep[gone] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpack_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    """Boolean keep flags of all lines."""
    stored = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little").astype(bool)[:n_lines]
    return np.concatenate([stored, np.ones(n_lines - len(stored), bool)])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = [x.values.to_numpy() for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(x) for x in gone], pa.int64()), pa.array([pack_bitmap(x) for x in gone], pa.binary())],
            names=["d", "tag", "n_dropped", "keep_bitmap"],
        )


def _apply(doc_columns: list[T.StructField], added: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bitmaps = batch.column(batch.num_columns - 1)
            n_lines, n_dropped, kept = [], [], []
            for text, bitmap in zip(batch.column(batch.num_columns - 2), bitmaps):
                value, bitmap = text.as_py() or "", bitmap.as_py()
                if bitmap is None:
                    n_lines.append(value.count("\n") + 1)
                    n_dropped.append(0)
                    kept.append(value)
                    continue
                lines = value.split("\n")
                keep = unpack_bitmap(bitmap, len(lines))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - int(keep.sum()))
                kept.append("\n".join(x for x, k in zip(lines, keep) if k))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), bitmaps, pa.array(kept, pa.string())],
                names=[f.name for f in doc_columns] + added.names,
            )

    return run


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) plus n_lines, n_dropped, keep_bitmap and kept_text."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    bitmaps = keep_bitmaps(docs, doc_id, text, min_chars)
    inner = [f"__k{i}" for i in range(len(keep))]
    plain = docs.select(
        *[col(c).alias(n) for c, n in zip(keep, inner)],
        F.coalesce(col(doc_id).cast("long"), F.lit(-(2**63))).alias("__d"),
        F.xxhash64(col(text)).alias("__tag"),
        col(text).alias("__text"),
    )
    joined = plain.join(bitmaps, (F.col("__d") == F.col("d")) & (F.col("__tag") == F.col("tag")), "left").select(*inner, "__text", "keep_bitmap")
    added = T.StructType().add("n_lines", "long").add("n_dropped", "long").add("keep_bitmap", "binary").add("kept_text", "string")
    own = plain.select(*inner).schema.fields
    out = joined.mapInArrow(_apply(own, added), T.StructType([*own, *added.fields]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(inner, apart(keep, added.names))], *added.names)
