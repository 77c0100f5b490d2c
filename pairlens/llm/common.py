"""Shared helpers of the training-data operators: checkpoints, byte-level tokens, hashing.

Texts are handled as UTF-8 bytes inside Arrow batches; words are found and named with numpy over the
whole slice, so no Python object is made per word. A name is a 64-bit hash of a word's bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import checkpoint_dir, ensure_checkpoint_dir

SLICE_BYTES = 4 << 20
_U = np.uint64


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read from there on (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def apart(columns: Sequence[str], added: Iterable[str]) -> list[str]:
    """Names of ``columns`` beside the ``added`` ones: one that clashes (in any case) gets ``_`` appended until it is free."""
    new = {c.lower() for c in added}
    taken = new | {c.lower() for c in columns}
    out = []
    for name in columns:
        if name.lower() in new:
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        out.append(name)
    return out


def gathered(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """``df`` of about ``rows`` small rows in as many partitions as hold ``each`` of them."""
    return df.coalesce(max(1, -(-rows // each)))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def rename_files(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Give the files of a folder another ending, through the file system that holds it (a call for each file)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        where = status.getPath()
        if where.getName().endswith(old):
            files.rename(where, spark._jvm.org.apache.hadoop.fs.Path(folder, where.getName()[: -len(old)] + new))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete intermediate data that ``shared_path`` named, through the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def crc32_mod(column: str, divisor: int) -> Column:
    """crc32 of the column's decimal text, modulo ``divisor``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


_HELD: dict[str, dict] = {}


def held(kind: str, key, make):
    """``make(key)``, kept in a Python worker from task to task of this kind; a ``lean`` task of another kind drops it."""
    own = _HELD.setdefault(kind, {})
    if key not in own:
        own[key] = make(key)
    return own[key]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _drop_others(kind: str | None) -> None:
    others = [k for k in _HELD if k != kind]
    for k in others:
        del _HELD[k]
    if others:
        _give_back()


def lean(run, kind: str | None = None):
    """A task function that gives memory back, for Python workers outlive their tasks: before it, what tasks of another ``kind`` held; at its end, what it freed."""

    @functools.wraps(run)
    def wrapped(batches):
        _drop_others(kind)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def byte_table(separators: bytes) -> np.ndarray:
    """Boolean lookup by byte: True where the byte separates words."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = True
    return table


#: [\x20\x09-\x0D]
WHITE = byte_table(b" \t\n\x0b\x0c\r")
#: bytes outside [0-9A-Za-z] and below 0x80
NOT_WORD = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column without copying; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def sliced(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of ``column`` (a longer row stands alone)."""
    _, at = text_buffers(batch.column(batch.schema.get_field_index(column)))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def word_spans(data: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the slice, and per document the index of its first word (n + 1 long)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~separators[data]
    edge = np.empty(len(data), dtype=bool)
    edge[0] = True
    np.logical_not(word[:-1], out=edge[1:])
    first = at[:-1][at[:-1] < len(data)]
    edge[first] = True
    starts = np.flatnonzero(word & edge)
    edge[-1] = True
    np.logical_not(word[1:], out=edge[:-1])
    last = at[1:][at[1:] > 0] - 1
    edge[last] = True
    ends = np.flatnonzero(word & edge) + 1
    return starts, ends, np.searchsorted(starts, at)


_BYTE_NAMES = np.random.default_rng(20240607).integers(1, 2**63, size=256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer on uint64 (shift-multiply avalanche)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA0761D6478BD642F)
    x ^= x >> _U(32)
    return x


_BLOCK = 1 << 19  # bytes hashed at a time; a longer word is hashed whole
_LONG = 256  # bytes; words can be made whose polynomials agree from 1,024 bytes on


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit name of each word: a polynomial over its bytes (random byte values), XXH64 for long words, then mixed."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        part = data[base : ends[j - 1]]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_NAMES[part] * up[: len(part)], out=sums[1:])
        first, last = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
        i = j
    for k in np.flatnonzero(ends - starts > _LONG):
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]], 77)
    return mix(out)


_STEPS = np.random.default_rng(77003).integers(1, 2**63, size=64, dtype=np.uint64) | _U(1)
_OTHER_STEPS = np.random.default_rng(90107).integers(1, 2**63, size=64, dtype=np.uint64) | _U(1)


def window_names(names: np.ndarray, width: int, steps: np.ndarray = _STEPS) -> np.ndarray:
    """Name of every run of ``width`` consecutive names (len(names) - width + 1 of them)."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += names[k : k + n] * steps[k % 64] + _U(k // 64)
    return mix(total)


def other_window_names(names: np.ndarray, width: int) -> np.ndarray:
    """A second, independent 64-bit name of every run: both together are its 128-bit name."""
    return window_names(mix(names ^ _U(0x2545F4914F6CDD1D)), width, _OTHER_STEPS)


def sequence_name(names: np.ndarray) -> np.ndarray:
    """Name of one whole short sequence, distinct from names of windows of other widths."""
    total = int(np.sum(names * _STEPS[np.arange(len(names)) % 64], dtype=np.uint64)) + (len(names) * 2 + 1) * 0xC2B2AE3D27D4EB4F
    return mix(np.array([total % 2**64], dtype=np.uint64))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as byte-planed differences, for a general compressor."""
    steps = np.diff(keys, prepend=_U(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
