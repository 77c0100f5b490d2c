"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has 64 bits: a bit is set if it is set in over half of the XXH64 (seed 42) of the
text's word shingles, repeats included. Fingerprints that differ in at most ``most`` bits are linked.

Equal fingerprints are one point. Over all points, Spark counts how often pairs of bits are set
together and how often each value of each block of bits occurs; both tables have a fixed size. Bits
that correlate are grouped into eight blocks of eight, and the blocks into partitions, so that what
makes a value frequent is kept to few partitions. If the thresholds of the partitions add up to
``most - partitions + 1`` (-1 at least each), points at distance ``most`` or less are within the
threshold in some partition. Every point allocates thresholds of its own: dynamic programming over the
partitions on its estimated candidate counts, so that it probes where its values are rare. The
estimates take the blocks of a partition as independent; they steer the cost, never the result. The
number of partitions is that of the least estimated cost, summed over all points.

A point is indexed by its value in each partition and probes all values within its own thresholds; the
join on (partition, value) gives candidates, which are verified on all 64 bits. Nothing is capped, and
a value that very many points share is a skewed join key, which Spark splits.

Defined results: lower case is made of A-Z only, words are parted by ASCII white space; a text of fewer
words than a shingle is one shingle, one without words (or null) has fingerprint zero, linked like any
other. Rows of one id are one vertex, whatever their texts. Null ids have a fingerprint; they name no
component unless all its ids are null. Texts of any length are used whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, col, cut, lean, sliced
from .components import components

SEED = 42
BLOCKS = WIDTH = 8  # blocks of bits and bits of a block
CHUNK = 1 << 16
_BYTE = np.arange(256, dtype=np.uint8)
_APART = np.unpackbits((_BYTE[:, None] ^ _BYTE)[..., None], axis=2).sum(axis=2)  # differing bits of two bytes


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    ends, starts = ends - 1, np.concatenate([[0], ends[:-1]])
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest, ones, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(last)
    for k in range(0, total, CHUNK):
        found = np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts[k : k + CHUNK].tolist(), last[k : k + CHUNK].tolist())), "<u8")
        ones += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = 3) -> DataFrame:
    """``keep`` columns (default: all but the text) and ``point``, the fingerprint as a signed bigint."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    inner = [f"__k{i}" for i in range(len(keep))]
    plain = docs.select(*[col(c).alias(n) for c, n in zip(keep, inner)], col(text).alias("__text"))
    schema = T.StructType([*plain.schema.fields[:-1], T.StructField("point", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "__text"):
                found = np.array([fingerprint(t, width) for t in part.column(part.num_columns - 1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found.view(np.int64))], names=schema.names)

    out = plain.mapInArrow(lean(run), schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(inner, apart(keep, ["point"]))], "point")


def as_hex(point: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(point)), 16, "0")


def _points(batch: pa.RecordBatch, name: str = "point") -> Iterator[np.ndarray]:
    values = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).view(np.uint64)
    for k in range(0, len(values), CHUNK):
        yield values[k : k + CHUNK]


def _bits(points: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(points).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many points of the task have both bits set, for each pair of bits (a bit with itself: alone)."""
    both = np.zeros((64, 64), np.int64)
    for batch in batches:
        for points in _points(batch):
            bits = _bits(points).astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)  # exact: fewer than 2 ** 24 points at a time
    a, b = np.divmod(np.arange(64 * 64), 64)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(both.ravel())], names=["a", "b", "n"])


def correlations(both: np.ndarray, rows: int) -> np.ndarray:
    """Absolute correlation of each pair of bits; 0 for constant bits and on the diagonal."""
    share = both / max(rows, 1)
    mean = np.diag(share)
    spread = np.sqrt(mean * (1 - mean))
    scale = np.outer(spread, spread)
    out = np.abs(np.divide(share - np.outer(mean, mean), scale, out=np.zeros((64, 64)), where=scale > 0))
    np.fill_diagonal(out, 0)
    return out


def grouped(weights: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Groups of the given sizes of things that weigh much together: each begins with the heaviest left and takes the closest to it."""
    left, out = list(range(len(weights))), []
    for size in sizes:
        first = max(left, key=lambda i: (weights[i, left].sum(), -i))
        group = [first]
        left.remove(first)
        while len(group) < size:
            group.append(max(left, key=lambda i: (weights[i, group].sum(), -i)))
            left.remove(group[-1])
        out.append(group)
    return out


@dataclass(frozen=True)
class Scheme:
    """Which bits make up each block, which blocks each partition, and the shares of points near each value."""

    blocks: list[list[int]]
    parts: list[list[int]]
    near: np.ndarray  # block, value, distance 0 .. most: share of all points
    rows: int
    most: int

    def values(self, points: np.ndarray) -> np.ndarray:
        """Value of each block of each point."""
        bits = _bits(points)
        return np.stack([np.packbits(bits[:, b], axis=1, bitorder="little")[:, 0] for b in self.blocks], axis=1)

    def keys(self, values: np.ndarray, part: int) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        for k, block in enumerate(self.parts[part]):
            out |= values[:, block].astype(np.int64) << (8 * k)
        return out

    def costs(self, values: np.ndarray) -> np.ndarray:
        """Estimated cost by row, partition and threshold -1 .. most: values to be probed and candidates found."""
        out = np.zeros((len(values), len(self.parts), self.most + 2))
        for k, blocks in enumerate(self.parts):
            share = np.zeros((len(values), self.most + 1))
            share[:, 0] = 1
            for block in blocks:
                own, total = self.near[block][values[:, block]], np.zeros_like(share)
                for a in range(self.most + 1):
                    for b in range(self.most + 1 - a):
                        total[:, a + b] += share[:, a] * own[:, b]
                share = total
            ball = np.cumsum([len(m) for m in masks(len(blocks) * WIDTH, self.most)])
            out[:, k, 1:] = np.cumsum(share, axis=1) * self.rows + ball
        return out

    def thresholds(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Threshold of each partition (-1: not probed) and the cost, by dynamic programming.

        A threshold t takes t + 1 of ``most + 1`` units, and the units of all partitions are used up.
        """
        costs, units = self.costs(values), self.most + 1
        best = np.full((len(values), units + 1), np.inf)
        best[:, 0] = 0
        taken = []
        for k in range(len(self.parts)):
            ways = np.full((len(values), units + 1, units + 1), np.inf)
            for u in range(units + 1):
                ways[:, u:, u] = best[:, : units + 1 - u] + costs[:, k, u, None]
            taken.append(ways.argmin(axis=2))
            best = ways.min(axis=2)
        out, left, rows = np.zeros((len(values), len(self.parts)), np.int64), np.full(len(values), units), np.arange(len(values))
        for k in reversed(range(len(self.parts))):
            out[:, k] = taken[k][rows, left]
            left -= out[:, k]
        return out - 1, best[:, units]


def masks(bits: int, most: int) -> list[np.ndarray]:
    """Numbers of ``bits`` bits with exactly 0, 1, .. ``most`` bits set."""
    return [np.array([sum(1 << i for i in some) for some in combinations(range(bits), n)] or [], np.int64) for n in range(most + 1)]


def _scheme(both: np.ndarray, rows: int, counted, most: int, parts: int, blocks: list[list[int]]) -> Scheme:
    near = np.stack([np.stack([(_APART == d) @ c for d in range(most + 1)], axis=1) for c in counted]) / max(rows, 1)
    weights = correlations(both, rows)
    close = np.array([[weights[np.ix_(a, b)].sum() if a is not b else 0.0 for b in blocks] for a in blocks])
    sizes = [BLOCKS // parts + (k < BLOCKS % parts) for k in range(parts)]
    return Scheme(blocks, grouped(close, sizes), near, rows, most)


def learn(points: DataFrame, most: int) -> Scheme:
    """The scheme of the least estimated cost over all ``points``; tables of fixed size reach the driver."""
    found = points.mapInArrow(_together, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()  # 64 times 64 rows
    both = np.zeros((64, 64), np.int64)
    for r in found:
        both[r.a, r.b] = r.n
    rows = points.count()
    blocks = grouped(correlations(both, rows), [WIDTH] * BLOCKS)
    shape = Scheme(blocks, [], np.zeros(0), rows, most)

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((BLOCKS, 256), np.int64)
        for batch in batches:
            for some in _points(batch):
                values = shape.values(some)
                counts += np.stack([np.bincount(values[:, b], minlength=256) for b in range(BLOCKS)])
        a, b = np.divmod(np.arange(BLOCKS * 256), 256)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(counts.ravel())], names=["a", "b", "n"])

    counted = np.zeros((BLOCKS, 256), np.int64)
    for r in points.mapInArrow(occurring, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # 8 times 256 rows
        counted[r.a, r.b] = r.n
    schemes = [_scheme(both, rows, counted, most, parts, blocks) for parts in range(2, min(most + 1, BLOCKS) + 1)] or [_scheme(both, rows, counted, most, 2, blocks)]

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = np.zeros(len(schemes))
        for batch in batches:
            for some in _points(batch):
                cost += [s.thresholds(s.values(some))[1].sum() for s in schemes]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(schemes))), pa.array(cost)], names=["scheme", "cost"])

    if len(schemes) == 1 or not rows:
        return schemes[0]
    costs = points.mapInArrow(priced, "scheme long, cost double").groupBy("scheme").agg(F.sum("cost").alias("cost")).collect()  # a row for each scheme
    return schemes[min(costs, key=lambda r: (r.cost, r.scheme)).scheme]


_ENTRY = "key long, point long"


def _entries(scheme: Scheme, probing: bool):
    """(key, point): of the index, the point's value in each partition; of the probes, all values within its thresholds."""
    balls = [[np.concatenate(masks(len(p) * WIDTH, t)) for t in range(scheme.most + 1)] for p in scheme.parts] if probing else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for points in _points(batch):
                values = scheme.values(points)
                limits = scheme.thresholds(values)[0] if probing else None
                for part in range(len(scheme.parts)):
                    keys = scheme.keys(values, part)
                    for t in range(scheme.most + 1) if probing else [0]:
                        rows = np.flatnonzero(limits[:, part] == t) if probing else np.arange(len(points))
                        ball = balls[part][t] if probing else np.zeros(1, np.int64)
                        each = max(1, (1 << 20) // len(ball))
                        for k in range(0, len(rows), each):
                            own = rows[k : k + each]
                            key = (keys[own][:, None] ^ ball) | np.int64(part << 56)
                            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(points[own].view(np.int64), len(ball)))], names=["key", "point"])

    return run


def links(points: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct ``points`` (bigint ``point``) that differ in at most ``most`` bits."""
    if not 0 <= most < 8:
        raise ValueError("most must be from 0 to 7")
    scheme = learn(points, most)
    index = points.mapInArrow(lean(_entries(scheme, False)), _ENTRY)
    probes = points.mapInArrow(lean(_entries(scheme, True)), _ENTRY).select(F.col("key").alias("probe"), F.col("point").alias("of"))
    near = F.bit_count(F.col("of").bitwiseXOR(F.col("point"))) <= most
    found = probes.join(index, F.col("probe") == F.col("key")).where(near & (F.col("of") != F.col("point")))
    return found.select(F.least("of", "point").alias("a"), F.greatest("of", "point").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; linked are fingerprints that differ in at most ``most`` bits."""
    rows = cut(fingerprints(docs.select(col(doc_id).alias("id"), col(text).alias("text")), "text", ["id"], width))
    points = cut(rows.groupBy("point").agg(F.min("id").alias("least")))
    pairs = links(points.select("point"), most)
    # rows of one id are one vertex
    several = rows.where("id is not null").groupBy("id").agg(F.min("point").alias("lo"), F.max("point").alias("hi")).where("lo <> hi").select(F.col("id").alias("of"), "lo")
    same = rows.join(several, F.col("id") == F.col("of")).select(F.col("lo").alias("a"), F.col("point").alias("b")).where("a <> b")
    labels = components(pairs.unionByName(same)).select(F.col("id").alias("vertex"), "component")
    named = points.join(labels, F.col("point") == F.col("vertex"), "left").select("point", "least", F.coalesce("component", "point").alias("component"))
    named = cut(named)
    heads = named.groupBy(F.col("component").alias("of")).agg(F.min("least").alias("component_id"))
    classes = named.join(heads, F.col("component") == F.col("of")).select(F.col("point").alias("own"), "component_id")
    out = rows.join(classes, F.col("point") == F.col("own"))
    return out.select(F.col("id").alias("doc_id"), as_hex(F.col("point")).alias("fingerprint"), "component_id")
