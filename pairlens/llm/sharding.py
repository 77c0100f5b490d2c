"""Sharding: a two-pass external shuffle into files of random order, with DataFrame functions only.

Pass 1 scatters records by seeded hashes: the record's key chooses the shard (the shard whose seeded
hash of the key is largest), and a seeded hash of all its columns one of the shard's buckets. A shard
has as many buckets as make one about ``bucket_bytes`` large, so a shard that a hot key fills has more
of them; equal rows that alone would fill a bucket are scattered by their row numbers. Pass 2 holds
one bucket in a partition of its own, puts it in a fixed order, permutes it (Spark's ``shuffle`` is a
seeded Fisher-Yates) and writes it. A record's slot is its place in the shard.

The law is ``key``: key and number of shards decide, and with one more shard a record either stays or
goes to the new one. Slots depend on the rows and the seed, not on how the input is partitioned
(but for the choice among equal rows). The table is read twice: sizes of hashes first, then the rows.

Defined results: null keys form one key of their own; null content has size 1 (a line end). Rows that
repeat in every column get slots of their own. All further columns are carried along under any name;
``records`` and ``write_shards`` append ``_`` to a column that is called shard or slot. An empty table
gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, col, cut

LAW = "key"
ROW_BYTES = 64  # counted for each row beside its content
BROADCAST_ROWS = 1_000_000


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Shard 0 .. shards - 1 with the largest seeded hash of the key (ties: the smaller shard)."""
    text = F.coalesce(key.cast("string"), F.lit("\0null"))
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(k), text).alias("h"), F.lit(-k).alias("k")) for k in range(shards)]
    return -(F.greatest(*scores) if shards > 1 else scores[0])["k"]


def _hashable(kind: T.DataType) -> bool:
    """Whether Spark can hash the type: no map in it."""
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def shuffled(df: DataFrame, key: str, content: str, shards: int = 16, seed: int = 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """All columns of ``df`` as struct ``record``, plus ``size``, ``shard``, ``bucket`` and ``slot``."""
    size = (F.coalesce(F.octet_length(col(content)), F.lit(0)) + 1).cast("long")
    digest = F.xxhash64(F.lit(seed + 1), *[col(f.name) for f in df.schema.fields if _hashable(f.dataType)])
    record = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = df.select(record.alias("record"), size.alias("size"), shard_of(col(key), shards, seed).alias("shard"), digest.alias("digest"))

    kinds = cut(rows.groupBy("shard", "digest").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("size") + ROW_BYTES).alias("bytes")))
    held = {r.shard: r.bytes for r in kinds.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}  # a row for each shard
    buckets = [max(1, -(-held.get(k, 0) // bucket_bytes)) for k in range(shards)]
    number, first = (F.array(*[F.lit(int(n)) for n in x]) for x in (buckets, [0, *accumulate(buckets[:-1])]))
    of = lambda values: F.get(values, F.col("shard"))
    bucket = (of(first) + F.pmod(F.xxhash64(F.lit(seed + 2), "digest"), of(number))).cast("int").alias("bucket")

    hot = cut(kinds.where((F.col("bytes") > bucket_bytes // 4) & (F.col("rows") > 1)).select(F.col("digest").alias("hot")))  # four for each bucket at most
    if hot.isEmpty():
        counts = kinds.select("shard", bucket, "rows").groupBy("shard", "bucket").agg(F.sum("rows").alias("rows"))
    else:
        spread = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.xxhash64("digest", F.monotonically_increasing_id()))
        rows = cut(rows.join(hot, F.col("digest") == F.col("hot"), "left").select("record", "size", "shard", spread.alias("digest")))
        counts = rows.select("shard", bucket).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    # places of the buckets in their shards: one small row for each bucket
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("before"))
    offsets = F.broadcast(offsets) if sum(buckets) <= BROADCAST_ROWS else offsets

    placed = rows.select("record", "size", "digest", bucket).repartitionById(sum(buckets), F.col("bucket"))
    parts = placed.groupBy("bucket").agg(F.collect_list(F.struct("digest", "size", "record")).alias("rows"))
    ordered = F.array_sort("rows", lambda a, b: F.when(a["digest"] < b["digest"], -1).when(a["digest"] > b["digest"], 1).otherwise(0))
    # the bucket's number, which is its partition's, and the seed decide the permutation
    mixed = parts.select("bucket", F.shuffle(ordered, F.lit(seed)).alias("rows"))
    out = mixed.join(offsets, F.col("bucket") == F.col("b")).select("shard", "bucket", "before", F.posexplode("rows").alias("place", "row"))
    return out.select("row.record", "row.size", "shard", "bucket", (F.col("before") + F.col("place")).alias("slot"))


def records(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` back from ``record``, with slot and shard last."""
    names = apart(like.columns, ["slot", "shard"])
    return df.select(*[F.col(f"record.c{i}").alias(c) for i, c in enumerate(names)], "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str, content: str, **options) -> None:
    """Write the shards as Parquet, one folder ``shard=k`` each, a file for each bucket, rows in slot order."""
    records(shuffled(df, key, content, **options), df).write.partitionBy("shard").parquet(path)
