"""Row alignment of two canonical tables by key, by key and sequence, or by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..functions.text import column

SEQ, ROW_ID = "_SEQ_", "_ROW_ID_"
MATCHED, MISSING, EXTRA = "Matched", "Missing in Dev", "Extra in Dev"


def resolve_keys(prod: DataFrame, dev: DataFrame, keys: list[str]) -> tuple[list[str], list[str]]:
    """(keys in both tables, keys missing from either), in the order given."""
    both = set(prod.columns) & set(dev.columns)
    return [k for k in keys if k in both], [k for k in keys if k not in both]


def common_columns(prod: DataFrame, dev: DataFrame, keys: list[str], ignore: set[str] | frozenset[str] = frozenset()) -> list[str]:
    """Columns to compare: in both tables, in PROD's order, without keys and ignored fields."""
    skip = set(keys) | set(ignore) | {SEQ, ROW_ID}
    there = set(dev.columns)
    return [c for c in prod.columns if c in there and c not in skip]


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with ``count``."""
    return df.groupBy(*[column(k) for k in keys]).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


HOT_ROWS = 1_000_000  # rows of one key that one task numbers


def _order_text(df: DataFrame, keys: list[str]) -> Column:
    rest = [column(c) for c in df.columns if c not in keys]
    return F.concat_ws("|", *rest) if rest else F.lit("")


def with_sequence(df: DataFrame, keys: list[str], hot: DataFrame | None = None) -> DataFrame:
    """Add ``_SEQ_``: the 0-based place in the key group, ordered by all other columns joined with ``|``.

    ``hot`` names keys (columns ``keys``) of very many rows; their rows are spread over partitions by
    key and order, numbered in each, and moved by the sizes of earlier partitions. All other groups
    are window partitions.
    """
    by = [column(k) for k in keys]
    if hot is not None:
        few = F.broadcast(hot.select(*by))  # one key in HOT_ROWS rows at most
        return with_sequence(df.join(few, keys, "left_anti"), keys).unionByName(_spread_sequence(df.join(few, keys, "left_semi"), keys))
    window = Window.partitionBy(*by).orderBy(_order_text(df, keys))
    return df.withColumn(SEQ, (F.row_number().over(window) - 1).cast("long"))


def _spread_sequence(df: DataFrame, keys: list[str]) -> DataFrame:
    names = [f"__k{i}" for i in range(len(keys))]
    packed = df.select(*[column(k).alias(n) for k, n in zip(keys, names)], _order_text(df, keys).alias("__order"), F.struct(*[column(c) for c in df.columns]).alias("__row"))
    # the last range column settles ties in the order, so that equal rows may part but stay in order
    tied = packed.withColumn("__tie", F.monotonically_increasing_id())
    ranged = stored(tied.repartitionByRange(*names, "__order", "__tie").withColumn("__pid", F.spark_partition_id()))
    sizes = ranged.groupBy(*names, "__pid").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*names).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    inner = F.row_number().over(Window.partitionBy(*names, "__pid").orderBy("__order")) - 1
    numbered = ranged.withColumn("__at", inner).join(F.broadcast(before), [*names, "__pid"])  # a row for each hot key and partition
    return numbered.select("__row.*", (F.col("__before") + F.col("__at")).cast("long").alias(SEQ))


def with_counted_sequence(df: DataFrame, keys: list[str]) -> DataFrame:
    """``with_sequence`` for keys with very many equal rows: one row for each distinct row and its count.

    Equal rows are counted first (pre-aggregated before the shuffle), numbered by a running sum over
    distinct rows, and expanded again, so a hot key of few distinct rows is a small window partition.
    """
    columns = df.columns
    counted = df.groupBy(*[column(c) for c in columns]).agg(F.count(F.lit(1)).alias("__n"))
    window = Window.partitionBy(*[column(k) for k in keys]).orderBy(_order_text(df, keys)).rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("__from", F.coalesce(F.sum("__n").over(window), F.lit(0)))
    places = F.explode(F.sequence(F.col("__from"), F.col("__from") + F.col("__n") - 1)).alias(SEQ)
    return numbered.select(*[column(c) for c in columns], places)


def largest_groups(tables: list[DataFrame], keys: list[str]) -> list[int]:
    """Rows of the most frequent repeated key of each table, 0 if none repeats; one action for all."""
    sizes = [duplicate_groups(df, keys).agg(F.lit(i).alias("table"), F.coalesce(F.max("count"), F.lit(0)).alias("n")) for i, df in enumerate(tables)]
    return [r.n for r in sorted(reduce(DataFrame.unionByName, sizes).collect(), key=lambda r: r.table)]  # a row for each table


def hot_keys(df: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> DataFrame:
    """Keys of more than ``rows`` rows."""
    return duplicate_groups(df, keys).where(F.col("count") > rows).drop("count")


def with_row_id(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Add ``_ROW_ID_``: the dense 0-based position, in ``order`` or, without one, in scan order.

    Rows are numbered inside their partitions and moved by the sizes of earlier partitions; the table
    of sizes has a row for each partition. No window over all rows is used.
    """
    rows = df.orderBy(*order) if order else df
    tagged = stored(rows.withColumn("__pid", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    # a window over one small row for each partition
    before = sizes.select(F.col("__pid").alias("__p"), "__first", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__before"))
    numbered = tagged.join(F.broadcast(before), F.col("__pid") == F.col("__p"))
    return numbered.withColumn(ROW_ID, F.col("__before") + F.col("__at") - F.col("__first")).select(*[column(c) for c in df.columns], ROW_ID)


def _align_repeated(prod: DataFrame, dev: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of a key, of both sides, meet in one task, which numbers and pairs them."""
    names, sides = [f"__k{i}" for i in range(len(keys))], (("p", prod), ("d", dev))
    cells = {name: [c for c in df.columns if c not in keys] for name, df in sides}
    packed = lambda df, name: F.struct(F.lit(True).alias("__here"), *[column(c) for c in cells[name]]).alias(name)
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select(*[column(k).alias(n) for k, n in zip(keys, names)], packed(df, name)) for name, df in sides])
    text = lambda name: F.concat_ws("|", *[column(c, name) for c in cells[name]])  # noqa: E731  as ``_order_text``
    place = Window.partitionBy(*names, F.col("p").isNull()).orderBy(F.when(F.col("d").isNull(), text("p")).otherwise(text("d")))
    seq = f"__k{len(keys)}"
    numbered = both.repartition(*names).withColumn(seq, (F.row_number().over(place) - 1).cast("long"))
    paired = numbered.groupBy(*names, seq).agg(*[F.first(name, ignorenulls=True).alias(name) for name, _ in sides])
    side = F.when(F.col("d").isNull(), MISSING).when(F.col("p").isNull(), EXTRA).otherwise(MATCHED)
    return paired.withColumn("side", side)


def align(prod: DataFrame, dev: DataFrame, keys: list[str], repeated: bool = False) -> DataFrame:
    """One full outer join: ``__k0``.. (keys), ``p`` and ``d`` (rows as structs), ``side``.

    One exchange for each input serves matched, missing and extra rows alike. With ``repeated`` the rows of
    a key are numbered as by ``with_sequence``, the numbers are the last key, ``p`` and ``d`` hold no keys, and
    one exchange, by ``keys``, serves for numbers and pairs; keys of very many rows are to be numbered before.
    """
    if repeated:
        return _align_repeated(prod, dev, keys)
    names = [f"__k{i}" for i in range(len(keys))]
    packed = lambda df, name: df.select(*[column(k).alias(n) for k, n in zip(keys, names)], F.struct(*[column(c) for c in df.columns]).alias(name))
    joined = packed(prod, "p").join(packed(dev, "d"), names, "full_outer")
    side = F.when(F.col("d").isNull(), MISSING).when(F.col("p").isNull(), EXTRA).otherwise(MATCHED)
    return joined.withColumn("side", side)


def with_chunks(df: DataFrame, rows: int, order: list[Column] | None = None) -> DataFrame:
    """Add ``chunk_id`` for chunks of ``rows`` consecutive rows."""
    numbered = with_row_id(df, order)
    return numbered.withColumn("chunk_id", F.floor(F.col(ROW_ID) / rows).cast("long"))
