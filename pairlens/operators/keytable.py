"""One table of keys for a pair of canonical tables: what can be said of their rows without their cells.

Every row sends its key, a 128-bit digest of its compared cells and nothing else; rows of a key are added
up before the exchange, so a key of very many rows is a few rows of it. The table has a row for each key:

* ``__k0`` .. the key, ``n_prod`` and ``n_dev`` its rows on each side;
* ``s0`` .. ``s3`` the four quarters of PROD's digests, summed, minus DEV's: zero if both sides hold the
  same rows as often (null, which settles nothing, beyond two thousand million rows of a key);
* ``f0`` .. cells that are not blank, of the fields that one side lacks.

A key is *settled* if both sides have as many rows of it and the sums are zero: its rows pair off without a
difference. It is *open* if both sides have it and it is not settled; only rows of open keys need cells.
Missing and extra rows, duplicate keys, hot keys and all row counts follow from the table alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..functions.text import column
from .align import EXTRA, MATCHED, MISSING, SEQ

BROADCAST_BYTES = 32 << 20  # of keys that are sent to all tasks
_PLACES = 1 << 14  # rows of a key that are listed at a time
_QUARTERS = tuple(f"s{k}" for k in range(4))


def _names(keys: list[str]) -> list[str]:
    return [f"__k{i}" for i in range(len(keys))]


def _side(df: DataFrame, keys: list[str], compared: list[str], fields: list[tuple[str, str]], own: str, hashed: bool) -> DataFrame:
    """Keys, counts, signed digests and filled fields of one side."""
    prod = own == MISSING
    names = [column(c) for c in compared]
    quarters = [q for seed in (1, 2) for h in [F.xxhash64(F.lit(seed), *names)] for q in (F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    digests = [((q if prod else -q) if hashed else F.lit(None)).cast("long").alias(n) for q, n in zip(quarters, _QUARTERS)]
    filled = [(column(c) != "" if side == own else F.lit(False)).cast("long").alias(f"f{i}") for i, (c, side) in enumerate(fields)]
    one = [F.lit(int(prod)).cast("long").alias("n_prod"), F.lit(int(not prod)).cast("long").alias("n_dev")]
    return df.select(*[column(k).alias(n) for k, n in zip(keys, _names(keys))], *one, *digests, *filled)


def key_rows(prod: DataFrame, dev: DataFrame, keys: list[str], compared: list[str], fields: list[tuple[str, str]] = [], hashed: bool = True) -> DataFrame:
    """The key table of a pair, in one pre-aggregated exchange; without ``hashed`` no key is settled.

    ``fields`` are (name, side) of columns that the other side lacks. Tables that are bucketed alike by
    their keys need no exchange.
    """
    both = _side(prod, keys, compared, fields, MISSING, hashed).unionByName(_side(dev, keys, compared, fields, EXTRA, hashed))
    sums = [F.sum(c).alias(c) for c in ("n_prod", "n_dev", *[f"f{i}" for i in range(len(fields))])] + [F.try_sum(q).alias(q) for q in _QUARTERS]
    return both.groupBy(*_names(keys)).agg(*sums)


def key_counts(prod: DataFrame, dev: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of a pair and their rows on each side, not stored: what ``alignment`` needs of the key table, for a third of its exchange."""
    counts = lambda df, own: _side(df, keys, [], [], own, False).select(*_names(keys), "n_prod", "n_dev")
    both = counts(prod, MISSING).unionByName(counts(dev, EXTRA))
    return both.groupBy(*_names(keys)).agg(F.sum("n_prod").alias("n_prod"), F.sum("n_dev").alias("n_dev"))


def key_table(*args, **kwargs) -> DataFrame:
    """``key_rows``, stored."""
    return stored(key_rows(*args, **kwargs))


def settled(same_columns: bool) -> Column:
    """Rows of repeated keys are paired in the order of all their columns, so those settle only if both sides have the same columns."""
    equal = reduce(lambda a, b: a & b, (F.col(q) == 0 for q in _QUARTERS), F.col("n_prod") == F.col("n_dev"))
    equal = equal if same_columns else equal & (F.col("n_prod") == 1)
    return F.coalesce(equal, F.lit(False))


def is_open(same_columns: bool) -> Column:
    return (F.col("n_prod") > 0) & (F.col("n_dev") > 0) & ~settled(same_columns)


def totals(table: DataFrame, keys: list[str], same_columns: bool, fields: list[tuple[str, str]] = []) -> Row:
    """All row counts, the sizes of hot keys and of what is not settled: one row, one pass over the keys."""
    done, opened = settled(same_columns), is_open(same_columns)
    rest = (F.col("n_prod") > 0) & ~done
    total = lambda c, where=F.lit(True): F.coalesce(F.sum(F.when(where, c)), F.lit(0)).cast("long")
    size = sum((F.octet_length(F.col(n).cast("string")) for n in _names(keys)), F.lit(16 * (len(keys) + 1))).cast("long")
    return table.agg(
        total(F.col("n_prod")).alias("total_prod"),
        total(F.col("n_dev")).alias("total_dev"),
        total(F.greatest(F.col("n_prod") - F.col("n_dev"), F.lit(0))).alias("missing_dev"),
        total(F.greatest(F.col("n_dev") - F.col("n_prod"), F.lit(0))).alias("extra_dev"),
        total(F.col("n_prod"), done).alias("settled"),
        F.count_if(F.col("n_prod") > 1).alias("duplicate_prod"),
        F.count_if(F.col("n_dev") > 1).alias("duplicate_dev"),
        F.coalesce(F.max("n_prod"), F.lit(0)).alias("largest_prod"),
        F.coalesce(F.max("n_dev"), F.lit(0)).alias("largest_dev"),
        F.count_if(opened).alias("open"),
        total(size, opened).alias("open_bytes"),
        F.count_if(rest).alias("rest"),
        total(size, rest).alias("rest_bytes"),
        *[total(F.col(f"f{i}"), done).alias(f"f{i}") for i in range(len(fields))],
    ).first()


def _rows(table: DataFrame, keys: list[str], sequence: bool, first: Column) -> DataFrame:
    """``keys``, ``_SEQ_`` (if rows are numbered) and ``side`` of the rows from place ``first`` of each key on."""
    named = [F.col(n).alias(k) for n, k in zip(_names(keys), keys)]
    if sequence:  # in blocks: a key may have very many rows
        last = F.greatest("n_prod", "n_dev") - 1
        blocks = table.withColumn("__b", F.explode(F.sequence(F.floor(first / _PLACES), F.floor(last / _PLACES))))
        low = F.greatest(first, F.col("__b") * _PLACES)
        table = blocks.withColumn("__at", F.explode(F.sequence(low.cast("long"), F.least(last, F.col("__b") * _PLACES + _PLACES - 1).cast("long"))))
        named.append(F.col("__at").alias(SEQ))
    at = F.col("__at") if sequence else F.lit(0)
    return table.select(*named, F.when(at >= F.col("n_dev"), MISSING).when(at >= F.col("n_prod"), EXTRA).otherwise(MATCHED).alias("side"))


def alignment(table: DataFrame, keys: list[str], sequence: bool) -> DataFrame:
    """Every row of either table: ``keys``, ``_SEQ_`` if rows are numbered, and ``side``."""
    return _rows(table, keys, sequence, F.lit(0).cast("long"))


def one_sided(table: DataFrame, keys: list[str], sequence: bool) -> DataFrame:
    """The rows of ``alignment`` that one side lacks."""
    return _rows(table.where("n_prod <> n_dev"), keys, sequence, F.least("n_prod", "n_dev"))


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys duplicated on either side, with ``duplicate_in_prod`` and ``duplicate_in_dev``."""
    rows = table.where("n_prod > 1 or n_dev > 1")
    return rows.select(*[F.col(n).alias(k) for n, k in zip(_names(keys), keys)], (F.col("n_prod") > 1).alias("duplicate_in_prod"), (F.col("n_dev") > 1).alias("duplicate_in_dev"))


def rows_of(df: DataFrame, keys: list[str], wanted: DataFrame, size: int, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is among those of the key table's rows ``wanted``, or with ``left_anti`` is not.

    Keys of at most ``BROADCAST_BYTES`` (``size``, measured) are sent to the tasks that read ``df``, so no
    other row moves; more keys are joined by an exchange.
    """
    names = [f"__w{i}" for i in range(len(keys))]
    while set(names) & set(df.columns):
        names = [f"{n}_" for n in names]
    few = wanted.select(*[F.col(n).alias(w) for n, w in zip(_names(keys), names)])
    few = F.broadcast(few) if size <= BROADCAST_BYTES else few
    return df.join(few, [column(k) == F.col(w) for k, w in zip(keys, names)], how)
