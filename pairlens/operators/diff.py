"""Differences of aligned tables: cells, rows and the wide pass report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, column, differs, label
from .align import MATCHED


def _keys(keys: list[str]) -> list[Column]:
    return [F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)]


def _cells(compared: list[str], tolerance: dict[str, int]) -> list[tuple[str, Column, Column, Column]]:
    cells = []
    for c in compared:
        p, d = column(c, "p"), column(c, "d")
        cells.append((c, p, d, differs(p, d, tolerance.get(c))))
    return cells


def value_differences(aligned: DataFrame, keys: list[str], compared: list[str], tolerance: dict[str, int]) -> DataFrame:
    """Differing cells of matched rows: keys, ``column``, ``prod_value``, ``dev_value``, in one pass."""
    matched = aligned.where(F.col("side") == MATCHED)
    cells = [
        F.when(bad, F.struct(F.lit(c).alias("column"), p.alias("prod_value"), d.alias("dev_value"))) for c, p, d, bad in _cells(compared, tolerance)
    ]
    found = F.array_compact(F.array(*cells)) if cells else F.array().cast("array<struct<column:string,prod_value:string,dev_value:string>>")
    return matched.select(*_keys(keys), F.explode(found).alias("__cell")).select(*[column(k) for k in keys], "__cell.*")


def pass_report(aligned: DataFrame, keys: list[str], compared: list[str], tolerance: dict[str, int], only_failed: bool = False) -> DataFrame:
    """Matched rows wide: keys, ``Prod.c``, ``Dev.c`` and ``CompareResult_c`` for every compared column."""
    cells = _cells(compared, tolerance)
    rows = aligned.where(F.col("side") == MATCHED)
    if only_failed:
        rows = rows.where(any_of([bad for *_, bad in cells]))
    wide = [x for c, p, d, bad in cells for x in (p.alias(f"Prod.{c}"), d.alias(f"Dev.{c}"), label(bad).alias(f"CompareResult_{c}"))]
    return rows.select(*_keys(keys), *wide)


def differences_by_column(cells: DataFrame) -> DataFrame:
    return cells.groupBy("column").agg(F.count(F.lit(1)).alias("differences"))


def cell_measures(compared: list[str], tolerance: dict[str, int]) -> list[tuple[str, Column]]:
    """Aggregates over aligned rows: matched rows that fail, and differing cells."""
    cells, matched = _cells(compared, tolerance), F.col("side") == MATCHED
    bad_cells = sum((F.when(bad, 1).otherwise(0) for *_, bad in cells), F.lit(0))
    failed = F.count_if(matched & any_of([bad for *_, bad in cells]))
    return [("failed", failed), ("cells", F.coalesce(F.sum(F.when(matched, bad_cells).otherwise(0)), F.lit(0)).cast("long"))]
