"""Column-set differences and comparison of typed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import column
from .align import EXTRA, MATCHED, MISSING

FIELD_SCHEMA = "field string, side string"


def schema_differences(prod: DataFrame, dev: DataFrame, exclude: set[str] | frozenset[str] = frozenset()) -> list[tuple[str, str]]:
    """(field, side) of columns on one side only, by side and name."""
    p, d = set(prod.columns) - set(exclude), set(dev.columns) - set(exclude)
    return sorted([(c, EXTRA) for c in d - p] + [(c, MISSING) for c in p - d], key=lambda x: (x[1], x[0]))


def filled_measures(fields: list[tuple[str, str]]) -> list[tuple[str, Column]]:
    """Aggregates over aligned rows: cells of each field that are not blank, over matched rows."""
    matched = F.col("side") == MATCHED
    return [(f"f{i}", F.count_if(matched & (column(c, "d" if side == EXTRA else "p") != ""))) for i, (c, side) in enumerate(fields)]


def first_fields(report: DataFrame, limit: int = 8) -> DataFrame:
    """For each side the first ``limit`` fields in order and how many more there are (a display list)."""
    names = F.array_sort(F.collect_list("field"))
    return report.groupBy("side").agg(names.alias("all")).select("side", F.slice("all", 1, limit).alias("fields"), F.greatest(F.size("all") - limit, F.lit(0)).alias("more"))


def typed_schema_check(spark: SparkSession, prod: DataFrame, dev: DataFrame, keys: list[str], ignore: list[str] = [], partitions: tuple[list[str], list[str]] = ([], [])) -> DataFrame:
    """``field, prod_type, dev_type, status`` of both schemas.

    Status is ok, missing, extra, type mismatch, missing key, case differs (the other side has the
    name in other letters only) or partition mismatch (``partitions``, the columns that each side is
    partitioned by, name it for one side only).
    """
    types = lambda df: {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in ignore}
    left = spark.createDataFrame(list(types(prod).items()), "field string, prod_type string")
    right = spark.createDataFrame(list(types(dev).items()), "field string, dev_type string")
    wanted = spark.createDataFrame([(k,) for k in keys], "key string")
    both = left.join(right, "field", "full_outer").join(wanted, F.col("field") == F.col("key"), "full_outer")
    absent = F.col("prod_type").isNull() | F.col("dev_type").isNull()
    lower = lambda df, other: [c for c in df.columns if c not in other.columns and c.lower() in {x.lower() for x in other.columns}]
    cased, uneven = lower(prod, dev) + lower(dev, prod), sorted(set(partitions[0]) ^ set(partitions[1]))
    status = (
        F.when(F.col("key").isNotNull() & absent, "missing key")
        .when(absent & F.col("field").isin(*cased), "case differs")
        .when(F.col("dev_type").isNull(), "missing")
        .when(F.col("prod_type").isNull(), "extra")
        .when(F.col("prod_type") != F.col("dev_type"), "type mismatch")
        .when(F.col("field").isin(*uneven), "partition mismatch")
        .otherwise("ok")
    )
    return both.select(F.coalesce("field", "key").alias("field"), "prod_type", "dev_type", status.alias("status"))
