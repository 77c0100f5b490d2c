"""Quality metrics of the columns of canonical tables, in one pass over each table after unpivoting.

Everything but exact distinct counts can be merged: ``profile_parts`` holds a row for each column and group
of rows (a day, a partition, a file) with counts, extremes, mean, sum of squares around it and a sketch of
the distinct values; ``merge_parts`` makes of such rows those of larger groups. Stored parts of old data
need not be computed again when new data come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import column, parsed

#: The checks that a quality report can be limited to.
CHECKS = frozenset({"null_rate", "distinct_count", "type_inference", "numeric_stats"})
NUMERIC_SHARE = 0.9  # a column is numeric if more of its rows parse
SKETCH = 12  # binary logarithm of the sketch's registers: about 1.6 % off
_PART = ("rows", "blanks", "count", "lo", "hi", "mean", "m2")


def _long(df: DataFrame, by: list[str], numbers: bool) -> DataFrame:
    """A row for each cell: the group (``__b0`` ..), ``column``, ``value`` and ``number``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), column(c).alias("value")) for c in df.columns if c not in by])
    long = df.select(*[column(b).alias(f"__b{i}") for i, b in enumerate(by)], F.inline(cells))
    return long.withColumn("number", parsed(F.col("value")) if numbers else F.lit(None).cast("double"))


def _moments() -> list[Column]:
    """Aggregates of one pass; Spark merges the moments of partial groups around their means."""
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("value") == "").alias("blanks"),
        F.count("number").alias("count"),
        F.min("number").alias("lo"),
        F.max("number").alias("hi"),
        F.avg("number").alias("mean"),
        (F.var_pop("number") * F.count("number")).alias("m2"),
    ]


def _described(parts: DataFrame, by: list[str], stats: bool = True) -> DataFrame:
    """Profile rows of parts: null_rate, distinct_count, numeric, min, max, mean, std, count."""
    numeric = F.col("count") / F.col("rows") > NUMERIC_SHARE
    # one row in the table: 0; one number among several rows: undefined
    std = F.when(F.col("rows") == 1, 0.0).otherwise(F.sqrt(F.col("m2") / F.nullif(F.col("count") - 1, F.lit(0))))
    value = lambda c: F.when(numeric, F.round(c, 6)) if stats else F.lit(None).cast("double")
    return parts.select(
        *[column(b) for b in by],
        "column",
        F.round(F.col("blanks").cast("double") / F.col("rows"), 6).alias("null_rate"),
        "distinct_count",
        numeric.alias("numeric"),
        value(F.col("lo")).alias("min"),
        value(F.col("hi")).alias("max"),
        value(F.col("mean")).alias("mean"),
        value(std).alias("std"),
        (F.when(numeric, F.col("count")) if stats else F.lit(None).cast("long")).alias("count"),
    )


def profile(df: DataFrame, approx: bool = False, distinct: bool = True, checks: frozenset[str] = CHECKS) -> DataFrame:
    """A row for each column: null_rate, distinct_count, numeric, min, max, mean, std, count.

    The statistics are null unless the column is numeric. ``approx`` counts distinct values with a
    sketch; exact counting shuffles the distinct (column, value) pairs, pre-aggregated, and the other
    metrics with them. What only checks need that are not among ``checks`` is not computed.
    """
    own = F.nullif(F.col("value"), F.lit(""))
    if not (distinct and "distinct_count" in checks):
        several = F.lit(None).cast("long")
    else:
        several = F.approx_count_distinct(own) if approx else F.count_distinct(own)
    cells = _long(df, [], bool(checks & {"type_inference", "numeric_stats"}))
    return _described(cells.groupBy("column").agg(*_moments(), several.alias("distinct_count")), [], "numeric_stats" in checks)


def profile_parts(df: DataFrame, by: list[str] = []) -> DataFrame:
    """A mergeable row for each column and group: ``by``, ``column``, rows, blanks, count, lo, hi, mean, m2 and ``sketch``.

    The columns of ``by`` (a day, say) group the rows and are not profiled themselves.
    """
    sketch = F.hll_sketch_agg(F.nullif(F.col("value"), F.lit("")), F.lit(SKETCH)).alias("sketch")
    names = [f"__b{i}" for i in range(len(by))]
    parts = _long(df, by, True).groupBy(*names, "column").agg(*_moments(), sketch)
    return parts.select(*[F.col(n).alias(b) for n, b in zip(names, by)], "column", *_PART, "sketch")


def merge_parts(parts: DataFrame, by: list[str] = []) -> DataFrame:
    """Parts of larger groups: those that agree in ``by`` (fewer columns than before, or none) become one.

    Squares are added up around the common mean, so nothing cancels out.
    """
    group = [*[column(b) for b in by], F.col("column")]
    over = Window.partitionBy(*group)  # a row for each part and column
    mean = F.sum(F.col("count") * F.col("mean")).over(over) / F.nullif(F.sum("count").over(over), F.lit(0))
    around = parts.withColumn("__mean", mean)
    moved = F.col("m2") + F.col("count") * (F.col("mean") - F.col("__mean")) * (F.col("mean") - F.col("__mean"))
    sums = [F.sum(c).alias(c) for c in ("rows", "blanks", "count")] + [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("__mean").alias("mean"), F.sum(moved).alias("m2")]
    return around.groupBy(*group).agg(*sums, F.hll_union_agg("sketch").alias("sketch")).select(*[column(b) for b in by], "column", *_PART, "sketch")


def profile_of_parts(parts: DataFrame, by: list[str] = []) -> DataFrame:
    """The rows of ``profile`` for each group of ``parts``; distinct values are estimated from the sketches."""
    return _described(parts.withColumn("distinct_count", F.hll_sketch_estimate("sketch")), by)


def type_mismatches(prod: DataFrame, dev: DataFrame) -> DataFrame:
    """Columns of both profiles that are numeric on one side only."""
    p, d = (x.select("column", F.col("numeric").alias(n)) for x, n in ((prod, "prod_numeric"), (dev, "dev_numeric")))
    return p.join(d, "column").where("prod_numeric <> dev_numeric").select("column")


def quality_report(prod: DataFrame, dev: DataFrame, checks: frozenset[str] = CHECKS) -> DataFrame:
    """Both profiles side by side, a row for each column of either; checks that are off give nulls."""
    names = ["null_rate", "distinct_count", "min", "max", "mean", "std"]
    p, d = (x.select("column", "numeric", *names) for x in (prod, dev))
    both = p.alias("p").join(d.alias("d"), "column", "full_outer")
    of = {"null_rate": "null_rate", "distinct_count": "distinct_count"}
    cells = [
        (F.col(f"{side}.{n}") if of.get(n, "numeric_stats") in checks else F.lit(None)).cast("long" if n == "distinct_count" else "double").alias(f"{n}_{name}")
        for n in names
        for side, name in (("p", "prod"), ("d", "dev"))
    ]
    mismatch = F.when(F.col("p.numeric") != F.col("d.numeric"), "Yes").otherwise("No") if "type_inference" in checks else F.lit("No")
    return both.select("column", *cells, mismatch.alias("type_mismatch"))
