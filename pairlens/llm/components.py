"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of edges (a, b); a component is named by its smallest vertex.

    Null vertices and loops are ignored. Each step is a pre-aggregated minimum for each vertex and a
    join on the vertex, so a vertex of very many edges is split like any skewed join key. The number
    of edges never grows, and sets the number of partitions.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rows = e.count()
    few = lambda df: gathered(df, 2 * rows)
    e, mark = few(e), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = few(both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))).withColumn("m", F.least("m", "c"))
        large = few(both.join(low, F.col("u") == F.col("c"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = few(large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")))
        joined = few(large.join(low, F.col("u") == F.col("c")))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
        e = cut(few(small.where("u <> v").distinct()))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return few(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
