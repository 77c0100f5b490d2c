"""PROD and DEV views of the test tables: deterministic projections with known differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(key: str, n: int):
    return F.col(key) % n == 0


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Unique keys; DEV lacks and has extra rows, prices inside and outside two decimals, one renamed column."""
    base = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,4)"))
    prod = base.where(F.col("o_orderkey") % 97 != 0)
    price = F.when(_every("o_orderkey", 53), F.col("o_totalprice") + F.lit("0.0040").cast("decimal(18,4)")).when(_every("o_orderkey", 59), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    status = F.when(_every("o_orderkey", 61), F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    dev = base.where(F.col("o_orderkey") % 89 != 0).withColumns({"o_totalprice": price.cast("decimal(18,4)"), "o_orderstatus": status}).withColumnRenamed("o_orderpriority", "o_priority")
    return prod, dev


def lineitem_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keys (order, line) that repeat."""
    money = lambda c: F.col(c).cast("decimal(18,2)").alias(c)
    base = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", money("l_quantity"), money("l_extendedprice"), "l_returnflag", "l_linestatus", "l_shipdate", "l_suppkey")
    flag = F.when(_every("l_partkey", 53), F.lower("l_returnflag")).otherwise(F.col("l_returnflag")).alias("l_returnflag")
    prod = base.where(F.col("l_partkey") % 101 != 0).drop("l_suppkey")
    dev = base.where(F.col("l_suppkey") % 97 != 0).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", flag, "l_linestatus", "l_shipdate")
    return prod, dev


def customer_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """DEV has blank segments and text in the balance column."""
    prod = table(spark, sf_dir, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    segment = F.when(_every("c_custkey", 7), F.lit("  ")).otherwise(F.col("c_mktsegment"))
    balance = F.when(_every("c_custkey", 5), F.lit("unknown")).otherwise(F.col("c_acctbal").cast("string"))
    return prod, prod.withColumns({"c_mktsegment": segment, "c_acctbal": balance})


def part_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """DEV has blank sizes and brands in lower case."""
    prod = table(spark, sf_dir, "part").withColumn("p_retailprice", F.col("p_retailprice").cast("decimal(18,2)"))
    size = F.when(_every("p_partkey", 3), F.lit("")).otherwise(F.col("p_size").cast("string"))
    return prod, prod.withColumns({"p_size": size, "p_brand": F.when(_every("p_partkey", 13), F.lower("p_brand")).otherwise(F.col("p_brand"))})


def supplier_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """For comparison by position: DEV lacks the last rows in order and has renamed suppliers."""
    prod = table(spark, sf_dir, "supplier").withColumn("s_acctbal", F.col("s_acctbal").cast("decimal(18,2)"))
    name = F.when(_every("s_suppkey", 9), F.concat("s_name", F.lit(" Ltd"))).otherwise(F.col("s_name"))
    return prod, prod.where(F.col("s_suppkey") % 17 != 16).withColumn("s_name", name)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job log made of events: a batch for each user, a job for each event."""
    states = F.array(*[F.lit(s) for s in ("SUCCESS", "FAILED", "RUNNING", "SUCCESS", "SKIPPED", "SUCCESS", "CANCELLED", "SUCCESS")])
    status = F.element_at(states, (F.col("event_id") % 31 % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("batch_id"), F.col("ts").alias("created_at"), status.alias("status"), (F.col("event_id") % 101).cast("double").alias("progress")
    )
