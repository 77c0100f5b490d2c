"""Run history: filters, pages and totals over stored summary or run-log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def history(log: DataFrame, order: list[Column], status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the log, by ``order`` (newest first is the caller's choice), of one status if given."""
    rows = log.where(F.upper("status") == status.upper()) if status else log
    return rows.orderBy(*order).offset(offset).limit(limit)


#: States of a job that is over, and the states of a batch below.
OVER = ("SUCCESS", "FAILED", "CANCELLED", "SKIPPED")


def batch_totals(jobs: DataFrame) -> DataFrame:
    """Totals of each batch from its job rows (batch_id, status, progress).

    A job is over when it succeeded, failed, was cancelled or was skipped. The batch is RUNNING while
    a job is not over, CANCELLED if one was cancelled, else SUCCESS, PARTIAL_SUCCESS or FAILED.
    """
    counted = lambda *names: F.count_if(F.col("status").isin(*names))
    sums = jobs.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        counted(*OVER).alias("completed"),
        counted("SUCCESS").alias("successful"),
        counted("FAILED").alias("failed"),
        counted("CANCELLED").alias("__cancelled"),
        F.round(F.avg("progress"), 1).alias("progress"),
    )
    status = (
        F.when(F.col("completed") < F.col("total"), "RUNNING")
        .when(F.col("__cancelled") > 0, "CANCELLED")
        .when(F.col("failed") == 0, "SUCCESS")
        .when(F.col("successful") > 0, "PARTIAL_SUCCESS")
        .otherwise("FAILED")
    )
    return sums.withColumn("status", status).drop("__cancelled")


def overall_pass(summaries: DataFrame, strict: bool = False) -> DataFrame:
    """One row: whether every pair has no failed row, error or alert (and, if strict, no row on one side only)."""
    zero = lambda c: F.coalesce(c, F.lit(0)) == 0
    ok = zero(F.col("matched_failed")) & F.col("error").isNull() & zero(F.col("alerts_triggered"))
    if strict:
        ok = ok & zero(F.col("missing_dev")) & zero(F.col("extra_dev"))
    return summaries.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("overall_pass"))
