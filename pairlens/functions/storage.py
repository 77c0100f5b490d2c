"""Checkpoints in the shared folder that the cluster names, and exchanges that are dropped once they were read."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; where it is unset a local master (tests) gets a local folder, a cluster an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pairlens-")
    context.setCheckpointDir(folder)


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's own folder below ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def dropped_exchanges(spark: SparkSession) -> Iterator[None]:
    """Within it Spark deletes what a job's exchanges have written when the job ends, not when the driver collects its garbage.

    For jobs whose results are stored: a table that is computed again exchanges its rows again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
