"""Writers of results. Nothing is overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical, clean_name, column
from ..operators.history import overall_pass


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 CSV with a header, quoted so that ``read_delimited`` gets the same cells back."""
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def result_path(spark: SparkSession, root: str, table: str, result_name: str, run_id: str) -> str:
    """Where a result table of a run lies: ``root/table/run_id=.../result_name=...``."""
    name = spark.range(1).select(clean_name(F.lit(result_name))).first()[0]
    return f"{root}/{table}/run_id={run_id}/result_name={name}"


def write_table(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One Parquet table that must not exist yet; sorted over all files by the columns of ``order`` that it has."""
    by = [column(c) for c in order or [] if c in df.columns]
    (df.orderBy(*by) if by else df).write.mode("errorifexists").parquet(path)


def write_keyed(df: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None, **texts) -> None:
    """The canonical text of ``df`` as a catalog table that must not exist yet, bucketed and sorted by its keys.

    Two such tables of one number of buckets are compared (``DiffConfig(canonical_inputs=True)``) without an
    exchange of either: a version that many others are compared with is shuffled once, when it is written.
    ``texts`` are options of ``canonical``; ``path`` puts the files outside the warehouse. All rows of a key
    are in one bucket.
    """
    rows = canonical(df, **texts)
    writer = rows.repartition(buckets, *[column(k) for k in keys]).write.format("parquet").mode("errorifexists").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_results(tables: dict[str, DataFrame], root: str, result_name: str, run_id: str, order: list[str] | None = None) -> dict[str, str]:
    """Every result table as Parquet under ``root/table/run_id=.../result_name=...``; {table: path}.

    An empty result is an empty table. A run that exists already is refused. ``DiffResult.write`` writes
    the results of one pair and reads its aligned rows once.
    """
    paths = {}
    for table, df in tables.items():
        paths[table] = result_path(df.sparkSession, root, table, result_name, run_id)
        write_table(df, paths[table], order)
    return paths


def write_summary(summaries: DataFrame, root: str, run_id: str) -> None:
    """Summary rows with ``overall_pass`` repeated on each, as JSON."""
    summaries.crossJoin(overall_pass(summaries).select("overall_pass")).write.mode("errorifexists").json(f"{root}/run_id={run_id}")  # one row


def append_audit(events: DataFrame, root: str) -> None:
    """Append audit events (column ``timestamp`` in seconds) as JSON under year, month and day."""
    at = F.timestamp_seconds("timestamp")
    dated = events.withColumns({"year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM"), "day": F.date_format(at, "dd")})
    dated.write.mode("append").partitionBy("year", "month", "day").json(root)
