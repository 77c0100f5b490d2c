"""Rule tables: tolerances, alerts, pre-flight checks and control rows, all as small DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import column, strip

#: Metrics, operators and levels that alert rules may name, and the largest tolerance.
METRICS = (
    "matched_failed", "matched_passed", "total_diffs", "missing_dev", "extra_dev", "missing_dev_pct", "extra_dev_pct",
    "dup_count_prod", "dup_count_dev", "schema_missing", "schema_extra", "type_mismatch_count",
)
OPERATORS = (">", "<", ">=", "<=", "==", "!=")
LEVELS = ("ERROR", "WARNING", "INFO")
MAX_DECIMALS = 18


def normalised_names(df: DataFrame) -> dict[str, str]:
    """{name in lower case with single blanks: actual name}."""
    return {" ".join(c.lower().split()): c for c in df.columns}


def tolerance_rules(rules: DataFrame) -> DataFrame:
    """``prod_name, dev_name, field, decimals, reason``; reason says why a rule cannot be used.

    The control table has the columns Prod File Name, Dev File Name, Field Name and Tolerance Level
    (in decimal), found regardless of case and blanks. Decimals are whole numbers from 0 to 18.
    """
    names = normalised_names(rules)
    level = next(v for k, v in names.items() if k.startswith("tolerance level"))
    text = F.btrim(column(level).cast("string"))
    decimals = text.try_cast("int")
    blank = lambda c: F.coalesce(F.btrim(c), F.lit("")) == ""
    parts = {n: F.btrim(column(names[k]).cast("string")) for n, k in (("prod_name", "prod file name"), ("dev_name", "dev file name"), ("field", "field name"))}
    reason = (
        F.when(blank(parts["prod_name"]) | blank(parts["dev_name"]) | blank(parts["field"]), "blank name")
        .when(blank(text), "blank tolerance")
        .when(decimals.isNull(), "tolerance is not a whole number")
        .when((decimals < 0) | (decimals > MAX_DECIMALS), "tolerance out of range")
    )
    return rules.select(*[c.alias(n) for n, c in parts.items()], F.when(reason.isNull(), decimals).alias("decimals"), reason.alias("reason"))


def pair_tolerance(rules: DataFrame, prod_name: str, dev_name: str, prod: list[str], dev: list[str], ignore: list[str]) -> DataFrame:
    """Usable and skipped rules of one pair: ``field, decimals, reason``."""
    spark = rules.sparkSession
    known = lambda names, flag: spark.createDataFrame([(n, True) for n in names], f"__{flag} string, {flag} boolean")
    own = rules.where((F.col("prod_name") == prod_name) & (F.col("dev_name") == dev_name))
    for names, flag in ((prod, "in_prod"), (dev, "in_dev"), (ignore, "ignored")):
        table = known(names, flag)
        own = own.join(F.broadcast(table), F.col("field") == F.col(f"__{flag}"), "left")  # a row for each column name
    reason = F.coalesce(
        "reason", F.when(F.col("ignored").isNotNull(), "ignored").when(F.col("in_prod").isNull(), "absent from PROD").when(F.col("in_dev").isNull(), "absent from DEV")
    )
    return own.select("field", "decimals", reason.alias("reason"))


def tolerance_map(pair: DataFrame) -> dict[str, int]:
    """{field: decimals} of usable rules; the last by decimals wins where a field is named twice."""
    rows = pair.where(F.col("reason").isNull()).groupBy("field").agg(F.max("decimals").alias("decimals")).collect()
    return {r.field: r.decimals for r in rows}


def unpivoted_metrics(one_row: DataFrame) -> DataFrame:
    """``metric, value`` from a table of one row."""
    return one_row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), column(c).cast("double").alias("value")) for c in one_row.columns])))


def _alert_problem() -> Column:
    """Why an alert rule cannot be evaluated; null if it can. Absent operators and thresholds have defaults."""
    operator = F.coalesce(F.btrim("operator"), F.lit(">"))
    return (
        F.when(~F.coalesce(F.btrim("metric"), F.lit("")).isin(*METRICS), "unknown metric")
        .when(~operator.isin(*OPERATORS), "unknown operator")
        .when(F.coalesce(F.btrim(F.col("threshold").cast("string")), F.lit("0")).try_cast("double").isNull(), "threshold is not a number")
    )


def alert_issues(rules: DataFrame) -> DataFrame:
    """``rule, problem`` of alert rules that cannot be used."""
    problem = F.coalesce(_alert_problem(), F.when(~F.upper(F.coalesce("level", F.lit("WARNING"))).isin(*LEVELS), "unknown level"))
    return rules.select(F.col("metric").alias("rule"), problem.alias("problem")).where(F.col("problem").isNotNull())


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose condition holds: ``level, metric, operator, threshold, actual_value, message``.

    A rule of unknown metric or operator, or whose threshold is no number, never fires; an absent
    threshold is 0, an unknown level is passed on.
    """
    threshold = F.coalesce(F.btrim(F.col("threshold").cast("string")).try_cast("double"), F.lit(0.0))
    rule = rules.where(_alert_problem().isNull()).select(
        F.upper(F.coalesce("level", F.lit("WARNING"))).alias("level"),
        F.btrim("metric").alias("metric"),
        F.coalesce(F.btrim("operator"), F.lit(">")).alias("operator"),
        threshold.alias("threshold"),
        F.coalesce("message", F.concat(F.lit("Alert: "), F.col("metric"))).alias("message"),  # fixed value: the default text
    )
    values = metrics.select(F.col("metric").alias("__m"), F.col("value").alias("actual_value"))
    v, t = F.col("actual_value"), F.col("threshold")
    holds = F.lit(False)
    for name, condition in ((">", v > t), ("<", v < t), (">=", v >= t), ("<=", v <= t), ("==", v == t), ("!=", v != t)):
        holds = F.when(F.col("operator") == name, condition).otherwise(holds)
    joined = rule.join(F.broadcast(values), F.col("metric") == F.col("__m"))  # twelve rows
    return joined.where(holds).select("level", "metric", "operator", "threshold", "actual_value", "message")


def active_pairs(control: DataFrame) -> DataFrame:
    """Rows of a control table whose run flag is yes, with parsed keys and options.

    ``result_name, path, prod, dev, keys, ignore, include_pass``; key columns in numeric order.
    """
    names = normalised_names(control)
    text = lambda k: F.btrim(column(names[k]).cast("string")) if k in names else F.lit(None).cast("string")
    numbered = sorted((int(k.removeprefix("key column").strip() or 0), v) for k, v in names.items() if k.startswith("key column"))
    keys = [F.nullif(strip(column(v).cast("string")), F.lit("")) for _, v in numbered]
    rows = control.where(F.lower(text("run")).isin("yes", "y", "true", "1"))
    ignore = F.filter(F.transform(F.split(F.coalesce(text("ignorefields"), F.lit("")), ","), lambda x: F.btrim(x)), lambda x: x != "")
    return rows.select(
        text("result report name").alias("result_name"),
        text("files path").alias("path"),
        text("prod file name").alias("prod"),
        text("dev file name").alias("dev"),
        F.array_compact(F.array(*keys) if keys else F.array().cast("array<string>")).alias("keys"),
        ignore.alias("ignore"),
        F.coalesce(F.lower(text("include pass report")).isin("yes", "y", "true", "1"), F.lit(False)).alias("include_pass"),
    )


#: Columns that a control table must have.
REQUIRED = ("run", "files path", "prod file name", "dev file name", "result report name")


def control_issues(control: DataFrame, files: DataFrame) -> DataFrame:
    """``row, field, message`` for problems of a control table's rows.

    ``control`` has a column ``row`` beside its own; ``files`` is (path) of the inputs that exist. A
    required column that is absent is one issue with a null row.
    """
    names = normalised_names(control)
    absent = [c for c in REQUIRED if c not in names]
    if absent:
        return control.sparkSession.createDataFrame([(None, c, "required column is missing") for c in absent], "row long, field string, message string")
    text = {k: F.coalesce(F.btrim(column(names[k]).cast("string")), F.lit("")) for k in REQUIRED}
    rows = control.select(F.col("row").cast("long").alias("row"), *[c.alias(f"c{i}") for i, c in enumerate(text.values())])
    blank = [F.when(F.col(f"c{i}") == "", F.struct(F.lit(k).alias("field"), F.lit("is empty").alias("message"))) for i, k in enumerate(REQUIRED) if k != "run"]
    empty = rows.select("row", F.inline(F.array_compact(F.array(*blank))))
    paths = rows.select("row", F.inline(F.array(*[F.struct(F.lit(k).alias("field"), F.concat_ws("/", "c1", f"c{i}").alias("path"), (F.col(f"c{i}") != "").alias("named")) for i, k in ((2, "prod file name"), (3, "dev file name"))])), "c1")
    lost = paths.where("named and c1 <> ''").join(files.select(F.col("path").alias("known")), F.col("path") == F.col("known"), "left_anti")
    return empty.unionByName(lost.select("row", "field", F.concat(F.lit("file not found: "), F.col("path")).alias("message")))


def quality_switches(switches: DataFrame) -> tuple[frozenset[str], DataFrame]:
    """(checks that are on, ``check, problem`` of unknown names and unclear values) of a (check, value) table."""
    from .profile import CHECKS

    value = F.lower(F.btrim(F.col("value").cast("string")))
    problem = F.when(~F.col("check").isin(*CHECKS), "unknown check").when(~F.coalesce(value, F.lit("")).isin("true", "false", "yes", "no", "1", "0"), "not a yes or no")
    off = {r.check for r in switches.where(problem.isNull() & value.isin("false", "no", "0")).select("check").distinct().collect()}  # four names
    return CHECKS - off, switches.select("check", problem.alias("problem")).where(F.col("problem").isNotNull())


SPEC = "job int, prod_path string, dev_path string, keys array<string>, ignore_columns array<string>, tolerance map<string,string>"


def preflight_issues(specs: DataFrame, columns: DataFrame) -> DataFrame:
    """``job, field, message, severity`` for every problem of every job, job numbers from 1.

    ``columns`` is (path, name) for the columns of every readable input; a path without rows is
    reported as unreadable. Missing keys in the spec are a warning; everything else is an error.
    """
    issue = lambda df, field, message, severity="ERROR": df.select("job", F.lit(field).alias("field"), (F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit(severity).alias("severity"))
    known = columns.groupBy("path").agg(F.collect_set("name").alias("names"))
    found = []
    for side in ("prod", "dev"):
        path = F.coalesce(F.btrim(f"{side}_path"), F.lit(""))
        rows = specs.withColumn("__path", path).join(known, F.col("__path") == F.col("path"), "left")
        found.append(issue(rows.where("__path = ''"), f"{side}_path", f"No {side.upper()} input is named."))
        found.append(issue(rows.where("__path <> '' and names is null"), f"{side}_path", F.concat(F.lit("No columns are known of input "), F.col("__path"))))
        missing = rows.where("names is not null").select("job", "__path", "names", F.explode("keys").alias("key")).where(~F.array_contains("names", F.col("key")))
        found.append(issue(missing, "keys", F.concat(F.lit(f"{side.upper()} input "), F.col("__path"), F.lit(" has no column for key "), F.col("key"))))
    found.append(issue(specs.where("coalesce(size(keys), 0) <= 0"), "keys", "The job names no key, so rows are compared by their places.", "WARNING"))
    levels = specs.select("job", F.explode("tolerance").alias("name", "level"))
    number = F.btrim("level").try_cast("int")
    bad = levels.where(number.isNull() | (number < 0) | (number > MAX_DECIMALS))
    found.append(issue(bad, "tolerance", F.concat(F.lit("Tolerance of '"), F.col("name"), F.lit("' must be a whole number from 0 to 18."))))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def columns_of(inputs: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """(path, column) rows for ``preflight_issues``; reads no data."""
    return [(path, c) for path, df in inputs.items() for c in df.columns]
