"""One comparison from two inputs to all result tables, and many comparisons from a control table.

Rows are compared hash-first: the key table (``operators.keytable``) settles rows that are equal, and cells
are fetched only for keys whose rows may differ. It is stored when a result first needs it. ``results`` and
``write`` run every step, store its tables and keep the fetched rows while they do; what the summary,
metrics, settings and alerts need of them is observed while the differences are stored, so none of them
reads the rows again. Only one-row summaries and control tables reach the driver.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import dropped_exchanges, stored
from ..functions.text import apart_by_case, canonical, column, percent
from ..operators import align as A
from ..operators import diff, keytable, profile, rules, schema_diff
from ..operators.history import overall_pass  # noqa: F401
from ..sources import readers, sinks

#: The order of the built-in steps.
STEPS = ("tolerance", "comparison", "duplicate", "schema", "data_quality", "alerts")
#: The names of a summary's fields.
SUMMARY = (
    "result_name string, prod_file string, dev_file string, total_prod long, total_dev long, matched_passed long, matched_failed long, extra_dev long, missing_dev long, duplicate_prod long, "
    "duplicate_dev long, used_keys array<string>, missing_key_columns array<string>, ignored_fields array<string>, tolerance_used map<string,int>, report_path string, elapsed_seconds double, "
    "alerts_triggered long, schema_extra_count long, schema_missing_count long, error string"
)


@dataclass(frozen=True)
class DiffConfig:
    """What to compare and how. Keys that a side lacks are reported, not fatal."""

    keys: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    tolerance: dict[str, int] = field(default_factory=dict)
    scales: dict[str, int] = field(default_factory=dict)
    na_values: tuple[str, ...] = ()
    order: tuple[str, ...] = ()  # row order where there is no key
    result_name: str = "CompareRecords"
    prod_name: str = "prod"
    dev_name: str = "dev"
    enabled: frozenset[str] = frozenset(STEPS)
    canonical_inputs: bool = False  # the inputs are canonical text already, as ``sinks.write_keyed`` stores it
    hash_first: bool = True  # rows of equal keys and digests are settled without their cells
    counted_sequence: bool = False  # keys with very many equal rows
    hot_rows: int = A.HOT_ROWS  # rows of a key from which on it is numbered by several tasks
    quality_checks: frozenset[str] = profile.CHECKS
    include_pass: bool = True  # whether the pass report is among the results


Hook = Callable[["DiffResult"], DataFrame]


class DiffResult:
    """All results of one pair. Build it with ``compare``."""

    def __init__(self, prod: DataFrame, dev: DataFrame, cfg: DiffConfig, tolerance_rules: DataFrame | None = None):
        if twins := apart_by_case(prod, dev):
            name = lambda c: twins.get(c, c)
            named = lambda d: {name(c): v for c, v in d.items()}
            prod, dev = (df.toDF(*map(name, df.columns)) for df in (prod, dev))
            cfg = replace(cfg, keys=tuple(map(name, cfg.keys)), ignore=tuple(map(name, cfg.ignore)), order=tuple(map(name, cfg.order)), tolerance=named(cfg.tolerance), scales=named(cfg.scales))
        self.cfg, self.run_id, self.events = cfg, uuid.uuid4().hex, []
        self.spark = prod.sparkSession
        texts = lambda df: df.drop(*cfg.ignore) if cfg.canonical_inputs else canonical(df, cfg.ignore, cfg.scales, cfg.na_values)
        self.prod, self.dev = texts(prod), texts(dev)
        self.keys, self.missing_keys = A.resolve_keys(self.prod, self.dev, list(cfg.keys))
        self.compared = A.common_columns(self.prod, self.dev, self.keys, set(cfg.ignore))
        self.rules = None  # field, decimals, reason of this pair's rules
        levels = dict(cfg.tolerance)
        if tolerance_rules is not None:
            self.rules = rules.pair_tolerance(tolerance_rules, cfg.prod_name, cfg.dev_name, self.prod.columns, self.dev.columns, list(cfg.ignore))
            levels |= rules.tolerance_map(self.rules)
        self.tolerance = {c: d for c, d in levels.items() if c in self.compared} if "tolerance" in cfg.enabled else {}
        self._hooks: dict[str, Hook] = {}
        self._watch: Observation | None = None
        self._watching = False
        self._quality: int | None = None  # columns of two types, once the quality report is stored

    @cached_property
    def _sides(self) -> tuple[DataFrame, DataFrame, list[str]]:
        """Both tables and their keys; without keys, rows are keyed by their place."""
        if self.keys:
            return self.prod, self.dev, self.keys
        order = [F.col(f"`{c}`") for c in self.cfg.order] or None
        return A.with_row_id(self.prod, order), A.with_row_id(self.dev, order), [A.ROW_ID]

    @cached_property
    def _same_columns(self) -> bool:
        rest = lambda df: [c for c in df.columns if c not in self.keys]
        return rest(self.prod) == rest(self.dev)

    @cached_property
    def keytable(self) -> DataFrame:
        """The stored key table of the pair; see ``operators.keytable``."""
        prod, dev, keys = self._sides
        return keytable.key_table(prod, dev, keys, self.compared, self.schema_fields, self.cfg.hash_first)

    @cached_property
    def totals(self) -> Row:
        """Row counts of the pair and sizes of its keys: one action over the key table."""
        return keytable.totals(self.keytable, self._sides[2], self._same_columns, self.schema_fields)

    @property
    def largest(self) -> list[int]:
        """Rows of the most frequent repeated key of each side, 0 if none repeats."""
        return [n if n > 1 else 0 for n in (self.totals.largest_prod, self.totals.largest_dev)]

    @property
    def using_sequence(self) -> bool:
        """Whether either side repeats a key."""
        return bool(self.keys) and max(self.largest) > 0

    def _numbered(self, df: DataFrame, side: str) -> DataFrame:
        if self.cfg.counted_sequence:
            return A.with_counted_sequence(df, self.keys)
        rows = F.col(f"n_{side}")
        hot = self.keytable.where(rows > self.cfg.hot_rows).select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(self.keys)])
        return A.with_sequence(df, self.keys, hot if self.totals[f"largest_{side}"] > self.cfg.hot_rows else None)

    def _aligned(self, prod: DataFrame, dev: DataFrame) -> DataFrame:
        if self.using_sequence and not self.cfg.counted_sequence and max(self.largest) <= self.cfg.hot_rows:
            return A.align(prod, dev, self.keys, True)
        if self.using_sequence:
            prod, dev = self._numbered(prod, "prod"), self._numbered(dev, "dev")
        return A.align(prod, dev, self.align_keys)

    @cached_property
    def align_keys(self) -> list[str]:
        if not self.keys:
            return [A.ROW_ID]
        return [*self.keys, A.SEQ] if self.using_sequence else self.keys

    @cached_property
    def aligned(self) -> DataFrame:
        """All rows of both sides with all their cells, in a full outer join; see ``operators.align.align``."""
        return self._aligned(*self._sides[:2])

    def alignment(self, numbered: bool | None = None) -> DataFrame:
        """The align keys and ``side`` of all rows, from the numbers of rows of each key alone.

        ``numbered`` says whether ``_SEQ_`` is among the keys (default: if either side repeats a key); where
        it is given no key table is stored for this.
        """
        numbered = self.using_sequence if numbered is None else numbered
        prod, dev, keys = self._sides
        table = self.keytable if "keytable" in self.__dict__ else keytable.key_counts(prod, dev, keys)
        return keytable.alignment(table, keys, numbered)

    @cached_property
    def rows(self) -> DataFrame:
        """Aligned rows that may differ: those of open keys, fetched by their keys; with ``hash_first=False`` all rows."""
        if not self.cfg.hash_first:
            return self.aligned
        prod, dev, keys = self._sides
        if not self.totals.open:
            return self._aligned(prod.where(F.lit(False)), dev.where(F.lit(False)))
        wanted = self.keytable.where(keytable.is_open(self._same_columns))
        return self._aligned(*(keytable.rows_of(df, keys, wanted, self.totals.open_bytes) for df in (prod, dev)))

    def _settled_rows(self) -> DataFrame:
        """Aligned rows of settled keys: DEV's cells are PROD's, so only PROD is read."""
        prod, _, keys = self._sides
        if self.totals.rest:
            rest = self.keytable.where((F.col("n_prod") > 0) & ~keytable.settled(self._same_columns))
            prod = keytable.rows_of(prod, keys, rest, self.totals.rest_bytes, "left_anti")
        prod = self._numbered(prod, "prod") if self.using_sequence else prod
        row = F.struct(*[column(c) for c in prod.columns])
        return prod.select(*[column(k).alias(f"__k{i}") for i, k in enumerate(self.align_keys)], row.alias("p"), row.alias("d"), F.lit(A.MATCHED).alias("side"))

    @cached_property
    def cells(self) -> dict[str, int]:
        """Failed rows, differing cells and filled schema fields of ``rows``; a run observes them while it stores the differences."""
        if not self.totals.open:
            return {n: 0 for n, _ in self._measures()}
        return self.rows.agg(*[m.alias(n) for n, m in self._measures()]).first().asDict()  # one row

    def _measures(self) -> list[tuple[str, Column]]:
        return diff.cell_measures(self.compared, self.tolerance) + schema_diff.filled_measures(self.schema_fields)

    def value_differences(self) -> DataFrame:
        return diff.value_differences(self.rows, self.align_keys, self.compared, self.tolerance)

    def count_differences(self) -> DataFrame:
        return keytable.one_sided(self.keytable, self._sides[2], self.using_sequence)

    def pass_report(self, only_failed: bool = False) -> DataFrame:
        report = lambda rows: diff.pass_report(rows, self.align_keys, self.compared, self.tolerance, only_failed)
        if only_failed or not self.cfg.hash_first or not self.totals.settled:
            return report(self.rows)
        return report(self.rows).unionByName(report(self._settled_rows()))

    def differences_by_column(self) -> DataFrame:
        return diff.differences_by_column(self.value_differences())

    def duplicates(self) -> DataFrame:
        if not self.keys:
            return self.spark.createDataFrame([], "duplicate_in_prod boolean, duplicate_in_dev boolean")
        return keytable.duplicates(self.keytable, self.keys)

    @cached_property
    def schema_fields(self) -> list[tuple[str, str]]:
        return schema_diff.schema_differences(self.prod, self.dev, {*self.keys, *self.cfg.ignore})

    def schema_differences(self) -> DataFrame:
        """Fields of one side only, with their cells that are not blank over matched rows."""
        counts = [(c, side, self.totals[f"f{i}"] + self.cells[f"f{i}"]) for i, (c, side) in enumerate(self.schema_fields)]
        return self.spark.createDataFrame(counts, "field string, side string, count long")

    def quality_report(self, approx: bool = False) -> DataFrame:
        checks = self.cfg.quality_checks
        return profile.quality_report(*(profile.profile(x, approx, checks=checks) for x in (self.prod, self.dev)), checks)

    def counts(self) -> DataFrame:
        """One row of all row and cell counts, from the key table and the rows that may differ."""
        t, failed = self.totals, self.cells["failed"]
        matched = t.total_prod - t.missing_dev
        dups = (t.duplicate_prod, t.duplicate_dev) if self.keys else (0, 0)
        row = (t.total_prod, t.total_dev, matched - failed, failed, t.extra_dev, t.missing_dev, self.cells["cells"], *dups)
        names = ("total_prod", "total_dev", "matched_passed", "matched_failed", "extra_dev", "missing_dev", "total_diffs", "duplicate_prod", "duplicate_dev")
        return self.spark.createDataFrame([row], ", ".join(f"{n} long" for n in names))

    def metrics(self) -> DataFrame:
        """``metric, value`` of the twelve metrics that alert rules may name."""
        side = lambda s: F.lit(float(sum(x == s for _, x in self.schema_fields)))
        mismatches = F.lit(0.0)
        counts = self.counts()
        if "data_quality" in self.cfg.enabled and self._quality is not None:
            mismatches = F.lit(float(self._quality))
        elif "data_quality" in self.cfg.enabled:
            found = profile.type_mismatches(*(profile.profile(x, checks=frozenset({"type_inference"})) for x in (self.prod, self.dev))).agg(F.count(F.lit(1)).alias("mismatches"))
            counts, mismatches = counts.crossJoin(found), F.col("mismatches")  # single rows
        row = counts.select(
            "matched_failed", "matched_passed", "total_diffs", "missing_dev", "extra_dev",
            percent(F.col("missing_dev"), F.col("total_prod")).alias("missing_dev_pct"),
            percent(F.col("extra_dev"), F.col("total_dev")).alias("extra_dev_pct"),
            F.col("duplicate_prod").alias("dup_count_prod"),
            F.col("duplicate_dev").alias("dup_count_dev"),
            side(A.MISSING).alias("schema_missing"),
            side(A.EXTRA).alias("schema_extra"),
            mismatches.alias("type_mismatch_count"),
        )
        return rules.unpivoted_metrics(row)

    def alerts(self, alert_rules: DataFrame) -> DataFrame:
        return rules.alerts(self.metrics(), alert_rules)

    def _described(self) -> dict[str, Column]:
        listed = lambda names: F.lit(", ".join(names) or "-")
        fields = lambda s: listed(sorted(f for f, x in self.schema_fields if x == s))
        # fixed values: the texts for no key and of a tolerance
        return {
            "used_keys": F.lit(", ".join(self.keys) or "(row-order fallback)"),
            "missing_key_columns": listed(self.missing_keys),
            "ignored_fields": listed(sorted(self.cfg.ignore)),
            "tolerance": listed([f"{c}({self.tolerance[c]}dp)" for c in sorted(self.tolerance)]),
            "using_sequence": F.lit(str(self.using_sequence)),
            "extra_fields": fields(A.EXTRA),
            "missing_fields": fields(A.MISSING),
        }

    def settings(self) -> DataFrame:
        """``setting, value`` rows describing the run."""
        # fixed values: the labels
        said, c = self._described(), lambda n: F.col(n).cast("string")
        rows = [
            ("Used Keys", said["used_keys"]),
            ("Missing Key Columns", said["missing_key_columns"]),
            ("Ignored Fields", said["ignored_fields"]),
            ("Tolerance Applied", said["tolerance"]),
            ("Duplicates in Prod", c("duplicate_prod")),
            ("Duplicates in Dev", c("duplicate_dev")),
            ("Using Sequence Index (_SEQ_)", said["using_sequence"]),
            ("Extra Fields in Dev", said["extra_fields"]),
            ("Missing Fields in Dev (Prod only)", said["missing_fields"]),
            ("Total Prod Rows", c("total_prod")),
            ("Total Dev Rows", c("total_dev")),
            ("Matched Rows", (F.col("matched_passed") + F.col("matched_failed")).cast("string")),
            ("Only in Prod", c("missing_dev")),
            ("Only in Dev", c("extra_dev")),
            ("Total Cell Differences", c("total_diffs")),
            ("Matched Passed", c("matched_passed")),
            ("Matched Failed", c("matched_failed")),
            ("Run ID", F.lit(self.run_id)),
            ("Result Name", F.lit(self.cfg.result_name)),
        ]
        return self.counts().select(F.inline(F.array(*[F.struct(F.lit(k).alias("setting"), v.alias("value")) for k, v in rows])))

    def summary(self, alert_rules: DataFrame | None = None, report_path: str = "") -> DataFrame:
        """The pair's summary row (20 fields and ``error``); the field names are fixed values."""
        counts = self.counts()
        triggered = F.lit(0).cast("long")
        if alert_rules is not None:
            counts = counts.crossJoin(self.alerts(alert_rules).agg(F.count(F.lit(1)).alias("__alerts")))  # single rows
            triggered = F.col("__alerts")
        texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
        used = F.map_from_arrays(texts(sorted(self.tolerance)), F.array(*[F.lit(self.tolerance[c]) for c in sorted(self.tolerance)]).cast("array<int>"))
        elapsed = sum(e[3] for e in self.events)
        return counts.select(
            F.lit(self.cfg.result_name).alias("result_name"), F.lit(self.cfg.prod_name).alias("prod_file"), F.lit(self.cfg.dev_name).alias("dev_file"),
            "total_prod", "total_dev", "matched_passed", "matched_failed", "extra_dev", "missing_dev", "duplicate_prod", "duplicate_dev",
            texts(self.keys).alias("used_keys"), texts(self.missing_keys).alias("missing_key_columns"), texts(sorted(self.cfg.ignore)).alias("ignored_fields"),
            used.alias("tolerance_used"), F.lit(report_path).alias("report_path"), F.lit(round(float(elapsed), 2)).alias("elapsed_seconds"), triggered.alias("alerts_triggered"),
            F.lit(sum(s == A.EXTRA for _, s in self.schema_fields)).cast("long").alias("schema_extra_count"),
            F.lit(sum(s == A.MISSING for _, s in self.schema_fields)).cast("long").alias("schema_missing_count"),
            F.lit(None).cast("string").alias("error"),
        )

    def register_check(self, name: str, check: Hook) -> None:
        """Add a result of your own; a built-in step's name replaces that step."""
        self._hooks[name] = check

    def _steps(self, alert_rules: DataFrame | None) -> dict[str, Callable[[], dict[str, DataFrame]]]:
        """The built-in steps and the result tables of each."""

        def comparison() -> dict[str, DataFrame]:
            found = {"value_differences": self._observed_differences(), "count_differences": self.count_differences()}
            return found | ({"pass_report": self.pass_report()} if self.cfg.include_pass else {})

        return {
            "tolerance": lambda: {"tolerance": self.rules} if self.rules is not None else {},
            "comparison": comparison,
            "duplicate": lambda: {"duplicates": self.duplicates()},
            "schema": lambda: {"schema_differences": self.schema_differences()},
            "data_quality": lambda: {"quality_report": self.quality_report()},
            "alerts": lambda: {"alerts": self.alerts(alert_rules)} if alert_rules is not None else {},
        }

    def _observed_differences(self) -> DataFrame:
        """``value_differences`` that counts what ``cells`` holds while it is stored, unless that is known."""
        if "cells" in self.__dict__ or not self.totals.open or not self._watching:
            return self.value_differences()
        self._watch = Observation()
        watched = self.rows.observe(self._watch, *[m.alias(n) for n, m in self._measures()])
        return diff.value_differences(watched, self.align_keys, self.compared, self.tolerance)

    def _learn(self, step: str, tables: dict[str, DataFrame]) -> None:
        """Keep what a built-in step has found out, so that later ones do not compute it again."""
        if step == "comparison" and self._watch is not None and step not in self._hooks:
            self.cells = self._watch.get
            self._watch = None
        elif step == "data_quality" and step not in self._hooks and "type_inference" in self.cfg.quality_checks:
            self._quality = tables["quality_report"].where("type_mismatch = 'Yes'").count()

    def _run(self, keep: Callable[[str, DataFrame], DataFrame], alert_rules: DataFrame | None, order: list[str] | None, once: bool) -> dict[str, DataFrame]:
        """Run the enabled steps; ``keep(name, table)`` stores a table, so that a step is done when it says so.

        ``once`` says that storing a table computes it once, in one stage after the join, so that what is
        observed then is exact. Otherwise the kept rows are counted on their own.
        """
        self._watching = once
        built_in, out = self._steps(alert_rules), {}
        self.rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name in order or [*STEPS, *(h for h in self._hooks if h not in STEPS)]:
                if name in STEPS and name not in self.cfg.enabled:
                    self.events.append((time.time(), name, "SKIPPED", 0.0))
                    continue
                began = time.time()
                self.events.append((began, name, "START", 0.0))
                try:
                    made = {name: self._hooks[name](self)} if name in self._hooks else built_in[name]()
                    out |= {table: keep(table, df) for table, df in made.items()}
                    self._learn(name, out)
                    self.events.append((time.time(), name, "DONE", time.time() - began))
                except Exception as e:  # a hook's failure, also in its job, is a result of the run
                    if name not in self._hooks:
                        raise
                    self.events.append((time.time(), name, f"FAILED: {e}", time.time() - began))
            out["settings"] = keep("settings", self.settings())
        finally:
            self.rows.unpersist()
        return out

    def results(self, alert_rules: DataFrame | None = None, order: list[str] | None = None) -> dict[str, DataFrame]:
        """All result tables of the enabled steps, by name, each stored in the checkpoint folder. A failing hook becomes an audit event."""
        return self._run(lambda name, df: stored(df), alert_rules, order, False)

    def write(self, root: str, run_id: str, alert_rules: DataFrame | None = None, order: list[str] | None = None, ordered: bool = False) -> dict[str, DataFrame]:
        """``results`` as Parquet tables under ``root``, which must not hold the run yet; ``ordered`` sorts them by the align keys."""

        def keep(name: str, df: DataFrame) -> DataFrame:
            path = sinks.result_path(self.spark, root, name, self.cfg.result_name, run_id)
            sinks.write_table(df, path, self.align_keys if ordered else None)
            return self.spark.read.parquet(path)

        return self._run(keep, alert_rules, order, not ordered)

    def audit(self) -> DataFrame:
        """``timestamp, capability, event, elapsed`` of the steps so far."""
        return self.spark.createDataFrame(self.events, "timestamp double, capability string, event string, elapsed double")


def audit_timings(audit: DataFrame) -> DataFrame:
    return audit.groupBy("capability").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("elapsed"), 4).alias("elapsed"))


def compare(prod: DataFrame, dev: DataFrame, cfg: DiffConfig = DiffConfig(), tolerance_rules: DataFrame | None = None) -> DiffResult:
    """Compare two versions of a dataset. ``tolerance_rules`` (see ``rules.tolerance_rules``) add to the configured tolerances.

    Columns of a table that differ in case only are told apart by ``functions.text.apart_by_case``.
    """
    return DiffResult(prod, dev, cfg, tolerance_rules)


def in_passes(prod: DataFrame, dev: DataFrame, cfg: DiffConfig, passes: int, table: Callable[[DiffResult], DataFrame]) -> DataFrame:
    """What ``table`` makes of the comparison of one part of the keys after the other, stored and united.

    All rows of a key are in one part and each part is compared whole, so no row is left out; counts of the
    parts are to be added up. Exchanges of a part are dropped before the next begins, so they never hold more
    than a part of the rows, for the price of scans of both inputs in each pass. Without keys there is one pass.
    """
    whole = DiffResult(prod, dev, cfg)
    cfg = replace(whole.cfg, canonical_inputs=True, tolerance=whole.tolerance)
    found = []
    with dropped_exchanges(whole.spark):
        for k in range(passes if whole.keys else 1):
            part = F.pmod(F.xxhash64(F.lit(3), *[column(c) for c in whole.keys]), F.lit(passes)) == k if whole.keys else F.lit(True)
            found.append(stored(table(DiffResult(whole.prod.where(part), whole.dev.where(part), cfg))))
    return union_all(found)


Pair = tuple[str, Callable[[], DataFrame], Callable[[], DataFrame], DiffConfig]


def compare_many(spark: SparkSession, pairs: list[Pair], alert_rules: DataFrame | None = None, workers: int = 4, tolerance_rules: DataFrame | None = None, root: str | None = None, run_id: str = "") -> DataFrame:
    """Summary rows of many pairs. A pair that fails, also while it is built, is a row with ``error``.

    Pairs are independent Spark jobs, submitted from a few driver threads. With ``root`` all result
    tables are written there.
    """

    def one(pair: Pair) -> list:
        name, prod, dev, cfg = pair
        began = time.time()
        try:
            result = compare(prod(), dev(), replace(cfg, result_name=name), tolerance_rules)
            if root:
                result.write(root, run_id or result.run_id, alert_rules)
            row = result.summary(alert_rules, root or "").first().asDict()  # one row
            return [{**row, "elapsed_seconds": round(time.time() - began, 2)}]
        except Exception as e:
            return [{"result_name": name, "error": str(e).splitlines()[0] if str(e) else type(e).__name__}]

    with ThreadPoolExecutor(workers) as pool:
        rows = [r for found in pool.map(one, pairs) for r in found]
    schema = T.StructType.fromDDL(SUMMARY)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def compare_control(spark: SparkSession, control: DataFrame, tolerance: DataFrame | None = None, switches: DataFrame | None = None, alert_rules: DataFrame | None = None, read: Callable[[str], DataFrame] | None = None, root: str | None = None, run_id: str = "", workers: int = 4) -> DataFrame:
    """Summary rows of all active rows of a control table (a small table, one row for each pair).

    ``tolerance`` is a table of tolerance rules, ``switches`` one of quality checks and their values.
    Inputs are read by ``read`` (default: ``read_any``) from the row's path and file names.
    """
    checks = rules.quality_switches(switches)[0] if switches is not None else profile.CHECKS
    parsed = rules.tolerance_rules(tolerance) if tolerance is not None else None
    load = read or (lambda path: readers.read_any(spark, path))
    place = lambda r, name: f"{r.path}/{name}" if r.path else name
    pairs: list[Pair] = []
    for r in rules.active_pairs(control).collect():
        cfg = DiffConfig(keys=tuple(r["keys"]), ignore=tuple(r.ignore), prod_name=r["prod"], dev_name=r.dev, quality_checks=checks, include_pass=r.include_pass)
        pairs.append((r.result_name, lambda r=r: load(place(r, r["prod"])), lambda r=r: load(place(r, r.dev)), cfg))
    return compare_many(spark, pairs, alert_rules, workers, parsed, root, run_id)


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
