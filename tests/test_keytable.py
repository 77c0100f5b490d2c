"""Hash-first comparison: the same results as the full alignment, from keys and digests."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pairlens.operators import keytable
from pairlens.plans import compare as C
from pairlens.plans.compare import DiffConfig, compare
from pairlens.sources import sinks


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).repartition(3)


def everything(result):
    """All result tables as sorted rows."""
    tables = {
        "cells": result.value_differences(),
        "sides": result.count_differences(),
        "report": result.pass_report(),
        "failed": result.pass_report(only_failed=True),
        "counts": result.counts(),
        "schema": result.schema_differences(),
        "duplicates": result.duplicates(),
        "settings": result.settings().where("setting <> 'Run ID'"),
    }
    return {n: (t.columns, sorted((tuple(r) for r in t.collect()), key=repr)) for n, t in tables.items()}


def versions(seed, keys, copies, same_columns):
    """Two versions of random rows: changed, missing, extra and repeated ones, and values that rounding makes equal."""
    rng = random.Random(seed)
    prod = [(str(rng.randrange(keys)), rng.choice("ab"), f"{rng.randrange(3)}.{rng.randrange(3)}", rng.choice(["", "x"])) for _ in range(copies)]
    dev = []
    for k, a, n, e in prod:
        what = rng.random()
        if what < 0.1:
            continue
        dev.append((k, "c" if what < 0.2 else a, n + "01" if what < 0.4 else n, e))
        if what > 0.95:
            dev.append((str(rng.randrange(2 * keys)), a, n, e))
    rng.shuffle(dev)
    names = ["k", "a", "n", "e"]
    return (prod, names), (dev, names if same_columns else ["k", "a", "n", "other"])


@pytest.mark.parametrize("same_columns", [True, False])
@pytest.mark.parametrize(("seed", "keys"), [(1, 400), (2, 30), (3, 3)])
def test_same_results_as_the_full_alignment(spark, seed, keys, same_columns):
    prod, dev = (frame(spark, *x) for x in versions(seed, keys, 150, same_columns))
    cfg = {"keys": ("k",), "tolerance": {"n": 1}}
    assert everything(compare(prod, dev, DiffConfig(**cfg))) == everything(compare(prod, dev, DiffConfig(**cfg, hash_first=False)))


def test_same_results_by_position(spark):
    prod, dev = (frame(spark, *x).coalesce(1) for x in versions(4, 50, 80, True))
    cfg = {"order": ("k", "a", "n", "e")}
    assert everything(compare(prod, dev, DiffConfig(**cfg))) == everything(compare(prod, dev, DiffConfig(**cfg, hash_first=False)))


@pytest.mark.parametrize("size", [0, keytable.BROADCAST_BYTES])
def test_keys_beyond_the_broadcast_bound_are_joined(spark, monkeypatch, size):
    prod, dev = (frame(spark, *x) for x in versions(5, 40, 90, True))
    expected = everything(compare(prod, dev, DiffConfig(keys=("k",), hash_first=False)))
    monkeypatch.setattr(keytable, "BROADCAST_BYTES", size)
    result = compare(prod, dev, DiffConfig(keys=("k",)))
    wanted = result.keytable.where(keytable.is_open(True))
    plan = keytable.rows_of(result.prod, ["k"], wanted, result.totals.open_bytes)._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (size > 0)
    assert everything(result) == expected


def test_unchanged_pairs_move_keys_and_digests_only(spark):
    """Of equal tables no cell reaches an exchange, also where keys repeat; the differences are known to be empty."""
    rows = [(str(i % 70), f"long cell {i % 9}", "x" * 50) for i in range(140)]
    result = compare(frame(spark, rows, "kab"), frame(spark, rows[::-1], "kab"), DiffConfig(keys=("k",)))
    prod, dev, keys = result._sides
    sides = [keytable._side(df, keys, result.compared, [], own, True) for df, own in ((prod, "Missing in Dev"), (dev, "Extra in Dev"))]
    assert all(s.columns == ["__k0", "n_prod", "n_dev", "s0", "s1", "s2", "s3"] for s in sides)
    assert result.totals.open == 0 and result.totals.settled == 140
    for table in (result.value_differences(), result.pass_report(only_failed=True)):
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString() and table.isEmpty()
    assert result.pass_report().count() == 140 and result.counts().first().matched_passed == 140


def test_multisets_of_equal_keys(spark):
    """Copies count: two of one row and one of another are not one and two."""
    one = frame(spark, [("k", "1"), ("k", "1"), ("k", "2")], "kv")
    other = frame(spark, [("k", "1"), ("k", "2"), ("k", "2")], "kv")
    result = compare(one, other, DiffConfig(keys=("k",)))
    assert [(r["_SEQ_"], r.prod_value, r.dev_value) for r in result.value_differences().collect()] == [(1, "1", "2")]
    assert compare(one, one, DiffConfig(keys=("k",))).totals.open == 0


def test_very_frequent_key_is_listed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(keytable, "_PLACES", 7)
    many = spark.range(100).select(F.lit("hot").alias("k"), F.col("id").cast("string").alias("v"))
    result = compare(many, many.where("v < 50"), DiffConfig(keys=("k",)))
    assert sorted(r["_SEQ_"] for r in result.count_differences().collect()) == list(range(50, 100))
    sides = result.alignment().groupBy("side").count().collect()
    assert {(r.side, r["count"]) for r in sides} == {("Matched", 50), ("Missing in Dev", 50)}


def test_odd_key_names(spark):
    names = ["n_prod", "__w0", "side", "s1"]
    rows = [("1", "a", "b", "c"), ("1", "a", "b", "d"), ("2", "a", "b", "c")]
    result = compare(frame(spark, rows, names), frame(spark, rows[1:], names), DiffConfig(keys=("n_prod", "__w0")))
    row = result.count_differences().drop("side").collect()
    assert [(r["n_prod"], r["__w0"], r["_SEQ_"]) for r in row] == [("1", "a", 1)]
    assert [(r.column, r.prod_value, r.dev_value) for r in result.value_differences().collect()] == [("s1", "c", "d")]


@pytest.mark.parametrize("how", ["results", "write", "ordered"])
def test_one_alignment_serves_all_results(spark, tmp_path, monkeypatch, how):
    """Summary, metrics, settings and alerts after a run align nothing again, and agree with a fresh comparison."""
    prod, dev = (frame(spark, *x) for x in versions(6, 60, 120, False))
    cfg = DiffConfig(keys=("k",), tolerance={"n": 1})
    rules = spark.createDataFrame([("total_diffs", ">", 0.0, "ERROR", "m")], "metric string, operator string, threshold double, level string, message string")
    expected = compare(prod, dev, cfg)
    fresh = (expected.counts().first(), sorted(expected.schema_differences().collect()), expected.alerts(rules).collect())
    made = []
    monkeypatch.setattr(C.A, "align", lambda *a, align=C.A.align: made.append(1) or align(*a))
    result = compare(prod, dev, cfg)
    tables = result.results(rules) if how == "results" else result.write(str(tmp_path / how), "r1", rules, ordered=how == "ordered")
    summary = result.summary(rules)
    after = summary._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "keytable" not in after and "Join FullOuter" not in after
    assert (result.counts().first(), sorted(result.schema_differences().collect()), result.alerts(rules).collect()) == fresh
    stored = {r.setting: r["value"] for r in tables["settings"].collect()}
    assert stored["Total Cell Differences"] == str(fresh[0].total_diffs) and stored["Matched Failed"] == str(fresh[0].matched_failed)
    assert summary.first().alerts_triggered == 1


def test_tables_stored_by_key_are_compared_without_an_exchange(spark, tmp_path):
    prod, dev = (frame(spark, [(str(i), "a", f"{i}.0{s}", "x") for i in range(k, 200)], "kabc") for k, s in ((0, 0), (3, 1)))
    plain = compare(prod, dev, DiffConfig(keys=("k",), tolerance={"b": 1}))
    expected = everything(plain)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name, df in (("keyed_prod", prod), ("keyed_dev", dev)):
            sinks.write_keyed(df, name, ["k"], 4, str(tmp_path / name))
        result = compare(spark.table("keyed_prod"), spark.table("keyed_dev"), DiffConfig(keys=("k",), tolerance={"b": 1}, canonical_inputs=True))
        for df in (keytable.key_rows(result.prod, result.dev, ["k"], result.compared), result.aligned):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert everything(result) == expected
        with pytest.raises(Exception, match="(?i)exist"):
            sinks.write_keyed(prod, "keyed_prod", ["k"], 4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table if exists keyed_prod")
        spark.sql("drop table if exists keyed_dev")


@pytest.mark.parametrize("same_columns", [True, False])
def test_repeated_keys_are_numbered_and_paired_in_one_exchange(spark, same_columns):
    """The same pairs as those of rows that were numbered before they are joined, which exchanges either side twice."""
    prod, dev = (frame(spark, *x) for x in versions(7, 20, 200, same_columns))
    numbered = C.A.align(*(C.A.with_sequence(df, ["k"]) for df in (prod, dev)), ["k", C.A.SEQ])
    paired = C.A.align(prod, dev, ["k"], True)
    cells = [f"{side}.`{c}`" for side, df in (("p", prod), ("d", dev)) for c in df.columns if c != "k"]
    said = [sorted((tuple(r) for r in df.selectExpr("__k0", "__k1", "side", *cells).collect()), key=repr) for df in (numbered, paired)]
    assert said[0] == said[1] and {r[2] for r in said[0]} == {"Matched", "Missing in Dev", "Extra in Dev"}
    assert paired._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("keys", [("k",), ()])
def test_passes_leave_nothing_out_and_keep_no_exchange(spark, keys):
    """Parts of the keys give the counts of the whole; what their exchanges wrote is gone, and the session is as before."""
    prod, dev = (frame(spark, *x) for x in versions(8, 60, 150, True))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: {f for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in f.getName()}
    cfg, before, kept = DiffConfig(keys=keys, order=("k", "a", "n", "e"), tolerance={"n": 1}), spark.conf.get(name), files()
    parts = C.in_passes(prod, dev, cfg, 3, lambda r: r.counts())
    names = parts.columns
    assert parts.count() == (3 if keys else 1) and spark.conf.get(name) == before
    for _ in range(100):  # Spark deletes them in the background
        if not (left := files() - kept):
            break
        time.sleep(0.1)
    assert not left
    assert parts.agg(*[F.sum(n).alias(n) for n in names]).first() == compare(prod, dev, cfg).counts().first()
