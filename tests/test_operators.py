from pyspark.sql import functions as F

from pairlens.functions.text import canonical
from pairlens.operators import align, history, profile, rules, schema_diff


def test_row_ids_are_dense_over_partitions(spark):
    df = spark.range(1000).repartition(7).select(F.col("id").cast("string").alias("v"))
    ids = align.with_row_id(df, [F.col("v").cast("long")]).collect()
    assert all(int(r.v) == r[align.ROW_ID] for r in ids) and len(ids) == 1000
    assert sorted(r[align.ROW_ID] for r in align.with_row_id(df).collect()) == list(range(1000))


def test_chunks(spark):
    df = align.with_chunks(spark.range(25), 10, [F.col("id")])
    assert {r.chunk_id: r["count"] for r in df.groupBy("chunk_id").count().collect()} == {0: 10, 1: 10, 2: 5}


def test_counted_sequence_equals_plain(spark):
    df = canonical(spark.createDataFrame([("k", str(i % 3)) for i in range(30)] + [("j", "z")], "k string, v string"))
    a = sorted(tuple(r) for r in align.with_sequence(df, ["k"]).collect())
    b = sorted(tuple(r) for r in align.with_counted_sequence(df, ["k"]).collect())
    assert a == b


def test_hot_keys_are_numbered_by_several_tasks(spark):
    rows = [("hot", str(i % 7)) for i in range(400)] + [("hot", str(i)) for i in range(300)] + [("cold", "b"), ("cold", "a"), ("one", "z")]
    df = canonical(spark.createDataFrame(rows, "k string, v string").repartition(5))
    assert align.largest_groups([df, df.where("k <> 'hot'"), df.limit(0)], ["k"]) == [700, 2, 0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # tiny partitions stay apart
    spread = align.with_sequence(df, ["k"], align.hot_keys(df, ["k"], 100))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(tuple(r) for r in spread.collect()) == sorted(tuple(r) for r in align.with_sequence(df, ["k"]).collect())
    assert spread.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_profile(spark):
    df = spark.createDataFrame([("1", "x"), ("2", ""), ("4", "x"), ("", "y")], "n string, t string")
    rows = {r.column: r for r in profile.profile(df).collect()}
    assert (rows["n"].null_rate, rows["n"].distinct_count, rows["n"].numeric) == (0.25, 3, False)
    full = {r.column: r for r in profile.profile(df.where("n <> ''")).collect()}
    assert (full["n"].min, full["n"].max, full["n"].mean, full["n"].std, full["n"]["count"]) == (1.0, 4.0, 2.333333, 1.527525, 3)
    rough = {r.column: r for r in profile.profile(df, approx=True).collect()}
    assert (rough["t"].distinct_count, rough["t"].null_rate) == (2, 0.25)
    single = {r.column: r for r in profile.profile(df.limit(1)).collect()}
    assert single["n"].std == 0.0
    assert profile.profile(df.limit(0)).count() == 0


def test_merged_profiles_equal_those_of_all_rows(spark):
    """Also where sums of squares would cancel out: values far from zero that vary little."""
    rows = [(str(i % 7), str(10**9 + (i * 37 % 101) / 100), ["", "x", "y"][i % 3], str(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "day string, n string, t string, id string")
    parts = profile.profile_parts(df, ["day"])
    merged = {r.column: r for r in profile.profile_of_parts(profile.merge_parts(parts)).collect()}
    whole = {r.column: r for r in profile.profile(df.drop("day")).collect()}
    assert set(merged) == set(whole) == {"n", "t", "id"}
    for c, r in whole.items():
        assert abs(merged[c].distinct_count - r.distinct_count) <= 0.05 * r.distinct_count
        a, b = (tuple(x[n] for n in ("null_rate", "numeric", "min", "max", "mean", "std", "count")) for x in (merged[c], r))
        assert all(x == y or abs(x - y) <= 1e-5 for x, y in zip(a, b))
    days = {(r.day, r.column): r for r in profile.profile_of_parts(parts, ["day"]).collect()}
    assert len(days) == 21 and days["3", "id"]["count"] == 71
    assert profile.merge_parts(parts.where("false")).collect() == []


def test_a_profile_is_one_pass(spark):
    plan = profile.profile(spark.createDataFrame([("1", "x")], "a string, b string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Join" not in plan


def test_quality_report_of_differing_columns(spark):
    p = profile.profile(spark.createDataFrame([("1",), ("2",)], "a string"))
    d = profile.profile(spark.createDataFrame([("x", "1")], "a string, b string"))
    rows = {r.column: r for r in profile.quality_report(p, d).collect()}
    assert rows["a"].type_mismatch == "Yes" and rows["b"].type_mismatch == "No" and rows["b"].min_prod is None
    off = profile.quality_report(p, d, frozenset({"null_rate"})).first()
    assert off.distinct_count_prod is None and off.type_mismatch == "No" and off.null_rate_prod == 0.0


def test_tolerance_rules(spark):
    table = spark.createDataFrame(
        [("p", "d", "a", "2"), ("p", "d", "b", "x"), ("p", "d", "c", ""), ("p", "d", "", "1"), ("p", "d", "e", "0.01"), ("p", "d", "gone", "3"), ("p", "d", "skip", "3"), ("q", "d", "a", "9")],
        "`PROD file  name` string, `Dev File Name` string, `Field Name` string, `Tolerance Level ( in decimal )` string",
    )
    all_rules = rules.tolerance_rules(table)
    assert {r.field: r.reason for r in all_rules.where("prod_name = 'p'").collect()} == {
        "a": None, "b": "tolerance is not a whole number", "c": "blank tolerance", "": "blank name", "e": "tolerance is not a whole number", "gone": None, "skip": None,
    }
    own = rules.pair_tolerance(all_rules, "p", "d", ["a", "b", "gone", "skip"], ["a", "b", "skip"], ["skip"])
    assert rules.tolerance_map(own) == {"a": 2}
    assert {r.field: r.reason for r in own.where("field in ('gone', 'skip')").collect()} == {"gone": "absent from DEV", "skip": "ignored"}


def test_alert_issues(spark):
    table = spark.createDataFrame([("extra_dev", ">", "1", "INFO"), ("nope", ">", "1", None), ("extra_dev", "=", "1", None), ("extra_dev", "<", "x", None), ("extra_dev", "<", "1", "odd")], "metric string, operator string, threshold string, level string")
    assert [r.problem for r in rules.alert_issues(table).collect()] == ["unknown metric", "unknown operator", "threshold is not a number", "unknown level"]


def test_unusable_alerts_never_fire(spark):
    metrics = spark.createDataFrame([("extra_dev", 5.0)], "metric string, value double")
    table = spark.createDataFrame([("extra_dev", ">", "x", "INFO", "a"), ("extra_dev", "=>", "1", None, "b"), ("extra_dev", None, None, None, "c"), ("extra_dev", ">", " 4 ", "odd", "d")], "metric string, operator string, threshold string, level string, message string")
    assert {(r.message, r.threshold, r.level) for r in rules.alerts(metrics, table).collect()} == {("c", 0.0, "WARNING"), ("d", 4.0, "ODD")}


def test_checks_that_are_off_are_not_computed(spark):
    df = spark.createDataFrame([("1",), ("2",)], "a string")
    plan = lambda checks: profile.profile(df, checks=frozenset(checks))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan({"null_rate"}).lower() and "rlike" not in plan({"null_rate"}).lower() and "Join" not in plan({"type_inference"})
    (row,) = profile.profile(df, checks=frozenset({"type_inference"})).collect()
    assert (row.numeric, row.distinct_count, row["mean"]) == (True, None, None)


def test_partition_and_case_mismatches(spark):
    a = spark.createDataFrame([], "k long, Name string, day string, hour string")
    b = spark.createDataFrame([], "k long, name string, day string, hour string")
    rows = {r.field: r.status for r in schema_diff.typed_schema_check(spark, a, b, ["k"], partitions=(["day", "hour"], ["day"])).collect()}
    assert rows == {"k": "ok", "Name": "case differs", "name": "case differs", "day": "ok", "hour": "partition mismatch"}


def test_typed_schema(spark):
    a = spark.createDataFrame([], "k long, same string, kind int, gone string")
    b = spark.createDataFrame([], "k long, same string, kind string, new string")
    rows = {r.field: r.status for r in schema_diff.typed_schema_check(spark, a, b, ["k", "gone"]).collect()}
    assert rows == {"k": "ok", "same": "ok", "kind": "type mismatch", "gone": "missing key", "new": "extra"}


def test_batch_totals(spark):
    jobs = spark.createDataFrame(
        [(1, "SUCCESS", 100.0), (1, "FAILED", 50.0), (2, "RUNNING", 10.0), (3, "SUCCESS", 100.0), (3, "SKIPPED", 0.0), (4, "FAILED", 1.0), (5, "CANCELLED", 0.0)], "batch_id int, status string, progress double"
    )
    assert {r.batch_id: r.status for r in history.batch_totals(jobs).collect()} == {1: "PARTIAL_SUCCESS", 2: "RUNNING", 3: "SUCCESS", 4: "FAILED", 5: "CANCELLED"}


def test_control_rows_and_switches(spark):
    table = spark.createDataFrame([(1, "yes", "in", "a", "b", "r"), (2, "no", "", "a", None, " ")], "row long, RUN string, `Files Path` string, `Prod File Name` string, `dev file name` string, `Result Report Name` string")
    files = spark.createDataFrame([("in/a",)], "path string")
    assert {(r.row, r.field, r.message) for r in rules.control_issues(table, files).collect()} == {
        (1, "dev file name", "file not found: in/b"), (2, "files path", "is empty"), (2, "dev file name", "is empty"), (2, "result report name", "is empty"),
    }
    assert [r.field for r in rules.control_issues(table.drop("RUN"), files).collect()] == ["run"]
    on, issues = rules.quality_switches(spark.createDataFrame([("null_rate", "no"), ("odd", "yes"), ("numeric_stats", "perhaps")], "check string, value string"))
    assert on == {"distinct_count", "type_inference", "numeric_stats"} and {r.check: r.problem for r in issues.collect()} == {"odd": "unknown check", "numeric_stats": "not a yes or no"}
