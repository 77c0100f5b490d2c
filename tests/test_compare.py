"""Row, key, duplicate and cell semantics on literal pairs."""

import pytest
from pyspark.sql import types as T

from pairlens.operators.align import ROW_ID
from pairlens.plans.compare import SUMMARY, DiffConfig, compare, compare_many, overall_pass


def frame(spark, text, columns):
    rows = [tuple(r.split(",")) for r in text.split("|")] if text else []
    return spark.createDataFrame(rows, ", ".join("`" + c.replace("`", "``") + "` string" for c in columns.split(",")))


def pair(spark, prod, dev, columns="ID,V", keys=("ID",), **more):
    return compare(frame(spark, prod, columns), frame(spark, dev, columns), DiffConfig(keys=keys, **more))


def counts(result):
    r = result.counts().first()
    return r.matched_passed, r.matched_failed, r.missing_dev, r.extra_dev


def test_trade_pair(spark):
    prod = frame(spark, "T001,EQ,100.001,500,Alice,X|T002,FI,50.500,200,Bob,Y|T003,EQ,75.000,300,Carol,X|T003,EQ,75.000,300,Carol,X|T004,FI,200.000,100,Dave,Y|T005,EQ,999.000,50,Eve,X", "TradeID,Portfolio,Price,Quantity,Trader,IgnoreMe")
    dev = frame(spark, "T001,EQ,100.003,500,Alice,A|T002,FI,50.500,999,Bob,B|T003,EQ,75.000,300,Carol,A|T004,FI,200.000,100,Dave,A|T006,EQ,123.000,777,Frank,B", "TradeID,Portfolio,Price,Quantity,TraderName,IgnoreMe")
    result = compare(prod, dev, DiffConfig(keys=("TradeID", "Portfolio"), ignore=("IgnoreMe",), tolerance={"Price": 2}))
    assert counts(result) == (3, 1, 2, 1)
    cell = result.value_differences().collect()
    assert [(c.TradeID, c.column, c.prod_value, c.dev_value) for c in cell] == [("T002", "Quantity", "200", "999")]
    assert {(r.field, r.side, r["count"]) for r in result.schema_differences().collect()} == {("Trader", "Missing in Dev", 4), ("TraderName", "Extra in Dev", 4)}
    assert [(r.TradeID, r.duplicate_in_prod, r.duplicate_in_dev) for r in result.duplicates().collect()] == [("T003", True, False)]
    alert = spark.createDataFrame([("matched_failed", ">", 0.0, "critical", "differs"), ("nothing", ">", 0.0, None, None)], "metric string, operator string, threshold double, level string, message string")
    assert [(a.level, a.metric, a.actual_value) for a in result.alerts(alert).collect()] == [("CRITICAL", "matched_failed", 1.0)]
    assert result.settings().count() == 19
    assert [(f.name, f.dataType) for f in result.summary().schema] == [(f.name, f.dataType) for f in T.StructType.fromDDL(SUMMARY)]


@pytest.mark.parametrize(
    ("prod", "dev", "expected"),
    [
        ("A,1|A,2|B,3", "A,1|A,2|B,3", (3, 0, 0, 0)),
        ("A,1|A,1|B,2", "A,1|A,1|B,2", (3, 0, 0, 0)),
        ("A,1|A,2", "A,1|A,9", (1, 1, 0, 0)),
        ("A,1|A,2", "A,1", (1, 0, 1, 0)),
        ("1,A|2,B|3,C", "1,A|4,D", (1, 0, 2, 1)),
        (",A|1,B", ",A|1,B", (2, 0, 0, 0)),
        ("ABC,A", "abc,A", (0, 0, 1, 1)),
        (" T001 ,A", "T001,A", (1, 0, 0, 0)),
        ("3,C|1,A|2,B", "1,A|2,B|3,C", (3, 0, 0, 0)),
        ("001,A|1,B", "001,A|1,B", (2, 0, 0, 0)),
        ("", "1,A", (0, 0, 0, 1)),
        ("", "", (0, 0, 0, 0)),
    ],
)
def test_small_pairs(spark, prod, dev, expected):
    assert counts(pair(spark, prod, dev)) == expected
    assert counts(pair(spark, prod, dev, counted_sequence=True)) == expected


@pytest.mark.parametrize(
    ("prod", "dev", "equal"),
    [
        ("100.0", "100", False), ("true", "TRUE", False), ("2024-01-15", "15/01/2024", False), ("2024-01-15 00:00:00", "2024-01-15", False), ("1.5e3", "1500", False),
        ("$100", "100", False), ("", "", True), ("", "   ", True), ("", "0", False), (" x", "x ", True),
    ],
)
def test_cells(spark, prod, dev, equal):
    result = pair(spark, f"1,{prod}", f"1,{dev}")
    assert counts(result) == ((1, 0, 0, 0) if equal else (0, 1, 0, 0))


def test_no_key_compares_by_position(spark):
    prod, dev = frame(spark, "A|B|C", "Val").coalesce(1), frame(spark, "A|X|C", "Val").coalesce(1)
    result = compare(prod, dev, DiffConfig())
    assert counts(result) == (2, 1, 0, 0)
    assert [(r[ROW_ID], r.prod_value, r.dev_value) for r in result.value_differences().collect()] == [(1, "B", "X")]


def test_pass_report_keeps_failed_rows_only_on_request(spark):
    result = pair(spark, "1,A|2,B", "1,A|2,X")
    assert result.pass_report().count() == 2
    (row,) = result.pass_report(only_failed=True).collect()
    assert row.asDict() == {"ID": "2", "Prod.V": "B", "Dev.V": "X", "CompareResult_V": "Fail"}


def test_invariants_and_swap(spark):
    prod, dev = "A,1|A,2|B,3|C,4|,5", "A,1|B,9|B,8|D,4|,5"
    there, back = pair(spark, prod, dev), pair(spark, dev, prod)
    p, f, missing, extra = counts(there)
    assert p + f + missing == 5 and p + f + extra == 5
    assert counts(back) == (p, f, extra, missing)
    assert pair(spark, prod, prod).value_differences().isEmpty()


def test_odd_column_names_and_case(spark):
    columns = "ID,a.b,side,p,_x y`z,Größe"
    result = pair(spark, "1,q,r,s,t,u", "1,q,R,s,T,u", columns=columns)
    assert {r.column for r in result.value_differences().collect()} == {"side", "_x y`z"}


def test_missing_key_is_reported(spark):
    result = pair(spark, "1,A", "1,A", keys=("ID", "Nope"))
    assert (result.keys, result.missing_keys) == (["ID"], ["Nope"])


def test_wide_pair(spark):
    names = ",".join(["ID", *(f"c{i}" for i in range(300))])
    row = ",".join(["1", *(str(i) for i in range(300))])
    result = pair(spark, row, row.replace(",299", ",x"), columns=names)
    assert [r.column for r in result.value_differences().collect()] == ["c299"]


def test_many_pairs_survive_failures(spark):
    def broken():
        raise ValueError("no such file")

    good = lambda: frame(spark, "1,A", "ID,V")
    table = compare_many(spark, [("ok", good, good, DiffConfig(keys=("ID",))), ("bad", broken, good, DiffConfig())])
    found = {r.result_name: r for r in table.collect()}
    assert found["ok"].matched_passed == 1 and found["bad"].error == "no such file"
    assert overall_pass(table).first().overall_pass is False
    assert overall_pass(table.where("error is null"), strict=True).first().overall_pass is True


def test_hooks_and_switches(spark):
    result = pair(spark, "1,A", "1,B", enabled=frozenset({"comparison"}))
    result.register_check("mine", lambda r: r.value_differences().select("column"))
    result.register_check("fails", lambda r: r.spark.table("absent"))
    tables = result.results()
    assert set(tables) == {"value_differences", "count_differences", "pass_report", "mine", "settings"}
    events = {(r.capability, r.event.split(":")[0]) for r in result.audit().collect()}
    assert {("mine", "DONE"), ("fails", "FAILED"), ("schema", "SKIPPED")} <= events


def test_steps_are_done_when_they_say_so(spark, tmp_path):
    """Tables are stored under the timer, and a hook whose job fails is a result of the run."""
    result = pair(spark, "1,A|2,B", "1,B|2,B")
    result.register_check("fails_in_its_job", lambda r: r.value_differences().selectExpr("raise_error('in the job')"))
    tables = result.write(str(tmp_path / "out"), "r1", ordered=True)
    events = {r.capability: r for r in result.audit().where("event <> 'START'").collect()}
    assert events["fails_in_its_job"].event.startswith("FAILED") and "in the job" in events["fails_in_its_job"].event
    assert events["comparison"].event == "DONE" and events["comparison"].elapsed > 0
    assert tables["value_differences"].count() == 1 and "fails_in_its_job" not in tables
    assert not result.aligned.is_cached
    with pytest.raises(Exception, match="(?i)exist"):
        pair(spark, "1,A", "1,A").write(str(tmp_path / "out"), "r1")


def test_tolerance_can_be_switched_off_and_comes_from_rules(spark):
    rule = spark.createDataFrame([("prod", "dev", "V", 1, None), ("prod", "dev", "gone", 1, None)], "prod_name string, dev_name string, field string, decimals int, reason string")
    data = frame(spark, "1,1.04", "ID,V"), frame(spark, "1,1.01", "ID,V")
    assert compare(*data, DiffConfig(keys=("ID",)), rule).value_differences().isEmpty()
    assert compare(*data, DiffConfig(keys=("ID",), enabled=frozenset({"comparison"})), rule).value_differences().count() == 1
    tables = compare(*data, DiffConfig(keys=("ID",), include_pass=False), rule).results()
    assert {(r.field, r.reason) for r in tables["tolerance"].collect()} == {("V", None), ("gone", "absent from PROD")} and "pass_report" not in tables


def test_hot_key_alignment(spark):
    rows = "|".join(f"A,{i % 50}" for i in range(300)) + "|B,1"
    assert counts(pair(spark, rows, rows, hot_rows=100)) == (301, 0, 0, 0)


def test_one_exchange_for_each_side_and_no_python(spark):
    result = pair(spark, "1,A|2,B", "1,A|2,X", hash_first=False)
    result.aligned  # noqa: B018  settles the sequence question
    plan = result.value_differences()._jdf.queryExecution().sparkPlan().toString()
    assert "Python" not in plan and plan.count("Join") == 1
