import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pairlens.functions.text import CSV_NA, apart_by_case, canonical, clean_name, parsed, percent, rounded
from pairlens.plans.compare import DiffConfig, compare


@pytest.mark.parametrize(
    ("value", "decimals", "expected"),
    [
        ("0.005", 2, "0.01"), ("100.001", 2, "100.00"), ("100.006", 2, "100.01"), ("99.7", 0, "100"), ("1,234.567", 2, "1234.57"), ("N/A", 2, "N/A"), ("", 2, ""),
        ("-5.554", 2, "-5.55"), ("3.14159265", 4, "3.1416"), ("-0.001", 2, "0.00"), (" 12 ", 1, "12.0"), ("inf", 2, "inf"), ("1_000", 2, "1_000"), ("9" * 50, 2, "9" * 50),
    ],
)
def test_rounded(spark, value, decimals, expected):
    assert spark.range(1).select(rounded(F.lit(value), decimals)).first()[0] == expected


def test_rounded_pairs(spark):
    for a, b, n in (("0.30000000004", "0.3", 10), ("1e-5", "0.00001", 5)):
        row = spark.range(1).select(rounded(F.lit(a), n), rounded(F.lit(b), n)).first()
        assert row[0] == row[1]


def test_canonical_types(spark):
    when = datetime.datetime(2024, 1, 15, 1, 2, 3)
    rows = [(" a  ", 1e7, Decimal("1.50"), when, True, [1, 2], None), (None, None, None, when.replace(microsecond=5), None, None, b"\x01")]
    df = spark.createDataFrame(rows, "s string, d double, n decimal(5,2), t timestamp, b boolean, a array<int>, x binary")
    first, second = canonical(df).collect()
    assert tuple(first) == ("a", "10000000", "1.50", "2024-01-15 01:02:03", "true", "[1,2]", "")
    assert tuple(second) == ("", "", "", "2024-01-15 01:02:03.000005", "", "", "01")


def test_na_values_only_when_asked(spark):
    df = spark.createDataFrame([("N/A", " NA")], "a string, b string")
    assert tuple(canonical(df).first()) == ("N/A", "NA")
    assert tuple(canonical(df, na_values=CSV_NA).first()) == ("", "NA")


@pytest.mark.parametrize(("text", "number"), [("1e3", 1000.0), (" 5 ", 5.0), (".5", 0.5), ("1d", None), ("True", None), ("1_000", None), ("0x10", None), ("", None), ("-7.", -7.0)])
def test_parsed(spark, text, number):
    assert spark.range(1).select(parsed(F.lit(text))).first()[0] == number


def test_percent_and_names(spark):
    row = spark.range(1).select(percent(F.lit(1), F.lit(3)), percent(F.lit(1), F.lit(0)), clean_name(F.lit(' a<b>:"c. ')), clean_name(F.lit(" .. "))).first()
    assert tuple(row) == (33.3333, 0.0, "a_b___c", "CompareRecords")


def test_doubles_keep_their_digits(spark):
    import random
    import struct
    from decimal import Decimal

    rng = random.Random(1)
    values = [0.0, -0.0, 1e7, -1e7, 1e-7, 2e-7, 123456789.125, 0.001, 1e22, 1.5e300, 5e-324, 100.0, -2.5, 12345678.9] + [struct.unpack("d", rng.randbytes(8))[0] for _ in range(400)]
    values = [v for v in values if v == v and abs(v) != float("inf")]
    out = canonical(spark.createDataFrame([(v,) for v in values], "v double")).collect()
    for v, r in zip(values, out):
        assert "E" not in r.v and float(r.v) == v and "." not in r.v[-1:] and not (("." in r.v) and r.v.endswith("0"))
    said = dict(zip(values, (r.v for r in out)))
    assert {v: said[v] for v in (1e7, 1e-7, 100.0, -2.5, 123456789.125, 0.0)} == {1e7: "10000000", 1e-7: "0.0000001", 100.0: "100", -2.5: "-2.5", 123456789.125: "123456789.125", 0.0: "0"}
    assert all(said[v] == format(Decimal(repr(v)), "f") for v in (1e22, 0.001, 12345678.9))
    odd = canonical(spark.createDataFrame([(float("nan"), 0.1), (float("inf"), 1e10), (None, None)], "v double, f float")).collect()
    assert [tuple(r) for r in odd] == [("NaN", "0.1"), ("Infinity", "10000000000"), ("", "")]
    assert canonical(spark.createDataFrame([(2.345678912,)], "v double"), scales={"v": 2}).first().v == "2.35"


def test_maps_are_equal_in_any_order(spark):
    rows = spark.sql("select map('b', 1, 'a', 2) as m, array(map('y', map(2, 'x', 1, 'w'), 'x', null)) as n, named_struct('m', map('b', 1, 'a', 2)) as s union all select map('a', 2, 'b', 1), array(map('x', null, 'y', map(1, 'w', 2, 'x'))), named_struct('m', map('a', 2, 'b', 1))")
    one, other = canonical(rows).collect()
    assert one == other and one.m == '{"a":2,"b":1}'


def test_names_that_differ_in_case_only(spark):
    one = spark.createDataFrame([("1", "a", "x")], "k string, Val string, val string")
    other = spark.createDataFrame([("y", "1", "a")], "val string, k string, Val string")
    assert apart_by_case(one, other) == {"val": "val~1"} and apart_by_case(one.select("k"), other.select("k")) == {}
    result = compare(one, other, DiffConfig(keys=("k",), ignore=("Val",)))
    assert [(r.column, r.prod_value, r.dev_value) for r in result.value_differences().collect()] == [("val~1", "x", "y")]
    assert compare(one, other, DiffConfig(keys=("k",), ignore=("val",))).value_differences().isEmpty()
