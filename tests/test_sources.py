import random

import pytest

from pairlens.plans.compare import DiffConfig, compare
from pairlens.sources import layout, readers, sinks
from pairlens.sources.records import block_traits, composed, ends_inside, records


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("sep", readers.DELIMITERS)
def test_delimiters(spark, tmp_path, sep):
    path = write(tmp_path / "x.txt", sep.join(["ID", "Name", "N"]) + "\n" + sep.join(["1", "Ann B", "2"]) + "\n")
    assert [tuple(r) for r in readers.read_any(spark, path).collect()] == [("1", "Ann B", "2")]


def test_quotes_bom_and_line_breaks(spark, tmp_path):
    path = write(tmp_path / "x.csv", b'\xef\xbb\xbfID,V\n1,"a ""b"", c"\n2,"two\nlines"\n')
    df = readers.read_any(spark, path)
    assert df.columns == ["ID", "V"]
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [("1", 'a "b", c'), ("2", "two\nlines")]


def test_encodings_of_one_folder(spark, tmp_path):
    write(tmp_path / "in/a.csv", "ID,V\n1,é€\n")
    write(tmp_path / "in/b.csv", "ID,V\n2,é €“\n", "cp1252")
    write(tmp_path / "in/c.csv", b"ID,V\n3,\xe9\x81\n")
    path = str(tmp_path / "in")
    assert {r.file[-5:]: r.encoding for r in readers.encodings(spark, path).collect()} == {"a.csv": "utf-8", "b.csv": "cp1252", "c.csv": "latin1"}
    assert {tuple(r) for r in readers.read_delimited(spark, path).collect()} == {("1", "é€"), ("2", "é €“"), ("3", "é\x81")}


def test_fixed_width_and_blanks(spark, tmp_path):
    text = "ID   Name      N\n1    Ann B     10\n22   C         7\n"
    path = write(tmp_path / "f.txt", text)
    assert [tuple(r) for r in readers.read_any(spark, path, "fixed").collect()] == [("1", "Ann B", "10"), ("22", "C", "7")]
    path = write(tmp_path / "w.txt", "ID  V\n1   x\n 2 \t y\n")
    assert [tuple(r) for r in readers.read_any(spark, path, "blank").collect()] == [("1", "x"), ("2", "y")]


def test_separators_of_one_folder(spark, tmp_path):
    write(tmp_path / "in/a.txt", "id|v\n1|x;y\n")
    write(tmp_path / "in/b.txt", "id;v\n2;b\n")
    write(tmp_path / "in/c.txt", "v;id\nc;3\n")
    assert {(r.id, r.v) for r in readers.read_delimited(spark, str(tmp_path / "in")).collect()} == {("1", "x;y"), ("2", "b"), ("3", "c")}


def test_blank_cells(spark, tmp_path):
    path = write(tmp_path / "x.csv", "ID,V\n1,N/A\n2,NULL\n3, NA\n4,x\n")
    assert {r.ID: r.V for r in readers.read_any(spark, path).collect()} == {"1": None, "2": None, "3": " NA", "4": "x"}
    other = write(tmp_path / "y.csv", "ID,V\n1,\n2,nan\n3, NA\n4,x\n")
    result = compare(readers.read_any(spark, path), readers.read_any(spark, other), DiffConfig(keys=("ID",)))
    assert result.value_differences().isEmpty()
    assert {r.V for r in readers.read_delimited(spark, path, sep=",", na_values=()).collect()} >= {"N/A", "NULL"}


def test_only_files_with_quoted_breaks_are_read_whole(spark, tmp_path):
    write(tmp_path / "in/a.csv", 'ID,V\n1,"two\nlines"\n')
    write(tmp_path / "in/b.csv", 'ID,V\n2,"one ""line"""\n')
    assert {r.file[-5:]: r.broken for r in block_traits(spark, str(tmp_path / "in"), {}).collect()} == {"a.csv": True, "b.csv": False}
    assert {(r.ID, r.V) for r in readers.read_delimited(spark, str(tmp_path / "in"), sep=",").collect()} == {("1", "two\nlines"), ("2", 'one "line"')}


def test_fixed_width_loses_nothing(spark, tmp_path):
    head = "ID   Name      N\n"
    lines = [f"{k:<5}{'n' + str(k):<10}{k}\n" for k in range(10, 99)]
    late = "123456Long name 7\n" + "ID   Name      N\n" + "1    x         " + "9" * 40 + "\n"
    path = write(tmp_path / "f.txt", head + "".join(lines * 2) + late)
    rows = [tuple(r) for r in readers.read_any(spark, path, "fixed").collect()]
    assert len(rows) == 178 + 3
    assert "".join(rows[-3]).replace(" ", "") == "123456Longname7" and "".join(rows[-2]).replace(" ", "") == "IDNameN" and "".join(rows[-1]).replace(" ", "") == "1x" + "9" * 40
    wider = write(tmp_path / "w.txt", head + "".join(lines * 2) + "1234 x         7\n")
    assert readers.fixed_width_edges(spark, wider) == [(0, 4), (5, 4), (15, 2)]
    assert tuple(readers.read_any(spark, wider, "fixed").collect()[-1]) == ("1234", "x", "7")


def test_detection_reads_beginnings_only(spark, tmp_path):
    write(tmp_path / "a/x", b"PAR1 and more")
    write(tmp_path / "b/x", "ID,V\n1,A\n")
    assert readers.is_parquet(spark, str(tmp_path / "a")) and not readers.is_parquet(spark, str(tmp_path / "b"))
    assert not readers.is_parquet(spark, str(tmp_path / "no.csv"))  # its ending says so, nothing is opened
    plan = readers._files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    with pytest.raises(Exception, match="(?i)exist"):
        readers.read_any(spark, str(tmp_path / "absent"))
    write(tmp_path / "e/x.txt", "")
    assert readers.read_any(spark, str(tmp_path / "e/x.txt"), "fixed").columns == [] and readers.read_any(spark, str(tmp_path / "e/x.txt"), "blank").columns == []


def test_inventory_and_mixed_formats(spark, tmp_path):
    df = spark.createDataFrame([("1", "A", "2020"), ("2", "B", "2021")], "ID string, V string, year string")
    df.write.partitionBy("year").parquet(str(tmp_path / "t/p"))
    write(tmp_path / "t/c/x.csv", "ID,V,year\n1,A,2020\n2,C,2021\n")
    files = readers.source_inventory(spark, str(tmp_path / "t")).collect()
    assert sorted((r.is_parquet, list(r.partition_columns)) for r in files) == [(False, []), (True, ["year"]), (True, ["year"])]
    assert readers.is_parquet(spark, str(tmp_path / "t/p")) and not readers.is_parquet(spark, str(tmp_path / "t/c"))
    result = compare(readers.read_any(spark, str(tmp_path / "t/p")), readers.read_any(spark, str(tmp_path / "t/c/x.csv")), DiffConfig(keys=("ID",)))
    assert [(r.column, r.prod_value, r.dev_value) for r in result.value_differences().collect()] == [("V", "B", "C")]


def test_parquet_prunes_and_pushes(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(10).selectExpr("id", "id * 2 as twice", "'x' as rest").write.parquet(path)
    df = readers.read_parquet(spark, path, ["twice"], "id > 7")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,7)" in plan and "rest" not in plan
    assert readers.row_count(spark, path) == 10


def test_sinks_never_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a,"b'), ("2", "")], "ID string, V string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert {(r.ID, r.V or "") for r in readers.read_delimited(spark, str(tmp_path / "csv"), sep=",").collect()} == {("1", 'a,"b'), ("2", "")}
    root = str(tmp_path / "results")
    paths = sinks.write_results({"t": df, "empty": df.limit(0)}, root, "a/b", "r1")
    assert spark.read.parquet(paths["t"]).count() == 2 and spark.read.parquet(paths["empty"]).columns == ["ID", "V"]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_results({"t": df}, root, "a/b", "r1")
    events = spark.createDataFrame([(0.0, "x", "START", 0.0)], "timestamp double, capability string, event string, elapsed double")
    sinks.append_audit(events, str(tmp_path / "audit"))
    sinks.append_audit(events, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2


@pytest.fixture
def small_blocks(spark):
    """Scan tasks of a few hundred bytes, as a large file has them of 128 MB."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def random_csv(seed, rows=150):
    """Cells with breaks, separators, doubled and stray quotes, blanks and text behind a closing quote."""
    rng = random.Random(seed)
    cells = ["x", "", "plain text", '"quoted"', '"two\nlines"', '"a ""b"" c"', '"sep, in"', '5" pipe', ' "blank before"', '"closed" and more', '"' + "long\n\n" * 30 + '"', '""', "é€", '"\r\n"', '"ends with quote"""']
    return "k,a,b\n" + "".join(f"{i},{rng.choice(cells)},{rng.choice(cells)}\n" for i in range(rows))


@pytest.mark.parametrize("seed", range(4))
def test_many_tasks_read_what_one_reads(spark, tmp_path, small_blocks, seed):
    path = write(tmp_path / "in/x.csv", random_csv(seed))
    write(tmp_path / "in/y.csv", random_csv(seed + 10, 40))
    found = readers._groups(spark, str(tmp_path / "in"), ",", None, None, True, False)
    assert len(found) == 1 and found[0].blocks is not None and len(found[0].blocks) > 20 and any(b.inside for b in found[0].blocks.values())
    assert found[0].records().rdd.getNumPartitions() > 20
    for where in (path, str(tmp_path / "in")):
        one = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(where)
        many = readers.read_delimited(spark, where, sep=",", na_values=())
        assert many.columns == one.columns
        assert sorted(map(tuple, many.collect()), key=repr) == sorted(map(tuple, one.collect()), key=repr)


def test_records_know_their_lines(spark, tmp_path, small_blocks):
    text = random_csv(7, 80)
    path = write(tmp_path / "x.csv", "\n" + text)
    blocks = composed(block_traits(spark, path, {}).collect())
    rows = sorted((r.line, r.text) for r in records(spark, path, ",", blocks).collect())
    lines = ("\n" + text).split("\n")
    assert len(rows) == 80 and all(lines[line - 1].startswith(t.split("\n")[0].rstrip("\r")) for line, t in rows)
    assert [t.split(",")[0] for _, t in rows] == [str(i) for i in range(80)]


@pytest.mark.parametrize(
    ("line", "inside", "expected"),
    [
        (b"a,b", False, False), (b'"a', False, True), (b'a"b,"c', False, True), (b'a"b', False, False), (b'"a""', False, True), (b'"a"""', False, False),
        (b'"a"x"y,z', False, False), (b'text",b', True, False), (b"text", True, True), (b'text"",x', True, True), (b'x","y', True, True), (b' "a', False, False), (b"", True, True), (b'"', True, False),
    ],
)
def test_states_of_quotes(line, inside, expected):
    assert ends_inside(line, inside, b",") is expected


def test_unclosed_quotes_and_other_encodings(spark, tmp_path, small_blocks):
    body = "".join(f'{i},"é\nline {i}"\n' for i in range(60))
    write(tmp_path / "in/a.csv", "k,v\n" + body, "cp1252")
    rows = {r.k: r.v for r in readers.read_delimited(spark, str(tmp_path / "in"), sep=",").collect()}
    assert rows == {str(i): f"é\nline {i}" for i in range(60)}
    path = write(tmp_path / "open.csv", "k,v\n" + "1,x\n" * 50 + '2,"never closed\n' + "3,y\n" * 90)
    rows = readers.read_delimited(spark, path, sep=",").collect()
    assert len(rows) == 51 and rows[-1].v.count("\n") >= 90


def test_rejected_rows(spark, tmp_path):
    text = 'ID,V\n1,a,EXTRA\n2\n3,"two\nlines"\n\n4,"x,y","z",\n5,b\n'
    path = write(tmp_path / "x.csv", text)
    rows, rejected = readers.read_delimited_checked(spark, path, sep=",")
    assert sorted(map(tuple, rows.collect())) == [("2", None), ("3", "two\nlines"), ("5", "b")]
    assert sorted((r.line, r.text, r.reason) for r in rejected.collect()) == [(2, "1,a,EXTRA", "too many cells"), (3, "2", "too few cells"), (7, '4,"x,y","z",', "too many cells")]
    assert {r.file.rsplit("/", 1)[1] for r in rejected.collect()} == {"x.csv"}
    with pytest.raises(Exception, match="more cells than the header"):
        readers.read_delimited(spark, path, sep=",").count()
    plain = write(tmp_path / "y.csv", "ID,V\n1,a\n2\n3,c,\n")
    with pytest.raises(Exception, match="more cells than the header"):
        readers.read_delimited(spark, plain, sep=",").select("ID").collect()
    short = write(tmp_path / "z.csv", "ID,V,W\n1,a\n2\n,,\n")
    assert sorted(map(tuple, readers.read_delimited(spark, short, sep=",").collect()), key=repr) == [("1", "a", None), ("2", None, None), (None, None, None)]
    rows, rejected = readers.read_delimited_checked(spark, write(tmp_path / "none.csv", ""))
    assert rows.columns == [] and rejected.collect() == []


def test_repeated_and_blank_header_names(spark, tmp_path):
    path = write(tmp_path / "x.csv", 'id,v,v,"a\nb",,v.1\n1,2,3,4,5,6\n')
    df = readers.read_delimited(spark, path, sep=",")
    assert df.columns == ["id", "v", "v.1", "a\nb", "_c4", "v.1.1"] and tuple(df.first()) == ("1", "2", "3", "4", "5", "6")


def test_layouts_of_one_folder(spark, tmp_path):
    write(tmp_path / "in/a.txt", "id|name|city\n1|Ann B|Oslo\n")
    write(tmp_path / "in/b.txt", "id   name      city\n2    Ann C     New York\n3    D         Rome\n")
    write(tmp_path / "in/c.txt", "city name id\nRome Eve 4\nOslo   Fay\t5\n")
    write(tmp_path / "in/d.txt", "name id\nGus 6\n")
    kinds = {r.file[-5:]: r.kind for r in layout.layouts(spark, str(tmp_path / "in")).collect()}
    assert kinds == {"a.txt": "delimited", "b.txt": "fixed", "c.txt": "blank", "d.txt": "blank"}
    rows = {(r.id, r.name, r.city) for r in readers.read_any(spark, str(tmp_path / "in")).collect()}
    assert rows == {("1", "Ann B", "Oslo"), ("2", "Ann C", "New York"), ("3", "D", "Rome"), ("4", "Eve", "Rome"), ("5", "Fay", "Oslo"), ("6", "Gus", None)}


def test_blank_separated_files_of_other_headers(spark, tmp_path):
    write(tmp_path / "in/a.txt", "id name\n1 x\n")
    write(tmp_path / "in/b.txt", "name id\ny 2\n")
    assert {(r.id, r.name) for r in readers.read_blank_separated(spark, str(tmp_path / "in")).collect()} == {("1", "x"), ("2", "y")}
    path = write(tmp_path / "w.txt", "id name\n1 a b c\n2\n")
    assert {tuple(r) for r in readers.read_blank_separated(spark, path).collect()} == {("1", "a b c"), ("2", None)}


def test_fixed_width_files_of_other_headers(spark, tmp_path):
    write(tmp_path / "in/a.txt", "id   name      \n1    Ann B\n")
    write(tmp_path / "in/b.txt", "name      id\nAnn C     2\n")
    assert {(r.id, r.name) for r in readers.read_fixed_width(spark, str(tmp_path / "in")).collect()} == {("1", "Ann B"), ("2", "Ann C")}


def test_trailer_line_is_rejected(spark, tmp_path):
    lines = [f"{k:<5}{'n' + str(k):<10}{k}" for k in range(10, 99)]
    trailer = "TOTAL of 89 lines in this file"
    path = write(tmp_path / "f.txt", "\n".join(["ID   Name      N", *lines, trailer, ""]))
    rows, rejected = readers.read_fixed_width_checked(spark, path)
    assert rows.columns == ["ID", "Name", "N"] and rows.count() == 89
    assert [(r.line, r.text, r.reason) for r in rejected.collect()] == [(91, trailer, "text between columns")]
    kept = readers.read_fixed_width(spark, path)
    assert kept.columns == ["ID", "Name", "N"] and "".join(kept.where("ID = 'TOTAL'").first()).replace(" ", "") == trailer.replace(" ", "")


def test_right_aligned_numbers_that_grow(spark, tmp_path):
    lines = [f"{'n' + str(k):<8}{k * k:>10}  z" for k in range(200)]
    path = write(tmp_path / "f.txt", "\n".join([f"{'name':<8}{'number':>10}  q", *lines, f"{'last':<8}{10**9:>10}  z", ""]))
    rows = readers.read_fixed_width(spark, path).collect()
    assert len(rows) == 201 and tuple(rows[-1]) == ("last", "1000000000", "z") and tuple(rows[5]) == ("n5", "25", "z")


def test_detection_reads_the_beginning_of_large_files(spark, tmp_path):
    """Of a file larger than a scan partition only the beginning is read for its layout."""
    path = write(tmp_path / "big.txt", "id|v\n" + "".join(f"{i}|{'z' * 400}\n" for i in range(500_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        store = spark.sparkContext._jsc.sc().statusStore()
        (row,) = layout.layouts(spark, path).collect()
        stage = max(s for job in spark.sparkContext.statusTracker().getJobIdsForGroup() for s in spark.sparkContext.statusTracker().getJobInfo(job).stageIds)
        assert (row.kind, row.delimiter, row.header) == ("delimited", "|", "id|v")
        assert 0 < store.lastStageAttempt(stage).inputBytes() < 120_000_000  # of 203 MB; what is on its way when the task stops is read in vain
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_known_options_need_no_detection(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "x.csv", "ID,V\n1,a\n")
    monkeypatch.setattr(readers, "block_traits", None)  # not called
    assert readers.read_delimited(spark, path, sep=",", encoding="utf-8", multiline=False).collect() == [("1", "a")]
