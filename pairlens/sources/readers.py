"""Delimited, fixed-width, blank-separated and Parquet inputs, with encoding, layout and format detection.

``layout`` judges files by their beginnings; a pass over all lines (``records.block_traits``) is made only for
what cannot be judged there and is not given: the encoding, and quoted line breaks. A row for each file, or
for each block of files that quotes may span, comes back. Lines that do not fit their file's layout are
never cut off in silence: they fail the read, are kept whole, or are returned as rejected rows.
"""

from __future__ import annotations

import csv
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CSV_NA, column
from .layout import DELIMITERS, SAMPLE_LINES, cuts_of, first_lines, layouts, stray  # noqa: F401
from .records import Block, block_traits, composed, records

#: The cp1252 characters of bytes 80 to 9F.
UNDEFINED_CP1252 = "\x81\x8d\x8f\x90\x9d"
CP1252 = "".join(bytes([b]).decode("cp1252", "replace") if chr(b) not in UNDEFINED_CP1252 else chr(b) for b in range(0x80, 0xA0))
LATIN1 = "".join(map(chr, range(0x80, 0xA0)))
#: Endings that settle the format of a file without looking into it.
PARQUET_ENDINGS = (".parquet", ".parq")
OTHER_ENDINGS = (".csv", ".txt", ".tsv", ".json", ".gz", ".crc", "_success")
REJECTED = "file string, line long, text string, reason string"
_BAD, _END = "__bad", "\x1fend"


def _encoding(utf8: Column, cp1252: Column) -> Column:
    return F.when(F.every(utf8), "utf-8").when(F.every(cp1252), "cp1252").otherwise("latin1")


def encodings(spark: SparkSession, path: str) -> DataFrame:
    """``file, encoding`` for every text file below a path: utf-8, cp1252 or latin1."""
    return block_traits(spark, path, {}).groupBy("file").agg(_encoding(F.col("utf8"), F.col("cp1252")).alias("encoding"))


def delimiters(spark: SparkSession, path: str, lines: int = SAMPLE_LINES) -> DataFrame:
    """``file, delimiter`` for every file; see ``layout.delimiter_of``. Without any, a comma."""
    return layouts(spark, path, lines).select("file", F.coalesce("delimiter", F.lit(",")).alias("delimiter"))


def _blank(df: DataFrame, na_values: tuple[str, ...]) -> DataFrame:
    """Cells that stand for blank become null."""
    return df.select(*[F.when(~column(c).isin(*na_values), column(c)).alias(c) for c in df.columns]) if na_values else df


def header_names(cells: list[str], strip: bool = True) -> list[str]:
    """Column names of a header: blank ones are numbered; a name that comes again gets ``.1``, ``.2`` and so on."""
    out: list[str] = []
    for i, cell in enumerate(cells):
        name = (cell.strip() if strip else cell) or f"_c{i}"
        again, k = name, 0
        while again in out:
            k += 1
            again = f"{name}.{k}"
        out.append(again)
    return out


def _header(line: str, sep: str, strip: bool) -> list[str]:
    return header_names(next(csv.reader([line], delimiter=sep, skipinitialspace=sep != ","), []), strip)


def _options(sep: str, width: int) -> tuple[dict[str, str], str]:
    """Options of the CSV parser and the schema of ``width`` text columns with the corrupt record behind them."""
    options = {"sep": sep, "quote": '"', "escape": '"', "columnNameOfCorruptRecord": _BAD, "ignoreLeadingWhiteSpace": str(sep != ",").lower()}
    return options, ", ".join([*(f"c{i} string" for i in range(width)), f"{_BAD} string"])


def _surplus(text: Column, sep: str, width: int) -> Column:
    """Whether a record that does not have ``width`` cells has more: an added last cell is then beyond them."""
    options, schema = _options(sep, width)
    cells = F.from_csv(F.concat(text, F.lit(sep + _END)), F.lit(schema), {**options, "multiLine": "true"})
    return ~F.array_contains(F.array(*[F.coalesce(cells[f"c{i}"], F.lit("")) for i in range(width)]), _END)


class _Group:
    """Files of one separator, encoding and header line."""

    def __init__(self, spark: SparkSession, sep: str, encoding: str, header: str, files: list[str], blocks: dict[tuple[str, int], Block] | None, strip: bool):
        self.spark, self.sep, self.encoding, self.files, self.blocks = spark, sep, encoding, files, blocks
        self.names = _header(header, sep, strip)

    def parsed(self) -> DataFrame:
        """``c0`` .., and ``__bad`` with the text of records that have not as many cells as the header."""
        options, schema = _options(self.sep, len(self.names))
        if self.blocks is not None:
            cells = self.records().select(F.from_csv("text", F.lit(schema), {**options, "multiLine": "true"}).alias("r"))
            return cells.select("r.*")
        reader = self.spark.read.schema(schema).options(**options).option("header", True).option("encoding", "UTF-8" if self.encoding == "utf-8" else "ISO-8859-1")
        df = reader.csv(self.files)
        if self.encoding == "cp1252":
            df = df.select(*[F.translate(F.col(c), LATIN1, CP1252).alias(c) for c in df.columns])
        return df

    def records(self) -> DataFrame:
        """``file``, ``line`` and ``text`` of the records behind the header."""
        own = {k: b for k, b in self.blocks.items() if k[0] in set(self.files)}
        return records(self.spark, self.files, self.sep, own, self.encoding, self.sep != ",")

    def named(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(self.names)])

    def surplus(self) -> Column:
        return F.col(_BAD).isNotNull() & _surplus(F.col(_BAD), self.sep, len(self.names))

    def rows(self) -> DataFrame:
        """All records; one of too many cells fails the read, one of too few is filled with nulls."""
        # the message names all cells, because the CSV source overlooks what lies behind cells that are not read
        cells = F.concat_ws(" | ", *[F.col(f"c{i}") for i in range(len(self.names))])
        found = F.raise_error(F.concat(F.lit(f"a record has more cells than the header's {len(self.names)}: "), F.col(_BAD), F.lit(" of which are read: "), cells)).cast("boolean")
        return self.named(self.parsed().where(F.coalesce(F.when(self.surplus(), found), F.lit(True))))

    def checked(self) -> tuple[DataFrame, DataFrame]:
        """Records that are not of too many cells, and (file, line, text, reason) of those that do not fit."""
        options, schema = _options(self.sep, len(self.names))
        cells = self.records().select("file", "line", "text", F.from_csv("text", F.lit(schema), {**options, "multiLine": "true"}).alias("r")).select("file", "line", "text", "r.*")
        bad = cells.where(F.col(_BAD).isNotNull())
        reason = F.when(self.surplus(), "too many cells").otherwise("too few cells")
        return self.named(cells.where(~self.surplus())), bad.select("file", "line", "text", reason.alias("reason"))


def _groups(spark: SparkSession, path: str, sep: str | None, encoding: str | None, multiline: bool | None, strip: bool, lines: bool, found: list | None = None) -> list[_Group]:
    """The files of a path by separator, encoding and header; ``lines`` asks for the blocks of all files."""
    found = layouts(spark, path).collect() if found is None else found  # a row for each file
    seps = {r.file: sep or r.delimiter or "," for r in found}
    coded: dict[str, str] = {}
    broken: set[str] = set()
    blocks: dict[tuple[str, int], Block] = {}
    if found and (encoding is None or multiline is not False or lines):
        files = [r.file for r in found]
        traits = [t for blank in {s != "," for s in seps.values()} for t in block_traits(spark, [f for f in files if (seps[f] != ",") == blank], seps, blank).collect()]  # a row for each block
        blocks = composed(traits)
        flags: dict[str, list] = {}
        for t in traits:
            flags.setdefault(t.file, []).append(t)
        coded = {f: "utf-8" if all(t.utf8 for t in ts) else "cp1252" if all(t.cp1252 for t in ts) else "latin1" for f, ts in flags.items()}
        broken = {f for f, ts in flags.items() if any(t.broken or blocks[f, t.block].inside for t in ts)}
    by: dict[tuple, list[str]] = {}
    for r in sorted(found, key=lambda r: r.file):
        parts = lines or (r.file in broken if multiline is None else multiline)
        by.setdefault((seps[r.file], encoding or coded.get(r.file, "utf-8"), parts, r.header), []).append(r.file)
    return [_Group(spark, own, name, header, files, blocks if parts else None, strip) for (own, name, parts, header), files in by.items()]


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, multiline: bool | None = None, strip_header: bool = True, na_values: tuple[str, ...] = CSV_NA) -> DataFrame:
    """CSV or delimited text with a header, all columns strings; ``na_values`` become null.

    Separator, encoding and quoted line breaks are found for each file unless given. Files of one
    separator, encoding and header line are read together, and these tables united by column name.
    Files whose quotes span lines (all, if ``multiline``) are cut into records by many tasks. A record
    of more cells than the header fails the read; missing cells are null. An input without lines gives
    no columns.
    """
    groups = _groups(spark, path, sep, encoding, multiline, strip_header, bool(multiline))
    return _blank(_united([g.rows() for g in groups]), na_values) if groups else spark.createDataFrame([], "value string").select()


def read_delimited_checked(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, strip_header: bool = True, na_values: tuple[str, ...] = CSV_NA) -> tuple[DataFrame, DataFrame]:
    """The rows of ``read_delimited`` without records of too many cells, and the rejected records.

    Rejected are (file, line, text, reason) of every record with more or fewer cells than its header;
    those with fewer are among the rows, too, their missing cells null. Lines count from 1.
    """
    both = [g.checked() for g in _groups(spark, path, sep, encoding, None, strip_header, True)]
    if not both:
        return spark.createDataFrame([], "value string").select(), spark.createDataFrame([], REJECTED)
    return _blank(_united([rows for rows, _ in both]), na_values), _united([bad for _, bad in both])


def _text(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, at, value) of the lines of files behind their headers, but blank ones; ``at`` orders the lines of a task."""
    lines = spark.read.option("header", True).option("sep", "\x01").option("quote", "").option("ignoreTrailingWhiteSpace", False).schema("value string").csv(files)
    return lines.select(F.col("_metadata.file_path").alias("file"), "value").where(F.length(F.trim("value")) > 0)


def _sample(spark: SparkSession, files: list[str], lines: int = SAMPLE_LINES) -> list:
    return layouts(spark, files, lines).collect()  # a row for each file


class _Fixed:
    """Fixed-width files of one header line."""

    def __init__(self, spark: SparkSession, header: str, files: list[str], starts: list[int], edges: list[tuple[int, int]] | None = None):
        self.spark, self.header, self.files = spark, header, files
        self.lines = _text(spark, files)
        self.starts = [a for a, _ in edges] if edges else self._settled(starts)

    def _settled(self, starts: list[int]) -> list[int]:
        """Column starts after a look at all lines: each gap is cut where fewest lines have text; one that many lines fill is none."""
        ends = [*starts[1:], None]
        heads = [self.header[a:b].rstrip() for a, b in zip(starts, ends)]
        gaps = [(a + len(h), b - a - len(h)) for a, b, h in zip(starts, starts[1:], heads)]
        wanted = sorted({p for a, n in gaps for p in range(a, a + n)})
        if not wanted:
            return starts
        has = lambda p: F.sum(F.when(F.trim(F.substring("value", p + 1, 1)) != "", 1).otherwise(0))
        row = self.lines.agg(F.count(F.lit(1)).alias("n"), *[has(p).alias(f"p{p}") for p in wanted]).first()  # one row
        used = Counter({p: row[f"p{p}"] or 0 for p in wanted})
        cuts = cuts_of(gaps, used)
        return [starts[0], *[c + 1 for c in cuts if used[c] <= stray(row.n)]]

    def edges(self) -> list[tuple[int, int]]:
        """(first character, length) of each column: up to the last place that fitting lines use."""
        bounds = list(zip(self.starts, [*self.starts[1:], None]))
        size = lambda a, b: F.max(F.length(F.rtrim(F.substring("value", a + 1, (b or 1 << 20) - a))))
        row = self.lines.where(self.fits()).agg(*[size(a, b).alias(f"n{i}") for i, (a, b) in enumerate(bounds)]).first()  # one row
        return [(a, max(row[f"n{i}"] or 0, len(self.header[a:b].rstrip()))) for i, (a, b) in enumerate(bounds)]

    def fits(self) -> Column:
        """Whether no text of the line crosses the edge between two columns, or lies before the first."""
        across = [F.trim(F.substring("value", b, 1)) == "" for b in self.starts[1:]]
        before = [F.trim(F.substring("value", 1, self.starts[0])) == ""] if self.starts[0] else []
        return reduce(lambda a, b: a & b, [*across, *before], F.lit(True))

    def rows(self, fitting: bool) -> DataFrame:
        """Lines as cells, each cut at the starts of the columns, so that no text is lost; or only those that fit."""
        names = header_names([self.header[a:b] for a, b in zip(self.starts, [*self.starts[1:], None])])
        cells = [F.substring("value", a + 1, b - a) for a, b in zip(self.starts, self.starts[1:])] + [F.expr(f"substring(value, {self.starts[-1] + 1})")]
        cells[0] = F.concat(F.substring("value", 1, self.starts[0]), cells[0]) if self.starts[0] else cells[0]
        lines = self.lines.where(self.fits()) if fitting else self.lines
        return lines.select(*[F.btrim(c).alias(n) for c, n in zip(cells, names)])

    def rejected(self) -> DataFrame:
        """(file, line, text, reason) of the lines that do not fit; line numbers count all lines of the file."""
        blocks = composed(block_traits(self.spark, self.files, {}).collect())  # a row for each block
        plain = {k: Block(False, b.first_line, b.header) for k, b in blocks.items()}
        lines = records(self.spark, self.files, "\x00", plain, quotes=False).withColumnRenamed("text", "value")
        return lines.where(~self.fits()).select("file", "line", F.col("value").alias("text"), F.lit("text between columns").alias("reason"))


def _by_header(found: list) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in sorted(found, key=lambda r: r.file):
        out.setdefault(r.header, []).append(r)
    return out


def _fixed(spark: SparkSession, found: list, edges: list[tuple[int, int]] | None = None) -> list[_Fixed]:
    # files of one header line have one layout: that of the file in whose first lines most columns were seen
    return [_Fixed(spark, header, [r.file for r in rows], max((list(r.starts) for r in rows), key=len), edges) for header, rows in _by_header(found).items()]


def fixed_width_edges(spark: SparkSession, path: str, lines: int = SAMPLE_LINES) -> list[tuple[int, int]]:
    """(first character, length) of each column of fixed-width files of one header line.

    The first ``lines`` lines of a file show the gaps between columns, all lines where to cut them: a
    place that few lines use (5 in 100, or one) still parts columns.
    """
    groups = _fixed(spark, _sample(spark, [path], lines))
    return groups[0].edges() if groups else []


def read_fixed_width(spark: SparkSession, path: str, edges: list[tuple[int, int]] | None = None, na_values: tuple[str, ...] = CSV_NA) -> DataFrame:
    """Fixed-width text whose files begin with a header line; column edges are inferred unless given.

    Files are read by their own header lines and united by column name. A column reaches to the start of
    the next, the last one to the end of the line; a line with text across an edge is cut there, and
    ``read_fixed_width_checked`` names it. An input without lines gives no columns.
    """
    groups = _fixed(spark, _sample(spark, [path]), edges)
    return _blank(_united([g.rows(False) for g in groups]), na_values) if groups else spark.createDataFrame([], "value string").select()


def read_fixed_width_checked(spark: SparkSession, path: str, edges: list[tuple[int, int]] | None = None, na_values: tuple[str, ...] = CSV_NA) -> tuple[DataFrame, DataFrame]:
    """The lines that fit their columns, and (file, line, text, reason) of those that do not."""
    groups = _fixed(spark, _sample(spark, [path]), edges)
    if not groups:
        return spark.createDataFrame([], "value string").select(), spark.createDataFrame([], REJECTED)
    return _blank(_united([g.rows(True) for g in groups]), na_values), _united([g.rejected() for g in groups])


def _blank_separated(spark: SparkSession, found: list) -> list[DataFrame]:
    out = []
    for header, rows in _by_header(found).items():
        names, parts = header_names(header.split()), F.split(F.btrim(F.regexp_replace("value", r"^\s+|\s+$", "")), r"\s+")
        # what a line has beyond the header's words belongs to the last column
        cells = [F.get(parts, F.lit(i)) for i in range(len(names) - 1)] + [F.nullif(F.array_join(F.slice(parts, len(names), F.greatest(F.size(parts), F.lit(1))), " "), F.lit(""))]
        out.append(_text(spark, [r.file for r in rows]).select(*[c.alias(n) for c, n in zip(cells, names)]))
    return out


def read_blank_separated(spark: SparkSession, path: str, na_values: tuple[str, ...] = CSV_NA) -> DataFrame:
    """Columns parted by runs of white space; files are read by their own header lines and united by column name.

    Words beyond the header's stay in the last column. An input without lines gives no columns.
    """
    parts = _blank_separated(spark, _sample(spark, [path]))
    return _blank(_united(parts), na_values) if parts else spark.createDataFrame([], "value string").select()


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | str | None = None, partition_keys: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Parquet with only the wanted columns and rows; both reach the scan.

    With ``partition_keys`` rows of equal keys are dealt to one partition (of ``partitions``), and what
    follows by these keys needs no exchange of its own. For many comparisons see ``sinks.write_keyed``.
    """
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    df = df.select(*[column(c) for c in columns]) if columns else df
    if not partition_keys:
        return df.repartition(partitions) if partitions else df
    by = [column(k) for k in partition_keys]
    return df.repartition(partitions, *by) if partitions else df.repartition(*by)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``file, length`` of all files below a path; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "length")


def _parquet_by_look(spark: SparkSession, files: list[str]) -> set[str]:
    """Those of ``files`` whose first four bytes say Parquet, looked at by tasks: a row for each file comes back."""
    return {r.file for r in first_lines(spark, files).where(F.startswith(F.col("value"), F.lit(b"PAR1"))).select("file").collect()} if files else set()


def source_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``file, length, is_parquet, partition_columns`` of all files below a path.

    The ending tells the format; the beginnings of files with an unknown ending are looked at by tasks.
    Partition columns come from key=value folders.
    """
    files = _files(spark, path)
    ending = lambda endings: reduce(lambda a, b: a | b, (F.lower("file").endswith(e) for e in endings))
    unknown = [r.file for r in files.where((F.col("length") >= 4) & ~ending(PARQUET_ENDINGS) & ~ending(OTHER_ENDINGS)).select("file").collect()]  # the files to look into
    by_look = spark.createDataFrame([(f,) for f in sorted(_parquet_by_look(spark, unknown))], "known string")
    marked = files.join(by_look, F.col("file") == F.col("known"), "left")
    return marked.select("file", "length", (ending(PARQUET_ENDINGS) | F.col("known").isNotNull()).alias("is_parquet"), F.expr(r"regexp_extract_all(file, '([^/=]+)=[^/]*/', 1)").alias("partition_columns"))


def is_parquet(spark: SparkSession, path: str) -> bool:
    """Whether a path names Parquet: by its ending, by that of a file in it, else by the first bytes of its first file."""
    name = path.rstrip("/").lower()
    if name.endswith(PARQUET_ENDINGS) or name.endswith(OTHER_ENDINGS):
        return name.endswith(PARQUET_ENDINGS)
    files = _files(spark, path).where("length >= 4 and not endswith(file, '/_SUCCESS')")
    first = files.orderBy("file").first()
    if first is None:
        return False
    return first.file.lower().endswith(PARQUET_ENDINGS) or (not first.file.lower().endswith(OTHER_ENDINGS) and bool(_parquet_by_look(spark, [first.file])))


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet path, from the file footers."""
    return spark.read.parquet(path).count()


def read_any(spark: SparkSession, path: str, kind: str | None = None, na_values: tuple[str, ...] = CSV_NA) -> DataFrame:
    """Any supported input: ``parquet``, ``csv``, ``delimited``, ``fixed``, ``blank``, or detected if None.

    A path that ends in ``.csv`` is parted by commas. Other text files are each read by the layout of
    their first lines: delimited if a delimiter is found, else fixed-width if there are columns, else
    parted by blanks; the files of a folder may differ, and are united by column name.
    """
    kind = kind or ("parquet" if is_parquet(spark, path) else "csv" if path.lower().endswith(".csv") else None)
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind == "fixed":
        return read_fixed_width(spark, path, na_values=na_values)
    if kind == "blank":
        return read_blank_separated(spark, path, na_values)
    if kind in ("csv", "delimited"):
        return read_delimited(spark, path, sep="," if kind == "csv" else None, na_values=na_values)
    found = layouts(spark, path).collect()  # a row for each file
    of = lambda name: [r for r in found if r.kind == name]
    parts = [g.rows() for g in _groups(spark, path, None, None, None, True, False, of("delimited"))]
    parts += [g.rows(False) for g in _fixed(spark, of("fixed"))] + _blank_separated(spark, of("blank"))
    return _blank(_united(parts), na_values) if parts else spark.createDataFrame([], "value string").select()
