"""Records of delimited text whose quoted cells may hold line breaks, cut by many tasks.

A line that begins outside quotes begins a record; whether a line does depends on all quotes before it.
So one pass over the lines finds, for each block of a file, in which state it ends if it begins outside
and if it begins inside quotes; the states at the beginnings of all blocks follow by applying one after
the other, a row for each block (as many as the scan has tasks). A second pass cuts each block into
records, knowing its first state. Only what reaches over a block's edge is put together afterwards.

Quotes follow the CSV rules that the reader has: a cell is quoted if it begins with a quote (after blanks,
if those are skipped); a doubled quote in it is text; after the closing quote the cell reaches to the next
separator. Quotes inside other cells are text. An unclosed quote makes one record of all that follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that cp1252 does not define.
UNDEFINED = re.compile(b"[\x81\x8d\x8f\x90\x9d]")
QUOTE = b'"'
_BLOCK = "file string, block long, lines long, first long, outside boolean, inside boolean, broken boolean, utf8 boolean, cp1252 boolean"
RECORD = "file string, block long, line long, part string, text string"


def ends_inside(line: bytes, inside: bool, sep: bytes, skip_blanks: bool = False) -> bool:
    """Whether a quoted cell is open at the end of the line, which begins inside one or with a new record."""
    at = 0
    while True:
        if not inside:
            while skip_blanks and line[at : at + 1] in (b" ", b"\t") and line[at : at + 1] != sep:
                at += 1
            if line[at : at + 1] == QUOTE:
                at += 1
                inside = True
        while inside:
            at = line.find(QUOTE, at) + 1
            if not at:
                return True
            if line[at : at + 1] == QUOTE:
                at += 1
            else:
                inside = False
        at = line.find(sep, at) + 1
        if not at:
            return False


@dataclass(frozen=True)
class Block:
    """What is known of a block of a file before it is cut."""

    inside: bool
    first_line: int  # lines of the file before the block
    header: int  # the file's first line that is not blank, from 1


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, value) of all lines in the order of each block; only line feeds end a line."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, block, lines) of each run of rows of one block."""
    files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    begin = 0
    for k in range(1, len(files) + 1):
        if k == len(files) or files[k] != files[begin] or blocks[k] != blocks[begin]:
            yield files[begin], blocks[begin], batch.column(2).slice(begin, k - begin)
            begin = k


def _joined(lines: pa.Array) -> tuple[bytes, np.ndarray]:
    """The lines with their line feeds, and where each begins (and the last ends)."""
    sizes = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return b"\n".join(lines.to_pylist()) + b"\n", np.concatenate([[0], np.cumsum(sizes)])


_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 13]] = True


def states(data: bytes, at: np.ndarray, inside: bool, sep: bytes, skip_blanks: bool = False) -> np.ndarray:
    """Whether a quoted cell is open at the end of each line.

    Where each quote that opens stands at the beginning of a cell (or doubles the one before it) and each
    that closes at the end of one, the quotes up to a line's end tell by their number. Otherwise lines are
    looked at one by one.
    """
    codes = np.frombuffer(data, dtype=np.uint8)
    quotes = np.flatnonzero(codes == QUOTE[0])
    if not len(quotes):
        return np.full(len(at) - 1, inside)
    edge = _BREAK.copy()
    edge[[sep[0], QUOTE[0]]] = True
    opens, closes = quotes[int(inside) :: 2], quotes[1 - int(inside) :: 2]
    before = codes[np.maximum(opens - 1, 0)]
    if (edge[before] | (opens == 0)).all() and edge[codes[closes + 1]].all():  # the last byte is a line feed
        return (np.searchsorted(quotes, at[1:]) + int(inside)) % 2 == 1
    out = np.full(len(at) - 1, inside)
    marked = np.unique(np.searchsorted(at, quotes, side="right") - 1)
    for k, line in enumerate(marked):
        inside = ends_inside(data[at[line] : at[line + 1]].rstrip(b"\r\n"), inside, sep, skip_blanks)
        out[line : marked[k + 1] if k + 1 < len(marked) else None] = inside
    return out


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def block_traits(spark: SparkSession, path: str | list[str], seps: dict[str, str], skip_blanks: bool = False) -> DataFrame:
    """A row for each block: its lines, the states it ends in, whether a line ends inside quotes, and what decodes it.

    ``seps`` gives the separator of each file (default: a comma).
    """
    known = {f: s.encode() for f, s in seps.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for file, block, lines in _runs(batch):
                if (file, block) != now:
                    rows.append([file, block, 0, -1, False, True, False, True, True])
                    now, sep = (file, block), known.get(file, b",")
                row = rows[-1]
                data, at = _joined(lines)
                if row[3] < 0:
                    row[3] = next((row[2] + k for k, v in enumerate(lines) if v.as_py().strip()), -1)
                row[2] += len(lines)
                # from where both states lead to the same one, they are one
                begin, out, into = 0, row[4], row[5]
                while out != into and begin < len(lines):
                    quote = data.find(QUOTE, at[begin])
                    if quote < 0:
                        begin = len(lines)
                        row[6] = row[6] or out
                        break
                    line = int(np.searchsorted(at, quote, side="right")) - 1
                    row[6] = row[6] or (out and line > begin)
                    text = data[at[line] : at[line + 1]].rstrip(b"\r\n")
                    out, into = ends_inside(text, out, sep, skip_blanks), ends_inside(text, into, sep, skip_blanks)
                    row[6] = row[6] or out
                    begin = line + 1
                if begin < len(lines):
                    found = states(data[at[begin] :], at[begin:] - at[begin], out, sep, skip_blanks)
                    row[6] = row[6] or bool(found.any())
                    out = into = bool(found[-1])
                row[4], row[5] = out, into
                if not data.isascii():
                    row[7] = row[7] and _is_utf8(data)
                    row[8] = row[8] and not UNDEFINED.search(data)
        if rows:
            kinds = [pa.string(), *[pa.int64()] * 3, *[pa.bool_()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _BLOCK.split(", ")])

    return _lines(spark, path).mapInArrow(run, _BLOCK)


def composed(rows: list) -> dict[tuple[str, int], Block]:
    """What is known at the beginning of each block, by applying the blocks of a file one after the other."""
    out: dict[tuple[str, int], Block] = {}
    file, inside, lines, header = None, False, 0, 0
    for r in sorted(rows, key=lambda r: (r.file, r.block)):
        if r.file != file:
            file, inside, lines, header = r.file, False, 0, 0
        header = header or (lines + r.first + 1 if r.first >= 0 else 0)
        out[r.file, r.block] = Block(inside, lines, header)
        inside, lines = (r.inside if inside else r.outside), lines + r.lines
    return out


def records(spark: SparkSession, path: str | list[str], sep: str, blocks: dict[tuple[str, int], Block], encoding: str = "utf-8", skip_blanks: bool = False, quotes: bool = True) -> DataFrame:
    """``file``, ``line`` (of its beginning, from 1) and ``text`` of every record behind the header but empty ones.

    Without ``quotes`` every line is a record.
    """
    mark = sep.encode()
    kinds = np.array(["whole", "head", "tail", "middle"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, inside, number, rest, begun, began_inside = None, None, False, 0, b"", 0, False

        def made(data: bytes, stops: np.ndarray, numbers: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
            """Records that are neighbours in ``data``; their texts are views of it where it is UTF-8."""
            first = (numbers + 1 == known.header) & ((parts == 0) | (parts == 2))  # the header record goes
            chosen = np.flatnonzero(~first | (parts != 0))
            numbers = np.where(first, -1, numbers + 1)
            offsets = np.concatenate([[0], stops]).astype(np.int32)
            if encoding == "utf-8" and _is_utf8(data):
                texts = pa.Array.from_buffers(pa.string(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            else:
                texts = pa.array([data[i:j].decode(encoding, "replace") for i, j in zip(offsets[:-1], offsets[1:])], pa.string())
            columns = [pa.repeat(now[0], len(numbers)), pa.repeat(pa.scalar(now[1], pa.int64()), len(numbers)), pa.array(numbers), pa.array(kinds[parts], pa.string()), texts]
            batch = pa.RecordBatch.from_arrays(columns, names=["file", "block", "line", "part", "text"])
            return batch if len(chosen) == len(numbers) else batch.take(pa.array(chosen))

        def closing() -> Iterator[pa.RecordBatch]:
            """What is open at the end of a block."""
            if rest:
                yield made(rest, np.array([len(rest)]), np.array([begun]), np.array([3 if began_inside else 2]))

        for batch in batches:
            for file, block, lines in _runs(batch):
                if (file, block) != now:
                    yield from closing()
                    now, known, rest = (file, block), blocks[file, block], b""
                    inside, number = known.inside, known.first_line
                    begun, began_inside = number, inside
                data, at = _joined(lines)
                ends = np.flatnonzero(~states(data, at, inside, mark, skip_blanks)) if quotes else np.arange(len(lines))
                if len(ends):
                    stops = at[ends + 1] + len(rest)
                    data = rest + data
                    numbers = number + np.concatenate([[0], ends[:-1] + 1])
                    numbers[0] = begun
                    parts = np.zeros(len(ends), np.int64)
                    parts[0] = int(began_inside)
                    yield made(data[: stops[-1]], stops, numbers, parts)
                    rest, began_inside = data[stops[-1] :], False
                    begun = number + int(ends[-1]) + 1
                else:
                    rest += data
                number += len(lines)
                inside = len(rest) > 0 and quotes
        yield from closing()

    found = _lines(spark, path).mapInArrow(run, RECORD)
    text = F.regexp_replace("text", r"\r?\n$", "")
    whole = found.where("part = 'whole'").select("file", "line", text.alias("text"))
    if not any(b.inside for b in blocks.values()):
        whole = whole.unionByName(found.where("part <> 'whole' and line > 0").select("file", "line", text.alias("text")))  # an unclosed quote at the end of a file
        return whole.where(F.btrim("text", F.lit(" \t\r\n\x0b\x0c")) != "")
    # at most two fragments of each block; those of a record are as large as the record
    tail = (F.col("part") == "tail").cast("int")
    begins = F.sum(tail).over(Window.partitionBy("file").orderBy("block", tail))
    parts = found.where("part <> 'whole'").withColumn("record", begins)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda s: s["text"]), "")
    across = parts.groupBy("file", "record").agg(F.min("line").alias("line"), joined.alias("text")).where("line > 0").select("file", "line", text.alias("text"))
    return whole.unionByName(across).where(F.btrim("text", F.lit(" \t\r\n\x0b\x0c")) != "")
