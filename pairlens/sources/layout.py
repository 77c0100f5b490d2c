"""What a text file looks like, from its first lines: delimited, fixed-width or parted by blanks.

One task looks at the beginning of each file and stops, so what is read of a file does not grow with it
beyond one scan partition; a row for each file comes back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import ends_inside

#: Delimiters that are looked for, in this order.
DELIMITERS = ("|", ",", "\t", ";", "~", "^")
SAMPLE_LINES = 100
BOM = "﻿"
STRAY_SHARE, STRAY_LINES = 0.05, 5  # lines that may cross a column edge: this share, or one of so many
LAYOUT = "file string, kind string, delimiter string, header string, starts array<int>, encoding string"


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file``, ``size`` and ``value`` (bytes) of the non-empty lines of each file, read from its beginning by one task."""
    reader = spark.read.schema("value string").option("multiLine", True).option("sep", "\x01").option("quote", "").option("encoding", "ISO-8859-1")
    return reader.csv(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.encode("value", "ISO-8859-1").alias("value"))


def first_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file`` and ``value``, the bytes up to the first line end, of each file; of a large file no more is read."""
    alone = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            rows = []
            for file, size, value in zip(*(c.to_pylist() for c in batch.columns)):
                if file not in seen:
                    seen.add(file)
                    rows.append((file, value))
                elif size >= alone:
                    break
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["file", "value"])
            if size >= alone:
                return

    return raw_lines(spark, files).mapInArrow(run, "file string, value binary")


def text_of(line: bytes) -> str:
    """A line of unknown encoding as text, for looking at it."""
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin1")


def delimiter_of(lines: list[str]) -> str | None:
    """The delimiter that each line holds equally often: of several the most frequent, then the first in the list.

    Without any, the most frequent on the first line; None if it holds none.
    """
    counts = {d: [x.count(d) for x in lines] for d in DELIMITERS}
    even = {d: n[0] for d, n in counts.items() if len(set(n)) == 1}
    for found in (even, {d: n[0] for d, n in counts.items()}):
        best = max(found, key=lambda d: found[d], default=None)
        if best is not None and found[best]:
            return best
    return None


def stray(lines: int) -> int:
    """How many of ``lines`` may hold text in a place that still counts as blank."""
    return max(int(lines * STRAY_SHARE), int(lines >= STRAY_LINES))


def gaps_of(used: Counter, width: int, lines: int) -> list[tuple[int, int]]:
    """(first place, length) of runs of places, between the first and the last column, that are blank but for stray lines."""
    most, out = stray(lines), []
    blank = [p for p in range(width) if used[p] <= most]
    for p in blank:
        if out and p == sum(out[-1]):
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((p, 1))
    return [(a, n) for a, n in out if a and a + n < width]


def cuts_of(gaps: list[tuple[int, int]], used: Counter) -> list[int]:
    """For each gap the place that fewest lines use, of several the last; the next column begins behind it."""
    return [min(range(a, a + n), key=lambda p: (used[p], -p)) for a, n in gaps]


def places(lines: list[str]) -> Counter:
    """How many lines hold text in each place."""
    used: Counter = Counter()
    for line in lines:
        used.update(p for p, c in enumerate(line) if not c.isspace())
    return used


def starts_of(lines: list[str]) -> list[int]:
    """Places where fixed-width columns begin, judged by these lines."""
    used = places(lines)
    if not used:
        return []
    most = stray(len(lines))
    width = max(p for p in used if used[p] > most or used[p] == max(used.values())) + 1
    header = places(lines[:1])
    gaps = gaps_of(used + Counter({p: len(lines) for p in header}), width, len(lines))  # where the header has text is no gap
    return [min(header or used), *[p + 1 for p in cuts_of(gaps, used)]]


def kind_of(lines: list[str], delimiter: str | None, starts: list[int]) -> str:
    """Delimited if a delimiter was found, else fixed-width if there are columns, else parted by blanks if each line has as many words as the header."""
    if delimiter is not None:
        return "delimited"
    words = [len(x.split()) for x in lines]
    even = words and words[0] > 1 and len(set(words)) == 1
    if len(starts) > 1 and (len(starts) == words[0] or not even):
        return "fixed"
    return "blank" if even else "delimited"


def layouts(spark: SparkSession, path: str | list[str], lines: int = SAMPLE_LINES) -> DataFrame:
    """``file, kind, delimiter, header, starts, encoding`` of every text file, judged by its first non-empty lines.

    ``encoding`` is utf-8 if those lines are, else cp1252; ``encodings`` judges whole files.
    """
    alone = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()

    def row(file: str, head: list[bytes]) -> tuple:
        texts = [text_of(x).rstrip("\r") for x in head]
        texts[0] = texts[0].lstrip(BOM)
        delimiter, starts = delimiter_of(texts), starts_of(texts)
        try:
            b"\n".join(head).decode("utf-8")
            encoding = "utf-8"
        except UnicodeDecodeError:
            encoding = "cp1252"
        header, more = texts[0], iter(texts[1:])
        while delimiter and ends_inside(header.encode(), False, delimiter.encode()) and (line := next(more, None)) is not None:
            header += "\n" + line  # a column name that holds a line break
        return file, kind_of(texts, delimiter, starts), delimiter, header, starts, encoding

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, []
        ready = lambda: [row(now, head)] if head else []
        rows, done = [], False
        for batch in batches:
            for file, size, value in zip(*(c.to_pylist() for c in batch.columns)):
                if file != now:
                    rows += ready()
                    now, head = file, []
                if len(head) < lines and value and value.strip():
                    head.append(value)
                elif len(head) == lines and size >= alone:  # such a file has its task to itself: the rest is not read
                    done = True
                    break
            if done:
                break
        rows += ready()
        if rows:
            names = ["file", "kind", "delimiter", "header", "starts", "encoding"]
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return raw_lines(spark, path).mapInArrow(run, LAYOUT)
