"""Canonical text of columns and the cell comparison built on it. All expressions stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NBSP = " "
#: Cell texts that a CSV reader takes for blank.
CSV_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str, parent: str | None = None) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col(f"{parent}.{quoted(name)}" if parent else quoted(name))


def strip(c: Column) -> Column:
    """No-break space becomes space; Unicode white space goes at both ends."""
    return F.regexp_replace(F.translate(c, NBSP, " "), r"(?U)^\s+|\s+$", "")


def plain_number(c: Column) -> Column:
    """The shortest decimal text of a double or float without exponent and closing zeros: ``1E7`` is ``10000000``, ``-0.0`` is ``0``.

    All digits that tell the value from its neighbours are kept. NaN and infinities stay words. A float's
    text may be shorter than that of the equal double, as its neighbours are farther: ``1048594.2`` of 1048594.25.
    """
    said = c.cast("string")

    def spread(p: Column) -> Column:  # digit, fraction, exponent
        fraction = F.when(p[1] == "0", "").otherwise(p[1])
        digits, point = F.concat(F.ltrim(p[0], F.lit("-")), fraction), p[2].cast("int") + 1
        zeros = lambda n: F.repeat(F.lit("0"), n)
        small = F.concat(F.lit("0."), zeros(-point), digits)
        large = F.concat(F.substring(digits, F.lit(1), point), zeros(point - F.length(digits)))
        rest = F.substring(digits, point + 1, F.length(digits))
        whole = F.when(F.length(digits) > point, F.concat(large, F.lit("."), rest)).otherwise(large)
        return F.concat(F.when(F.startswith(p[0], F.lit("-")), "-").otherwise(""), F.when(point <= 0, small).otherwise(whole))

    plain = F.regexp_replace(F.regexp_replace(said, r"\.0$", ""), "^-0$", "0")
    return F.when(F.contains(said, F.lit("E")), F.transform(F.array(F.split(said, "[.E]")), spread)[0]).otherwise(plain)


def _ordered(c: Column, kind: T.DataType) -> Column:
    """A nested value with the entries of its maps in the order of their keys."""
    if isinstance(kind, T.MapType):
        by_key = F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        out = F.map_from_entries(by_key)
        return F.transform_values(out, lambda _, v: _ordered(v, kind.valueType)) if _has_map(kind.valueType) else out
    if not _has_map(kind):
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _ordered(x, kind.elementType))
    return F.when(c.isNotNull(), F.struct(*[_ordered(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields))


def as_text(c: Column, kind: T.DataType, scale: int | None = None, na_values: tuple[str, ...] = ()) -> Column:
    """Canonical text of a column of any type; null becomes the empty string.

    Doubles and floats keep all their digits unless a ``scale`` is given, to which they are rounded.
    Maps are written in the order of their keys.
    """
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        text = F.when(~c.isin(*na_values), c) if na_values else c
        text = strip(text)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = plain_number(c) if scale is None else F.coalesce(c.try_cast(T.DecimalType(38, scale)).cast("string"), plain_number(c))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        text = F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(_ordered(c, kind))
    elif isinstance(kind, T.BinaryType):
        text = F.lower(F.hex(c))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def canonical(df: DataFrame, ignore: list[str] | tuple[str, ...] = (), scales: dict[str, int] | None = None, na_values: tuple[str, ...] = ()) -> DataFrame:
    """All columns but the ignored ones as canonical text, in one projection."""
    scales = scales or {}
    return df.select(*[as_text(column(f.name), f.dataType, scales.get(f.name), na_values).alias(f.name) for f in df.schema.fields if f.name not in set(ignore)])


def rounded(c: Column, decimals: int) -> Column:
    """Text of the number rounded half up to ``decimals`` places; other texts are only trimmed.

    Commas are dropped before parsing. Texts that are no decimal of at most 20 whole digits stay text;
    digits after the 18th place do not count.
    """
    trimmed = strip(c)
    number = F.replace(trimmed, F.lit(","), F.lit("")).try_cast(T.DecimalType(38, 18))
    return F.coalesce(F.round(number, decimals).cast("string"), trimmed)


def apart_by_case(*tables: DataFrame) -> dict[str, str]:
    """New names for columns that some table has in several spellings which differ in case only.

    The first spelling of such a name (in binary order) stays; the others get ``~1``, ``~2`` and so on,
    the same in all tables, whatever the order of their columns.
    """
    out: dict[str, str] = {}
    for lower in sorted({c.lower() for df in tables for c in df.columns}):
        spelt = [{c for c in df.columns if c.lower() == lower} for df in tables]
        if any(len(some) > 1 for some in spelt):
            out |= {c: f"{c}~{k}" for k, c in enumerate(sorted(set().union(*spelt))) if k}
    return out


def differs(prod: Column, dev: Column, decimals: int | None = None) -> Column:
    """True where two canonical cells differ, after rounding if decimals are given."""
    return rounded(prod, decimals) != rounded(dev, decimals) if decimals is not None else prod != dev


def parsed(c: Column) -> Column:
    """The cell as a double, null where it is not a number."""
    trimmed = strip(c)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def label(failed: Column) -> Column:
    return F.when(failed, "Fail").otherwise("Pass")


def percent(part: Column, whole: Column) -> Column:
    """Percentage with four decimals, 0 for an empty whole."""
    return F.coalesce(F.round(part / F.nullif(whole, F.lit(0)) * 100, 4), F.lit(0.0)).cast("double")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def clean_name(name: Column) -> Column:
    """A name safe for file systems: reserved characters become underscores; an empty one gets a default."""
    # fixed values: the reserved characters and the default
    safe = F.btrim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(". "))
    return F.when(safe == "", F.lit("CompareRecords")).otherwise(safe)
