"""Scalar functions of schema changes: lenient casts, type equivalence, names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: names of one type.
SYNONYMS = (frozenset({"numeric", "decimal"}), frozenset({"int", "integer"}), frozenset({"float", "real"}))


def lenient(value: str, kind: str) -> str:
    """SQL text: the leading number of a text as ``kind``, 0 where there is none; null stays null."""
    number = r"^\\s*([+-]?\\d+)" if kind in ("int", "bigint", "smallint") else r"^\\s*([+-]?\\d+(?:\\.\\d*)?)"
    found = f"regexp_extract(CAST({value} AS STRING), '{number}', 1)"
    return f"CASE WHEN {value} IS NOT NULL THEN coalesce(try_cast(nullif({found}, '') AS {kind}), CAST(0 AS {kind})) END"


_CHARS = re.compile(r"\b(var)?char\s*\(\s*(\d+)\s*\)", re.I)


def plain_type(kind: str) -> str:
    """A type that values can have: char and varchar are declarations of columns."""
    return _CHARS.sub("string", kind)


def stored_as(value: Column, kind: str) -> Column:
    """``value`` as a column of that type holds it: char is filled up with spaces."""
    out, fixed = value.cast(plain_type(kind)), _CHARS.fullmatch(kind.strip())
    if not fixed or fixed[1]:
        return out
    return F.when(F.length(out) < int(fixed[2]), F.rpad(out, int(fixed[2]), " ")).otherwise(out)


def type_name(kind: Column) -> Column:
    """First word of a type text, lower case, synonyms made one."""
    name = F.lower(F.regexp_extract(kind, r"^\s*([\w\-]+)", 1))
    for names in SYNONYMS:
        name = F.when(name.isin(*names), min(names)).otherwise(name)
    return name


def type_arguments(kind: Column) -> Column:
    """The numbers in a type's parentheses, named ones (scale=5) left out."""
    inside = F.regexp_extract(kind, r"\((.*)\)", 1)
    parts = F.transform(F.split(inside, ","), lambda x: F.lower(F.trim(x)))
    return F.filter(parts, lambda x: (x != "") & ~x.contains("="))


def types_differ(actual: Column, desired: Column) -> Column:
    """Other name; or other arguments, where both have equally many (DECIMAL(10) and DECIMAL(10,5) are alike)."""
    a, b = type_arguments(actual), type_arguments(desired)
    return (type_name(actual) != type_name(desired)) | ((F.size(a) == F.size(b)) & (a != b))


def plain_default(default: Column) -> Column:
    """A default's text without outer blanks, one pair of parentheses, and quotes; for comparison."""
    bare = F.regexp_replace(F.trim(default), r"^\((.*)\)$", "$1")
    return F.regexp_replace(bare, r"^'(.*)'$", "$1")


def slug(text: Column, length: int = 40) -> Column:
    """Words joined by ``_``, lower case, cut after a whole word at about ``length``."""
    joined = F.lower(F.array_join(F.regexp_extract_all(text, F.lit(r"(\w+)"), 1), "_"))
    cut = F.regexp_replace(F.substring(joined, 1, length), r"_[^_]*$", "")
    return F.when(F.length(joined) > length, cut).otherwise(joined)


def revision_id(*key: Column) -> Column:
    """Twelve hexadecimal digits that depend on the key alone, so that a plan run again gives the same ids; without a key random ones."""
    whole = F.sha2(F.concat_ws("\x1f", *(F.coalesce(k.cast("string"), F.lit("\x1e")) for k in key)), 256) if key else F.replace(F.expr("uuid()"), F.lit("-"))
    return F.right(whole, F.lit(12))


def stamp_parts(moment: Column, zone: str = "UTC") -> dict[str, Column]:
    """epoch, year, month, day, hour, minute and second of a timestamp without zone that is UTC, as seen in ``zone``."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), moment)
    parts = {n: getattr(F, n)(local) for n in ("year", "month", "day", "hour", "minute", "second")}
    return {"epoch": F.unix_seconds(moment.cast("timestamp")), **parts}


def file_name(rev: Column, text: Column, moment: Column, zone: str = "UTC", length: int = 40) -> Column:
    """yyyy_mm_dd_hhmm-rev_slug."""
    p = stamp_parts(moment, zone)
    two = lambda n: F.lpad(p[n].cast("string"), 2, "0")
    day = F.concat_ws("_", F.lpad(p["year"].cast("string"), 4, "0"), two("month"), two("day"), F.concat(two("hour"), two("minute")))
    return F.concat(day, F.lit("-"), rev, F.lit("_"), slug(text, length))


_BAD_ID = re.compile(r"[@+:\-]")


def check_revision_id(rev: str) -> str:
    if _BAD_ID.search(rev):
        raise ValueError(f"characters @ + - : are not allowed in revision ids: {rev}")
    return rev
