"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where text lines end: more places than where byte lines do.
TEXT_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def text_lines(text: Column) -> Column:
    """Lines without their ends; a break at the end opens no further line."""
    got = F.split(text, TEXT_BREAK, -1)
    return F.when(F.element_at(got, -1) == "", F.slice(got, F.lit(1), F.size(got) - 1)).otherwise(got)


def kept_lines(text: Column) -> Column:
    """Text lines with their ends."""
    got = F.split(text, r"(?<=[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)", -1)
    return F.when(F.element_at(got, -1) == "", F.slice(got, F.lit(1), F.size(got) - 1)).otherwise(got)


def byte_lines(text: Column) -> Column:
    """Lines with their ends, which are line feeds, carriage returns or both."""
    got = F.split(text, r"(?<=\n)|(?<=\r)(?!\n)", -1)
    return F.when(F.element_at(got, -1) == "", F.slice(got, F.lit(1), F.size(got) - 1)).otherwise(got)


def _range(lines: Column, start: Column, end: Column) -> Column:
    n = F.greatest(F.lit(0), end - start + 1)
    return F.when((start >= 1) & end.isNotNull(), F.slice(lines, F.greatest(start, F.lit(1)), n))


def excerpt(text: Column, start: Column, end: Column) -> Column:
    """Text lines start to end, from 1, both included, with their ends; null without numbers."""
    return F.array_join(_range(kept_lines(text), start, end), "")


def line_hash(text: Column, start: Column, end: Column) -> Column:
    """SHA-256 of byte lines start to end with their ends."""
    return F.sha2(F.array_join(_range(byte_lines(text), start, end), ""), 256)


def bare_hash(tagged: Column) -> Column:
    return F.regexp_replace(tagged, "^sha256:", "")


def html_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return out


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 of nothing."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(F.lit(100.0) * part / whole + 0.5)).cast("long")


def code(rank: Column, letter: str = "A") -> Column:
    """A letter and at least two digits."""
    n = rank.cast("string")
    return F.concat(F.lit(letter), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n))


def known(text: Column) -> Column:
    """Null where nothing is mapped."""
    return F.nullif(text, F.lit("UNMAPPED"))


def alarming(status: Column) -> Column:
    return F.coalesce(status, F.lit("None")).contains("FALSE") | F.coalesce(status, F.lit("None")).contains("BLOCK")


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= tolerance


def close_arrays(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda x: F.coalesce(x, F.lit(False)))


def placeholders(text: Column) -> Column:
    """Whether a proof leaves something out."""
    return text.rlike(r"(?m)^\s*(?:sorry|admit|axiom)\b|:=\s*(?:sorry|by\s+sorry)\b")


def audited_axioms(line: Column) -> Column:
    """Names between the brackets of an audit line, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.regexp_extract(line, r"depends on axioms: \[([^]]*)\]", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
