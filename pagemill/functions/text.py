"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import constants as C


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def is_blank(x: Column) -> Column:
    return strip(x) == ""


def split_lines(text: Column) -> Column:
    """Lines without their ends; a last empty piece is dropped."""
    parts = F.split(text, C.LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def capture(x: Column, pattern: str, group: int = 1) -> Column:
    """The group, or null where the pattern isn't found."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def heading_level(line: Column, typographic: Column | None = None) -> Column:
    """Level of a heading line or null: typographic, named (1), or by the dots of its number (6 at most)."""
    numbered = F.least(F.lit(6), F.regexp_count(F.substring_index(strip(F.regexp_replace(line, r"(?U)\s+", " ")), " ", 1), F.lit(r"\.")) + 1)
    level = F.when(F.lower(line).isin(*C.NAMED_HEADINGS), F.lit(1)).when(line.rlike(C.NUMBERED_HEADING), numbered)
    return (level if typographic is None else F.coalesce(typographic, level)).cast("int")


def bullet_text(line: Column) -> Column:
    return capture(line, C.BULLET_ITEM)


def ordered_text(line: Column) -> Column:
    return capture(line, C.ORDERED_ITEM)


def line_endings(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, which has no built-in function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def needs_nfc(text: Column) -> Column:
    """Whether composition could change the text: ASCII and Latin-1 text never does."""
    return text.rlike("[^\\x00-ÿ]")


def display_formula(text: Column) -> Column:
    """LaTeX of `f(x) = sum_i a * b / n`, or null."""
    t = strip(text)
    product = strip(F.regexp_replace(F.regexp_replace(F.regexp_extract(t, C.SUM_FRACTION, 3), r"\*", " "), r"(?U)\s+", " "))
    latex = F.concat(F.regexp_extract(t, C.SUM_FRACTION, 1), F.lit(" = \\frac{\\sum_"), F.regexp_extract(t, C.SUM_FRACTION, 2), F.lit(" "), product, F.lit("}{"), F.regexp_extract(t, C.SUM_FRACTION, 4), F.lit("}"))
    return F.when(t.rlike(C.SUM_FRACTION), latex)


def is_formula_candidate(text: Column) -> Column:
    t = strip(text)
    return (F.length(t) <= 160) & t.rlike(C.FORMULA_CANDIDATE)


def normalize_cell(cell: Column) -> Column:
    """Lines with single spaces, empty ones dropped, joined by <br>."""
    lines = F.transform(split_lines(cell), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "<br>")


def escape_label(label: Column) -> Column:
    return F.regexp_replace(label, r"([\\\[\]])", r"\\$1")


def page_marker(page: Column) -> Column:
    return F.concat(F.lit(f"<!-- {C.NAMESPACE}:page="), page.cast("string"), F.lit(" -->"))


def table_markdown(headers: Column, rows: Column) -> Column:
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = line(F.transform(headers, lambda _: F.lit("---")))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")


def duration_text(ms: Column) -> Column:
    """`h min s,mmm` without leading zero units; null of null."""
    h, m, s, rest = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    seconds = F.format_string("%d,%03d s", s, rest.cast("long"))
    return F.when(h > 0, F.concat(F.format_string("%d h %d min ", h, m), seconds)).when(m > 0, F.concat(F.format_string("%d min ", m), seconds)).when(ms.isNotNull(), seconds)


def redact(text: Column) -> Column:
    """White space collapsed, tokens and file ids hidden, 500 characters at most."""
    t = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    t = F.regexp_replace(t, r"(?i)bearer\s+\S+", "Bearer [redacted]")
    t = F.regexp_replace(t, r"\b(?:sk|file|resp)[-_][A-Za-z0-9_-]+", "[redacted]")
    return F.left(t, F.lit(500))


def occurrences(text: Column, needle: Column) -> Column:
    """How often the text holds the needle, overlaps left out; 0 for an empty needle. No pattern, so any needle will do."""
    n = F.length(needle)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / n).cast("int")).otherwise(0)
