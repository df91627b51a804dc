"""Texts: identities, gaps, synthetic widths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that lines break at (no-break spaces don't count): fixed value.
GAPS = "\\x{0009}-\\x{000D}\\x{0020}\\x{1680}\\x{2000}-\\x{2006}\\x{2008}-\\x{200A}\\x{2028}\\x{2029}\\x{205F}\\x{3000}"
#: Hyphens that a line may break after: fixed value.
BREAK_HYPHENS = "\\x{002D}\\x{2010}\\x{2012}\\x{2013}\\x{2014}"
#: The synthetic face: units in an em, and a character's advance.
UPM = 2048


def identity_of(content: Column) -> Column:
    """First 12 hex digits of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 12)


def advance(code_point: Column) -> Column:
    return F.lit(512) + F.lit(64) * (code_point % 17)


def width_units(text: Column) -> Column:
    """Width in the synthetic face: a fold over the characters, no row for each."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: acc + advance(F.ascii(c)).cast("long"))


def normalised(text: Column) -> Column:
    """Without NUL, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\x00"), F.lit("")), r"\s+", " "))


def ink_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def extension_of(path: Column) -> Column:
    """Lower case after the last dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def recomputed_page_field(instruction: Column) -> Column:
    return F.upper(F.element_at(F.split(F.trim(instruction), r"\s+"), 1)).isin("PAGE", "NUMPAGES", "SECTIONPAGES", "PAGEREF")


def percent(count: Column, of: Column) -> Column:
    """With one decimal; n/a of nothing."""
    return F.when(of == 0, F.lit("n/a")).otherwise(F.concat(F.format_number(F.floor(count * 1000 / of + 0.5) / 10, 1), F.lit("%")))


def redacted(error: Column) -> Column:
    """An error's text without quoted parts and paths, 200 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(error, r"\"[^\"]*\"|'[^']*'", "''"), r"(?:[A-Za-z]:)?[/\\][^\s]*", "<path>"), 1, 200)
