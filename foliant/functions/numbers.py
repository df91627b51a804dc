"""Numbers as lists spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONES = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
TENS = ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]
HUNDREDS = ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"]


def decimal(n: Column) -> Column:
    return n.cast("string")


def decimal_zero(n: Column) -> Column:
    return F.when((n >= 0) & (n < 10), F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def letters(n: Column) -> Column:
    """a to z, then aa, bb, ...; below 1 decimal."""
    k = n.cast("int")
    return F.when(k < 1, n.cast("string")).otherwise(F.repeat(F.char(F.lit(97) + (k - 1) % 26), F.floor((k - 1) / 26).cast("int") + 1))


def roman(n: Column) -> Column:
    """1 to 3999, else decimal."""
    k = n.cast("int")
    digit = lambda table, by: F.element_at(F.array(*map(F.lit, table)), (F.floor(k / by).cast("int") % 10) + 1)
    spelled = F.concat(F.repeat(F.lit("m"), F.floor(k / 1000).cast("int")), digit(HUNDREDS, 100), digit(TENS, 10), digit(ONES, 1))
    return F.when((k >= 1) & (k <= 3999), spelled).otherwise(n.cast("string"))


def written(n: Column, form: Column) -> Column:
    """A number in a format; none and bullet write nothing; a format that isn't known is null."""
    return (
        F.when(form == "decimal", decimal(n)).when(form == "decimalZero", decimal_zero(n)).when(form == "lowerLetter", letters(n)).when(form == "upperLetter", F.upper(letters(n)))
        .when(form == "lowerRoman", roman(n)).when(form == "upperRoman", F.upper(roman(n))).when(form.isin("none", "bullet"), F.lit(""))
    )


def filled(template: Column, counts: list[Column]) -> Column:
    """%1 to %9 of a level's text."""
    for i, c in enumerate(counts, 1):
        template = F.replace(template, F.lit(f"%{i}"), F.coalesce(c, F.lit("")))
    return template
