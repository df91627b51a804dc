"""Ordered computations over siblings: list numbers, spacing, table grids, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_counters(rows: DataFrame, keys: list[str], order: list[str], level: str, levels: int, restart: dict[int, int | None] | None = None) -> DataFrame:
    """count_0 ... count_k: each level's counter as of a row; a shallower row starts deeper levels again.

    restart: levels that start again only after a row of the given level, or never (None).
    """
    by_list = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    restart = restart or {}

    def starts_again(k: int) -> Column:
        if k not in restart:
            return F.col(level) < k
        return F.lit(False) if restart[k] is None else F.col(level) == restart[k]

    groups = {f"__grp_{k}": F.count(F.when(starts_again(k), 1)).over(by_list) for k in range(levels)}
    out = rows.withColumns(groups)
    for k in range(levels):
        w = Window.partitionBy(*keys, f"__grp_{k}").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"count_{k}", F.count(F.when(F.col(level) == k, 1)).over(w))
    return out.drop(*groups)


def collapsed_spacing(rows: DataFrame, keys: list[str], order: list[str], before: str, after: str, style: str | None = None) -> DataFrame:
    """space_before: what remains of it beyond the paragraph above's space after. With style, equal neighbours drop what faces each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    own_before, own_after = F.col(before), F.col(after)
    if style:
        own_before = F.when(F.lag(style).over(w) == F.col(style), 0).otherwise(own_before)
        own_after = F.when(F.lead(style).over(w) == F.col(style), 0).otherwise(own_after)
    out = rows.withColumn("own_before", own_before).withColumn("own_after", own_after)
    return out.withColumn("space_before", F.greatest(F.col("own_before") - F.coalesce(F.lag("own_after").over(w), F.lit(0)), F.lit(0)))


def running_before(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """name: the sum of value over the rows before: grid columns from spans, row tops from heights."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(value).over(w) - F.col(value))


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "run") -> DataFrame:
    """name: the number of the run of equal values that a row is in, from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    begins = F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True))
    return rows.withColumn("__begins", begins.cast("int")).withColumn(name, F.sum("__begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__begins")


def stronger_border(one: Column, other: Column) -> Column:
    """The wider; the first of equal ones; either if the other is null."""
    return F.when(other.isNull() | (one >= other), one).otherwise(other)


def crossings(rows: DataFrame, keys: list[str], order: list[str], value: str, least: float) -> DataFrame:
    """keys, crossings: rows that lie more than least below the highest before them."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("__under", F.max(value).over(w) - F.col(value) > least)
    return marked.groupBy(*keys).agg(F.count_if("__under").alias("crossings"))


def upper_median(value: str) -> Column:
    """sorted[floor(n / 2)]."""
    listed = F.array_sort(F.collect_list(value))
    return F.element_at(listed, (F.floor(F.size(listed) / 2) + 1).cast("int"))
