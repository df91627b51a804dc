"""Cascades: values stated along a chain of styles, the nearest of which counts.

A property is three-valued: a null struct is unstated; a struct whose value is null is stated as none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.storage import cut


def stated(value: Column) -> Column:
    """A value that is stated, null included."""
    return F.struct(value.alias("value"))


def merged(base: Column, over: Column) -> Column:
    return F.coalesce(over, base)


def style_chain(styles: DataFrame, keys: list[str], style: str, based_on: str, properties: list[str], depth: int = 1024) -> DataFrame:
    """styles with each property as the nearest style on its chain states it.

    Pointers double: each round every style takes what its pointer's style has gathered and points where that one does,
    so a chain of n styles takes log2(n) joins. A missing style ends a chain; so do depth styles, which ends cycles.
    Each round is written to reliable storage, so the plan of the next one reads it twice whatever the depth.
    """
    out = styles.select(*keys, style, F.col(based_on).alias("__up"), *properties)
    for _ in range(max(1, depth - 1).bit_length()):
        above = out.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(style).alias("__style"), F.col("__up").alias("__next"), *(F.col(p).alias(f"__{p}") for p in properties))
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__up") == F.col("__style")])
        out = out.join(above, on, "left").select(*keys, style, F.col("__next").alias("__up"), *(merged(F.col(f"__{p}"), F.col(p)).alias(p) for p in properties))
        out = cut(out)
        if not out.where(F.col("__up").isNotNull()).limit(1).count():
            break
    return out.drop("__up")


def cascade(rows: DataFrame, keys: list[str], rank: str, properties: list[str]) -> DataFrame:
    """For each key the last stated value of each property in order of rank."""
    last = [F.max_by(p, F.when(F.col(p).isNotNull(), F.col(rank))).alias(p) for p in properties]
    return rows.groupBy(*keys).agg(*last)


def forward_filled(rows: DataFrame, keys: list[str], order: list[str], properties: list[str]) -> DataFrame:
    """Each property as it or the nearest row before it states it, as sections inherit headers."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({p: F.last_value(p, ignoreNulls=True).over(w) for p in properties})


#: Conditional formats of tables, weakest first: fixed value.
CONDITIONAL = ["wholeTable", "band1Horz", "band2Horz", "band1Vert", "band2Vert", "firstCol", "lastCol", "firstRow", "lastRow", "nwCell", "neCell", "swCell", "seCell"]


def conditional_formats(row: Column, col: Column, rows: Column, cols: Column, row_band: int = 1, col_band: int = 1) -> Column:
    """Those that reach a cell (row and col from 0), weakest first. Bands count after the first row and column."""
    first_row, last_row, first_col, last_col = row == 0, row == rows - 1, col == 0, col == cols - 1
    band = lambda at, size: F.floor((at - 1) / size) % 2
    reach = {
        "wholeTable": F.lit(True), "band1Horz": ~first_row & (band(row, row_band) == 0), "band2Horz": ~first_row & (band(row, row_band) == 1),
        "band1Vert": ~first_col & (band(col, col_band) == 0), "band2Vert": ~first_col & (band(col, col_band) == 1), "firstCol": first_col, "lastCol": last_col, "firstRow": first_row, "lastRow": last_row,
        "nwCell": first_row & first_col, "neCell": first_row & last_col, "swCell": last_row & first_col, "seCell": last_row & last_col,
    }
    return F.array_compact(F.array(*(F.when(reach[n], F.lit(n)) for n in CONDITIONAL)))


def settled_stops(entries: DataFrame, keys: list[str], order: str, position: str, kind: str) -> DataFrame:
    """keys, stops: positions in ascending order whose last entry isn't "clear"."""
    last = entries.groupBy(*keys, position).agg(F.max_by(kind, order).alias("__kind"))
    stops = F.sort_array(F.collect_list(F.when(F.col("__kind") != "clear", F.col(position))))
    return last.groupBy(*keys).agg(stops.alias("stops"))
