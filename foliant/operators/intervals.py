"""Intervals: what bands leave free of an extent, and which lines overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def free_spans(bands: DataFrame, keys: list[str], left: str, right: str, extent_left: float, extent_right: float) -> DataFrame:
    """keys, span_left, span_right: the gaps in the extent that no band covers. One shuffle, a running maximum."""
    own = bands.select(*keys, F.greatest(F.col(left), F.lit(extent_left)).alias("l"), F.least(F.col(right), F.lit(extent_right)).alias("r")).where("l < r")
    w = Window.partitionBy(*keys).orderBy("l", "r")
    reached = F.coalesce(F.max("r").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(extent_left))
    gaps = own.withColumn("reached", reached).where(F.col("l") > F.col("reached")).select(*keys, F.col("reached").alias("span_left"), F.col("l").alias("span_right"))
    ends = own.groupBy(*keys).agg(F.max("r").alias("span_left")).where(F.col("span_left") < extent_right).select(*keys, "span_left", F.lit(extent_right).alias("span_right"))
    return gaps.unionByName(ends)


def overlaps(rows: DataFrame, keys: list[str], number: str, start: str, end: str) -> DataFrame:
    """Pairs (a, b) of a key's intervals that overlap, a before b by number; shared: how far."""
    a = rows.select(*keys, F.col(number).alias("a"), F.col(start).alias("__start"), F.col(end).alias("__end"))
    b = rows.select(*keys, F.col(number).alias("b"), F.col(start).alias("__start_b"), F.col(end).alias("__end_b"))
    on = [F.col("a") < F.col("b"), F.col("__start") < F.col("__end_b"), F.col("__start_b") < F.col("__end")]
    out = a.join(b.select(*(F.col(k).alias(f"__{k}") for k in keys), "b", "__start_b", "__end_b"), [a[k] == F.col(f"__{k}") for k in keys] + on)
    return out.select(*keys, "a", "b", (F.least("__end", "__end_b") - F.greatest("__start", "__start_b")).alias("shared"))
