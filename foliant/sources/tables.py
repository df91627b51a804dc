"""Tables of a package: rows, cells, spans, merges, borders, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.colour import blend
from foliant.sources.package import MAIN_PART, W, attribute, named

# Border styles that are drawn as they are stated; bits of a table look.
DRAWN_BORDERS = ["single", "double", "dashed", "dotted", "thick", "dashSmallGap", "dotDash"]
LOOK_BITS = {"firstRow": 0x20, "lastRow": 0x40, "firstColumn": 0x80, "lastColumn": 0x100, "noHBand": 0x200, "noVBand": 0x400}


def cells(nodes: DataFrame, part: str = MAIN_PART) -> DataFrame:
    """(doc_id, table, row, cell, grid_at, span, merge, width_twips, fill, node_id): table is the table's node.

    grid_at: the columns that the cells before take. merge: restart, continue or null. A width counts in twips only.
    """
    own = nodes.where(F.col("part") == part)
    inner = lambda name: own.where((F.col("ns") == W) & (F.col("name") == name))
    rows = inner("tr").select("doc_id", F.col("node_id").alias("r"), F.col("parent_id").alias("table"))
    cell = inner("tc").select("doc_id", F.col("node_id").alias("c"), F.col("parent_id").alias("r"))
    stated = inner("tcPr").select("doc_id", F.col("node_id").alias("pr"), F.col("parent_id").alias("c"))
    within = own.where((F.col("ns") == W) & F.col("name").isin("gridSpan", "vMerge", "tcW", "shd")).select("doc_id", F.col("parent_id").alias("pr"), "name", "attrs")
    pick = lambda name, value: F.max(F.when(F.col("name") == name, value))
    read = stated.join(within, ["doc_id", "pr"]).groupBy("doc_id", "c").agg(
        pick("gridSpan", F.greatest(F.lit(1), F.floor(attribute("val").try_cast("double")))).alias("span"), pick("vMerge", F.when(attribute("val") == "restart", "restart").otherwise("continue")).alias("merge"),
        pick("tcW", F.when(attribute("type") == "dxa", attribute("w").try_cast("int"))).alias("width_twips"), pick("shd", shading(attribute("fill"), attribute("color"), attribute("val"))).alias("fill"),
    )
    by_table, by_row = Window.partitionBy("doc_id", "table").orderBy("r"), Window.partitionBy("doc_id", "r").orderBy("c")
    out = cell.join(rows, ["doc_id", "r"]).join(read, ["doc_id", "c"], "left").withColumn("span", F.coalesce("span", F.lit(1)).cast("int"))
    out = out.withColumn("row", F.dense_rank().over(by_table) - 1).withColumn("cell", F.row_number().over(by_row) - 1)
    out = out.withColumn("grid_at", F.sum("span").over(by_row.rowsBetween(Window.unboundedPreceding, 0)) - F.col("span"))
    return out.select("doc_id", "table", "row", "cell", "grid_at", "span", "merge", "width_twips", "fill", F.col("c").alias("node_id"))


def shading(fill: Column, colour: Column, pattern: Column) -> Column:
    """A fill, with pctN so much of the foreground in it; null for auto or clear without a fill."""
    hex_ = lambda c, auto: F.when(c.isNull() | (F.lower(c) == "auto"), F.lit(auto)).otherwise(F.upper(c))
    share = F.regexp_extract(F.coalesce(pattern, F.lit("")), r"^pct(\d+)$", 1).try_cast("double") / 100
    plain = F.when(fill.isNull() | (F.lower(fill) == "auto"), F.lit(None).cast("string")).otherwise(F.upper(fill))
    return F.when(share.isNotNull(), blend(hex_(fill, "FFFFFF"), hex_(colour, "000000"), share)).otherwise(plain)


def merge_runs(cells_: DataFrame) -> DataFrame:
    """(doc_id, table, grid_at, first_row, last_row) of vertical merges: a restart and what continues it in its column."""
    w = Window.partitionBy("doc_id", "table", "grid_at").orderBy("row")
    begins = F.when(F.col("merge").eqNullSafe("continue"), 0).otherwise(1)
    runs = cells_.withColumn("run", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "table", "grid_at", "run")
    return runs.agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.max(F.col("merge").eqNullSafe("restart")).alias("merged")).where("merged").drop("run", "merged")


def borders(nodes: DataFrame, name: str = "tcBorders", part: str = MAIN_PART) -> DataFrame:
    """(doc_id, owner, side, border): owner is the node whose properties state it; a null border is stated as none.

    border: struct<style, width_pt, colour, space_pt>; widths are stated in eighths of a point.
    """
    own = named(nodes, name, part=part).select("doc_id", F.col("node_id").alias("b"), F.col("parent_id").alias("pr"))
    up = nodes.where(F.col("part") == part).select("doc_id", F.col("node_id").alias("pr"), F.col("parent_id").alias("owner"))
    side = nodes.where((F.col("part") == part) & (F.col("ns") == W)).select("doc_id", F.col("parent_id").alias("b"), F.col("name").alias("side"), "attrs")
    width = attribute("sz").try_cast("double") / 8
    colour = F.when(F.lower(attribute("color")) == "auto", F.lit(None).cast("string")).otherwise(F.upper(attribute("color")))
    drawn = ~attribute("val").isin("none", "nil") & (width > 0)
    border = F.when(drawn, F.struct(attribute("val").alias("style"), width.alias("width_pt"), colour.alias("colour"), attribute("space").try_cast("double").alias("space_pt")))
    return own.join(up, ["doc_id", "pr"]).join(side, ["doc_id", "b"]).select("doc_id", "owner", "side", border.alias("border"))


def extent_pt(border: Column) -> Column:
    """A double border takes three widths."""
    return F.when(border.isNull(), 0.0).when(border["style"] == "double", 3 * border["width_pt"]).otherwise(border["width_pt"])


def look(attribute_mask: Column, stated: dict[str, Column]) -> dict[str, Column]:
    """Attributes beat the mask's bits; the banding bits say no."""
    mask = F.conv(attribute_mask, 16, 10).cast("int")
    return {k: F.coalesce(stated.get(k, F.lit(None).cast("boolean")), mask.bitwiseAND(F.lit(bit)) != 0, F.lit(False)) for k, bit in LOOK_BITS.items()}
