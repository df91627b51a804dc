"""Packages to pages: relational up to the resolved paragraphs, one task a document from there."""

from __future__ import annotations



import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import numbers
from foliant.operators import cascade, lines, ordered
from foliant.sources import package

LEVELS = 9


def resolved_paragraphs(nodes: DataFrame) -> DataFrame:
    """(doc_id, p_idx, sec_idx, style_id, number, text, size_pt, bold, italic): styles cascaded, lists numbered."""
    paragraphs = package.section_of_paragraphs(package.paragraphs(nodes))
    styles = package.styles(nodes)
    chained = cascade.style_chain(styles, ["doc_id"], "style_id", "based_on", ["bold", "italic", "size_half_points", "num_id", "ilvl"])
    default = styles.where("is_default AND type = 'paragraph'").groupBy("doc_id").agg(F.min("style_id").alias("default_style"))
    chained = chained.select("doc_id", "style_id", F.col("bold.value").alias("bold"), F.col("italic.value").alias("italic"), (F.col("size_half_points.value") / 2).alias("size_pt"), F.col("num_id.value").alias("s_num"), F.col("ilvl.value").alias("s_ilvl"))
    out = paragraphs.join(default, "doc_id", "left").withColumn("style_id", F.coalesce("style_id", "default_style")).join(chained, ["doc_id", "style_id"], "left")
    out = out.withColumn("num_id", F.coalesce("num_id", "s_num")).withColumn("num_id", F.when(F.col("num_id") != "0", F.col("num_id"))).withColumn("ilvl", F.coalesce("ilvl", "s_ilvl", F.lit(0)))
    table = package.numbering(nodes)
    listed = ordered.list_counters(out.where("num_id IS NOT NULL").select("doc_id", "num_id", "ilvl", "p_idx"), ["doc_id", "num_id"], ["p_idx"], "ilvl", LEVELS)
    levels = table.groupBy("doc_id", "num_id").agg(F.map_from_entries(F.collect_list(F.struct("ilvl", F.struct("format", "level_text", "start")))).alias("levels"))
    listed = listed.join(levels, ["doc_id", "num_id"])
    shown = [numbers.written(F.greatest(F.col(f"count_{k}"), F.lit(1)) + F.col("levels")[k]["start"] - 1, F.col("levels")[k]["format"]) for k in range(LEVELS)]
    listed = listed.select("doc_id", "p_idx", numbers.filled(F.col("levels")[F.col("ilvl")]["level_text"], shown).alias("number"))
    out = out.join(listed, ["doc_id", "p_idx"], "left")
    return out.select("doc_id", "p_idx", "sec_idx", "style_id", "number", "text", F.coalesce("size_pt", F.lit(10.0)).alias("size_pt"), F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("italic", F.lit(False)).alias("italic"))


PLACED = "doc_id string, page int, p_idx int, line_idx int, text string, width_pt double"


def _lay_out(table: pa.Table, room_pt: float, page_pt: float) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["p_idx"])
    broken = []
    for r in rows:
        text = f"{r['number']} {r['text']}" if r["number"] else r["text"]
        own = [x for part in text.split("\n") for x in lines.break_lines(part, int(room_pt * lines.UPM / r["size_pt"]))]
        broken.append((r, own))
    stack = [lines.Paragraph([1.2 * r["size_pt"]] * len(own), widow_control=True, starts_page=k > 0 and r["sec_idx"] != broken[k - 1][0]["sec_idx"]) for k, (r, own) in enumerate(broken)]
    cols: list[list] = [[], [], [], [], [], []]
    for page, placed in enumerate(lines.break_pages(stack, page_pt)):
        for p, n in placed:
            r, own = broken[p]
            for c, v in zip(cols, (r["doc_id"], page, r["p_idx"], n, own[n].text, own[n].width * r["size_pt"] / lines.UPM), strict=True):
                c.append(v)
    return pa.table(dict(zip(["doc_id", "page", "p_idx", "line_idx", "text", "width_pt"], (pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()), strict=True)), strict=True)))


def lay_out_packages(packages: DataFrame, room_pt: float = 451.0, page_pt: float = 698.0) -> DataFrame:
    """(doc_id, page, p_idx, line_idx, text, width_pt) of every package that can be read. A document's paragraphs meet in one task."""
    nodes = package.nodes_of(package.parts_of(packages).where("error IS NULL")).where("error IS NULL")
    return resolved_paragraphs(nodes).groupBy("doc_id").applyInArrow(lambda t: _lay_out(t, room_pt, page_pt), PLACED)



def status(packages: DataFrame) -> DataFrame:
    """(doc_id, error): null for a package that can be laid out."""
    parts = package.parts_of(packages)
    nodes = package.nodes_of(parts.where(F.col("part") == package.MAIN_PART))
    errors = parts.where("error IS NOT NULL").select("doc_id", "error").unionByName(nodes.where("error IS NOT NULL").select("doc_id", "error"))
    return packages.select("doc_id").distinct().join(errors.groupBy("doc_id").agg(F.first("error").alias("error")), "doc_id", "left")


def first_boxes(placed: DataFrame) -> DataFrame:
    """Each paragraph's lines on the first page it stands on."""
    w = Window.partitionBy("doc_id", "p_idx")
    return placed.withColumn("first", F.min("page").over(w)).where("page = first").drop("first")
