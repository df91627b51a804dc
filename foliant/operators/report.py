"""What a package asks for that this engine doesn't honour: one pass over the nodes, gathered by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import recomputed_page_field
from foliant.sources.package import MC, W, attribute

# Kinds by the node that asks, and whether text moves or paint changes.
BY_NAME = {
    "keepLines": "keep-lines-together", "commentReference": "comment", "vanish": "hidden-text", "autoHyphenation": "automatic-hyphenation", "rtl": "right-to-left", "bidi": "right-to-left",
    "footnoteReference": "footnote", "evenAndOddHeaders": "alternate-first-or-even-page", "background": "page-background", "sym": "symbol-character",
}
CHANGES_PAINT = ["bar-tab-stop", "page-number-field", "page-background", "approximated-border", "unknown-drawing"]
PART_PATTERN = r"^word/(document|settings|header\d*|footer\d*)\.xml$"


def unhonoured(nodes: DataFrame) -> DataFrame:
    """(doc_id, kind, effect, places, parts): an element that is switched off asks for nothing; fallbacks for older readers don't count."""
    own = nodes.where(F.col("part").rlike(PART_PATTERN))
    hidden = own.where((F.col("ns") == MC) & (F.col("name") == "Fallback")).select(F.col("doc_id").alias("h_doc"), F.col("part").alias("h_part"), F.col("node_id").alias("h"), F.col("last_desc").alias("h_last"))
    own = own.join(hidden, (F.col("doc_id") == F.col("h_doc")) & (F.col("part") == F.col("h_part")) & F.col("node_id").between(F.col("h"), F.col("h_last")), "left_anti")
    on = attribute("val").isNull() | ~F.lower(attribute("val")).isin("0", "false", "off")
    kind = F.lit(None).cast("string")
    for name, k in BY_NAME.items():
        kind = F.when((F.col("name") == name) & on, F.lit(k)).otherwise(kind)
    kind = F.when((F.col("name") == "tab") & (attribute("val") == "bar"), "bar-tab-stop").otherwise(kind)
    kind = F.when((F.col("name") == "br") & (attribute("type") == "column"), "column-break").otherwise(kind)
    field = F.when(F.col("name") == "instrText", F.col("text")).when(F.col("name") == "fldSimple", attribute("instr"))
    kind = F.when(recomputed_page_field(field), "page-number-field").otherwise(kind)
    found = own.where(F.col("ns") == W).select("doc_id", "part", kind.alias("kind")).where("kind IS NOT NULL")
    effect = F.when(F.col("kind").isin(CHANGES_PAINT), "changes-paint").otherwise("moves-text")
    return found.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("places"), F.sort_array(F.collect_set("part")).alias("parts")).withColumn("effect", effect)
