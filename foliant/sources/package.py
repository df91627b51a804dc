"""Word-processing packages as tables: parts, nodes, and what the nodes of well-known parts state.

A package that can't be read is a row with its error, not a failed job. A node's number is its place in document order;
its descendants are the nodes from its number to last_desc, so that every axis is a comparison of integers.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Namespaces of the format.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
XML = "http://www.w3.org/XML/1998/namespace"
MC = "http://schemas.openxmlformats.org/markup-compatibility/2006"
MAIN_PART = "word/document.xml"

PARTS = "doc_id string, part string, content binary, error string"
NODES = "doc_id string, part string, node_id int, parent_id int, last_desc int, ord int, depth int, ns string, name string, attrs map<string,string>, text string, preserve boolean, error string"


def open_package(content: bytes) -> dict[str, bytes]:
    """Parts by name. ValueError: docx-unreadable if it is no zip, docx-malformed without a main part."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            parts = {i.filename.lstrip("/"): z.read(i) for i in z.infolist() if not i.is_dir()}
    except Exception as e:  # whatever a broken archive leads to
        raise ValueError("docx-unreadable") from e
    if MAIN_PART not in parts:
        raise ValueError("docx-malformed")
    return parts


def parse_xml(content: bytes) -> list[dict]:
    """Nodes in document order. text is what stands directly in a node, joined; an attribute without a prefix is in no
    namespace and named as it is, one with a prefix as {namespace}name; xml:space is inherited. No value is changed."""
    nodes: list[dict] = []
    open_: list[int] = []
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.ordered_attributes = True

    def split(name: str) -> tuple[str, str]:
        ns, sep, local = name.rpartition("}")
        return (ns, local) if sep else ("", name)

    def start(name: str, attributes: list[str]) -> None:
        ns, local = split(name)
        attrs = {("{" + k if "}" in k else k): v for k, v in zip(attributes[::2], attributes[1::2], strict=True)}
        up = open_[-1] if open_ else None
        space = attrs.get(f"{{{XML}}}space")
        preserve = space == "preserve" if space is not None else bool(up is not None and nodes[up]["preserve"])
        own = len(nodes)
        nodes.append({"node_id": own, "parent_id": up, "last_desc": own, "ord": 0 if up is None else nodes[up]["n"], "depth": len(open_), "ns": ns, "name": local, "attrs": attrs, "text": "", "preserve": preserve, "n": 0})
        if up is not None:
            nodes[up]["n"] += 1
        open_.append(own)

    def end(_: str) -> None:
        nodes[open_.pop()]["last_desc"] = len(nodes) - 1

    def data(text: str) -> None:
        if open_:
            nodes[open_[-1]]["text"] += text

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(content, True)
    except expat.ExpatError as e:
        raise ValueError("docx-malformed") from e
    return nodes


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                rows = [(doc, k, v, None) for k, v in open_package(content.as_py() or b"").items()]
            except ValueError as e:
                rows = [(doc, None, None, str(e))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], ["doc_id", "part", "content", "error"])


_NODE_TYPES = [("node_id", pa.int32()), ("parent_id", pa.int32()), ("last_desc", pa.int32()), ("ord", pa.int32()), ("depth", pa.int32()), ("ns", pa.string()), ("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("preserve", pa.bool_())]


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, part, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            error = None
            try:
                nodes = parse_xml(content.as_py() or b"")
            except ValueError as e:
                nodes, error = [], str(e)
            n = max(1, len(nodes))
            own = [pa.array([list(x["attrs"].items()) if k == "attrs" else x[k] for x in nodes] if nodes else [None], t) for k, t in _NODE_TYPES]
            yield pa.RecordBatch.from_arrays([pa.array([doc] * n), pa.array([part] * n), *own, pa.array([error] * n, pa.string())], ["doc_id", "part", *(k for k, _ in _NODE_TYPES), "error"])


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, content) of the packages in a folder and below; locks and hidden files aren't read. doc_id: of the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.startswith("~$") & ~name.startswith(".")).select(F.substring(F.sha2("content", 256), 1, 12).alias("doc_id"), "path", "content")


def parts_of(packages: DataFrame) -> DataFrame:
    return packages.select("doc_id", "content").mapInArrow(_parts, PARTS)


def nodes_of(parts: DataFrame) -> DataFrame:
    """Nodes of all XML parts; a part that isn't well-formed is a row with its error."""
    xml = parts.where(F.col("part").rlike(r"\.(xml|rels)$")).select("doc_id", "part", "content")
    return xml.mapInArrow(_nodes, NODES)


def attribute(name: str, ns: str = W) -> Column:
    return F.col("attrs").getItem(f"{{{ns}}}{name}" if ns else name)


def named(nodes: DataFrame, name: str, ns: str = W, part: str | None = None) -> DataFrame:
    out = nodes.where((F.col("ns") == ns) & (F.col("name") == name))
    return out.where(F.col("part") == part) if part else out


def children(nodes: DataFrame, parents: DataFrame, name: str, ns: str = W) -> DataFrame:
    """Children of a name, with their parent's columns renamed up_*."""
    up = parents.select("doc_id", "part", F.col("node_id").alias("parent_id"), *(F.col(c).alias(f"up_{c}") for c in parents.columns if c not in ("doc_id", "part")))
    return named(nodes, name, ns).join(up, ["doc_id", "part", "parent_id"])


def descendants(nodes: DataFrame, above: DataFrame, name: str, ns: str = W) -> DataFrame:
    """Descendants of a name, or the nodes themselves, with above_id: a range of document order."""
    a = above.select(F.col("doc_id").alias("a_doc"), F.col("part").alias("a_part"), F.col("node_id").alias("above_id"), F.col("last_desc").alias("a_last"))
    return named(nodes, name, ns).join(a, (F.col("doc_id") == F.col("a_doc")) & (F.col("part") == F.col("a_part")) & F.col("node_id").between(F.col("above_id"), F.col("a_last"))).drop("a_doc", "a_part", "a_last")


def resolve_target(owner: str, target: str) -> str:
    """A target relative to the part that names it; a leading slash is absolute, .. goes up."""
    return posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(owner), target)).lstrip("/")


def relationships(nodes: DataFrame) -> DataFrame:
    """(doc_id, owner, rid, type, target): internal ones that have an id and a target; the last of an id counts."""
    rel = named(nodes, "Relationship", RELS).where(F.coalesce(attribute("TargetMode", ""), F.lit("")) != "External")
    rel = rel.where(attribute("Id", "").isNotNull() & attribute("Target", "").isNotNull())
    owner = F.regexp_replace(F.regexp_replace("part", r"(^|/)_rels/", "$1"), r"\.rels$", "")
    last = rel.groupBy("doc_id", owner.alias("owner"), attribute("Id", "").alias("rid")).agg(F.max_by(F.struct(attribute("Type", "").alias("type"), attribute("Target", "").alias("target")), F.col("node_id")).alias("r"))
    folder = F.regexp_replace("owner", r"[^/]*$", "")
    joined = F.when(F.col("r.target").startswith("/"), F.substring(F.col("r.target"), 2, 4096)).otherwise(F.concat(folder, F.col("r.target")))
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    target = F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step), "/")
    return last.select("doc_id", "owner", "rid", F.col("r.type").alias("type"), target.alias("target"))


def settings(nodes: DataFrame) -> DataFrame:
    """(doc_id, default_tab_twips, compat_mode): 720 and null where they aren't stated; the last compatibility mode counts."""
    own = nodes.where(F.col("part") == "word/settings.xml")
    tab = F.max_by(F.when(F.col("name") == "defaultTabStop", attribute("val")), F.when(F.col("name") == "defaultTabStop", F.col("node_id")))
    mode = (F.col("name") == "compatSetting") & (attribute("name") == "compatibilityMode")
    out = own.groupBy("doc_id").agg(tab.try_cast("int").alias("tab"), F.max_by(F.when(mode, attribute("val")), F.when(mode, F.col("node_id"))).try_cast("int").alias("compat_mode"))
    documents = nodes.where((F.col("part") == MAIN_PART) & (F.col("node_id") == 0)).select("doc_id")
    return documents.join(out, "doc_id", "left").select("doc_id", F.coalesce("tab", F.lit(720)).alias("default_tab_twips"), "compat_mode")


def theme_colours(nodes: DataFrame) -> DataFrame:
    """(doc_id, slot, rgb) of the colour scheme."""
    scheme = named(nodes, "clrScheme", A).select("doc_id", "part", F.col("node_id").alias("scheme"))
    own = nodes.join(scheme, (nodes.doc_id == scheme.doc_id) & (nodes.part == scheme.part) & (nodes.parent_id == scheme.scheme)).select(nodes.doc_id, nodes.part, F.col("node_id").alias("slot_id"), F.col("name").alias("slot"))
    value = nodes.where((F.col("ns") == A) & F.col("name").isin("srgbClr", "sysClr")).select("doc_id", "part", F.col("parent_id").alias("slot_id"), F.upper(F.coalesce(F.when(F.col("name") == "srgbClr", attribute("val", "")), attribute("lastClr", ""))).alias("rgb"))
    return own.join(value, ["doc_id", "part", "slot_id"]).select("doc_id", "slot", "rgb")


def styles(nodes: DataFrame) -> DataFrame:
    """(doc_id, style_id, type, based_on, is_default, bold, italic, size_half_points, num_id, ilvl), each property as struct<value> or null if it is unstated."""
    own = named(nodes, "style", part="word/styles.xml").select("doc_id", "part", F.col("node_id").alias("s"), F.col("last_desc").alias("s_last"), attribute("styleId").alias("style_id"), attribute("type").alias("type"), F.coalesce(attribute("default").isin("1", "true", "on"), F.lit(False)).alias("is_default"))
    inner = nodes.where((F.col("ns") == W) & (F.col("part") == "word/styles.xml")).select("doc_id", "part", "node_id", "name", "attrs")
    inside = own.join(inner, ["doc_id", "part"]).where(F.col("node_id").between(F.col("s") + 1, F.col("s_last")))
    on = F.when(attribute("val").isNull() | ~F.lower(attribute("val")).isin("0", "false", "off"), F.lit(True)).otherwise(F.lit(False))
    last = lambda name, value: F.max_by(F.when(F.col("name") == name, F.struct(value.alias("value"))), F.when(F.col("name") == name, F.col("node_id")))
    stated = inside.groupBy("doc_id", "style_id").agg(
        last("basedOn", attribute("val")).alias("based_on"), last("b", on).alias("bold"), last("i", on).alias("italic"), last("sz", attribute("val").try_cast("double")).alias("size_half_points"),
        last("numId", attribute("val")).alias("num_id"), last("ilvl", attribute("val").try_cast("int")).alias("ilvl"), last("jc", attribute("val")).alias("alignment"),
    )
    return own.select("doc_id", "style_id", "type", "is_default").join(stated, ["doc_id", "style_id"], "left").withColumn("based_on", F.col("based_on.value"))


def numbering(nodes: DataFrame) -> DataFrame:
    """(doc_id, num_id, ilvl, format, level_text, start, restart): abstract levels joined to instances; an override replaces the start."""
    part = "word/numbering.xml"
    inner = lambda name: nodes.where((F.col("part") == part) & (F.col("ns") == W) & (F.col("name") == name)).select("doc_id", F.col("parent_id").alias("up"), attribute("val").alias("val"))
    abstract = named(nodes, "abstractNum", part=part).select("doc_id", F.col("node_id").alias("a_node"), attribute("abstractNumId").alias("a_id"))
    levels = named(nodes, "lvl", part=part).select("doc_id", F.col("parent_id").alias("a_node"), F.col("node_id").alias("l_node"), attribute("ilvl").try_cast("int").alias("ilvl")).join(abstract, ["doc_id", "a_node"])
    for name, column in (("numFmt", "format"), ("lvlText", "level_text"), ("start", "start"), ("lvlRestart", "restart")):
        levels = levels.join(inner(name).select("doc_id", F.col("up").alias("l_node"), F.col("val").alias(column)), ["doc_id", "l_node"], "left")
    nums = named(nodes, "num", part=part).select("doc_id", F.col("node_id").alias("n_node"), attribute("numId").alias("num_id")).join(inner("abstractNumId").select("doc_id", F.col("up").alias("n_node"), F.col("val").alias("a_id")), ["doc_id", "n_node"])
    over = named(nodes, "lvlOverride", part=part).select("doc_id", F.col("parent_id").alias("n_node"), F.col("node_id").alias("o_node"), attribute("ilvl").try_cast("int").alias("ilvl"))
    over = over.join(inner("startOverride").select("doc_id", F.col("up").alias("o_node"), F.col("val").try_cast("int").alias("own_start")), ["doc_id", "o_node"]).select("doc_id", "n_node", "ilvl", "own_start")
    out = nums.join(levels, ["doc_id", "a_id"]).join(over, ["doc_id", "n_node", "ilvl"], "left")
    return out.select("doc_id", "num_id", "ilvl", F.coalesce("format", F.lit("decimal")).alias("format"), F.coalesce("level_text", F.lit("")).alias("level_text"), F.coalesce("own_start", F.col("start").try_cast("int"), F.lit(0)).alias("start"), F.col("restart").try_cast("int").alias("restart"))


def paragraphs(nodes: DataFrame) -> DataFrame:
    """(doc_id, p_idx, node_id, last_desc, style_id, num_id, ilvl, text, closes_section) of the body in document order.

    What stands in text boxes and in fallbacks for older readers isn't the body's.
    """
    body = nodes.where(F.col("part") == MAIN_PART)
    hidden = body.where(((F.col("ns") == W) & (F.col("name") == "txbxContent")) | ((F.col("ns") == MC) & (F.col("name") == "Fallback"))).select("doc_id", F.col("node_id").alias("h"), F.col("last_desc").alias("h_last"))
    seen = body.join(hidden, (body.doc_id == hidden.doc_id) & body.node_id.between(hidden.h, hidden.h_last), "left_anti")
    w = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    is_p = (F.col("ns") == W) & (F.col("name") == "p")
    inner = seen.where(F.col("ns") == W).where(F.col("name").isin("p", "pStyle", "numId", "ilvl", "t", "tab", "br", "sectPr")).select("doc_id", "node_id", "last_desc", "name", "attrs", "text", F.last_value(F.when(is_p, F.struct(F.col("node_id").alias("p"), F.col("last_desc").alias("p_last"))), ignoreNulls=True).over(w).alias("at"))
    p = inner.where(F.col("name") == "p").select("doc_id", F.col("node_id").alias("p"), F.col("last_desc").alias("p_last"))
    within = inner.where((F.col("name") != "p") & (F.col("node_id") <= F.col("at.p_last"))).withColumn("p", F.col("at.p"))
    first = lambda name: F.min_by(F.when(F.col("name") == name, attribute("val")), F.when(F.col("name") == name, F.col("node_id")))
    spelled = F.when(F.col("name") == "t", F.col("text")).when(F.col("name").isin("tab"), F.lit("\t")).when(F.col("name") == "br", F.lit("\n"))
    pieces = F.transform(F.sort_array(F.collect_list(F.when(spelled.isNotNull(), F.struct("node_id", spelled.alias("s"))))), lambda x: x["s"])
    read = within.groupBy("doc_id", "p").agg(first("pStyle").alias("style_id"), first("numId").alias("num_id"), first("ilvl").try_cast("int").alias("ilvl"), F.array_join(pieces, "").alias("text"), F.max(F.col("name") == "sectPr").alias("closes"))
    out = p.join(read, ["doc_id", "p"], "left")
    return out.select(
        "doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("p")) - 1).alias("p_idx"), F.col("p").alias("node_id"), F.col("p_last").alias("last_desc"), "style_id", "num_id", "ilvl",
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("closes", F.lit(False)).alias("closes_section"),
    )


def sections(nodes: DataFrame) -> DataFrame:
    """(doc_id, sec_idx, node_id, width_twips, height_twips, columns, kind) of the body in document order."""
    own = named(nodes, "sectPr", part=MAIN_PART).select("doc_id", "node_id")
    inner = nodes.where((F.col("part") == MAIN_PART) & (F.col("ns") == W) & F.col("name").isin("pgSz", "cols", "type")).select("doc_id", F.col("parent_id").alias("node_id"), "name", "attrs")
    pick = lambda name, a: F.max(F.when(F.col("name") == name, attribute(a)))
    read = inner.groupBy("doc_id", "node_id").agg(pick("pgSz", "w").try_cast("int").alias("width_twips"), pick("pgSz", "h").try_cast("int").alias("height_twips"), pick("cols", "num").try_cast("int").alias("columns"), pick("type", "val").alias("kind"))
    numbered = own.join(read, ["doc_id", "node_id"], "left").withColumn("sec_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id")) - 1)
    return numbered.select("doc_id", "sec_idx", "node_id", "width_twips", "height_twips", F.coalesce("columns", F.lit(1)).alias("columns"), F.coalesce("kind", F.lit("nextPage")).alias("kind"))


def section_of_paragraphs(paragraphs_: DataFrame) -> DataFrame:
    """paragraphs with sec_idx: how many sections closed before; a paragraph that closes one is in it."""
    w = Window.partitionBy("doc_id").orderBy("p_idx").rowsBetween(Window.unboundedPreceding, -1)
    return paragraphs_.withColumn("sec_idx", F.coalesce(F.sum(F.col("closes_section").cast("int")).over(w), F.lit(0)))
