import struct
import zlib

import numpy as np
import pytest

from foliant.functions import numbers
from foliant.operators import cascade, ordered
from foliant.sinks.images import overlay, write_png
from foliant.sinks.package import body, build_package
from foliant.sinks.pdf import Objects, number, pdf_of_stories, write_pdf
from foliant.sources import fonts, images
from foliant.sources import package as P

STYLES = f"""<w:styles xmlns:w="{P.W}"><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:rPr><w:sz w:val="20"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="Head"><w:basedOn w:val="Normal"/><w:rPr><w:b/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Sub"><w:basedOn w:val="Head"/><w:rPr><w:b w:val="0"/><w:i/></w:rPr></w:style></w:styles>"""
NUMBERING = f"""<w:numbering xmlns:w="{P.W}"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl>
<w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%2)"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="1"><w:startOverride w:val="3"/></w:lvlOverride></w:num></w:numbering>"""
SETTINGS = f'<w:settings xmlns:w="{P.W}"><w:defaultTabStop w:val="360"/><w:compat><w:compatSetting w:name="compatibilityMode" w:val="12"/><w:compatSetting w:name="compatibilityMode" w:val="15"/></w:compat></w:settings>'
RELS = f'<Relationships xmlns="{P.RELS}"><Relationship Id="r1" Type="t" Target="../media/a.png"/><Relationship Id="r1" Type="t" Target="header1.xml"/><Relationship Id="r2" Type="t" Target="/word/x/./y/../z.xml"/><Relationship Id="r3" Type="t" TargetMode="External" Target="http://x"/></Relationships>'
ITEM = '<w:p><w:pPr><w:pStyle w:val="Head"/><w:numPr><w:ilvl w:val="{1}"/><w:numId w:val="5"/></w:numPr></w:pPr><w:r><w:t>{0}</w:t></w:r></w:p>'
BODY = (
    ITEM.format("a", 0) + ITEM.format("b", 1) + ITEM.format("c", 1) + ITEM.format("d", 0) + ITEM.format("e", 1)
    + '<w:p><w:pPr><w:sectPr><w:pgSz w:w="100" w:h="200"/><w:type w:val="continuous"/></w:sectPr></w:pPr><w:r><w:t xml:space="preserve"> x </w:t><w:tab/><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:r></w:p>'
    + '<w:p/><w:sectPr><w:pgSz w:w="300" w:h="400"/><w:cols w:num="2"/></w:sectPr>'
)


@pytest.fixture(scope="module")
def nodes(spark):
    package = build_package({"word/document.xml": body(BODY), "word/styles.xml": STYLES, "word/numbering.xml": NUMBERING, "word/settings.xml": SETTINGS, "word/_rels/document.xml.rels": RELS})
    rows = [("d1", bytearray(package)), ("bad", bytearray(b"\1\2\3\4\5")), ("none", None), ("no main", bytearray(build_package({"word/x.xml": "<a/>"}))), ("broken", bytearray(build_package({"word/document.xml": "<a><b></a>"})))]
    parts = P.parts_of(spark.createDataFrame(rows, "doc_id string, content binary")).cache()
    return parts, P.nodes_of(parts).cache()


def test_errors_are_rows(nodes):
    parts, found = nodes
    assert {(r.doc_id, r.error) for r in parts.where("error IS NOT NULL").collect()} == {("bad", "docx-unreadable"), ("none", "docx-unreadable"), ("no main", "docx-malformed")}
    assert [(r.doc_id, r.part) for r in found.where("error IS NOT NULL").collect()] == [("broken", "word/document.xml")]


def test_xml_nodes():
    n = P.parse_xml(b'<a xmlns="u" xmlns:p="v" x="1" p:y=""><b xml:space="preserve"> t&amp;<c/>u </b><!-- no --><d/></a>')
    assert [(x["ns"], x["name"], x["parent_id"], x["last_desc"], x["ord"], x["depth"], x["text"], x["preserve"]) for x in n] == [
        ("u", "a", None, 3, 0, 0, "", False), ("u", "b", 0, 2, 0, 1, " t&u ", True), ("u", "c", 1, 2, 0, 2, "", True), ("u", "d", 0, 3, 1, 1, "", False),
    ]
    assert n[0]["attrs"] == {"x": "1", "{v}y": ""}


def test_parts_state(nodes):
    _, n = nodes
    n = n.where("doc_id = 'd1'")
    assert [tuple(r) for r in P.settings(n).collect()] == [("d1", 360, 15)]
    assert {(r.rid, r.target) for r in P.relationships(n).where("owner = 'word/document.xml'").collect()} == {("r1", "word/header1.xml"), ("r2", "word/x/z.xml")}
    assert P.resolve_target("word/document.xml", "../media/a.png") == "media/a.png"
    assert {(r.ilvl, r.format, r.level_text, r.start) for r in P.numbering(n).collect()} == {(0, "decimal", "%1.", 1), (1, "lowerLetter", "%2)", 3)}
    assert [(r.sec_idx, r.width_twips, r.columns, r.kind) for r in P.sections(n).orderBy("sec_idx").collect()] == [(0, 100, 1, "continuous"), (1, 300, 2, "nextPage")]


def test_styles_cascade(nodes):
    s = P.styles(nodes[1].where("doc_id = 'd1'"))
    got = {r.style_id: r for r in cascade.style_chain(s, ["doc_id"], "style_id", "based_on", ["bold", "italic", "size_half_points"]).collect()}
    assert (got["Sub"].bold.value, got["Sub"].italic.value, got["Sub"].size_half_points.value) == (False, True, 20.0) and got["Head"].bold.value and got["Normal"].bold is None


def test_paragraphs_sections_and_list_numbers(nodes):
    n = nodes[1].where("doc_id = 'd1'")
    p = P.section_of_paragraphs(P.paragraphs(n))
    assert [(r.p_idx, r.text, r.sec_idx) for r in p.orderBy("p_idx").collect()] == [(0, "a", 0), (1, "b", 0), (2, "c", 0), (3, "d", 0), (4, "e", 0), (5, " x \t", 0), (6, "", 1)]
    counted = ordered.list_counters(p.where("num_id IS NOT NULL"), ["doc_id", "num_id"], ["p_idx"], "ilvl", 2).join(P.numbering(n), ["doc_id", "num_id", "ilvl"])
    from pyspark.sql import functions as F

    at = F.when(F.col("ilvl") == 0, F.col("count_0")).otherwise(F.col("count_1")) + F.col("start") - 1
    shown = numbers.written(at, F.col("format"))
    assert [r.s for r in counted.orderBy("p_idx").select(numbers.filled(F.col("level_text"), [shown, shown]).alias("s")).collect()] == ["1.", "c)", "d)", "2.", "c)"]


def test_png_and_gif():
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (7, 5, 4)).astype(np.uint8)
    assert (images.read_png(write_png(px)) == px).all() and images.size_of(write_png(px)) == ("png", 5, 7)
    lines, above = b"", np.zeros(15, np.uint8)
    rgb = rng.integers(0, 256, (5, 15)).astype(np.uint8)
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        row = []
        for x in range(15):
            left, corner = (int(rgb[y, x - 3]), int(above[x - 3])) if x >= 3 else (0, 0)
            guess = {0: 0, 1: left, 2: int(above[x]), 3: (left + int(above[x])) // 2, 4: images.paeth(left, int(above[x]), corner)}[kind]
            row.append((int(rgb[y, x]) - guess) & 255)
        lines, above = lines + bytes([kind, *row]), rgb[y]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (images.read_png(png)[:, :, :3].reshape(5, 15) == rgb).all()
    gif = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x80, 0, 0) + bytes([255, 0, 0, 0, 0, 255]) + b"," + struct.pack("<HHHHB", 0, 0, 2, 1, 0) + bytes([2, 2, 0b01000100, 0b01010, 0]) + b";"
    assert images.read_gif(gif)[0, :, :3].tolist() == [[255, 0, 0], [0, 0, 255]] and images.size_of(b"x") is None
    assert (overlay(px, None) != 255).any() and (overlay(px, px)[:, :, 0] == overlay(px, px)[:, :, 1]).all()


def test_pixels_become_rows(spark):
    px = np.zeros((2, 3, 4), np.uint8)
    px[1, 2] = [1, 2, 3, 4]
    rows = images.pixels_of(spark.createDataFrame([("a", bytearray(write_png(px))), ("bad", bytearray(b"x")), ("none", None)], "id string, content binary")).collect()
    assert len(rows) == 6 and [tuple(r) for r in rows if r.y == 1 and r.x == 2] == [("a", 1, 2, 1, 2, 3, 4)]


def build_font(widths):
    """A face whose glyph k + 1 is chr(97 + k)."""
    n = len(widths)
    head = bytearray(54)
    struct.pack_into(">H", head, 18, 1000)
    hhea = bytearray(36)
    struct.pack_into(">hhh", hhea, 4, 800, -200, 50)
    struct.pack_into(">H", hhea, 34, n + 1)
    hmtx = b"".join(struct.pack(">Hh", w, 0) for w in [500, *widths])
    segments = struct.pack(">HHHHHHH", 4, 32, 0, 4, 4, 1, 0) + struct.pack(">HH", 96 + n, 0xFFFF) + b"\0\0" + struct.pack(">HH", 97, 0xFFFF) + struct.pack(">HH", (1 - 97) & 0xFFFF, 1) + struct.pack(">HH", 0, 0)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + segments
    kern = struct.pack(">HHHHHHHHH", 0, 1, 0, 20, 1, 1, 6, 0, 0) + struct.pack(">HHh", 1, 2, -30)
    family = "Fäce".encode("utf-16-be")
    name = struct.pack(">HHH6H", 0, 1, 18, 3, 1, 1033, 1, len(family), 0) + family
    tables, at, out, data = {b"head": bytes(head), b"hhea": bytes(hhea), b"hmtx": hmtx, b"cmap": cmap, b"kern": kern, b"name": name}, 12 + 16 * 6, b"\0\1\0\0" + struct.pack(">HHHH", 6, 0, 0, 0), b""
    for tag, t in tables.items():
        out += struct.pack(">4sIII", tag, 0, at + len(data), len(t))
        data += t
    return out + data


def test_fonts(spark):
    (t,) = fonts.faces_of(build_font([300, 400]))
    assert fonts.advances(t) == {97: 300, 98: 400} and fonts.kerning(t) == {(1, 2): -30} and fonts.name_of(t, 1) == "Fäce" and fonts.style_of(t) == (False, False)
    rows = fonts.read_faces(spark.createDataFrame([("a", bytearray(build_font([300]))), ("bad", bytearray(b"nope")), ("cut", bytearray(build_font([300])[:40]))], "file string, content binary")).collect()
    assert [(r.file, r.upm, r.ascender, r.advances, r.error) for r in rows][0] == ("a", 1000, 800, {97: 300}, None) and all(r.error for r in rows[1:])


def test_pdf(spark):
    data = write_pdf([["Hello (world)", "é\\"], []])
    assert data == write_pdf([["Hello (world)", "é\\"], []]) and data.startswith(b"%PDF-1.7") and data.count(b"/Type/Page/") == 2
    start = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    assert data[start : start + 4] == b"xref" and all(data[int(x[:10]) :].split(b" ", 1)[0] == str(k).encode() for k, x in enumerate(data[start:].split(b"\n")[3:-7], 1) if x.endswith(b"n "))
    objects = Objects()
    objects.reserve()
    with pytest.raises(ValueError, match="not written"):
        objects.file(1)
    assert [number(v) for v in (1.0, -0.00001, 2.5, 1e-3)] == ["1", "0", "2.5", "0.001"]
    rows = pdf_of_stories(spark.createDataFrame([(1, "a b\n\nc"), (2, None)], "k long, t string"), "k", "t", 90000, 2).collect()
    assert [(r.k, r.pages) for r in rows] == [(1, 2), (2, 1)] and all(bytes(r.content).startswith(b"%PDF") for r in rows)


def test_streams(spark, tmp_path):
    from helpers import SF

    from foliant.streaming import ingest

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    folder = tmp_path / "in"
    for k in range(3):
        spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(folder))
    q = ingest.each_batch(ingest.table_stream(spark, str(folder), schema), lambda b: b.select("doc_id"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert q.awaitTermination(120) and spark.read.parquet(str(tmp_path / "out")).count() == 200
