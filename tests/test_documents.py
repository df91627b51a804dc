import pytest

from foliant.operators import report
from foliant.plans import documents
from foliant.sinks.package import body, build_package
from foliant.sources import package as P
from foliant.sources import tables
from test_sources import BODY, NUMBERING, STYLES

TABLE = (
    '<w:tbl><w:tr><w:tc><w:tcPr><w:tcW w:w="500" w:type="dxa"/><w:gridSpan w:val="2"/><w:vMerge w:val="restart"/><w:shd w:val="pct50" w:color="000000" w:fill="FFFFFF"/><w:tcBorders><w:top w:val="double" w:sz="8" w:color="auto"/><w:left w:val="nil"/></w:tcBorders></w:tcPr><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr>'
    '<w:tr><w:tc><w:tcPr><w:tcW w:w="50" w:type="pct"/><w:gridSpan w:val="2"/><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:tcPr><w:shd w:val="clear" w:fill="auto"/></w:tcPr><w:p/></w:tc></w:tr></w:tbl>'
)
ASKS = '<w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>x</w:t><w:br w:type="column"/></w:r><w:r><w:rPr><w:vanish w:val="0"/></w:rPr></w:r><w:r><w:instrText> page \\* x</w:instrText></w:r></w:p>'


@pytest.fixture(scope="module")
def packages(spark):
    rows = [("d1", build_package({"word/document.xml": body(BODY), "word/styles.xml": STYLES, "word/numbering.xml": NUMBERING})), ("d2", build_package({"word/document.xml": body(TABLE + ASKS)})), ("bad", b"x")]
    return spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "doc_id string, content binary")


def test_layout_of_packages(packages):
    placed = documents.lay_out_packages(packages).where("doc_id = 'd1'").orderBy("page", "p_idx", "line_idx").collect()
    assert [(r.page, r.text) for r in placed] == [(0, "1. a"), (0, "c) b"), (0, "d) c"), (0, "2. d"), (0, "c) e"), (0, " x"), (1, "")]
    assert {(r.doc_id, r.error) for r in documents.status(packages).collect()} == {("d1", None), ("d2", None), ("bad", "docx-unreadable")}


def test_tables(packages):
    n = P.nodes_of(P.parts_of(packages).where("error IS NULL"))
    cells = tables.cells(n)
    assert [(r.row, r.cell, r.grid_at, r.span, r["merge"], r.width_twips, r.fill) for r in cells.orderBy("row", "cell").collect()] == [
        (0, 0, 0, 2, "restart", 500, "808080"), (0, 1, 2, 1, None, None, None), (1, 0, 0, 2, "continue", None, None), (1, 1, 2, 1, None, None, None),
    ]
    assert [(r.grid_at, r.first_row, r.last_row) for r in tables.merge_runs(cells).collect()] == [(0, 0, 1)]
    found = {r.side: (r.border and tuple(r.border), r.extent) for r in tables.borders(n).withColumn("extent", tables.extent_pt(tables.F.col("border"))).collect()}
    assert found == {"top": (("double", 1.0, None, None), 3.0), "left": (None, 0.0)}


def test_report(packages):
    n = P.nodes_of(P.parts_of(packages).where("error IS NULL"))
    assert {(r.doc_id, r.kind, r.effect, r.places) for r in report.unhonoured(n).collect()} == {("d2", "hidden-text", "moves-text", 1), ("d2", "column-break", "moves-text", 1), ("d2", "page-number-field", "changes-paint", 1)}
