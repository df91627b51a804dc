"""Packages from parts, for fixtures and exports."""

from __future__ import annotations

import io
import zipfile

TYPES = """<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>"""
ROOT = """<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>"""


def body(inner: str) -> str:
    from foliant.sources.package import W

    return f'<?xml version="1.0"?><w:document xmlns:w="{W}"><w:body>{inner}</w:body></w:document>'


def build_package(parts: dict[str, str | bytes]) -> bytes:
    """The same parts give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in ({"[Content_Types].xml": TYPES, "_rels/.rels": ROOT} | parts).items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    return out.getvalue()
