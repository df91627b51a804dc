"""PDF files of laid-out lines. The same lines give the same bytes: no clock is read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def number(value: float) -> str:
    """Fixed decimals without trailing zeros or exponent."""
    s = f"{value:.4f}".rstrip("0").rstrip(".")
    return "0" if s in ("-0", "") else s


def name(text: str) -> str:
    return "/" + "".join(chr(b) if 33 <= b <= 126 and chr(b) not in "()<>[]{}/%#" else f"#{b:02X}" for b in text.encode())


def string(text: str) -> str:
    """In the standard Latin encoding; what it lacks is a question mark."""
    return "(" + text.encode("cp1252", "replace").decode("latin-1").replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"


class Objects:
    """Numbered objects, the table of their places and the trailer. An object that is written twice or never is an error."""

    def __init__(self):
        self.written: list[bytes | None] = []

    def reserve(self) -> int:
        self.written.append(None)
        return len(self.written)

    def write(self, at: int, body: str, stream: bytes | None = None) -> int:
        if self.written[at - 1] is not None:
            raise ValueError(f"object {at} is written twice")
        data = body.encode("latin-1")
        if stream is not None:
            data = data[:-2] + f"/Length {len(stream)}>>\nstream\n".encode() + stream + b"\nendstream"
        self.written[at - 1] = data
        return at

    def add(self, body: str, stream: bytes | None = None) -> int:
        return self.write(self.reserve(), body, stream)

    def file(self, root: int) -> bytes:
        out, places = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n", []
        for k, data in enumerate(self.written, 1):
            if data is None:
                raise ValueError(f"object {k} is not written")
            places.append(len(out))
            out += f"{k} 0 obj\n".encode() + data + b"\nendobj\n"
        table = "".join(f"{p:010d} 00000 n \n" for p in places)
        return out + f"xref\n0 {len(places) + 1}\n0000000000 65535 f \n{table}trailer\n<</Size {len(places) + 1}/Root {root} 0 R>>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def write_pdf(pages: list[list[str]], width: float = 612, height: float = 792, margin: float = 72, size: float = 10, leading: float = 14) -> bytes:
    """One page for each list of lines, from the top margin down."""
    objects = Objects()
    tree = objects.reserve()
    font = objects.add("<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>")
    kids = []
    for lines in pages:
        ops = [f"BT /F1 {number(size)} Tf {number(leading)} TL 1 0 0 1 {number(margin)} {number(height - margin - size)} Tm"]
        ops += [f"{string(line)} Tj T*" for line in lines]
        content = objects.add("<</Filter/FlateDecode>>", zlib.compress("\n".join([*ops, "ET"]).encode("latin-1"), 9))
        kids.append(objects.add(f"<</Type/Page/Parent {tree} 0 R/MediaBox[0 0 {number(width)} {number(height)}]/Resources<</Font<</F1 {font} 0 R>>>>/Contents {content} 0 R>>"))
    objects.write(tree, f"<</Type/Pages/Count {len(kids)}/Kids[{' '.join(f'{k} 0 R' for k in kids)}]>>")
    return objects.file(objects.add(f"<</Type/Catalog/Pages {tree} 0 R>>"))


def pdf_of_stories(stories: DataFrame, key: str, text: str, room: int, page_lines: int) -> DataFrame:
    """(key, pages, content): each story laid out and written. A story is a row, so none is gathered."""
    from foliant.operators.lines import break_lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                part, counts, files = batch.slice(i, 32), [], []
                for story in part.column(1).to_pylist():
                    lines = [x.text for p in (story or "").split("\n") for x in break_lines(p, room)]
                    pages = [lines[k : k + page_lines] for k in range(0, len(lines), page_lines)]
                    counts.append(len(pages))
                    files.append(write_pdf(pages))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int32()), pa.array(files, pa.binary())], [key, "pages", "content"])

    return stories.select(key, text).mapInArrow(run, f"{key} {stories.schema[key].dataType.simpleString()}, pages int, content binary")
