"""Font files as tables: metrics, advances and kerning by code point.

Reads sfnt files, woff files and collections. What a file can't say is a null or a missing row, not an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

U16, I16 = struct.Struct(">H"), struct.Struct(">h")


def u16(b: bytes, at: int) -> int:
    return U16.unpack_from(b, at)[0]


def i16(b: bytes, at: int) -> int:
    return I16.unpack_from(b, at)[0]


def u32(b: bytes, at: int) -> int:
    return struct.unpack_from(">I", b, at)[0]


def sfnt_tables(data: bytes, at: int = 0) -> dict[str, bytes]:
    out = {}
    for k in range(u16(data, at + 4)):
        tag, _, offset, length = struct.unpack_from(">4sIII", data, at + 12 + 16 * k)
        out[tag.decode("latin-1")] = data[offset : offset + length]
    return out


def woff_tables(data: bytes) -> dict[str, bytes]:
    out = {}
    for k in range(u16(data, 12)):
        tag, offset, packed, length, _ = struct.unpack_from(">4sIIII", data, 44 + 20 * k)
        own = data[offset : offset + packed]
        out[tag.decode("latin-1")] = zlib.decompress(own) if packed < length else own
    return out


def faces_of(data: bytes) -> list[dict[str, bytes]]:
    """The tables of each face in a file. ValueError if it is no font."""
    kind = data[:4]
    if kind == b"ttcf":
        return [sfnt_tables(data, u32(data, 12 + 4 * k)) for k in range(u32(data, 8))]
    if kind == b"wOFF":
        return [woff_tables(data)]
    if kind in (b"\0\1\0\0", b"OTTO", b"true"):
        return [sfnt_tables(data)]
    raise ValueError("font-unreadable")


def name_of(tables: dict[str, bytes], wanted: int) -> str | None:
    """A name in Unicode if there is one, else in Latin."""
    t = tables.get("name")
    if not t:
        return None
    base, latin = u16(t, 4), None
    for k in range(u16(t, 2)):
        platform, _, _, name, length, offset = struct.unpack_from(">6H", t, 6 + 12 * k)
        if name == wanted:
            raw = t[base + offset : base + offset + length]
            if platform in (0, 3):
                return raw.decode("utf-16-be", "replace")
            latin = latin or raw.decode("latin-1")
    return latin


def style_of(tables: dict[str, bytes]) -> tuple[bool, bool]:
    """(bold, italic)"""
    if len(tables.get("OS/2", b"")) >= 64:
        selection = u16(tables["OS/2"], 62)
        return bool(selection & 32), bool(selection & 1)
    mac = u16(tables["head"], 44) if len(tables.get("head", b"")) >= 46 else 0
    return bool(mac & 1), bool(mac & 2)


#: Character maps by platform and encoding, best first: fixed value.
BEST = [(3, 10), (0, 6), (0, 4), (3, 1), (0, 3), (0, 2), (0, 1), (0, 0), (3, 0), (1, 0)]


def characters(tables: dict[str, bytes]) -> dict[int, int]:
    """Code point to glyph, from the best map whose format is 0, 4, 6, 12 or 13."""
    t = tables.get("cmap")
    if not t:
        return {}
    maps = {struct.unpack_from(">HH", t, 4 + 8 * k): u32(t, 8 + 8 * k) for k in range(u16(t, 2))}
    for key in BEST:
        if key in maps and (found := _subtable(t, maps[key])) is not None:
            return found
    return {}


def _subtable(t: bytes, at: int) -> dict[int, int] | None:
    kind = u16(t, at)
    if kind == 0:
        return {c: g for c, g in enumerate(t[at + 6 : at + 262]) if g}
    if kind == 6:
        first, n = u16(t, at + 6), u16(t, at + 8)
        return {first + k: g for k in range(n) if (g := u16(t, at + 10 + 2 * k))}
    if kind == 4:
        n, out = u16(t, at + 6) // 2, {}
        ends, starts, deltas, offsets = at + 14, at + 16 + 2 * n, at + 16 + 4 * n, at + 16 + 6 * n
        for k in range(n):
            first, last, delta, offset = u16(t, starts + 2 * k), u16(t, ends + 2 * k), u16(t, deltas + 2 * k), u16(t, offsets + 2 * k)
            for c in range(first, min(last, 0xFFFE) + 1):
                g = c if not offset else u16(t, offsets + 2 * k + offset + 2 * (c - first))
                if g and (g := (g + delta) & 0xFFFF) or (not offset and (g := (c + delta) & 0xFFFF)):
                    out[c] = g
        return out
    if kind in (12, 13):
        out = {}
        for k in range(u32(t, at + 12)):
            first, last, glyph = struct.unpack_from(">III", t, at + 16 + 12 * k)
            out.update((c, glyph + (c - first if kind == 12 else 0)) for c in range(first, last + 1))
        return out
    return None


def metrics(tables: dict[str, bytes]) -> dict[str, int]:
    """upm, ascender, descender, line_gap, n_advances. KeyError if a table is missing."""
    head, hhea = tables["head"], tables["hhea"]
    return {"upm": u16(head, 18), "ascender": i16(hhea, 4), "descender": i16(hhea, 6), "line_gap": i16(hhea, 8), "n_advances": u16(hhea, 34)}


def advances(tables: dict[str, bytes]) -> dict[int, int]:
    """Code point to advance in units; glyphs beyond the table have its last advance."""
    n, hmtx = metrics(tables)["n_advances"], tables["hmtx"]
    return {c: u16(hmtx, 4 * min(g, n - 1)) for c, g in characters(tables).items()}


def kerning(tables: dict[str, bytes]) -> dict[tuple[int, int], int]:
    """Glyph pairs of the kern table's horizontal subtables of format 0."""
    t, out = tables.get("kern"), {}
    if not t or u16(t, 0) != 0:
        return out
    at = 4
    for _ in range(u16(t, 2)):
        length, coverage = u16(t, at + 2), u16(t, at + 4)
        if coverage >> 8 == 0 and coverage & 1 and not coverage & 6:
            for k in range(u16(t, at + 6)):
                left, right, units = struct.unpack_from(">HHh", t, at + 14 + 6 * k)
                out[left, right] = units
        at += length
    return out


def underline(tables: dict[str, bytes]) -> tuple[int, int] | None:
    """(position, thickness) in units."""
    post = tables.get("post", b"")
    return (i16(post, 8), i16(post, 10)) if len(post) >= 12 else None


FACES = "file string, face_idx int, family string, bold boolean, italic boolean, upm int, ascender int, descender int, line_gap int, advances map<int,int>, error string"


def read_faces(files: DataFrame) -> DataFrame:
    """A row for each face of (file, content), with advances by code point; a file that can't be read has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), *[pa.int32()] * 4, pa.map_(pa.int32(), pa.int32()), pa.string()]
        names = ["file", "face_idx", "family", "bold", "italic", "upm", "ascender", "descender", "line_gap", "advances", "error"]
        for batch in batches:
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for k, t in enumerate(faces_of(content.as_py() or b"")):
                        m = metrics(t)
                        rows.append((file, k, name_of(t, 1), *style_of(t), m["upm"], m["ascender"], m["descender"], m["line_gap"], list(advances(t).items()), None))
                except (ValueError, KeyError, struct.error, zlib.error, IndexError) as e:
                    rows.append((file, None, None, None, None, None, None, None, None, None, "font-unreadable" if isinstance(e, ValueError) else "font-malformed"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names)

    return files.mapInArrow(run, FACES)
