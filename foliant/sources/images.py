"""Pictures: PNG pixels, and the sizes that PNG, GIF and JPEG files state."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("no png")
    at = 8
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def paeth(left: int, up: int, corner: int) -> int:
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    return left if a <= b and a <= c else up if b <= c else corner


def read_png(data: bytes) -> np.ndarray:
    """RGBA pixels (rows, columns, 4) of 8-bit pictures that aren't interlaced."""
    header, body, palette, alpha = None, b"", b"", b""
    for kind, chunk in png_chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"PLTE":
            palette = chunk
        elif kind == b"tRNS":
            alpha = chunk
    if header is None or header[2] != 8 or header[6]:
        raise ValueError("not an 8-bit png without interlace")
    width, height, _, colour = header[:4]
    n = CHANNELS[colour]
    raw, out, above = zlib.decompress(body), np.zeros((height, width * n), np.uint8), bytearray(width * n)
    for y in range(height):
        kind, line = raw[y * (width * n + 1)], bytearray(raw[y * (width * n + 1) + 1 : (y + 1) * (width * n + 1)])
        if kind == 2:
            line = bytearray((np.frombuffer(bytes(line), np.uint8) + np.frombuffer(bytes(above), np.uint8)).tobytes())
        elif kind:
            for x in range(len(line)):
                left, corner = (line[x - n], above[x - n]) if x >= n else (0, 0)
                line[x] = (line[x] + {1: left, 3: (left + above[x]) // 2, 4: paeth(left, above[x], corner)}[kind]) & 255
        out[y], above = np.frombuffer(bytes(line), np.uint8), line
    px = out.reshape(height, width, n)
    full = np.full((height, width, 1), 255, np.uint8)
    if colour == 3:
        table = np.full((256, 4), 255, np.uint8)
        table[: len(palette) // 3, :3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        table[: len(alpha), 3] = np.frombuffer(alpha, np.uint8)
        return table[px[:, :, 0]]
    grey = colour in (0, 4)
    return np.concatenate([np.repeat(px[:, :, :1], 3, 2) if grey else px[:, :, :3], px[:, :, -1:] if colour in (4, 6) else full], 2)


def size_of(data: bytes) -> tuple[str, int, int] | None:
    """(kind, width, height), null if it is none of the kinds."""
    if data[:8] == SIGNATURE and len(data) >= 24:
        return ("png", *struct.unpack_from(">II", data, 16))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("gif", *struct.unpack_from("<HH", data, 6))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            marker = data[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", data, at + 5)
                return ("jpeg", width, height)
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return None


def read_gif(data: bytes) -> np.ndarray:
    """RGBA pixels of a file's first frame."""
    kind = size_of(data)
    if not kind or kind[0] != "gif":
        raise ValueError("no gif")
    _, width, height = kind
    flags, at = data[10], 13
    table = data[at : at + 3 * (2 << (flags & 7))] if flags & 0x80 else b""
    at += len(table)
    clear_index, out = None, np.zeros((height, width, 4), np.uint8)
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9 and data[at + 3] & 1:
                clear_index = data[at + 6]
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        if own & 0x80:
            table = data[at : at + 3 * (2 << (own & 7))]
            at += len(table)
        least, at, body = data[at], at + 1, b""
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        index = np.frombuffer(_lzw(body, least)[: w * h].ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if own & 0x40:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            straight = np.zeros_like(index)
            straight[order] = index
            index = straight
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(table) // 3, :3] = np.frombuffer(table, np.uint8).reshape(-1, 3)
        colours[:, 3] = 255
        if clear_index is not None:
            colours[clear_index, 3] = 0
        part = colours[index][: max(0, height - top), : max(0, width - left)]
        out[top : top + part.shape[0], left : left + part.shape[1]] = part
        return out
    return out


def _lzw(body: bytes, least: int) -> bytes:
    clear, bits, at = 1 << least, least + 1, 0
    words, last, out = [bytes([k]) for k in range(clear)] + [b"", b""], b"", []
    held = int.from_bytes(body, "little")
    while at + bits <= 8 * len(body):
        code, at = held >> at & (1 << bits) - 1, at + bits
        if code == clear:
            words, bits, last = words[: clear + 2], least + 1, b""
            continue
        if code == clear + 1 or code > len(words):
            break
        word = words[code] if code < len(words) else last + last[:1]
        out.append(word)
        if last and len(words) < 4096:
            words.append(last + word[:1])
        if len(words) == 1 << bits and bits < 12:
            bits += 1
        last = word
    return b"".join(out)


def pixels_of(pictures: DataFrame) -> DataFrame:
    """(id, y, x, r, g, b, a) of PNG rows (id string, content); what can't be read gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    px = read_png(content.as_py())
                except (ValueError, KeyError, struct.error, zlib.error, TypeError):
                    continue
                y, x = np.mgrid[: px.shape[0], : px.shape[1]]
                cols = [y, x, *(px[:, :, k] for k in range(4))]
                yield pa.RecordBatch.from_arrays([pa.array([own] * y.size), *(pa.array(c.reshape(-1).astype(np.int32)) for c in cols)], ["id", "y", "x", "r", "g", "b", "a"])

    return pictures.mapInArrow(run, "id string, y int, x int, r int, g int, b int, a int")
