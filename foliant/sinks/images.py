"""PNG files of RGBA pixels, and two rasters laid over each other."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from foliant.sources.images import SIGNATURE


def write_png(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, -1)], 1)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def ink(pixels: np.ndarray) -> np.ndarray:
    """0 for white to 1 for black, by alpha."""
    return (1 - pixels[:, :, :3].mean(2) / 255) * (pixels[:, :, 3] / 255)


def overlay(ours: np.ndarray | None, theirs: np.ndarray | None) -> np.ndarray:
    """Ours in red, theirs in green, both in black; a missing one is blank."""
    shapes = [p.shape[:2] for p in (ours, theirs) if p is not None]
    height, width = (max(s[k] for s in shapes) for k in (0, 1))
    a, b = np.zeros((height, width)), np.zeros((height, width))
    for p, into in ((ours, a), (theirs, b)):
        if p is not None:
            into[: p.shape[0], : p.shape[1]] = ink(p)
    out = np.full((height, width, 4), 255, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = np.round(255 * (1 - b)), np.round(255 * (1 - a)), np.round(255 * (1 - np.maximum(a, b)))
    return out
