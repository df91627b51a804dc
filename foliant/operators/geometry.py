"""Geometry of laid-out pages: spans beside bands, tab stops, columns, table heights, anchors, turns. Plain functions for
the folds inside a document's task; lengths are points, comparisons forgive EPSILON."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from foliant.functions.units import EPSILON

#: The least span that text goes into; least room and share that count as an overlap.
LEAST_SPAN, OFF_SHEET_PT, OVERLAP_SHARE = 18.0, 1.5, 0.35


# Wrapping


@dataclass(frozen=True)
class Band:
    """What text keeps clear of. side: both, left, right (text stands there only). outline: corners, else a rectangle."""

    left: float
    right: float
    top: float
    bottom: float
    side: str = "both"
    outline: tuple[tuple[float, float], ...] = field(default=())


def across(outline: Sequence[tuple[float, float]], top: float, bottom: float) -> tuple[float, float] | None:
    """Extent of a polygon between two heights."""
    xs: list[float] = []
    for (x0, y0), (x1, y1) in zip(outline, [*outline[1:], *outline[:1]], strict=True):
        low, high = min(y0, y1), max(y0, y1)
        if high < top or low > bottom:
            continue
        for y in (max(low, top), min(high, bottom)):
            xs.append(x0 if y1 == y0 else x0 + (x1 - x0) * (y - y0) / (y1 - y0))
        if y0 == y1:
            xs += [x0, x1]
    return (min(xs), max(xs)) if xs else None


def crosses(band: Band, top: float, bottom: float) -> bool:
    """A rectangle: if they overlap; an outline: if it stands at the line's middle."""
    if band.outline:
        middle = (top + bottom) / 2
        return band.top < middle < band.bottom
    return band.top < bottom - EPSILON and band.bottom > top + EPSILON


def beside(band: Band, top: float, bottom: float) -> Band:
    """The band as wide as its outline is beside a line."""
    extent = across(band.outline, top, bottom) if band.outline else None
    return Band(*extent, band.top, band.bottom, band.side) if extent else band


def free_spans(left: float, right: float, bands: Sequence[Band]) -> list[tuple[float, float]]:
    """What bands leave of an extent; a one-sided band forbids the spans on its other side."""
    out, at = [], left
    for b in sorted(bands, key=lambda b: (b.left, b.right)):
        if b.left > at:
            out.append((at, min(b.left, right)))
        at = max(at, b.right)
    if at < right:
        out.append((at, right))
    for b in bands:
        if b.side == "left":
            out = [s for s in out if s[0] < b.left]
        elif b.side == "right":
            out = [s for s in out if s[1] > b.right]
    return [s for s in out if s[1] - s[0] > EPSILON]


def fit_line(left: float, right: float, top: float, height: float, width: float, bands: Sequence[Band]) -> tuple[float, float, float]:
    """(top, left, right) of the first place from top down with room for width: beside the bands, or past the nearest foot of one."""
    while True:
        met = [beside(b, top, top + height) for b in bands if crosses(b, top, top + height)]
        if not met:
            return top, left, right
        for a, b in free_spans(left, right, met):
            if b - a + EPSILON >= max(width, LEAST_SPAN):
                return top, a, b
        feet = [top + height if b.outline else b.bottom for b in bands if crosses(b, top, top + height)]
        top = max(min(feet), top + EPSILON * 10)


# Tabs and columns


def tab_stops(declared: Sequence[tuple[float, str, str]], hanging_at: float | None = None) -> list[tuple[float, str]]:
    """(position, alignment) in order: later entries of a position count, clear and bar are no stops; a hanging indent is one."""
    last: dict[float, tuple[str, str]] = {}
    for position, kind, alignment in declared:
        last[position] = (kind, alignment)
    out = {p: a for p, (kind, a) in last.items() if kind == "stop" and a != "bar"}
    if hanging_at is not None:
        out.setdefault(hanging_at, "left")
    return sorted(out.items())


def next_stop(at: float, stops: Sequence[tuple[float, str]], default: float = 36.0) -> tuple[float, str]:
    for p, a in stops:
        if p > at + EPSILON:
            return p, a
    return (math.floor(at / default + EPSILON) + 1) * default, "left"


def after_tab(filled: float, stop: float, alignment: str, span: float, before_point: float) -> float:
    """Where what follows a tab starts."""
    lead = {"left": 0.0, "center": span / 2, "right": span, "decimal": before_point}.get(alignment, 0.0)
    return max(filled, stop - lead)


def columns_across(left: float, width: float, count: int, space: float = 36.0, widths: Sequence[float] = (), gaps: Sequence[float] = ()) -> list[tuple[float, float]]:
    """(left, width): as stated if every column has a width, else equal."""
    if len(widths) >= count:
        out, at = [], left
        for k in range(count):
            out.append((at, widths[k]))
            at += widths[k] + (gaps[k] if k < len(gaps) else space)
        return out
    each = (width - space * (count - 1)) / count
    return [(left + k * (each + space), each) for k in range(count)]


def balanced(heights: Sequence[float], columns: int, room: float) -> list[list[int]]:
    """Blocks to columns: the least height, tried from each block's foot upward, that holds all; at room if none does."""

    def fill(height: float) -> list[list[int]]:
        out: list[list[int]] = [[]]
        used = 0.0
        for k, h in enumerate(heights):
            if out[-1] and used + h > height + EPSILON and len(out) < columns:
                out.append([])
                used = 0.0
            out[-1].append(k)
            used += h
        return out

    feet = sorted({sum(heights[i:j]) for i in range(len(heights)) for j in range(i + 1, len(heights) + 1)})
    for height in [f for f in feet if f <= room + EPSILON]:
        filled = fill(height)
        if all(sum(heights[k] for k in c) <= height + EPSILON for c in filled):
            return filled
    return fill(room)


# Tables


@dataclass(frozen=True)
class Cell:
    grid_at: int
    height: float
    merge: str | None = None  # restart, continue


def row_heights(rows: Sequence[Sequence[Cell]], margins: Sequence[tuple[float, float]], stated: Sequence[tuple[float, bool] | None]) -> list[float]:
    """Margins (top, bottom) and the tallest content or what is stated; exact rows have what is stated over the bottom
    margin. What a merge lacks goes to its last row, merges by ascending last row, exact rows excepted."""
    out = []
    for cells, (top, bottom), own in zip(rows, margins, stated, strict=True):
        content = max((c.height for c in cells if c.merge is None), default=0.0)
        out.append(bottom + own[0] if own and own[1] else top + bottom + max(content, own[0] if own else 0.0))
    merges = []
    for r, cells in enumerate(rows):
        for c in (c for c in cells if c.merge == "restart"):
            last = r
            while last + 1 < len(rows) and any(d.grid_at == c.grid_at and d.merge == "continue" for d in rows[last + 1]):
                last += 1
            merges.append((last, r, c.height + sum(margins[r])))
    for last, first, need in sorted(merges):
        lack = need - sum(out[first : last + 1])
        if lack > 0 and not (stated[last] and stated[last][1]):
            out[last] += lack
    return out


def settled_borders(grid: Sequence[Sequence[dict[str, float | None]]], table: dict[str, float | None]) -> list[list[dict[str, float | None]]]:
    """Widths of each cell's sides: its own if stated (null: stated as none), else the table's outer or inside border; of
    two that share an edge the wider, the first (above, left) of equal ones."""
    rows, out = len(grid), []
    for r, cells in enumerate(grid):
        line = []
        for c, own in enumerate(cells):
            behind = {"top": "top" if r == 0 else "insideH", "bottom": "bottom" if r == rows - 1 else "insideH", "left": "left" if c == 0 else "insideV", "right": "right" if c == len(cells) - 1 else "insideV"}
            line.append({side: own[side] if side in own else table.get(b) for side, b in behind.items()})
        out.append(line)
    wider = lambda a, b: b if a is None else a if b is None or a >= b else b
    for r in range(rows):
        for c in range(len(out[r])):
            if c + 1 < len(out[r]):
                out[r][c]["right"] = out[r][c + 1]["left"] = wider(out[r][c]["right"], out[r][c + 1]["left"])
            if r + 1 < rows and c < len(out[r + 1]):
                out[r][c]["bottom"] = out[r + 1][c]["top"] = wider(out[r][c]["bottom"], out[r + 1][c]["top"])
    return out


# Lines


def seated(natural: float, ascent: float, font_height: float, rule: str | None, asked: float = 0.0) -> tuple[float, float, float]:
    """(height, baseline, height that counts for the page) of a line under a line rule; auto asks in 240ths of the font's height."""
    if rule == "exact":
        return asked, 0.8 * asked, asked
    if rule == "atLeast":
        height = max(natural, asked)
        return height, ascent + height - natural, height
    if rule == "auto":
        return natural + (asked / 240 - 1) * font_height, ascent, natural
    return natural, ascent, natural


def line_start(start: float, end: float, content: float, alignment: str) -> float:
    return {"center": start + (end - start - content) / 2, "right": end - content}.get(alignment, start)


def squeeze(gaps: Sequence[float], space_advance: float) -> float:
    """How much a justified line may shrink."""
    n = len(gaps)
    return min(sum(gaps) / 4, space_advance * (1 / 3 + 0.2307 / (n - 0.5))) if n else 0.0


def justified(width: float, gaps: int, room: float) -> float:
    """What each gap gets."""
    return (room - width) / gaps if gaps and room > width else 0.0


# Anchors and turns


@dataclass(frozen=True)
class Page:
    width: float
    height: float
    left: float
    right: float
    top: float
    bottom: float


def horizontal_band(page: Page, origin: str, column: tuple[float, float] | None = None, character: float | None = None) -> tuple[float, float]:
    """(left, width) that an offset or alignment is measured in."""
    inner = (page.left, page.width - page.left - page.right)
    return {"page": (0.0, page.width), "margin": inner, "column": column or inner, "character": (character if character is not None else inner[0], 0.0), "leftMargin": (0.0, page.left), "rightMargin": (page.width - page.right, page.right)}.get(origin, inner)


def placed(band: tuple[float, float], size: float, offset: float | None = None, align: str | None = None) -> float:
    """An alignment beats an offset."""
    start, extent = band
    if align in ("center", "right", "bottom"):
        return start + (extent - size) / (2 if align == "center" else 1)
    return start if align else start + (offset or 0.0)


def turned(x: float, y: float, about: tuple[float, float], degrees: float) -> tuple[float, float]:
    a = math.radians(degrees)
    dx, dy = x - about[0], y - about[1]
    return about[0] + dx * math.cos(a) - dy * math.sin(a), about[1] + dx * math.sin(a) + dy * math.cos(a)


def bounds_of_turn(left: float, top: float, width: float, height: float, degrees: float) -> tuple[float, float, float, float]:
    """(left, top, width, height) that a turned rectangle takes."""
    a = math.radians(degrees)
    w, h = abs(width * math.cos(a)) + abs(height * math.sin(a)), abs(width * math.sin(a)) + abs(height * math.cos(a))
    return left + (width - w) / 2, top + (height - h) / 2, w, h


# What can't be shown


def off_sheet(lines: Sequence[tuple[float, float, float, float]], width: float, height: float) -> tuple[int, float]:
    """(lines, worst) of those wholly off a page: (left, top, right, bottom)."""
    beyond = [max(-r, left - width, -b, top - height) for left, top, r, b in lines]
    out = [d for d in beyond if d > OFF_SHEET_PT]
    return len(out), max(out, default=0.0)


def overlapping(lines: Sequence[tuple[int, float, float, float, float]]) -> int:
    """Lines (paragraph, left, top, right, bottom) that lie over another paragraph's by a share of the smaller in both directions. A sweep by tops."""
    order = sorted(range(len(lines)), key=lambda k: (lines[k][2], k))
    over: set[int] = set()
    standing: list[int] = []
    for k in order:
        p, left, top, right, bottom = lines[k]
        standing = [j for j in standing if lines[j][4] > top]
        for j in standing:
            q, left_j, top_j, right_j, bottom_j = lines[j]
            wide = min(right, right_j) - max(left, left_j) > OVERLAP_SHARE * min(right - left, right_j - left_j)
            deep = min(bottom, bottom_j) - max(top, top_j) > OVERLAP_SHARE * min(bottom - top, bottom_j - top_j)
            if p != q and wide and deep:
                over |= {j, k}
        standing.append(k)
    return len(over)
