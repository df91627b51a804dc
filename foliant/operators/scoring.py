"""Scores of a layout against another renderer's pages: which lines it places alike, and what each page's shape says."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

# Fixed values, in points: what is near, what is visible; shares that explain; the least matched lines.
NEAR, VISIBLE, EXPLAINED, CLUSTER, NUMBER_NEAR = 1.0, 3.0, 0.95, 3, 3.0


@dataclass(frozen=True)
class Item:
    text: str
    left: float
    baseline: float


def out_of_symbol_page(text: str) -> str:
    """A symbol font's bullet, and its other characters in the Latin page."""
    return "".join("\u2022" if c == "\uf0b7" else chr(ord(c) - 0xF000) if 0xF020 <= ord(c) <= 0xF0FF else c for c in text)


def normalised(text: str) -> str:
    return out_of_symbol_page(" ".join(text.replace("\0", "").split()))


def ink(text: str) -> str:
    return re.sub(r"\s+", "", text)


def items_for(text: str, drawn: Sequence[Item], taken: set[int]) -> list[int] | None:
    """The shortest run of unclaimed items, left to right, that spells a line's ink; the first of equal ones."""
    want, best = ink(normalised(text)), None
    if not want:
        return None
    for start in range(len(drawn)):
        if start in taken or not ink(drawn[start].text):
            continue
        spelled, run = "", []
        for k in range(start, len(drawn)):
            if k in taken or (run and drawn[k].left < drawn[run[-1]].left and ink(drawn[k].text)):
                break
            spelled += ink(normalised(drawn[k].text))
            run.append(k)
            if not want.startswith(spelled):
                break
            if spelled == want:
                if best is None or len(run) < len(best):
                    best = run
                break
    return best


def matched(lines: Sequence[Item], drawn: Sequence[Item]) -> list[tuple[Item, Item]]:
    """Each line with the first item of its run; a run is claimed once."""
    taken: set[int] = set()
    out = []
    for line in lines:
        run = items_for(line.text, drawn, taken)
        if run:
            taken.update(run)
            out.append((line, drawn[run[0]]))
    return out


def nearest_numbers(numbers: Sequence[Item], drawn: Sequence[Item], taken: set[int] | None = None) -> list[tuple[int, int]]:
    """(number, item): same text, baselines within NUMBER_NEAR, the nearest left edge, each item once."""
    taken = set() if taken is None else taken
    out = []
    for k, n in enumerate(numbers):
        near = [j for j, d in enumerate(drawn) if j not in taken and ink(normalised(d.text)) == ink(normalised(n.text)) and abs(d.baseline - n.baseline) <= NUMBER_NEAR]
        if near:
            j = min(near, key=lambda j: (abs(drawn[j].left - n.left), j))
            taken.add(j)
            out.append((k, j))
    return out


def middle(values: Sequence[float]) -> float | None:
    return sorted(values)[len(values) // 2] if values else None


def slope(points: Sequence[tuple[float, float]]) -> float:
    """Least squares; 0 without spread."""
    n = len(points)
    if not n:
        return 0.0
    mx, my = sum(x for x, _ in points) / n, sum(y for _, y in points) / n
    spread = sum((x - mx) ** 2 for x, _ in points)
    return sum((x - mx) * (y - my) for x, y in points) / spread if spread else 0.0


def crossings(values: Sequence[float], least: float = VISIBLE) -> int:
    most, n = -math.inf, 0
    for v in values:
        n += v < most - least
        most = max(most, v)
    return n


def explaining_offset(moves: Sequence[tuple[float, float]], tolerance: float = NEAR) -> tuple[tuple[float, float], float]:
    """The offset, of medians or of means without the outer tenths, that most moves are near to, and their share."""

    def trimmed(values: list[float]) -> float:
        cut = len(values) // 10
        kept = sorted(values)[cut : len(values) - cut]
        return sum(kept) / len(kept)

    xs, ys = [x for x, _ in moves], [y for _, y in moves]
    share = lambda o: sum(math.hypot(x - o[0], y - o[1]) <= tolerance for x, y in moves) / len(moves)
    options = [(middle(xs), middle(ys)), (trimmed(xs), trimmed(ys))]
    best = max(options, key=share)
    return best, share(best)


def shape_of(pairs: Sequence[tuple[Item, Item]]) -> str:
    """agrees, shifted, drifting or deformed."""
    moves = [(b.left - a.left, b.baseline - a.baseline) for a, b in pairs]
    if not moves or max(math.hypot(x, y) for x, y in moves) <= VISIBLE:
        return "agrees"
    if len(moves) < CLUSTER or explaining_offset(moves)[1] >= EXPLAINED:
        return "shifted"
    order = sorted(pairs, key=lambda p: p[0].baseline)
    straight = 1 - crossings([b.baseline for _, b in order]) / len(order)
    level = sum(abs(x) <= NEAR for x, _ in moves) / len(moves)
    return "drifting" if min(straight, level) >= EXPLAINED else "deformed"


def agreement(pages: Sequence[tuple[Sequence[Item], Sequence[Item]]]) -> dict[str, int | list[str]]:
    """lines, matched, placed (within NEAR) and each page's shape."""
    out: dict = {"lines": 0, "matched": 0, "placed": 0, "shapes": []}
    for ours, theirs in pages:
        pairs = matched(ours, theirs)
        out["lines"] += len(ours)
        out["matched"] += len(pairs)
        out["placed"] += sum(math.hypot(b.left - a.left, b.baseline - a.baseline) <= NEAR for a, b in pairs)
        shape = shape_of(pairs)
        ours_ink, theirs_ink = (sum(len(ink(i.text)) for i in items) for items in (ours, theirs))
        if shape != "deformed" and (theirs_ink > 1.05 * ours_ink or (ours_ink and not theirs_ink)):
            shape = "missing"
        out["shapes"].append(shape)
    return out
