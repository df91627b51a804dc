import random

import pytest

from foliant.operators import geometry as G
from foliant.operators import scoring as S


def test_spans_beside_bands():
    b = G.Band(200, 300, 100, 150)
    assert G.free_spans(36, 576, [b]) == [(36, 200), (300, 576)]
    assert G.free_spans(36, 576, [G.Band(200, 300, 0, 9, "left")]) == [(36, 200)] and G.free_spans(36, 576, [G.Band(200, 300, 0, 9, "right")]) == [(300, 576)]
    assert G.fit_line(36, 576, 100, 12, 100, [b]) == (100, 36, 200) and G.fit_line(36, 576, 100, 12, 200, [b]) == (100, 300, 576)
    top, left, right = G.fit_line(36, 576, 100, 12, 400, [b])
    assert (top, left, right) == (150, 36, 576)
    rnd = random.Random(1)
    for _ in range(200):
        bands = [G.Band(a := rnd.randint(0, 90), a + rnd.randint(1, 30), 0, 1) for _ in range(rnd.randint(0, 6))]
        free = [x for x in range(100) if not any(b.left <= x < b.right for b in bands)]
        assert [x for a, b in G.free_spans(0, 100, bands) for x in range(int(a), int(b))] == free


def test_outlines():
    triangle = ((0, 0), (100, 0), (50, 100))
    assert G.across(triangle, 50, 50) == (25, 75) and G.across(triangle, 200, 300) is None
    assert G.beside(G.Band(0, 100, 0, 100, outline=triangle), 40, 60).left == 20


def test_tabs_and_columns():
    stops = G.tab_stops([(72, "stop", "right"), (36, "stop", "left"), (36, "clear", "left"), (90, "stop", "bar")], hanging_at=18)
    assert stops == [(18, "left"), (72, "right")] and G.next_stop(18, stops) == (72, "right") and G.next_stop(80, stops) == (108, "left") and G.next_stop(72, []) == (108, "left")
    assert G.after_tab(10, 72, "right", 20, 5) == 52 and G.after_tab(60, 72, "center", 40, 5) == 60 and G.after_tab(0, 72, "decimal", 40, 5) == 67
    assert G.columns_across(10, 208, 2, 8) == [(10, 100), (118, 100)] and G.columns_across(0, 99, 2, widths=[30, 60], gaps=[9]) == [(0, 30), (39, 60)]
    assert G.balanced([10] * 6, 2, 100) == [[0, 1, 2], [3, 4, 5]] and G.balanced([30, 10, 10], 2, 100) == [[0], [1, 2]]


def test_tables():
    C = G.Cell
    rows = [[C(0, 50, "restart"), C(1, 10)], [C(0, 0, "continue"), C(1, 12)], [C(0, 5), C(1, 5)]]
    assert G.row_heights(rows, [(1, 1)] * 3, [None] * 3) == [12, 40, 7]
    assert G.row_heights(rows, [(1, 1)] * 3, [None, (9, True), (20, False)]) == [12, 10, 22]
    got = G.settled_borders([[{}, {"left": None}], [{"top": 3}, {}]], {"top": 1, "bottom": 1, "left": 1, "right": 1, "insideH": 2, "insideV": 0.5})
    assert got[0][0] == {"top": 1, "bottom": 3, "left": 1, "right": 0.5} and got[1][0]["top"] == 3 and got[0][1]["left"] == 0.5 and got[0][1]["bottom"] == 2


def test_lines():
    assert G.seated(12, 9, 11, "exact", 20) == (20, 16, 20) and G.seated(12, 9, 11, "atLeast", 20) == (20, 17, 20) and G.seated(12, 9, 11, "auto", 480) == (23, 9, 12) and G.seated(12, 9, 11, None) == (12, 9, 12)
    assert G.line_start(0, 100, 40, "center") == 30 and G.line_start(0, 100, 40, "right") == 60 and G.justified(80, 4, 100) == 5
    assert G.squeeze([4, 4], 4) == pytest.approx(min(2, 4 * (1 / 3 + 0.2307 / 1.5))) and G.squeeze([], 4) == 0


def test_anchors_and_turns():
    page = G.Page(612, 792, 72, 72, 72, 72)
    assert G.placed(G.horizontal_band(page, "margin"), 100, align="center") == 256 and G.placed(G.horizontal_band(page, "page"), 100, offset=10) == 10 and G.placed(G.horizontal_band(page, "rightMargin"), 10, align="right") == 602
    assert G.turned(10, 0, (0, 0), 90) == pytest.approx((0, 10)) and G.bounds_of_turn(0, 0, 100, 50, 90) == pytest.approx((25, -25, 50, 100))


def test_what_cannot_be_shown():
    assert G.off_sheet([(0, 0, 10, 10), (-20, 0, -5, 10), (0, 800, 10, 810)], 612, 792) == (2, 8)
    rnd = random.Random(2)
    for _ in range(50):
        lines = [(rnd.randint(0, 3), x := rnd.randint(0, 80), y := rnd.randint(0, 80), x + rnd.randint(1, 30), y + rnd.randint(1, 20)) for _ in range(12)]
        over = set()
        for i, a in enumerate(lines):
            for j, b in enumerate(lines):
                share = lambda k: min(a[k + 2], b[k + 2]) - max(a[k], b[k]) > 0.35 * min(a[k + 2] - a[k], b[k + 2] - b[k])  # noqa: E731, B023
                if i != j and a[0] != b[0] and share(1) and share(2):
                    over.add(i)
        assert G.overlapping(lines) == len(over)


def test_agreement():
    I = S.Item
    ours = [I("Hello world", 72, 100), I("Second line", 72, 114), I("Third", 72, 128)]
    same = [I("Hello", 72, 100), I(" world", 100, 100), I("Second line", 72, 114.5), I("Third", 72, 128)]
    assert S.agreement([(ours, same)]) == {"lines": 3, "matched": 3, "placed": 3, "shapes": ["agrees"]}
    moved = [I(i.text, i.left, i.baseline + 20) for i in ours]
    drift = [I(i.text, i.left, i.baseline * 1.2) for i in ours]
    wild = [I("Hello world", 172, 128), I("Second line", 10, 100), I("Third", 300, 114)]
    assert [S.shape_of(S.matched(ours, x)) for x in (moved, drift, wild)] == ["shifted", "drifting", "deformed"]
    assert S.agreement([(ours[:1], ours)])["shapes"] == ["missing"] and S.items_for("", same, set()) is None
    assert S.nearest_numbers([I("1.", 10, 100), I("1.", 50, 100)], [I("1.", 49, 101), I("1.", 11, 99), I("1.", 10, 200)]) == [(0, 1), (1, 0)]
    assert S.normalised("\uf0b7\0 a\uf041") == "\u2022 aA" and S.crossings([1, 10, 2, 11, 7]) == 2 and S.slope([(0, 0), (1, 2), (2, 4)]) == 2 and S.slope([(1, 1)]) == 0
