"""Lengths: integer units of the file format to points. Stated numbers as the format spells them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
TWIPS_PER_POINT = 20
EMU_PER_POINT = 12700
DEVICE_DOTS_PER_INCH = 300
POINTS_PER_INCH = 72
LEAST_FONT_PT = 0.5
DEFAULT_FONT_PT = 10.0
AUTOMATIC_SPACE_TWIPS = 280
DEFAULT_TAB_TWIPS = 720
CELL_SIDE_MARGIN_TWIPS = 108
SCRIPT_SIZE = 0.65
SMALL_CAPITAL_SIZE = 0.8

EPSILON = 1e-9


def twips_to_points(c: Column) -> Column:
    return c / F.lit(TWIPS_PER_POINT)


def emu_to_points(c: Column) -> Column:
    return c / F.lit(EMU_PER_POINT)


def half_up(c: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(c + F.lit(0.5))


def stated_number(c: Column) -> Column:
    """An absent attribute is unstated (null), an empty one is zero; hex is allowed."""
    t = F.trim(c)
    return F.when(c.isNull(), F.lit(None).cast("double")).when(t == "", F.lit(0.0)).when(t.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(t, 3, 64), 16, 10).cast("double")).otherwise(t.try_cast("double"))


def on_device_grid(pt: Column) -> Column:
    return half_up(pt * DEVICE_DOTS_PER_INCH / POINTS_PER_INCH) * POINTS_PER_INCH / DEVICE_DOTS_PER_INCH


def small_capital_size(pt: Column) -> Column:
    return half_up(pt * SMALL_CAPITAL_SIZE * 2) / 2


def line_height(size: Column, ascender: Column, descender: Column, gap: Column, upm: Column) -> Column:
    return size * (ascender - descender + gap) / upm


def turns_on_its_side(degrees: Column) -> Column:
    turn = F.pmod(degrees, F.lit(180))
    return (turn >= 45) & (turn < 135)


def states_on(c: Column) -> Column:
    return ~F.lower(c).isin("0", "false", "off")


def up_from_top(page_height: Column, down: Column) -> Column:
    return page_height - down


def bottom_of(page_height: Column, top: Column, height: Column) -> Column:
    return page_height - top - height
