"""Colours: RRGGBB to and from hue, saturation and luminance; blends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.units import half_up


def channel(rgb: Column, k: int) -> Column:
    return F.conv(F.substring(rgb, 1 + 2 * k, 2), 16, 10).cast("int")


def to_hsl(rgb: Column) -> Column:
    """struct<hue, saturation, luminance>, each from 0 to 1."""
    r, g, b = (channel(rgb, k) / F.lit(255.0) for k in range(3))
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    spread, luminance = most - least, (most + least) / 2
    hue = F.when(most == r, F.pmod((g - b) / spread, F.lit(6.0))).when(most == g, (b - r) / spread + 2).otherwise((r - g) / spread + 4) / 6
    saturation = spread / (1 - F.abs(2 * luminance - 1))
    return F.struct(F.when(spread == 0, 0.0).otherwise(hue).alias("hue"), F.when(spread == 0, 0.0).otherwise(saturation).alias("saturation"), luminance.alias("luminance"))


def to_hex(hue: Column, saturation: Column, luminance: Column) -> Column:
    """Upper-case RRGGBB."""
    chroma = (1 - F.abs(2 * luminance - 1)) * saturation
    sixth = hue * 6
    second = chroma * (1 - F.abs(F.pmod(sixth, F.lit(2.0)) - 1))
    lowest = luminance - chroma / 2
    zero = F.lit(0.0)

    def at(parts: list[Column]) -> Column:
        out = parts[5]
        for k in range(4, -1, -1):
            out = F.when(sixth < k + 1, parts[k]).otherwise(out)
        return F.lpad(F.hex(half_up((out + lowest) * 255).cast("int")), 2, "0")

    return F.concat(at([chroma, second, zero, zero, second, chroma]), at([second, chroma, chroma, second, zero, zero]), at([zero, zero, second, chroma, chroma, second]))


def with_luminance(rgb: Column, times: Column, plus: Column) -> Column:
    """A theme colour's luminance changed by a factor and a term, kept within 0 and 1."""
    hsl = to_hsl(rgb)
    return to_hex(hsl["hue"], hsl["saturation"], F.least(F.lit(1.0), F.greatest(F.lit(0.0), hsl["luminance"] * times + plus)))


def blend(fill: Column, foreground: Column, share: Column) -> Column:
    return F.concat(*(F.lpad(F.hex(half_up(channel(fill, k) * (1 - share) + channel(foreground, k) * share).cast("int")), 2, "0") for k in range(3)))
