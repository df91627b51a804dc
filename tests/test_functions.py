from pyspark.sql import functions as F

from foliant.functions import colour, math_letters, numbers, text, units
from foliant.operators import cascade, ordered


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_numbers(spark):
    written = lambda n, form: numbers.written(F.lit(n), F.lit(form))
    r = one(spark, a=written(27, "lowerLetter"), b=written(0, "lowerLetter"), c=written(1994, "upperRoman"), d=written(4000, "lowerRoman"), e=written(7, "decimalZero"), f=written(3, "bullet"), g=written(3, "chicken"))
    assert tuple(r) == ("aa", "0", "MCMXCIV", "4000", "07", "", None)


def test_stated_numbers(spark):
    r = one(spark, a=units.stated_number(F.lit(None).cast("string")), b=units.stated_number(F.lit("  ")), c=units.stated_number(F.lit(" 1e3 ")), d=units.stated_number(F.lit("0x10")), e=units.stated_number(F.lit("12pt")))
    assert tuple(r) == (None, 0.0, 1000.0, 16.0, None)


def test_units(spark):
    r = one(spark, a=units.small_capital_size(F.lit(11.0)), b=units.on_device_grid(F.lit(1.0)), c=units.turns_on_its_side(F.lit(-90)), d=units.turns_on_its_side(F.lit(135)), e=units.states_on(F.lit("off")), f=units.half_up(F.lit(-0.5)))
    assert (r.a, round(r.b, 6), r.c, r.d, r.e, r.f) == (9.0, 0.96, True, False, False, 0)


def test_colours(spark):
    for rgb in ("FF8000", "123456", "000000", "FFFFFF", "00FF7F"):
        hsl = colour.to_hsl(F.lit(rgb))
        r = one(spark, back=colour.to_hex(hsl["hue"], hsl["saturation"], hsl["luminance"]), dark=colour.with_luminance(F.lit(rgb), F.lit(0.0), F.lit(0.0)))
        assert (r.back, r.dark) == (rgb, "000000")


def test_texts(spark):
    r = one(spark, a=text.width_units(F.lit("ab")), b=text.extension_of(F.lit("word/media/Image1.PNG")), c=text.normalised(F.lit(" a \x00 b ")), d=text.redacted(F.lit("no 'x y' in /tmp/a.docx")), e=text.percent(F.lit(1), F.lit(8)), f=text.percent(F.lit(1), F.lit(0)))
    assert tuple(r) == (2 * 512 + 64 * (97 % 17 + 98 % 17), "png", "a b", "no '' in <path>", "12.5%", "n/a")


def test_cascade_keeps_stated_nones_and_ends_cycles(spark):
    rows = [("d", "root", None, 1, (None,)), ("d", "mid", "root", None, None), ("d", "leaf", "mid", 3, None), ("d", "lost", "gone", None, None), ("d", "x", "y", None, None), ("d", "y", "x", 9, None)]
    styles = spark.createDataFrame(rows, "doc string, id string, up string, size int, colour struct<value: string>")
    got = {r.id: (r.size, r.colour) for r in cascade.style_chain(styles, ["doc"], "id", "up", ["size", "colour"], depth=16).collect()}
    assert got["mid"] == (1, (None,)) and got["leaf"] == (3, (None,)) and got["lost"] == (None, None) and got["x"][0] == 9


def test_math_letters():
    assert math_letters.spelled("xh", "italic") == "\U0001d465\u210e" and math_letters.spelled("R1", "double-struck") == "\u211d\U0001d7d9" and math_letters.spelled("\u03b1 +", "bold") == "\U0001d6c2 +" and math_letters.spelled("h", None) == "h"


def test_counters_that_do_not_start_again(spark):
    rows = spark.createDataFrame([(1, i, lvl) for i, lvl in enumerate([0, 1, 2, 1, 2, 0, 2])], "k int, i int, lvl int")
    got = lambda **how: [tuple(r) for r in ordered.list_counters(rows, ["k"], ["i"], "lvl", 3, **how).orderBy("i").select("count_1", "count_2").collect()]
    assert got() == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (0, 0), (0, 1)]
    assert got(restart={1: None, 2: 0}) == [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (2, 0), (2, 1)]
