"""List and heading markers, numerals and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The thirteen signs of Roman numerals.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def is_roman(c: Column) -> Column:
    """A well-formed numeral in lower case, not empty."""
    return (c != "") & c.rlike("^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")


def roman_value(c: Column) -> Column:
    """Each sign counts against the total when a larger one follows."""
    worth = F.create_map(*[F.lit(x) for v, s in ROMAN if len(s) == 1 for x in (s, v)])
    signs = F.transform(F.split(c, ""), lambda s: F.coalesce(F.element_at(worth, s), F.lit(0)))
    return F.aggregate(F.transform(signs, lambda v, i: F.when(v < F.coalesce(F.get(signs, i + 1), F.lit(0)), -v).otherwise(v)), F.lit(0), lambda a, v: a + v)


def roman(c: Column) -> Column:
    """A number from 1 to 3999 as a numeral, digit by digit."""
    out = []
    for unit, one, five, ten in ((1000, "m", "", ""), (100, "c", "d", "m"), (10, "x", "l", "c"), (1, "i", "v", "x")):
        digit = F.floor(c / unit) % 10
        out.append(
            F.when(digit == 9, F.lit(one + ten)).when(digit == 4, F.lit(one + five))
            .when(digit >= 5, F.concat(F.lit(five), F.repeat(F.lit(one), (digit - 5).cast("int")))).otherwise(F.repeat(F.lit(one), digit.cast("int")))
        )
    return F.concat(*out)


def letter_value(c: Column) -> Column:
    """a is 1, z 26, then aa 27, bb 28: typed lists repeat the letter."""
    return (F.length(c) - 1) * 26 + F.ascii(F.lower(c)) - 96


def next_letter(c: Column) -> Column:
    """The token after this one: nothing gives a; equal letters step together, z beginning a longer token; else the last letter steps."""
    low = F.lower(c)
    same = F.length(F.replace(low, F.substring(low, 1, 1), F.lit(""))) == 0
    one = F.when(F.substring(low, 1, 1) == "z", F.repeat(F.lit("a"), F.length(low) + 1)).otherwise(F.repeat(F.char(F.ascii(low) + 1), F.length(low)))
    mixed = F.concat(low.substr(F.lit(1), F.length(low) - 1), F.char(F.ascii(F.substring(low, -1, 1)) + 1))
    return F.when(c.isNull() | (c == ""), F.lit("a")).when(same, one).otherwise(mixed)


def base26(c: Column) -> Column:
    """1 a, 26 z, 27 aa, 28 ab: as spreadsheets and word processors count."""
    def step(acc: Column, _: Column) -> Column:
        left = acc["left"]
        digit = ((left - 1) % 26).cast("int")
        more = F.struct(F.floor((left - 1) / 26).cast("int").alias("left"), F.concat(F.char(digit + 97), acc["out"]).alias("out"))
        return F.when(left > 0, more).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.struct(c.cast("int").alias("left"), F.lit("").alias("out")), step)["out"]


def wrapped_letter(c: Column) -> Column:
    return F.char((c - 1) % 26 + 97)


def heading_marker(c: Column) -> Column:
    """struct(scheme, token, label): `12.` before a blank or the end is decimal, `(ab)` is paren; else null."""
    decimal = F.regexp_extract(c, r"^\s*(\d{1,3})\.(?:\s|$)", 1)
    paren = F.regexp_extract(c, r"^\s*\(([a-zA-Z]{1,5})\)", 1)
    return F.when(decimal != "", F.struct(F.lit("decimal").alias("scheme"), decimal.alias("token"), F.concat(decimal, F.lit(".")).alias("label"))).when(
        paren != "", F.struct(F.lit("paren").alias("scheme"), F.lower(paren).alias("token"), F.concat(F.lit("("), paren, F.lit(")")).alias("label"))
    )


def item_marker(c: Column) -> Column:
    """The token of a typed list item - (x), x. or x) before a blank - or null; words such as `Dr.` are none."""
    token = F.regexp_extract(c, r"^\s*(?:\(([a-zA-Z]{1,5}|\d{1,3})\)|([a-zA-Z]{1,5}|\d{1,3})[.)])\s", 0)
    token = F.regexp_extract(token, r"[a-zA-Z]+|\d+", 0)
    low = F.lower(token)
    one_letter = F.length(F.replace(low, F.substring(low, 1, 1), F.lit(""))) == 0
    return F.when((token != "") & (token.rlike(r"^\d") | one_letter | is_roman(low)), token)


def number_label(fmt: Column, n: Column) -> Column:
    """A list number in one of the formats of word processors."""
    text = n.cast("string")
    return (
        F.when(fmt == "decimalZero", F.when(n < 10, F.concat(F.lit("0"), text)).otherwise(text)).when(fmt == "lowerLetter", base26(n)).when(fmt == "upperLetter", F.upper(base26(n)))
        .when(fmt == "lowerRoman", roman(n)).when(fmt == "upperRoman", F.upper(roman(n))).when(fmt == "none", F.lit("")).otherwise(text)
    )
