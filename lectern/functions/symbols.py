"""Characters typed in picture fonts, as Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the low bytes of the two picture fonts show.
GREEK = dict(zip("abgdezhqiklmnxoprstufcywjvABGDEZHQIKLMNXOPRSTUFCYW", "αβγδεζηθικλμνξοπρστυφχψωϕϖΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", strict=True))
SIGNS = {
    0xA3: "≤", 0xB3: "≥", 0xB9: "≠", 0xBB: "≈", 0xB1: "±", 0xB4: "×", 0xB8: "÷", 0xA5: "∞", 0xAE: "→", 0xAC: "←", 0xAD: "↑", 0xAF: "↓", 0xAB: "↔", 0xDE: "⇒", 0xDC: "⇐", 0xDB: "⇔",
    0xD6: "√", 0xE5: "∑", 0xB6: "∂", 0xB7: "•", 0xBC: "…", 0xD7: "·", 0xA2: "′", 0xB2: "″", 0xCE: "∈", 0xC7: "∩", 0xC8: "∪", 0xD9: "∧", 0xDA: "∨", 0xD8: "¬", 0xB0: "°", 0x2D: "−",
}
DINGBATS = {
    0xE0: "→", 0xDF: "←", 0xE1: "↑", 0xE2: "↓", 0xE8: "➔", 0xF0: "⇨", 0xEF: "⇦", 0xD8: "➢", 0xFC: "✔", 0xFB: "✘", 0xFE: "☑", 0xA7: "▪", 0x6C: "●", 0x6E: "■", 0x71: "❑", 0x76: "❖",
    0x77: "◆", 0xA8: "◻", 0x4A: "☺", 0x4C: "☹", 0x46: "☞",
}
SYMBOL = {ord(k): v for k, v in GREEK.items()} | SIGNS


def _map(table: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def is_picture_font(font: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(font, F.lit(""))))
    return (name == "symbol") | name.startswith("wingdings") | name.startswith("webdings")


def shown(text: Column, font: Column, symbol_font: Column | None = None) -> Column:
    """Private-use characters by their font's table (none there: gone), other characters only where the run's own font is a picture font."""
    symbol_font = F.lit(None).cast("string") if symbol_font is None else symbol_font
    own = is_picture_font(font)
    name = F.lower(F.coalesce(F.when(own | symbol_font.isNull() | (symbol_font == ""), font).otherwise(symbol_font), F.lit("")))

    def look(code: Column) -> Column:
        symbol, dingbat = F.element_at(_map(SYMBOL), code), F.element_at(_map(DINGBATS), code)
        return F.when(name.contains("wingding"), dingbat).when(name.contains("symbol"), symbol).otherwise(F.coalesce(symbol, dingbat))

    def one(c: Column) -> Column:
        # two UTF-16 bytes tell the code of any character that a picture font has
        code = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long")
        low = (code - 0xF000).cast("int")
        private = (code >= 0xF000) & (code <= 0xF0FF)
        plain = own & (code < 256) & ~c.rlike(r"(?U)[\s\d]")
        return F.when(private, F.coalesce(look(low), F.lit(""))).when(plain, F.coalesce(look(F.least(code, F.lit(255)).cast("int")), c)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")
