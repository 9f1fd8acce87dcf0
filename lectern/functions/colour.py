"""Colours: integers, six-digit codes, and theme adjustments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.binding import let

# The named highlight colours of word processors.
HIGHLIGHTS = {
    "yellow": "#FFFF00", "brightGreen": "#00FF00", "turquoise": "#00FFFF", "pink": "#FF00FF", "blue": "#0000FF", "red": "#FF0000", "darkBlue": "#000080", "teal": "#008080",
    "green": "#008000", "violet": "#800080", "darkRed": "#800000", "darkYellow": "#808000", "darkGray": "#808080", "lightGray": "#C0C0C0", "black": "#000000",
}
# The usual theme, and what schemes call its colours.
THEME = {
    "dk1": "#000000", "lt1": "#FFFFFF", "dk2": "#44546A", "lt2": "#E7E6E6", "accent1": "#4472C4", "accent2": "#ED7D31", "accent3": "#A5A5A5",
    "accent4": "#FFC000", "accent5": "#5B9BD5", "accent6": "#70AD47",
}
ALIASES = {"bg1": "lt1", "tx1": "dk1", "bg2": "lt2", "tx2": "dk2"}


def channels(code: Column) -> list[Column]:
    """Red, green and blue of `#RRGGBB`."""
    return [F.conv(F.substring(code, at, 2), 16, 10).cast("int") for at in (2, 4, 6)]


def code_of(value: Column) -> Column:
    """`#RRGGBB` of an integer; null for what is just text: nearly black, nearly white (it stood on a dark box), or dark grey."""
    rgb = [F.shiftright(value, by).bitwiseAND(F.lit(255)) for by in (16, 8, 0)]
    high, low = F.greatest(*rgb), F.least(*rgb)
    plain = (high < 0x30) | (low > 0xE6) | ((high < 0x50) & (high - low < 0x10))
    return F.when(~plain, F.format_string("#%02X%02X%02X", *rgb))


def is_dark(code: Column) -> Column:
    r, g, b = channels(code)
    return 0.299 * r + 0.587 * g + 0.114 * b < 140


def highlight(name: Column, fill: Column) -> Column:
    """A named highlight, else a shading that is neither automatic nor white."""
    table = F.create_map(*[F.lit(x) for kv in HIGHLIGHTS.items() for x in kv])
    return F.when(name.isNotNull() & (name != "none"), F.element_at(table, name)).when(~F.lower(fill).isin("auto", "ffffff") & (fill != ""), F.concat(F.lit("#"), F.upper(fill)))


def theme_base(name: Column) -> Column:
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    table = F.create_map(*[F.lit(x) for kv in THEME.items() for x in kv])
    return F.element_at(table, F.coalesce(F.element_at(alias, name), name))


def _hls(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span, light = high - low, (high + low) / 2
    sat = F.when(span == 0, 0.0).when(light <= 0.5, span / (high + low)).otherwise(F.try_divide(span, 2.0 - high - low))
    def part(x: Column) -> Column:
        return F.try_divide(high - x, span)

    hue = F.when(span == 0, 0.0).when(r == high, part(b) - part(g)).when(g == high, 2.0 + part(r) - part(b)).otherwise(4.0 + part(g) - part(r))
    return F.pmod(hue / 6.0, F.lit(1.0)), light, sat


def _rgb(h: Column, light: Column, sat: Column) -> list[Column]:
    top = F.when(light <= 0.5, light * (1 + sat)).otherwise(light + sat - light * sat)
    base = 2 * light - top

    def one(hue: Column) -> Column:
        hue = F.pmod(hue, F.lit(1.0))
        return F.when(hue < 1 / 6, base + (top - base) * hue * 6).when(hue < 0.5, top).when(hue < 2 / 3, base + (top - base) * (F.lit(2 / 3) - hue) * 6).otherwise(base)

    return [F.when(sat == 0, light).otherwise(one(h + by)) for by in (1 / 3, 0.0, -1 / 3)]


def adjusted(code: Column, steps: Sequence[tuple[str, Column]]) -> Column:
    """A colour after adjustments in order: lumMod and lumOff (shares of lightness), tint (to white), shade (to black); null ones are passed over."""
    def channel_struct(rgb: Sequence[Column]) -> Column:
        return F.struct(*[x.cast("double").alias(n) for x, n in zip(rgb, "rgb", strict=True)])

    def lightened(acc: Column, change: Callable[[Column], Column]) -> Column:
        h, light, sat = _hls(acc["r"], acc["g"], acc["b"])
        hls = F.struct(h.alias("h"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), change(light))).alias("l"), sat.alias("s"))
        return let(hls, lambda x: channel_struct(_rgb(x["h"], x["l"], x["s"])))

    def step(acc: Column, s: Column) -> Column:
        kind, amount = s["kind"], s["amount"]
        return (
            F.when(amount.isNull(), acc).when(kind == "lumMod", lightened(acc, lambda x: x * amount)).when(kind == "lumOff", lightened(acc, lambda x: x + amount))
            .when(kind == "tint", channel_struct([acc[n] + (1 - acc[n]) * (1 - amount) for n in "rgb"])).otherwise(channel_struct([acc[n] * amount for n in "rgb"]))
        )

    listed = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("double").alias("amount")) for k, v in steps])
    start = channel_struct([x / 255.0 for x in channels(code)])
    return F.aggregate(listed, start, step, lambda acc: F.format_string("#%02X%02X%02X", *[F.rint(acc[n] * 255).cast("int") for n in "rgb"]))
