"""Functions over arrays of styled runs (see schemas.RUN), as folds inside one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.schemas import RUN

STYLE = ("bold", "italic", "underline", "superscript", "subscript", "color", "highlight")


def no_runs() -> Column:
    return F.array().cast(f"array<{RUN}>")


def is_blank(text: Column) -> Column:
    return text.rlike(r"(?U)^\s+$")


def same_style(a: Column, b: Column) -> Column:
    same = F.lit(True)
    for name in STYLE:
        same = same & a[name].eqNullSafe(b[name])
    return same


def _but_last(runs: Column) -> Column:
    return F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0)))


def merged(runs: Column) -> Column:
    """Empty runs go; neighbours of one style join; a blank run joins the one before it, or at the front takes the style after it, unless underlined."""
    def step(out: Column, r: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(last["text"], r["text"])
        some = F.size(out) > 0
        return (
            F.when(r["text"] == "", out)
            .when(some & (same_style(last, r) | (is_blank(r["text"]) & ~r["underline"])), F.concat(_but_last(out), F.array(last.withField("text", joined))))
            .when(some & is_blank(last["text"]) & ~last["underline"], F.concat(_but_last(out), F.array(r.withField("text", joined))))
            .otherwise(F.concat(out, F.array(r)))
        )

    return F.aggregate(runs, no_runs(), step)


def normalised(runs: Column) -> Column:
    """Blanks collapse across runs and go at both ends; then runs are merged."""
    def step(acc: Column, r: Column) -> Column:
        text = F.regexp_replace(r["text"], r"(?U)\s+", " ")
        text = F.when(acc["blank"], F.regexp_replace(text, "^ ", "")).otherwise(text)
        more = F.struct(text.endswith(" ").alias("blank"), F.concat(acc["out"], F.array(r.withField("text", text))).alias("out"))
        return F.when(text == "", acc).otherwise(more)

    start = F.struct(F.lit(True).alias("blank"), no_runs().alias("out"))

    def trimmed(acc: Column) -> Column:
        out = acc["out"]
        last = F.try_element_at(out, F.lit(-1))
        text = F.rtrim(last["text"])
        cut = F.when(text == "", _but_last(out)).otherwise(F.concat(_but_last(out), F.array(last.withField("text", text))))
        return merged(F.when(F.size(out) == 0, out).otherwise(cut))

    return F.aggregate(runs, start, step, trimmed)


def without_uniform(runs: Column, *names: str) -> Column:
    """Styles that every visible run has are dropped from all."""
    visible = F.filter(runs, lambda r: ~r["text"].rlike(r"(?U)^\s*$"))
    for name in names:
        everywhere = (F.size(visible) > 0) & F.forall(visible, lambda r: r[name])
        runs = F.when(everywhere, F.transform(runs, lambda r: r.withField(name, F.lit(False)))).otherwise(runs)
    return merged(runs)


def rendered(runs: Column, colours: bool = True) -> Column:
    """Marked-up text; blanks at a run's ends stay outside its marks."""
    def one(r: Column) -> Column:
        text = r["text"]
        core = F.trim(text)
        lead, trail = F.regexp_extract(text, "^( *)", 1), F.regexp_extract(text, "( *)$", 1)
        marked = core
        for name, a, b in (("superscript", "^{", "}"), ("subscript", "_{", "}"), ("underline", "__", "__"), ("italic", "*", "*"), ("bold", "**", "**")):
            marked = F.when(r[name], F.concat(F.lit(a), marked, F.lit(b))).otherwise(marked)
        if colours:
            marked = F.when(r["color"].isNotNull(), F.concat(F.lit("{"), r["color"], F.lit("|"), marked, F.lit("}"))).otherwise(marked)
            marked = F.when(r["highlight"].isNotNull(), F.concat(F.lit("{hl "), r["highlight"], F.lit("|"), marked, F.lit("}"))).otherwise(marked)
        return F.when(core == "", text).otherwise(F.concat(lead, marked, trail))

    return F.array_join(F.transform(runs, one), "")


def without_marker(runs: Column, n: Column) -> Column:
    """The first n characters off, across runs, then blanks off the front."""
    def step(acc: Column, r: Column) -> Column:
        size = F.length(r["text"])
        rest = r.withField("text", r["text"].substr(acc["left"] + 1, size))
        return F.struct(F.greatest(acc["left"] - size, F.lit(0)).alias("left"), F.when(size <= acc["left"], acc["out"]).otherwise(F.concat(acc["out"], F.array(rest))).alias("out"))

    def tidied(acc: Column) -> Column:
        clean = F.transform(acc["out"], lambda r, i: F.when(i == 0, r.withField("text", F.regexp_replace(r["text"], r"(?U)^\s+", ""))).otherwise(r))
        return F.filter(clean, lambda r: r["text"] != "")

    return F.aggregate(runs, F.struct(n.cast("int").alias("left"), no_runs().alias("out")), step, tidied)


def split_lines(runs: Column) -> Column:
    """One array of runs for each line; lines that are blank go."""
    parts = F.flatten(F.transform(runs, lambda r: F.transform(F.split(F.replace(r["text"], F.lit("\r"), F.lit("\n")), "\n", -1), lambda t, i: F.struct((i > 0).alias("new"), r.withField("text", t).alias("run")))))

    def step(out: Column, p: Column) -> Column:
        piece = F.when(p["run"]["text"] == "", no_runs()).otherwise(F.array(p["run"]))
        grown = F.concat(F.try_element_at(out, F.lit(-1)), piece)
        return F.when(p["new"] | (F.size(out) == 0), F.concat(out, F.array(piece))).otherwise(F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown)))

    lines = F.aggregate(parts, F.array().cast(f"array<array<{RUN}>>"), step)
    return F.filter(lines, lambda line: ~F.array_join(F.transform(line, lambda r: r["text"]), "").rlike(r"(?U)^\s*$"))


def text_of(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def all_bold(runs: Column) -> Column:
    """A short line, all bold, that doesn't end in a full stop."""
    visible = F.filter(runs, lambda r: ~r["text"].rlike(r"(?U)^\s*$"))
    text = F.rtrim(text_of(runs))
    return (F.size(visible) > 0) & F.forall(visible, lambda r: r["bold"]) & (F.length(text) <= 120) & ~text.endswith(".")


def bold_ratio(runs: Column) -> Column:
    """Bold visible characters among all visible ones; 0 where there are none."""
    def visible(r: Column) -> Column:
        return F.length(F.regexp_replace(r["text"], r"(?U)\s", ""))

    total = F.aggregate(runs, F.lit(0), lambda a, r: a + visible(r))
    bold = F.aggregate(F.filter(runs, lambda r: r["bold"]), F.lit(0), lambda a, r: a + visible(r))
    return F.coalesce(F.try_divide(bold, total), F.lit(0.0))


def style_fields(r: Column, colours: bool = True) -> Column:
    """The names of the text-style fields that a run sets."""
    names = [
        F.when(r["bold"], "bold"), F.when(r["italic"], "italic"), F.when(r["underline"], "underline"), F.when(r["superscript"] | r["subscript"], "baselineOffset"),
        *([F.when(r["color"].isNotNull(), "foregroundColor"), F.when(r["highlight"].isNotNull(), "backgroundColor")] if colours else []),
    ]
    return F.array_compact(F.array(*names))
