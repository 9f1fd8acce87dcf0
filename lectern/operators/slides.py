"""Slides and drawn tables: titles, section slides, typed lines, spans into text, columns between rules, diagrams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import markers as mk
from lectern.operators.fold import scan
from lectern.operators.sequences import islands

# Glyphs that stand for bullets.
BULLETS = "•◦▪■●○‣⁃–—-*➢❖✔"


def section_slides(lines: DataFrame, slide: Sequence[str]) -> DataFrame:
    """slide, section: up to three large lines, a hundred characters, none a bullet, the first below a quarter of the page."""
    g = lines.groupBy(*slide).agg(
        F.count("*").alias("n"), F.sum(F.length(F.trim("text")) + 1).alias("chars"), F.min("size").alias("least"), F.bool_or(F.col("bullet").isNotNull()).alias("b"), F.min_by("y0", "line").alias("y"), F.max("height").alias("h"),
    )
    return g.select(*slide, ((F.col("n") <= 3) & (F.col("chars") - 1 <= 100) & (F.col("least") >= 32) & ~F.col("b") & (F.col("y") > 0.25 * F.col("h"))).alias("section"))


def slide_titles(lines: DataFrame, slide: Sequence[str], zone: float = 0.35, spacing: float = 1.6) -> DataFrame:
    """Adds `title`: the first line, if it stands high and is no bullet, and those of its size that follow closely."""
    w = Window.partitionBy(*slide).orderBy("line")
    first = Window.partitionBy(*slide).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = F.first("size").over(first)
    opens = (F.row_number().over(w) == 1) & F.col("bullet").isNull() & (F.col("y0") <= zone * F.col("height"))
    dy = F.col("y0") - F.lag("y0").over(w)
    follows = F.col("bullet").isNull() & (F.abs(F.col("size") - size) <= 1) & (dy > 0) & (dy <= spacing * F.col("size"))
    marked = lines.withColumn("_on", opens | F.coalesce(follows & (F.row_number().over(w) > 1), F.lit(False)))
    return marked.withColumn("title", F.min(F.col("_on").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_on")


def line_text(spans: Column, size: Column) -> Column:
    """Spans (text, x0, x1) of a line as text: a gap over a fifth of the size is a blank."""
    def step(acc: Column, s: Column) -> Column:
        gap = acc["x"].isNotNull() & (s["x0"] - acc["x"] > 0.2 * size) & ~acc["text"].endswith(" ") & ~s["text"].startswith(" ")
        return F.struct(F.concat(acc["text"], F.when(gap, " ").otherwise(""), s["text"]).alias("text"), s["x1"].alias("x"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("x")), step, lambda acc: acc["text"])


def leading_bullet(text: Column) -> Column:
    """A bullet's glyph at a line's start; a dash or star needs a blank after it."""
    return F.nullif(F.regexp_extract(text, r"^\s*([•◦▪■●○‣⁃➢❖✔]|[–—*-](?=\s))", 1), F.lit(""))


def column_gaps(gaps: DataFrame, starts: DataFrame, by: Sequence[str], support: int = 3, reach: float = 4.0) -> DataFrame:
    """gaps (x0, x1) between texts of a table's rows: those that overlap are one column's edge, narrowed to what they have in common.

    An edge counts if so many gaps and lines that start (starts: x) within `reach` of its right end back it up."""
    state = "struct<x0:double,x1:double>"

    def step(now: Column, gap: Column) -> Column:
        joins = F.coalesce(gap["x0"] < now["x1"], F.lit(False))
        common = F.struct(F.when(joins, F.greatest(now["x0"], gap["x0"])).otherwise(gap["x0"]).alias("x0"), F.when(joins, F.least(now["x1"], gap["x1"])).otherwise(gap["x1"]).alias("x1"))
        return F.struct(common.alias("state"), F.struct((~joins).alias("opens"), common["x0"].alias("x0"), common["x1"].alias("x1")).alias("out"))

    rows = gaps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1")))).alias("rows"))
    told = scan(F.col("rows"), F.from_json(F.lit("{}"), state), "struct<opens:boolean,x0:double,x1:double>", step)
    edges = islands(rows.select(*by, F.posexplode(told).alias("at", "g")).select(*by, "at", "g.*"), by, ["at"], F.col("opens"), "edge")
    edges = edges.groupBy(*by, "edge").agg(F.max_by("x0", "at").alias("x0"), F.max_by("x1", "at").alias("x1"), F.count("*").alias("n"))
    near = edges.join(starts.select(*by, F.col("x").alias("_x")), list(by)).where(F.abs(F.col("_x") - F.col("x1")) <= reach).groupBy(*by, "edge").agg(F.count("*").alias("_starts"))
    out = edges.join(near, [*by, "edge"], "left").withColumn("support", F.col("n") + F.coalesce("_starts", F.lit(0)))
    return out.where(F.col("support") >= support).select(*by, "x0", "x1", "support")


def diagrams(shapes: DataFrame, page: Sequence[str], group: str = "group") -> DataFrame:
    """Groups of touching shapes with two texts or more and a connector: their box and their text, in rows of twenty points."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct(F.bround(F.col("y0") / 20, 0).alias("r"), "x0", "text")))), lambda s: s["text"]), " ")
    g = shapes.groupBy(*page, group).agg(
        F.count_if(F.col("text") != "").alias("texts"), F.count_if(F.col("kind") == "connector").alias("connectors"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), text.alias("text"),
    )
    return g.where("texts >= 2 and connectors >= 1").drop("texts", "connectors")


def shape_numbers(df: DataFrame, by: Sequence[str], order: str, levels: int = 9) -> DataFrame:
    """Paragraphs of shapes (level, scheme of the automatic number or null, start) with `label`. A level's counter starts anew after a
    shallower paragraph, or one of its level without a number or with another scheme; so it is a row number."""
    doc = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy(*by, "level").orderBy(order)
    shallower = F.lit(None)
    for k in range(levels):
        shallower = F.when(F.col("level") == k, F.max(F.when(F.col("level") < k, F.col(order))).over(doc)).otherwise(shallower)
    rows = df.withColumn("_up", shallower)
    anew = ~F.col("scheme").eqNullSafe(F.lag("scheme").over(same)) | F.coalesce(F.col("_up") > F.lag(order).over(same), F.lit(False)) | F.lag(order).over(same).isNull()
    rows = islands(rows.withColumn("_anew", anew), [*by, "level"], [order], F.col("_anew"), "_count")
    count = Window.partitionBy(*by, "level", "_count").orderBy(order)
    n = (F.coalesce(F.first("start").over(count), F.lit(1)) + F.row_number().over(count) - 1).cast("int")
    rows = rows.withColumn("_n", n)
    scheme, n = F.col("scheme"), F.col("_n")
    letter = mk.wrapped_letter(n)
    number = F.when(scheme.startswith("alphaLc"), letter).when(scheme.startswith("alphaUc"), F.upper(letter)).when(scheme.startswith("romanLc"), mk.roman(n)).when(scheme.startswith("romanUc"), F.upper(mk.roman(n))).otherwise(n.cast("string"))
    shape = F.when(scheme.endswith("ParenBoth"), F.concat(F.lit("("), number, F.lit(")"))).when(scheme.endswith("ParenR"), F.concat(number, F.lit(")"))).when(scheme.endswith("Period"), F.concat(number, F.lit("."))).otherwise(number)
    return rows.withColumn("label", F.when(scheme.isNotNull(), shape)).select(*df.columns, "label")
