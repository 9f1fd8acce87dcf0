"""Operators over blocks of a document: spacers, bullet levels, labels, segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.fold import in_order, scan
from lectern.operators.sequences import islands, ordered

#: Kinds that bring their own spacing.
SPACED = ("heading", "table", "image")


def tidy_spacers(df: DataFrame, by: Sequence[str], order: Sequence[str], spacer: str = "spacer", kind: str = "kind") -> DataFrame:
    """One blank row at most between others; none at the ends or beside headings, tables and images."""
    w = ordered(by, order)
    content = F.when(~F.col(spacer), F.col(kind))
    before = F.last(content, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(content, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    doubled = F.coalesce(F.lag(spacer).over(w), F.lit(False))
    stays = ~F.col(spacer) | (before.isNotNull() & after.isNotNull() & ~before.isin(*SPACED) & ~after.isin(*SPACED) & ~doubled)
    return df.withColumn("_stays", stays).where("_stays").drop("_stays")


def spacers_follow(df: DataFrame, by: Sequence[str], order: Sequence[str], spacer: str = "spacer", selected: str = "selected") -> DataFrame:
    """A blank row is ticked as the row before it that isn't blank."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~F.col(spacer), F.col(selected)), ignorenulls=True).over(w)
    return df.withColumn(selected, F.when(F.col(spacer), F.coalesce(last, F.col(selected))).otherwise(F.col(selected)))


def bullets_from_top(df: DataFrame, by: Sequence[str], order: Sequence[str], kind: str = "kind", level: str = "level") -> DataFrame:
    """Each run of bullets starts at the level of the row before it (0 where there is none)."""
    w = ordered(by, order)
    bullet = F.col(kind) == "bullet"
    starts = ~bullet | (F.lag(kind).over(w) != "bullet")
    df = islands(df, by, order, starts, "_run").withColumn("_before", F.when(bullet, F.coalesce(F.lag(level).over(w), F.lit(0))))
    run = Window.partitionBy(*by, "_run").orderBy(*order)
    whole = Window.partitionBy(*by, "_run")
    shift = F.min(level).over(whole) - F.first("_before").over(run)
    return df.withColumn(level, F.when(bullet, F.col(level) - shift).otherwise(F.col(level))).drop("_run", "_before")


def counters(df: DataFrame, by: Sequence[str], order: Sequence[str], level: str, numbered: Column, levels: int = 9, name: str = "n") -> DataFrame:
    """n: how many rows of this level there were since a row of a smaller level or one that isn't numbered; null for those.

    A row's own list is told by how many such rows came before, so a counter is a row number and needs no state."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    breaks = F.lit(0)
    for r in range(levels):
        breaks = F.when(F.col(level) == r, F.sum(F.when(~numbered | (F.col(level) < r), 1).otherwise(0)).over(w)).otherwise(breaks)
    df = df.withColumn("_list", F.when(numbered, breaks))
    return df.withColumn(name, F.when(numbered, F.row_number().over(Window.partitionBy(*by, level, "_list").orderBy(*order)))).drop("_list")


def text_segments(df: DataFrame, by: Sequence[str], order: str, kind: str = "kind", whole: Column | None = None, limit: int = 150) -> DataFrame:
    """segment: tables and images stand alone, text between them is cut after `limit` rows, but never before a row of which `whole`
    holds (a numbered list goes on there, and its second half would count anew)."""
    alone = F.col(kind).isin("table", "image")
    before = F.lag(kind).over(ordered(by, [order]))
    marked = df.withColumns({"_new": alone | F.coalesce(before.isin("table", "image"), F.lit(True)), "_stays": F.lit(False) if whole is None else F.coalesce(whole, F.lit(False))})
    start = F.struct(F.lit(0).alias("n"))

    def step(state: Column, row: Column) -> Column:
        cut = row["_new"] | ((state["n"] >= limit) & ~row["_stays"])
        return F.struct(F.struct(F.when(cut, 1).otherwise(state["n"] + 1).alias("n")).alias("state"), cut.alias("out"))

    rows = in_order(marked.select(*by, order, "_new", "_stays"), by, order)
    cuts = rows.select(*by, F.explode(F.zip_with("rows", scan(F.col("rows"), start, "boolean", step), lambda r, c: F.struct(r[order].alias(order), c.alias("_cut")))).alias("x")).select(*by, "x.*")
    return islands(df.join(cuts, [*by, order]), by, [order], F.col("_cut"), "segment").drop("_cut")
