"""Definitions that documents look up: styles and their ancestors, lists and their levels, page widths, lists of recent documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Presets of lists by their first glyph, and the width of text where a page's is unknown, and the least one.
PRESETS = {"●": "BULLET_DISC", "❖": "BULLET_DIAMOND", "%0.": "NUMBERED"}
WIDTH, LEAST_WIDTH = 468.0, 100.0


def inherited(styles: DataFrame, own: Sequence[str], by: str = "doc_id", rounds: int = 5) -> DataFrame:
    """styles (style_id, base_id and the values `own`) -> each style's own values or those of the nearest ancestor that has them.

    Every round doubles how far a style sees, so `rounds` joins reach 2**rounds ancestors; a style that is its own ancestor ends there."""
    now = styles.select(by, "style_id", F.col("base_id").alias("up"), *own)
    for _ in range(rounds):
        above = now.select(F.col(by).alias("_by"), F.col("style_id").alias("_id"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in own])
        met = now.join(above, (F.col(by) == F.col("_by")) & (F.col("up") == F.col("_id")), "left")
        now = met.select(by, "style_id", F.col("_up").alias("up"), *[F.coalesce(c, f"_{c}").alias(c) for c in own])
    return now.drop("up")


def list_levels(used: DataFrame, nums: DataFrame, levels: DataFrame, overrides: DataFrame, by: str = "doc_id") -> DataFrame:
    """used (num_id, level) with format and start: by the abstract list of num_id, an override of the start first, 1 where nothing says."""
    met = used.join(nums, [by, "num_id"], "left").join(levels, [by, "abstract_id", "level"], "left").join(overrides, [by, "num_id", "level"], "left")
    return met.select(by, "num_id", "level", "format", F.coalesce("override", "start", F.lit(1)).alias("start"))


def list_preset(glyph: Column) -> Column:
    """A list's preset by its first glyph, a disc where that is unknown."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRESETS.items() for x in kv]), glyph), F.lit("BULLET_DISC"))


def usable_width(page: Column, left: Column, right: Column) -> Column:
    """Page less margins, LEAST_WIDTH at least, WIDTH where unknown."""
    return F.when(page.isNotNull(), F.greatest(F.lit(LEAST_WIDTH), page - left - right)).otherwise(F.lit(WIDTH))


def separator(empty: Column, after_table: Column, blank: Column, line_end: Column, anchor: Column) -> tuple[Column, Column]:
    """Place and number of line feeds between old and new text: none in an empty document; before the anchor after a table; a blank line is used again."""
    place = F.when(empty, None).when(after_table, anchor).otherwise(line_end)
    return place, F.when(empty, 0).when(~after_table & blank, 1).otherwise(2)


def cell_text(blocks: Column) -> Column:
    """A cell joins its blocks by strokes."""
    return F.array_join(blocks, " / ")


def row_text(cells: Column) -> Column:
    """A row joins its cells by bars."""
    return F.array_join(cells, " | ")


def remembered(recents: DataFrame, added: DataFrame, keep: int = 10) -> DataFrame:
    """recents with the added ones in their place, the newest `keep` of them. Times decide; ids break ties."""
    kept = recents.join(added.select("doc_id"), "doc_id", "left_anti").unionByName(added)
    return kept.orderBy(F.desc("last_used"), "doc_id").limit(keep)
