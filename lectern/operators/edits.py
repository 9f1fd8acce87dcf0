"""Edit plans: the typed requests that append blocks to a document, with exact offsets.

Offsets count UTF-16 units. Requests run in order of phase and seq: text first; then bullets off and paragraph styles; indents;
text styles; and new bullets from the last group to the first, since making bullets takes the leading tabs away and so moves
all that follows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import cleaned, utf16_length
from lectern.operators.sequences import islands, offsets

STEP = 36
PHASES = ("insertText", "deleteParagraphBullets", "updateParagraphStyle", "zeroIndent", "hangingIndent", "listIndent", "resetTextStyle", "createParagraphBullets")


def written(blocks: DataFrame, first: int = 1) -> DataFrame:
    """blocks with what is inserted for each (leading tabs tell a bullet's level) and its start and end."""
    body = F.when(F.col("kind") == "bullet", F.concat(F.repeat(F.lit("\t"), F.col("level")), cleaned(F.col("text")))).otherwise(cleaned(F.col("text")))
    return offsets(blocks.withColumn("body", body), ["doc_id"], ["pos"], utf16_length(F.col("body")), first)


def bullet_groups(placed: DataFrame) -> DataFrame:
    """doc_id, group, preset, start, end: neighbouring bullets of one preset; a numbered group spans rows inside its list; list_start begins a new one."""
    member = (F.col("kind") == "bullet") | F.col("in_list")
    w = Window.partitionBy("doc_id").orderBy("pos")
    own = F.when(F.col("kind") == "bullet", F.coalesce("numbered", F.lit("plain")))
    preset = F.coalesce(own, F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = placed.withColumn("_m", member).withColumn("_p", F.when(F.col("in_list") & (F.col("kind") == "bullet"), F.last(F.when(~F.col("in_list"), own), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).otherwise(preset))
    starts = ~F.lag("_m").over(w) | (F.lag("_p").over(w) != F.col("_p")) | F.col("list_start") | ~F.col("_m")
    grouped = islands(rows, ["doc_id"], ["pos"], starts, "group").where("_m")
    return grouped.groupBy("doc_id", "group").agg(F.first("_p").alias("preset"), F.min("start").alias("start"), F.max("end").alias("end"))


def _rows(df: DataFrame, phase: int, start: Column | str, end: Column | str, payload: Column, backwards: bool = False) -> DataFrame:
    order = F.desc("start") if backwards else F.asc("start")
    made = df.select("doc_id", F.lit(PHASES[phase]).alias("op"), F.col(start).alias("start") if isinstance(start, str) else start.alias("start"), F.col(end).alias("end") if isinstance(end, str) else end.alias("end"), payload.alias("payload"))
    return made.withColumn("phase", F.lit(phase)).withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy(order, "end")))


def points(first: Column, start: Column) -> Column:
    return F.concat(first.cast("string"), F.lit("/"), start.cast("string"))


def edit_plan(blocks: DataFrame, first: int = 1) -> DataFrame:
    """blocks (doc_id, pos, kind, text, level, style, numbered, list_start, in_list, hanging) -> doc_id, phase, seq, op, start, end, payload."""
    placed = written(blocks, first)
    whole = placed.groupBy("doc_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda b: F.concat(b["body"], F.lit("\n"))), "").alias("body"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    changed = ~F.col("style").eqNullSafe(F.lag("style").over(w)) | (F.row_number().over(w) == 1)
    styles = islands(placed, ["doc_id"], ["pos"], changed, "_run").groupBy("doc_id", "_run").agg(F.first("style").alias("style"), F.min("start").alias("start"), F.max("end").alias("end"))
    text = (F.col("kind") != "bullet") & ~F.col("in_list")
    level = F.col("level")
    parts = [
        _rows(whole, 0, "start", "start", F.col("body")),
        _rows(whole, 1, "start", "end", F.lit("")),
        _rows(styles, 2, "start", "end", F.col("style")),
        _rows(placed.where(text & ~F.col("hanging") & (level == 0)), 3, "start", "end", points(F.lit(0), F.lit(0))),
        _rows(placed.where(text & F.col("hanging")), 4, "start", "end", points(level * STEP + STEP // 2, level * STEP + STEP)),
        _rows(placed.where((F.col("kind") != "bullet") & F.col("in_list")), 5, "start", "end", points(level * STEP, level * STEP)),
        _rows(whole, 6, "start", "end", F.lit("")),
        _rows(bullet_groups(placed), 7, "start", "end", F.col("preset"), backwards=True),
    ]
    return reduce(DataFrame.unionByName, parts)


def in_tab(edits: DataFrame, tab: Column) -> DataFrame:
    """The same requests aimed at a tab (null: the first)."""
    return edits.withColumn("tab_id", tab)


def cell_edits(cells: DataFrame) -> DataFrame:
    """Shading and merges of table cells, from the last cell to the first so that places stay true."""
    span = (F.col("rowspan") > 1) | (F.col("colspan") > 1)
    shade = cells.where(F.col("background").isNotNull()).select("doc_id", "row", "col", F.lit("updateTableCellStyle").alias("op"), F.col("background").alias("payload"))
    merge = cells.where(span).select("doc_id", "row", "col", F.lit("mergeTableCells").alias("op"), F.concat(F.col("rowspan").cast("string"), F.lit("x"), F.col("colspan").cast("string")).alias("payload"))
    both = shade.unionByName(merge)
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("row"), F.desc("col"), "op")))
