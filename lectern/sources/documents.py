"""Files of any kind as one table of blocks, and blocks as an outline: each file goes to its format's reader, and what has none is an error row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.definitions import row_text
from lectern.sources import office
from lectern.sources.files import format_of

COLUMNS = ("path", "pos", "kind", "text", "level", "row", "col", "error")


def blocks_of(contents: DataFrame) -> DataFrame:
    """path, content -> path, pos, kind, text, level, row, col, error; cells come one by one, a file that can't be read is one row."""
    known = format_of(contents.select("path", "content"), "path")
    words = office.docx_rows(known.where(F.col("format") == "docx")).select(*COLUMNS)
    shapes = office.pptx_rows(known.where(F.col("format") == "pptx"))
    order = Window.partitionBy("path").orderBy(F.col("error").isNotNull(), "slide", "ord")
    kind = F.when(F.col("ph").isin("title", "ctrTitle"), "heading").when(F.col("kind") == "text", "bullet").otherwise(F.col("kind"))
    slides = shapes.where("kind is null or kind <> 'connector'").select("path", (F.row_number().over(order) - 1).alias("pos"), kind.alias("kind"), "text", F.when(kind == "heading", 1).otherwise(F.col("level")).alias("level"), "row", "col", "error")
    none = F.lit(None).cast("int")
    rejected = known.where("error is not null").select("path", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("text"), none.alias("level"), none.alias("row"), none.alias("col"), "error")
    return words.unionByName(slides).unionByName(rejected)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All files below a path."""
    return blocks_of(office.files(spark, path, "*"))


def outline(blocks: DataFrame) -> DataFrame:
    """path, outline, error: headings with a mark for each rank, bullets below their level, a table row to a line."""
    shown = blocks.where("error is null and trim(text) <> ''")
    cells = shown.where("kind = 'cell'")
    # cells of one row stand side by side, so their row is told by the first one
    rows = cells.withColumn("_start", F.col("pos") - F.row_number().over(Window.partitionBy("path").orderBy("pos"))).groupBy("path", "_start", "row").agg(F.min("pos").alias("pos"), row_text(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"])).alias("line"))
    level = F.greatest(F.coalesce("level", F.lit(0)), F.lit(0))
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(level, F.lit(1))), F.lit(" "), "text")).when(F.col("kind") == "bullet", F.concat(F.repeat(F.lit("  "), level), F.lit("- "), "text")).otherwise(F.col("text"))
    lines = shown.where("kind <> 'cell'").select("path", "pos", line.alias("line")).unionByName(rows.select("path", "pos", "line"))
    whole = lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l")).select("path", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("outline"))
    files = blocks.groupBy("path").agg(F.max("error").alias("error"))
    return files.join(whole, "path", "left").select("path", "outline", "error")
