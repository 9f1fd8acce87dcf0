"""Tables: rows of cells, and tables that were split over pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.sequences import islands


def header_key(cells: Column) -> Column:
    """What two first rows must share: the cells' text joined, blanks and case apart."""
    return F.lower(F.trim(F.regexp_replace(F.array_join(cells, " | "), r"(?U)\s+", " ")))


def merge_split(df: DataFrame, by: Sequence[str], order: str, header: str, n_cols: str, n_rows: str) -> DataFrame:
    """Tables (one row each, neighbours in `order` without a gap) that repeat the header before them as one.

    A table that goes on drops its header row, so the rows add up to the first one's plus n_rows - 1 of each later one.
    Comparing with the table before is enough, as equality of headers carries over."""
    w = Window.partitionBy(*by).orderBy(order)
    goes_on = (F.col(header) != "") & (F.lag(header).over(w) == F.col(header)) & (F.lag(n_cols).over(w) == F.col(n_cols)) & (F.lag(order).over(w) == F.col(order) - 1)
    marked = islands(df, by, [order], ~F.coalesce(goes_on, F.lit(False)), "_table").withColumn("_on", F.coalesce(goes_on, F.lit(False)))
    return marked.groupBy(*by, "_table").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.min_by(header, order).alias(header), F.first(n_cols).alias(n_cols),
        F.sum(F.col(n_rows) - F.col("_on").cast("int")).alias(n_rows), F.count("*").alias("parts"),
    ).drop("_table")


def merged_cells(tables: DataFrame, cells: DataFrame, by: Sequence[str], order: str, header: str, n_cols: str, n_rows: str) -> DataFrame:
    """cells (row, col, text of a table at `order`) of merged tables: `first` (where the merged table began), row, col, text.

    A part that repeats the header loses that row, and its other rows stand below all rows of the parts before."""
    w = Window.partitionBy(*by).orderBy(order)
    goes_on = F.coalesce((F.col(header) != "") & (F.lag(header).over(w) == F.col(header)) & (F.lag(n_cols).over(w) == F.col(n_cols)) & (F.lag(order).over(w) == F.col(order) - 1), F.lit(False))
    parts = islands(tables.withColumn("_on", goes_on.cast("int")), by, [order], F.col("_on") == 0, "_table")
    part = Window.partitionBy(*by, "_table").orderBy(order)
    above = F.coalesce(F.sum(F.col(n_rows) - F.col("_on")).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*by, order, "_on", above.alias("_above"), F.first(order).over(part).alias("first"))
    met = cells.join(parts, [*by, order]).where(F.col("row") >= F.col("_on"))
    return met.select(*by, "first", (F.col("row") + F.col("_above") - F.col("_on")).cast("int").alias("row"), "col", "text")


def shape(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """cells (row, col, rowspan, colspan) -> n_rows, n_cols of each table."""
    return cells.groupBy(*by).agg(F.max(F.col("row") + F.col("rowspan")).alias("n_rows"), F.max(F.col("col") + F.col("colspan")).alias("n_cols"))


def column_widths(df: DataFrame, by: Sequence[str], weight: str, page: float = 468.0, least: float = 5.0) -> DataFrame:
    """width: the page's width shared in proportion to the weights; equally where one isn't positive; five points at least."""
    w = Window.partitionBy(*by)
    known = F.min(F.coalesce(weight, F.lit(0.0))).over(w) > 0
    share = F.when(known, F.col(weight) / F.sum(weight).over(w)).otherwise(F.lit(1.0) / F.count("*").over(w))
    return df.withColumn("width", F.greatest(F.lit(least), F.rint(page * 10 * share) / 10))
