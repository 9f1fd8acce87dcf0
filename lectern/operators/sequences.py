"""Operators over ordered rows of a document. Each takes the columns that name the document and its order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(by: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*by).orderBy(*order)


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], starts: Column, name: str) -> DataFrame:
    """Number the stretches of rows that begin where `starts` holds; null counts as a start."""
    running = ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(running))


def clusters(df: DataFrame, by: Sequence[str], x: str, tolerance: float, name: str = "cluster") -> DataFrame:
    """Sorted values fall apart where the gap to the last member is above the tolerance."""
    gap = F.col(x) - F.lag(x).over(ordered(by, [x]))
    return islands(df, by, [x], gap > tolerance, name)


def floor_percentile(df: DataFrame, by: Sequence[str], x: str, q: float, name: str) -> DataFrame:
    """The value at place floor(q n) of n sorted ones, the last at most. One row for each group, null-free values only."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(x).isNotNull()).select(*by, x, (F.row_number().over(w.orderBy(x)) - 1).alias("_at"), F.count("*").over(w).alias("_n"))
    return ranked.where(F.col("_at") == F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n")))).select(*by, F.col(x).alias(name))


def weighted_mode(df: DataFrame, by: Sequence[str], value: Column, weight: str, order: str, default: float, name: str = "mode") -> DataFrame:
    """The value with the greatest weight; of equal ones the first seen; default where nothing weighs."""
    sums = df.groupBy(*by, value.alias("_v")).agg(F.sum(weight).alias("_w"), F.min(order).alias("_o"))
    best = F.max_by("_v", F.struct("_w", (-F.col("_o")).alias("_first")))
    return sums.groupBy(*by).agg(F.when(F.max("_w") > 0, best).otherwise(F.lit(default)).alias(name))


def gaps(df: DataFrame, by: Sequence[str], low: str, high: str, least: float) -> DataFrame:
    """Intervals grow together where they touch; gaps of at least `least` between them: gap_from, gap_to."""
    reach = F.max(high).over(ordered(by, [low, high]).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_reach", reach).where(F.col(low) - F.col("_reach") >= least).select(*by, F.col("_reach").alias("gap_from"), F.col(low).alias("gap_to"))


def offsets(df: DataFrame, by: Sequence[str], order: Sequence[str], length: Column, first: int = 1) -> DataFrame:
    """start and end of each row when rows are laid end to end, with one unit after each."""
    ahead = F.coalesce(F.sum(length + 1).over(ordered(by, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("start", (ahead + first).cast("long")).withColumn("end", (F.col("start") + length + 1).cast("long"))


def run_lengths(df: DataFrame, by: Sequence[str], order: Sequence[str], style: str) -> DataFrame:
    """Neighbouring rows of one style as one: style, first and last place, rows."""
    changed = ~F.col(style).eqNullSafe(F.lag(style).over(ordered(by, order)))
    first = F.row_number().over(ordered(by, order)) == 1
    numbered = islands(df, by, order, changed | first, "_run")
    return numbered.groupBy(*by, "_run").agg(F.first(style).alias(style), F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"), F.count("*").alias("rows")).drop("_run")


def parents(df: DataFrame, by: Sequence[str], order: Sequence[str], rank: str, pos: str, ranks: int = 6) -> DataFrame:
    """parent: the nearest row before with a smaller rank (rank 0: no heading, hangs below the last heading)."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col(rank) == 0, F.lit(ranks + 1)).otherwise(F.col(rank))
    out = F.lit(None).cast("long")
    for r in range(1, ranks + 1):  # the latest of those below each rank
        last = F.last(F.when((F.col(rank) > 0) & (F.col(rank) <= r), F.col(pos)), ignorenulls=True).over(w)
        out = F.when(own == r + 1, last).otherwise(out)
    return df.withColumn("parent", out)


def section_ends(df: DataFrame, by: Sequence[str], order: Sequence[str], level: str, pos: str, levels: int = 6) -> DataFrame:
    """end: place of the next heading of the same level or above; null at the last."""
    w = ordered(by, order).rowsBetween(1, Window.unboundedFollowing)
    out = F.lit(None).cast("long")
    for r in range(1, levels + 1):
        out = F.when(F.col(level) == r, F.first(F.when(F.col(level) <= r, F.col(pos)), ignorenulls=True).over(w)).otherwise(out)
    return df.withColumn("end", out)


def kept_apart(values: Column, tolerance: float) -> Column:
    """Sorted values, each further than the tolerance from the last one kept."""
    def step(kept: Column, x: Column) -> Column:
        return F.when((F.size(kept) == 0) | (x - F.try_element_at(kept, F.lit(-1)) > tolerance), F.concat(kept, F.array(x))).otherwise(kept)

    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), step)
