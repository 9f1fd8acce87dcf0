"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sources share all words by weight; none may exceed `epochs` times its own words, and what one can't take is shared again by
weight. The level of that filling has a closed form: with sources ordered by cap / weight, the level that follows from the
first k sources being full is largest just where the last full one is passed, so the answer is the maximum over k.
A source's target is met by whole repetitions of all its documents and one further repetition of those that come first in a
seeded order, up to the wanted words. The place in that order where a source stops is found from sums over 4096 slices of the
order; only the slice it falls in is sorted, so a source with a third of all rows is never sorted as one.

Defined cases: null or empty texts have size 0 and are never taken; a null source is a source of its own, last in order; rows
that repeat a doc_id are documents of their own; without any word all targets are 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import fresh, staged, table, word_count

WEIGHTS = (5, 2, 1)
#: Beyond so many sources their table is joined by a shuffle instead of a broadcast (some 60 bytes each).
BROADCAST_SOURCES = 20_000
SLICE_BITS, HASH_BITS = 12, 60


def water_levels(sizes: DataFrame, weights=WEIGHTS, epochs: int = 3) -> DataFrame:
    """(source, source_size) -> the same with weight and target. One row for each source, so plain windows do."""
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights)).cast("int"))
    caps = ranked.withColumns({"weight": weight, "cap": F.col("source_size") * float(epochs)})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    all_words = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    levels = caps.withColumn("level", (all_words - before) / after)
    top = F.max("level").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("target", F.least("cap", F.col("weight") * top)).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = 3, seed: int = 7, text: str = "text", source: str = "source", key: str = "doc_id", words: str | None = None) -> DataFrame:
    """docs with size, source_size, target (its source's) and taken (words the mix takes, repeats counted). words: a column that has the size already."""
    size, source_size, target, taken, h, whole, stop, rest, cell = fresh(docs.columns, "size", "source_size", "target", "taken", "h", "whole", "stop", "rest", "cell")
    seeded = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"))
    hashed = F.conv(F.substring(seeded, 1, HASH_BITS // 4), 16, 10).cast("long")
    sized = docs.withColumns({size: F.col(words) if words else word_count(text), h: hashed})
    cells = staged(
        sized.groupBy(F.col(source).alias("source"), F.shiftright(h, HASH_BITS - SLICE_BITS).cast("int").alias("cell")).agg(F.sum(size).alias("words")),
        "mix-cells",
    )
    levels = water_levels(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    levels = levels.withColumn("whole", repeats.cast("long")).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    lv, c = levels.alias("lv"), cells.alias("c")
    run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        c.join(lv, F.expr("c.source <=> lv.source"))
        .select("c.source", "c.cell", "c.words", "lv.source_size", "lv.target", "lv.whole", "lv.want")
        .withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    )
    # The first cell that ends beyond the wanted words; none: every cell is taken whole.
    open_cell = F.col("before") + F.col("words") > F.col("want")
    stops = placed.groupBy("source").agg(
        F.first("source_size").alias(source_size), F.first("target").alias(target), F.first("whole").alias(whole),
        F.coalesce(F.min(F.when(open_cell, F.col("cell"))), F.lit(1 << SLICE_BITS)).alias(stop),
        F.min(F.when(open_cell, F.struct("cell", (F.col("want") - F.col("before")).alias("rest")))).getField("rest").alias(rest),
    ).withColumnRenamed("source", cell)
    stops = staged(stops, "mix-stops")
    few = stops.count() <= BROADCAST_SOURCES
    met = sized.join(F.broadcast(stops) if few else stops, F.col(source).eqNullSafe(F.col(cell))).drop(cell)
    slice_ = F.shiftright(h, HASH_BITS - SLICE_BITS).cast("int")
    sure = met.where(slice_ != F.col(stop)).withColumn(taken, F.col(size) * (F.col(whole) + (slice_ < F.col(stop)).cast("long")))
    order = Window.partitionBy(source).orderBy(h, key, size).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(size).over(order), F.lit(0))
    cut = met.where(slice_ == F.col(stop)).withColumn(taken, F.col(size) * (F.col(whole) + (ahead + F.col(size) / 2 <= F.col(rest)).cast("long")))
    return sure.unionByName(cut).select(*docs.columns, size, source_size, target, taken)


def op10_water_filling(spark, sf_dir):
    """Texts are read once: both passes of the mix go over their word counts."""
    counted = staged(table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("words")), "mix-words")
    return mix(counted, words="words").select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('7|' || CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM s),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap FROM r),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM l)) AS target FROM l),
x AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
o AS (SELECT d.doc_id, d.size, x.source_size, x.target, x.whole, x.target - x.whole * x.source_size AS want,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN ahead + size / 2.0::DOUBLE <= want THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""
