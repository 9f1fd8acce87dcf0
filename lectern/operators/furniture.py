"""Repeated headers and footers, page numbers and boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import furniture_key, lone_numbers

#: Fixed value: an image on this share of the pages (and on three at least) is decoration.
IMAGE_SHARE = 0.3


def repeated_keys(df: DataFrame, document: str, page: str, text: str, share: float = 0.5, least: int = 2) -> DataFrame:
    """document, key: keys on at least `share` of a document's pages, and on `least` of them."""
    pages = df.groupBy(document).agg(F.count_distinct(page).alias("_pages"))
    keys = df.select(document, page, furniture_key(F.col(text)).alias("key")).distinct().groupBy(document, "key").agg(F.count("*").alias("_on"))
    met = keys.join(pages, document).where((F.col("_pages") >= 2) & (F.col("_on") >= F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("_pages")))))
    return met.select(document, "key")


def without_furniture(df: DataFrame, document: str, page: str, text: str, share: float = 0.5) -> DataFrame:
    """Lines that aren't among the repeated ones of their document."""
    keyed = df.withColumn("key", furniture_key(F.col(text)))
    return keyed.join(repeated_keys(df, document, page, text, share), [document, "key"], "left_anti")


def page_number_offsets(df: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """document, shift: what lone numbers exceed their page's index by on most pages; three pages and a third of all must agree."""
    paged = df.withColumn("_i", F.dense_rank().over(Window.partitionBy(document).orderBy(page)) - 1)
    pages = paged.groupBy(document).agg(F.count_distinct(page).alias("_pages"))
    found = paged.select(document, "_i", F.explode(lone_numbers(F.col(text))).alias("_n")).select(document, "_i", (F.col("_n") - F.col("_i")).alias("shift")).distinct()
    counts = found.groupBy(document, "shift").agg(F.count("*").alias("_on"), F.min("_i").alias("_first"))
    best = counts.groupBy(document).agg(F.max_by(F.struct("shift", "_on"), F.struct("_on", (-F.col("_first")).alias("f"), (-F.col("shift")).alias("s"))).alias("b"))
    met = best.join(pages, document).where(F.col("b._on") >= F.greatest(F.lit(3.0), F.col("_pages") / 3))
    return met.select(document, F.col("b.shift").alias("shift"))
