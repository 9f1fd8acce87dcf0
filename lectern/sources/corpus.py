"""The supplied tables as documents: lines, turns of a conversation, blocks of a web page, items of an order.

Order is data: every view has an explicit `pos` from posexplode or from a total order, never from a generated id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, pos, line."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, role, pos, line: a conversation as a deck, a turn as a slide."""
    turns = read(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "role", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


#: What counts as a block of a page.
TAGS = ("title", "h1", "p", "li", "footer")


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, host, pos, tag, text: blocks of a page, scripts, styles and comments taken out first."""
    pages = read(spark, sf_dir, "pages")
    bare = F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    found = F.expr(r"regexp_extract_all(bare, '(?s)<(?:title|h1|p|li|footer)[^a-z>]*?[^>]*>.*?</(?:title|h1|p|li|footer)>', 0)")
    blocks = pages.select("page_id", "url", bare.alias("bare")).select("page_id", "url", F.posexplode(found).alias("pos", "block"))
    text = F.trim(F.regexp_replace(F.regexp_replace("block", r"(?s)<[^>]*>", " "), r"[ \t\n\r]+", " "))
    return blocks.select(
        F.col("page_id").alias("doc_id"), F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), "pos",
        F.regexp_extract("block", r"^<([a-z0-9]+)", 1).alias("tag"), text.alias("text"),
    )


HTML_SQL = r"""
html_blocks AS (
  SELECT doc_id, host, pos, regexp_extract(block, '^<([a-z0-9]+)', 1) AS tag,
         trim(regexp_replace(regexp_replace(block, '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text
  FROM (SELECT page_id AS doc_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, unnest(bs) AS block, unnest(range(0, len(bs))) AS pos
        FROM (SELECT page_id, url, regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
                '(?s)<(?:title|h1|p|li|footer)[^a-z>]*?[^>]*>.*?</(?:title|h1|p|li|footer)>') AS bs FROM pages)))"""
LINES_SQL = """
lines AS (SELECT doc_id, source, lang, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line
          FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS ls FROM documents))"""
TURNS_SQL = """
turn_lines AS (SELECT doc_id, page, role, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line
          FROM (SELECT conv_id AS doc_id, turn AS page, role, string_split(text, chr(10)) AS ls FROM conversations))"""

ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (the order), pos, number, name: typed list items `n. name`."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", *ITEM_ORDER)
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ITEM_ORDER)) - 1
    return items.withColumn("pos", pos).join(part, "l_partkey").select(F.col("l_orderkey").alias("doc_id"), "pos", F.col("l_linenumber").alias("number"), "name")


ITEMS_SQL = f"""
order_items AS (SELECT l_orderkey AS doc_id, pos, l_linenumber AS number, p_name AS name FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ITEM_ORDER)}) - 1 AS pos FROM lineitem) JOIN part ON l_partkey = p_partkey)"""
