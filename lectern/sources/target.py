"""Target documents as JSON: their tabs, body elements, headings, and where text may be added."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ELEMENT = "startIndex:bigint,endIndex:bigint,paragraph:struct<elements:array<struct<textRun:struct<content:string>>>,paragraphStyle:struct<namedStyleType:string>,bullet:struct<listId:string,nestingLevel:int>>,table:struct<rows:int,columns:int>,sectionBreak:struct<sectionStyle:string>"
TAB = "tabProperties struct<tabId:string,title:string>, documentTab string"


def tabs(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """doc_id, path, depth, tab_id, title, body: every tab, depth first (path orders them). One pass for each depth that there is."""
    now = docs.select("doc_id", F.posexplode(F.from_json(F.get_json_object(raw, "$.tabs"), "array<string>")).alias("n", "json")).select("doc_id", F.array("n").alias("path"), "json")
    found = now
    while True:
        below = now.select("doc_id", "path", F.posexplode(F.from_json(F.get_json_object("json", "$.childTabs"), "array<string>")).alias("n", "json"))
        now = below.select("doc_id", F.concat("path", F.array("n")).alias("path"), "json")
        if now.isEmpty():
            break
        found = found.unionByName(now)
    tab = found.withColumn("tab", F.from_json("json", TAB))
    return tab.select("doc_id", "path", F.size("path").alias("depth"), F.col("tab.tabProperties.tabId").alias("tab_id"), F.col("tab.tabProperties.title").alias("title"), F.col("tab.documentTab").alias("body"))


def body(df: DataFrame, raw: str = "raw") -> DataFrame:
    """doc_id, ord, start_index, end_index, kind, named_style, text, list_id, nesting_level."""
    content = F.from_json(F.get_json_object(raw, "$.body.content"), f"array<struct<{ELEMENT}>>")
    rows = df.select("doc_id", F.posexplode(content).alias("ord", "e"))
    kind = F.when(F.col("e.paragraph").isNotNull(), "paragraph").when(F.col("e.table").isNotNull(), "table").otherwise("sectionBreak")
    text = F.array_join(F.transform(F.coalesce("e.paragraph.elements", F.array()), lambda x: F.coalesce(x["textRun"]["content"], F.lit(""))), "")
    return rows.select(
        "doc_id", "ord", F.coalesce("e.startIndex", F.lit(0)).alias("start_index"), F.col("e.endIndex").alias("end_index"), kind.alias("kind"),
        F.col("e.paragraph.paragraphStyle.namedStyleType").alias("named_style"), text.alias("text"), F.col("e.paragraph.bullet.listId").alias("list_id"), F.col("e.paragraph.bullet.nestingLevel").alias("nesting_level"),
    )


def headings(rows: DataFrame) -> DataFrame:
    """doc_id, ord, start_index, level, text of headings that show something; a title counts as level 1."""
    level = F.when(F.col("named_style") == "TITLE", 1).otherwise(F.expr("try_cast(nullif(regexp_extract(named_style, '^HEADING_([1-6])$', 1), '') AS int)"))
    return rows.withColumn("level", level).where("level is not null and trim(replace(text, chr(10), ' ')) <> ''").select("doc_id", "ord", "start_index", "level", F.trim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("text"))


def end_state(rows: DataFrame) -> DataFrame:
    """doc_id, end (before the last line feed), blank (the last paragraph is empty), after_table."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    last = rows.withColumns({"_kind": F.lag("kind").over(w), "_next": F.lead("ord").over(w)}).where("_next is null")
    return last.select("doc_id", (F.col("end_index") - 1).alias("end"), ((F.col("kind") == "paragraph") & (F.trim(F.replace("text", F.lit("\n"), F.lit(""))) == "")).alias("blank"), F.coalesce(F.col("_kind") == "table", F.lit(False)).alias("after_table"))


def rematched(heads: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, start_index, text) -> the heading's start now: at the same place with the same text, else the first with that text, else null."""
    same = heads.select("doc_id", "start_index", "text", F.col("start_index").alias("_same"))
    first = heads.groupBy("doc_id", "text").agg(F.min("start_index").alias("_first"))
    return wanted.join(same, ["doc_id", "start_index", "text"], "left").join(first, ["doc_id", "text"], "left").select("doc_id", "start_index", "text", F.coalesce("_same", "_first").alias("now"))
