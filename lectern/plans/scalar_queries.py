"""Queries over colours, runs, symbols, links and settings; literal rows stand beside the tables where those have no such data."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import colour as co
from lectern.functions import links as ln
from lectern.functions import runs as rn
from lectern.functions import symbols as sy
from lectern.functions import text as t
from lectern.schemas import RUN
from lectern.sources import corpus as c

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def vectors(*rows: tuple, names: str) -> str:
    """The same VALUES for both engines."""
    def lit(x):
        return "NULL" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


@query("colour_codes", """
WITH p AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v FROM part), k AS (SELECT *, v // 65536 AS r, v // 256 % 256 AS g, v % 256 AS b FROM p),
m AS (SELECT *, greatest(r, g, b) AS h, least(r, g, b) AS l FROM k)
SELECT p_partkey, CASE WHEN h < 48 OR l > 230 OR (h < 80 AND h - l < 16) THEN NULL ELSE printf('#%02X%02X%02X', r, g, b) END AS code,
  CASE WHEN h < 48 OR l > 230 OR (h < 80 AND h - l < 16) THEN NULL ELSE 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b < 140 END AS dark FROM m""")
def colour_codes(spark, d):
    parts = c.read(spark, d, "part").select("p_partkey", co.code_of((F.col("p_partkey") * 7919) % 16777216).alias("code"))
    return parts.withColumn("dark", co.is_dark(F.col("code")))


@query("page_links", """
SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host, nullif(regexp_extract(url, '/document/d/([a-zA-Z0-9_-]{20,})', 1), '') AS doc_id, nullif(regexp_extract(url, '[?&#]tab=([a-zA-Z0-9._-]+)', 1), '') AS tab_id FROM pages""")
def page_links(spark, d):
    url = F.col("url")
    return c.read(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract(url, "^https?://([^/]+)", 1), F.lit("")).alias("host"), ln.document_id(url).alias("doc_id"), ln.tab_id(url).alias("tab_id"))


# The named styles that headings may map to, and the usual map.
NAMED_STYLES = ("TITLE", "SUBTITLE", "HEADING_1", "HEADING_2", "HEADING_3", "HEADING_4", "HEADING_5", "HEADING_6", "NORMAL_TEXT")
HEADING_MAP = {"title": "HEADING_1", "section": "HEADING_1", "decimal": "HEADING_2", "alpha": "HEADING_3", "roman": "HEADING_4"}


def settings(raw):
    """JSON text -> the heading map in force: unknown or invalid styles are passed over, bad JSON gives the usual map."""
    usual = F.create_map(*[F.lit(x) for kv in HEADING_MAP.items() for x in kv])
    user = F.from_json(raw, "heading_map map<string,string>")["heading_map"]
    valid = F.map_filter(F.coalesce(user, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: v.isin(*NAMED_STYLES) & F.array_contains(F.map_keys(usual), k))
    return F.map_concat(F.map_filter(usual, lambda k, v: ~F.array_contains(F.map_keys(valid), k)), valid)


@query("html_blocks", f"WITH {c.HTML_SQL} SELECT doc_id, host, CAST(pos AS INTEGER) AS pos, tag, text FROM html_blocks")
def html_blocks(spark, d):
    return c.html_blocks(spark, d)


@query("html_outline", f"""
WITH {c.HTML_SQL} SELECT doc_id, string_agg(CASE tag WHEN 'title' THEN '# ' || text WHEN 'h1' THEN '## ' || text WHEN 'li' THEN '  - ' || text ELSE text END, chr(10) ORDER BY pos) AS outline FROM html_blocks WHERE tag <> 'footer' GROUP BY doc_id""")
def html_outline(spark, d):
    row = F.when(F.col("tag") == "title", F.concat(F.lit("# "), "text")).when(F.col("tag") == "h1", F.concat(F.lit("## "), "text")).when(F.col("tag") == "li", F.concat(F.lit("  - "), "text")).otherwise(F.col("text"))
    rows = c.html_blocks(spark, d).where("tag <> 'footer'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", row.alias("o")))).alias("rows"))
    return rows.select("doc_id", F.array_join(F.transform("rows", lambda r: r["o"]), "\n").alias("outline"))


@query("html_preview", f"""
WITH {c.TURNS_SQL}, e AS (SELECT *, replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS x FROM turn_lines)
SELECT doc_id, string_agg(CASE WHEN pos = 0 THEN '<h2>' || x || '</h2>' ELSE '<p>' || x || '</p>' END, '' ORDER BY page, pos) AS html FROM e GROUP BY doc_id""")
def html_preview(spark, d):
    x = t.escaped(F.col("line"))
    row = F.when(F.col("pos") == 0, F.concat(F.lit("<h2>"), x, F.lit("</h2>"))).otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>")))
    rows = c.turn_lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "pos", row.alias("o")))).alias("rows"))
    return rows.select("doc_id", F.array_join(F.transform("rows", lambda r: r["o"]), "").alias("html"))


@query("copyright_footers", f"""
WITH {c.HTML_SQL} SELECT host, count(*) FILTER (WHERE tag = 'footer') AS footers, count(*) FILTER (WHERE tag = 'footer' AND regexp_matches(replace(text, '&copy;', '©'), '(?i)copyright|©|all rights reserved')) AS notices FROM html_blocks GROUP BY host""")
def copyright_footers(spark, d):
    footer = F.col("tag") == "footer"
    text = F.replace(F.col("text"), F.lit("&copy;"), F.lit("©"))
    return c.html_blocks(spark, d).groupBy("host").agg(F.count_if(footer).alias("footers"), F.count_if(footer & t.is_copyright(text)).alias("notices"))


@query("dry_run_plans", None)
def dry_run_plans(spark, d):
    """A document's plan as one JSON line."""
    rows = c.turn_lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "pos", "line"))).alias("batches"))
    return rows.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("document_id"), F.lit("dry run").alias("note"), "batches")).alias("plan"))
