"""Queries over lines of documents and turns, with the SQL they equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import markers as m
from lectern.functions import text as t
from lectern.operators import furniture as fu
from lectern.operators import sequences as s
from lectern.sources import corpus as c

QUERIES, SQL = {}, {}

# A DuckDB form of Unicode blanks, spelt out: its \s is ASCII only.
B = "[ \\t\\n\\x0b\\f\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def key_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[0-9]+', '#', 'g'), '{B}', ' ', 'g'))"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("furniture_lines", f"""
WITH {c.LINES_SQL}, k AS (SELECT *, {key_sql('line')} AS key FROM lines),
n AS (SELECT source, count(DISTINCT doc_id) AS n FROM k GROUP BY source),
r AS (SELECT source, key FROM (SELECT source, key, count(DISTINCT doc_id) AS d FROM k GROUP BY source, key) JOIN n USING (source)
      WHERE n >= 2 AND d >= greatest(2, ceil(0.1::DOUBLE * n)))
SELECT k.source, k.doc_id, CAST(k.pos AS INTEGER) AS pos, k.line FROM k ANTI JOIN r ON k.source = r.source AND k.key = r.key""")
def furniture_lines(spark, d):
    return fu.without_furniture(c.lines(spark, d), "source", "doc_id", "line", 0.1).select("source", "doc_id", "pos", "line")


@query("furniture_keys", f"""
WITH {c.LINES_SQL}, k AS (SELECT *, {key_sql('line')} AS key FROM lines),
n AS (SELECT source, count(DISTINCT doc_id) AS n FROM k GROUP BY source)
SELECT source, key FROM (SELECT source, key, count(DISTINCT doc_id) AS d FROM k GROUP BY source, key) JOIN n USING (source)
WHERE n >= 2 AND d >= greatest(2, ceil(0.1::DOUBLE * n))""")
def furniture_keys(spark, d):
    return fu.repeated_keys(c.lines(spark, d), "source", "doc_id", "line", 0.1)


@query("page_number_offsets", """
WITH l AS (SELECT DISTINCT o_custkey AS doc_id, o_orderkey AS page FROM orders), p AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS i FROM l),
n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
f AS (SELECT doc_id, i, (page % 40) - i AS shift FROM p WHERE page % 40 < 30),
g AS (SELECT doc_id, shift, count(DISTINCT i) AS on_, min(i) AS first FROM f GROUP BY doc_id, shift),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY on_ DESC, first, shift) AS r FROM g)
SELECT doc_id, CAST(shift AS INTEGER) AS shift FROM b JOIN n USING (doc_id) WHERE r = 1 AND on_ >= greatest(3.0, n / 3.0)""")
def page_number_offsets(spark, d):
    orders = c.read(spark, d, "orders")
    number = F.col("o_orderkey") % 40
    line = F.when(number < 30, number.cast("string")).otherwise(F.lit("text 1"))
    return fu.page_number_offsets(orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), line.alias("line")), "doc_id", "page", "line")


@query("boilerplate_docs", f"""
WITH {c.LINES_SQL} SELECT doc_id, count(*) AS n_lines, NOT bool_or(regexp_matches(line, '(?i)all rights reserved')) AS selected,
  count(*) FILTER (WHERE regexp_matches(line, '(?i)copyright|©|all rights reserved')) AS copyright_lines FROM lines GROUP BY doc_id""")
def boilerplate_docs(spark, d):
    lines = c.lines(spark, d)
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), (~F.bool_or(F.col("line").rlike("(?i)all rights reserved"))).alias("selected"), F.count_if(t.is_copyright(F.col("line"))).alias("copyright_lines"))


@query("line_flags", f"""
WITH {c.LINES_SQL} SELECT doc_id, CAST(pos AS INTEGER) AS pos, regexp_matches(line, '^[ \\t\\n\\x0b\\f\\r*\\-–—_=~•·.]+$') AS decorative,
  regexp_matches({key_sql('line')}, '(?i)^[^a-z0-9_]*(page[ ]*)?#+([ ]*(of|/)[ ]*#+)?([ ]*[|][ ]*page)?[^a-z0-9_]*$') AS page_number,
  regexp_matches(line, '[.?!:]["''”’)]?[ \\t]*$') AS sentence_end FROM lines""")
def line_flags(spark, d):
    line = F.col("line")
    return c.lines(spark, d).select("doc_id", "pos", t.is_decorative(line).alias("decorative"), t.is_page_number(line).alias("page_number"), t.ends_sentence(line).alias("sentence_end"))


@query("line_markers", f"""
WITH {c.LINES_SQL}, k AS (SELECT doc_id, pos, regexp_extract(line, '^[ \\t]*([0-9]{{1,3}})[.]([ \\t]|$)', 1) AS de, regexp_extract(line, '^[ \\t]*[(]([a-zA-Z]{{1,5}})[)]', 1) AS pa,
  regexp_extract(regexp_extract(line, '^[ \\t]*([(]([a-zA-Z]{{1,5}}|[0-9]{{1,3}})[)]|([a-zA-Z]{{1,5}}|[0-9]{{1,3}})[.)])[ \\t]'), '[a-zA-Z]+|[0-9]+') AS tok FROM lines),
r AS (SELECT *, lower(tok) AS low FROM k)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN de <> '' THEN 'decimal' WHEN pa <> '' THEN 'paren' END AS scheme,
  CASE WHEN de <> '' THEN de WHEN pa <> '' THEN lower(pa) END AS token, CASE WHEN de <> '' THEN de || '.' WHEN pa <> '' THEN '(' || pa || ')' END AS label,
  CASE WHEN tok <> '' AND (regexp_matches(tok, '^[0-9]') OR replace(low, low[1], '') = '' OR regexp_matches(low, '^m{{0,3}}(cm|cd|d?c{{0,3}})(xc|xl|l?x{{0,3}})(ix|iv|v?i{{0,3}})$')) THEN tok END AS item
FROM r""")
def line_markers(spark, d):
    found = c.lines(spark, d).select("doc_id", "pos", m.heading_marker(F.col("line")).alias("mk"), m.item_marker(F.col("line")).alias("item"))
    return found.select("doc_id", "pos", "mk.scheme", "mk.token", "mk.label", "item")


@query("normalised_lines", f"""
WITH {c.LINES_SQL} SELECT doc_id, CAST(pos AS INTEGER) AS pos, trim(regexp_replace(line, '{B}', ' ', 'g')) AS collapsed,
  lower(regexp_replace(trim(regexp_replace(line, '{B}', ' ', 'g')), '^[.:]+|[.:]+$', '', 'g')) AS title_key,
  regexp_replace(replace(line, chr(9), ' '), '[\\x00-\\x08\\x0b-\\x1f\\x7f\\x{{e000}}-\\x{{f8ff}}]', '', 'g') AS cleaned FROM lines""")
def normalised_lines(spark, d):
    line = F.col("line")
    return c.lines(spark, d).select("doc_id", "pos", t.collapsed(line).alias("collapsed"), t.title_key(line).alias("title_key"), t.cleaned(line).alias("cleaned"))


@query("paragraph_offsets", f"""
WITH {c.LINES_SQL}, u AS (SELECT *, length(line) + len(regexp_extract_all(line, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS units FROM lines),
o AS (SELECT *, 1 + coalesce(sum(units + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(units AS BIGINT) AS units, CAST(start AS BIGINT) AS start, CAST(start + units + 1 AS BIGINT) AS "end" FROM o""")
def paragraph_offsets(spark, d):
    lines = c.lines(spark, d).select("doc_id", "pos", t.utf16_length(F.col("line")).alias("units"))
    return s.offsets(lines, ["doc_id"], ["pos"], F.col("units"))


@query("vocabulary", f"""
WITH {c.LINES_SQL} SELECT lang, count(DISTINCT w) AS words, count(*) AS word_docs FROM (SELECT DISTINCT lang, doc_id, lower(unnest(regexp_extract_all(line, '[A-Za-z]+'))) AS w FROM lines) GROUP BY lang""")
def vocabulary(spark, d):
    words = c.lines(spark, d).select("lang", "doc_id", F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select("lang", "doc_id", F.lower("w").alias("w")).distinct()
    return words.groupBy("lang").agg(F.count_distinct("w").alias("words"), F.count("*").alias("word_docs"))


# Prefixes that keep their hyphen.
PREFIXES = ("re", "co", "pre", "non", "self", "ex", "quasi", "cross", "post", "anti", "sub")


def hyphen_joined(df, vocabulary_, document="doc_id"):
    """left (ends with a hyphen), right (starts in lower case): one word where the document has it, else with the hyphen; a capital keeps both."""
    joined = F.lower(F.concat(F.expr("left(left_part, length(left_part) - 1)"), "right_part"))
    met = df.withColumn("w", joined).join(vocabulary_, [document, "w"], "left")
    stem = F.lower(F.expr("left(left_part, length(left_part) - 1)"))
    return met.withColumn("joined", F.when(~F.col("right_part").rlike("^[a-z]"), F.concat("left_part", F.lit(" "), "right_part")).when(stem.isin(*PREFIXES), F.concat("left_part", "right_part"))
                          .when(F.col("known").isNotNull(), F.concat(F.expr("left(left_part, length(left_part) - 1)"), "right_part")).otherwise(F.concat("left_part", "right_part")))


@query("hyphen_lines", f"""
WITH {c.LINES_SQL}, w AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(line, '[A-Za-z]+'))) AS w FROM lines),
a AS (SELECT doc_id, pos, regexp_extract(line, '([A-Za-z]+)[^A-Za-z]*$', 1) AS x, regexp_extract(lead(line) OVER (PARTITION BY doc_id ORDER BY pos), '^([a-zA-Z]+)', 1) AS y FROM lines),
p AS (SELECT * FROM a WHERE x <> '' AND y <> '')
SELECT p.doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN NOT regexp_matches(y, '^[a-z]') THEN x || '- ' || y WHEN lower(x) IN ('re','co','pre','non','self','ex','quasi','cross','post','anti','sub') THEN x || '-' || y
  WHEN w.w IS NOT NULL THEN x || y ELSE x || '-' || y END AS joined FROM p LEFT JOIN w ON p.doc_id = w.doc_id AND w.w = lower(x || y)""")
def hyphen_lines(spark, d):
    lines = c.lines(spark, d)
    words = lines.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select("doc_id", F.lower("w").alias("w"), F.lit(True).alias("known")).distinct()
    nxt = F.lead("line").over(Window.partitionBy("doc_id").orderBy("pos"))
    pairs = lines.select("doc_id", "pos", F.regexp_extract("line", "([A-Za-z]+)[^A-Za-z]*$", 1).alias("x"), F.regexp_extract(nxt, "^([a-zA-Z]+)", 1).alias("right_part")).where("x <> '' and right_part <> ''")
    return hyphen_joined(pairs.withColumn("left_part", F.concat("x", F.lit("-"))), words).select("doc_id", "pos", "joined")


@query("merged_titles", f"""
WITH t AS (SELECT conv_id AS doc_id, turn AS page, role AS title FROM conversations),
g AS (SELECT *, CASE WHEN lower(title) IS NOT DISTINCT FROM lag(lower(title)) OVER (PARTITION BY doc_id ORDER BY page) AND row_number() OVER (PARTITION BY doc_id ORDER BY page) > 1 THEN 0 ELSE 1 END AS b FROM t),
i AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT doc_id, CAST(run AS BIGINT) AS run, any_value(title) AS title, min(page) AS first_page, max(page) AS last_page, count(*) AS pages FROM i GROUP BY doc_id, run""")
def merged_titles(spark, d):
    slides = c.read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.col("role").alias("title"))
    w = Window.partitionBy("doc_id").orderBy("page")
    changed = ~t.title_key(F.col("title")).eqNullSafe(F.lag(t.title_key(F.col("title"))).over(w)) | (F.row_number().over(w) == 1)
    return s.islands(slides, ["doc_id"], ["page"], changed, "run").groupBy("doc_id", "run").agg(F.first("title").alias("title"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("pages"))


@query("style_ranges", """
WITH g AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS r FROM g)
SELECT conv_id AS doc_id, any_value(role) AS style, min(turn) AS first, max(turn) AS last, count(*) AS rows FROM i GROUP BY conv_id, r""")
def style_ranges(spark, d):
    turns = c.read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("role").alias("style"))
    return s.run_lengths(turns, ["doc_id"], ["turn"], "style")


@query("text_layer_status", """
WITH p AS (SELECT conv_id AS doc_id, turn AS page, length(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]', '', 'g')) AS chars FROM conversations)
SELECT doc_id, CAST(sum(chars) AS BIGINT) AS chars, count(DISTINCT page) AS pages, sum(chars) < 15 * count(DISTINCT page) AS rejected, count(*) FILTER (WHERE chars = 0) AS empty_pages FROM p GROUP BY doc_id""")
def text_layer_status(spark, d):
    pages = c.read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.length(F.regexp_replace("text", r"\s", "")).alias("chars"))
    out = pages.groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.count_distinct("page").alias("pages"), F.count_if(F.col("chars") == 0).alias("empty_pages"))
    return out.withColumn("rejected", F.col("chars") < 15 * F.col("pages"))


@query("page_range", f"""WITH {c.TURNS_SQL} SELECT doc_id, page, CAST(pos AS INTEGER) AS pos, line FROM turn_lines WHERE page BETWEEN 2 AND 3""")
def page_range(spark, d):
    low, high = parse_range("2-3")
    return c.turn_lines(spark, d).where(F.col("page").between(low, high)).select("doc_id", "page", "pos", "line")


def parse_range(text: str) -> tuple[int, int]:
    """`4` or `2-5` as first and last page."""
    low, dash, high = text.partition("-")
    first = int(low)
    return first, int(high) if dash else first


@query("selection_counts", f"""
WITH {c.TURNS_SQL} SELECT doc_id, count(*) FILTER (WHERE role = 'user' AND pos = 0) AS headings, count(*) FILTER (WHERE role <> 'system') AS ticked, count(*) FILTER (WHERE line <> '') AS total FROM turn_lines GROUP BY doc_id""")
def selection_counts(spark, d):
    lines = c.turn_lines(spark, d)
    heading, selected = (F.col("role") == "user") & (F.col("pos") == 0), F.col("role") != "system"
    return lines.groupBy("doc_id").agg(F.count_if(heading).alias("headings"), F.count_if(selected).alias("ticked"), F.count_if(F.col("line") != "").alias("total"))


@query("lone_number_lines", f"""
WITH {c.TURNS_SQL}, s AS (SELECT doc_id, page, pos, line, list_filter(regexp_split_to_array(trim(regexp_replace(line, '{B}', ' ', 'g')), ' '), lambda x: x <> '') AS ts FROM turn_lines)
SELECT doc_id, page, CAST(pos AS INTEGER) AS pos, CASE WHEN len(list_filter(ts, lambda x: NOT regexp_full_match(x, '[0-9]{{1,3}}'))) = 0 THEN list_transform(ts, lambda x: CAST(x AS INTEGER)) ELSE [] END AS numbers FROM s""")
def lone_number_lines(spark, d):
    return c.turn_lines(spark, d).select("doc_id", "page", "pos", t.lone_numbers(F.col("line")).alias("numbers"))


@query("outline_text", f"""
WITH {c.TURNS_SQL}, l AS (SELECT *, CASE WHEN pos = 0 THEN '## ' || CASE WHEN role = 'system' THEN '(skipped) ' ELSE '' END || line ELSE '  - ' || line END AS o FROM turn_lines)
SELECT doc_id, string_agg(o, chr(10) ORDER BY page, pos) AS outline FROM l GROUP BY doc_id""")
def outline_text(spark, d):
    skipped = F.when(F.col("role") == "system", "(skipped) ").otherwise("")
    row = F.when(F.col("pos") == 0, F.concat(F.repeat(F.lit("#"), F.lit(2)), F.lit(" "), skipped, "line")).otherwise(F.concat(F.repeat(F.lit(" "), F.lit(2)), F.lit("- "), "line"))
    rows = c.turn_lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "pos", row.alias("o")))).alias("rows"))
    return rows.select("doc_id", F.array_join(F.transform("rows", lambda r: r["o"]), "\n").alias("outline"))
