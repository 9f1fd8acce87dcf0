"""Queries that build blocks from lines, points from slides, and ticks from outlines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import runs as rn
from lectern.functions import text as t
from lectern.operators import drawn as dr
from lectern.operators import layout as ly
from lectern.operators import paragraphs as pg
from lectern.operators import sequences as s
from lectern.operators import slides as sl
from lectern.operators.fold import fold_by_doc
from lectern.plans import layout_queries as lq
from lectern.plans.measure_queries import headings
from lectern.sources import corpus as c

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("tick_states", """
WITH RECURSIVE h AS (SELECT o_custkey AS doc_id, o_orderkey % 3 <> 0 AS ticked, CAST(o_orderpriority[1] AS INTEGER) AS level, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders),
p AS (SELECT a.doc_id, a.pos, a.ticked, max(b.pos) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.pos < a.pos AND b.level < a.level GROUP BY ALL),
r AS (SELECT doc_id, pos, pos AS top, ticked, parent FROM p UNION ALL SELECT r.doc_id, r.pos, p.pos, r.ticked, p.parent FROM r JOIN p ON r.doc_id = p.doc_id AND r.parent = p.pos)
SELECT doc_id, top AS pos, CASE WHEN bool_and(ticked) THEN 'all' WHEN bool_or(ticked) THEN 'some' ELSE 'none' END AS state FROM r GROUP BY doc_id, top""")
def tick_states(spark, d):
    orders = c.read(spark, d, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    rows = orders.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 3 != 0).alias("ticked"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), pos.cast("long").alias("pos"))
    return fold_by_doc(s.parents(rows, ["doc_id"], ["pos"], "level", "pos").fillna(-1, ["parent"]), ["doc_id"], ["pos"], pg.ticks, "doc_id bigint, pos bigint, state string")


@query("subtitle_repeats", """
WITH t AS (SELECT conv_id AS doc_id, turn AS page, role, split_part(text, ' ', 1) AS subtitle FROM conversations),
l AS (SELECT *, lag(role) OVER w AS pr, lag(subtitle) OVER w AS ps FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY page))
SELECT doc_id, page, NOT coalesce(pr = role AND lower(ps) = lower(subtitle), false) AS shown FROM l""")
def subtitle_repeats(spark, d):
    """A subtitle shows unless the slide before, under the same title, had it."""
    w = Window.partitionBy("doc_id").orderBy("page")
    rows = c.read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "role", F.split_part("text", F.lit(" "), F.lit(1)).alias("subtitle"))
    same = (F.lag("role").over(w) == F.col("role")) & (F.lower(F.lag("subtitle").over(w)) == F.lower("subtitle"))
    return rows.select("doc_id", "page", (~F.coalesce(same, F.lit(False))).alias("shown"))


@query("title_blocks", """
WITH h AS (SELECT o_custkey AS doc_id, CAST(o_orderpriority[1] AS INTEGER) AS level, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders)
SELECT doc_id, pos, coalesce(max(CASE WHEN level <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS selected FROM h""")
def title_blocks(spark, d):
    """What stands before the first real heading is the title block, and not ticked."""
    rows = headings(spark, d)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("doc_id", "pos", (F.max((F.col("level") <= 2).cast("int")).over(w) == 1).alias("selected"))


@query("picture_filters", """
WITH i AS (SELECT p_partkey, p_retailprice AS w, p_size * 20.0::DOUBLE AS h FROM part)
SELECT p_partkey, w * h / (1000 * 800.0::DOUBLE) BETWEEN 0.02::DOUBLE AND 0.7::DOUBLE AND greatest(w / h, h / w) <= 3 AS kept FROM i""")
def picture_filters(spark, d):
    """Pictures of a fair share of the page, not too long or tall."""
    w, h = F.col("p_retailprice"), F.col("p_size") * F.lit(20.0)
    return c.read(spark, d, "part").select("p_partkey", ((w * h / F.lit(800000.0)).between(0.02, 0.7) & (F.greatest(w / h, h / w) <= 3)).alias("kept"))


@query("faint_spans", """
WITH p AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v FROM part) SELECT p_partkey FROM p WHERE least(v // 65536, v // 256 % 256, v % 256) <= 150""")
def faint_spans(spark, d):
    """Nearly white text goes."""
    v = (F.col("p_partkey") * 7919) % 16777216
    low = F.least(*[F.shiftright(v, by).bitwiseAND(F.lit(255)) for by in (16, 8, 0)])
    return c.read(spark, d, "part").where(low <= 150).select("p_partkey")


@query("written_blocks", f"""WITH {c.LINES_SQL} SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM lines WHERE trim(line) <> ''""")
def written_blocks(spark, d):
    return c.lines(spark, d).where(t.collapsed(F.col("line")) != "").select("doc_id", "pos")


@query("toc_and_junk", f"""
WITH {c.LINES_SQL} SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM lines WHERE NOT regexp_matches(line, '(?i)^(toc|contents|click to (add|edit))') AND NOT regexp_matches(line, '^[ \\t*\\-–—_=~•·.]+$')""")
def toc_and_junk(spark, d):
    return c.lines(spark, d).where(~F.col("line").rlike("(?i)^(toc|contents|click to (add|edit))") & ~t.is_decorative(F.col("line"))).select("doc_id", "pos", "line")


@query("line_sizes", """
WITH s AS (SELECT l_orderkey AS doc_id, round_even(l_quantity, 1) AS size, l_linenumber AS n, l_extendedprice AS y FROM lineitem),
m AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY sum(n) DESC, size) AS r FROM s GROUP BY doc_id, size),
b AS (SELECT doc_id, y, row_number() OVER (PARTITION BY doc_id ORDER BY y) - 1 AS a, count(*) OVER (PARTITION BY doc_id) AS c FROM s)
SELECT m.doc_id, m.size, b.y AS baseline FROM m JOIN b ON m.doc_id = b.doc_id AND r = 1 AND a = c // 2""")
def line_sizes(spark, d):
    """A line's commonest size by characters (the smaller of equals), and the upper median of its baselines."""
    spans = c.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.bround("l_quantity", 1).alias("size"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("y"))
    sizes = spans.groupBy("doc_id", "size").agg(F.sum("n").alias("n")).groupBy("doc_id").agg(F.max_by("size", F.struct("n", (-F.col("size")).alias("s"))).alias("size"))
    return sizes.join(s.floor_percentile(spans, ["doc_id"], "y", 0.5, "baseline"), "doc_id")


@query("slide_pitches", """
WITH e AS (SELECT user_id, event_id % 2 AS col, value AS y, 8.0::DOUBLE + event_id % 2 AS size, event_id FROM events), g AS (SELECT *, lag(y) OVER w AS py, lag(size) OVER w AS ps FROM e WINDOW w AS (PARTITION BY user_id, col ORDER BY y, event_id))
SELECT user_id, CAST(round_even(ps, 0) AS INTEGER) AS size, min(y - py) AS pitch FROM g WHERE abs(size - ps) <= 0.6::DOUBLE AND y - py > 0.5::DOUBLE * ps GROUP BY ALL""")
def slide_pitches(spark, d):
    """The least gap of lines of a size in a column, over half the size."""
    e = c.read(spark, d, "events").select("user_id", (F.col("event_id") % 2).alias("col"), F.col("value").alias("y"), (F.lit(8.0) + F.col("event_id") % 2).alias("size"), "event_id")
    w = Window.partitionBy("user_id", "col").orderBy("y", "event_id")
    g = e.withColumns({"dy": F.col("y") - F.lag("y").over(w), "ps": F.lag("size").over(w)}).where((F.abs(F.col("size") - F.col("ps")) <= 0.6) & (F.col("dy") > 0.5 * F.col("ps")))
    return g.groupBy("user_id", F.bround("ps", 0).cast("int").alias("size")).agg(F.min("dy").alias("pitch"))


DECK_SQL = """
k AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS line, o_clerk_size AS size, y0, bullet, text, 540.0::DOUBLE AS height FROM (
  SELECT *, CAST(20 + o_orderkey % 5 * 5 AS DOUBLE) AS o_clerk_size, CAST(o_orderkey % 30 * 18 AS DOUBLE) AS y0, CASE WHEN o_orderkey % 6 = 0 THEN '•' END AS bullet, o_orderpriority AS text FROM orders))"""


def deck_lines(spark, d):
    """A customer's orders as the lines of one slide."""
    k = F.col("o_orderkey")
    line = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return c.read(spark, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), line.cast("long").alias("line"), (20 + k % 5 * 5).cast("double").alias("size"), (k % 30 * 18).cast("double").alias("y0"), F.when(k % 6 == 0, "•").alias("bullet"),
        F.col("o_orderpriority").alias("text"), F.lit(540.0).alias("height"),
    )


@query("section_slides", f"""
WITH {DECK_SQL} SELECT doc_id, count(*) <= 3 AND sum(length(trim(text)) + 1) - 1 <= 100 AND min(size) >= 32 AND NOT bool_or(bullet IS NOT NULL) AND arg_min(y0, line) > 0.25::DOUBLE * max(height) AS section FROM k GROUP BY doc_id""")
def section_slides(spark, d):
    return sl.section_slides(deck_lines(spark, d), ["doc_id"])


@query("slide_titles", f"""
WITH {DECK_SQL}, f AS (SELECT *, first_value(size) OVER w AS s, lag(y0) OVER w AS p, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
o AS (SELECT *, CASE WHEN n = 1 THEN bullet IS NULL AND y0 <= 0.35::DOUBLE * height ELSE bullet IS NULL AND abs(size - s) <= 1 AND y0 - p > 0 AND y0 - p <= 1.6::DOUBLE * size END AS t FROM f)
SELECT doc_id, line, bool_and(t) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS title FROM o""")
def slide_titles(spark, d):
    return sl.slide_titles(deck_lines(spark, d), ["doc_id"]).select("doc_id", "line", "title")


@query("underlined_spans", f"""
WITH {lq.BOXES_SQL} SELECT DISTINCT s.box FROM b s JOIN b r ON s.doc_id = r.doc_id AND s.box <> r.box AND r.y0 - s.y1 >= -0.1::DOUBLE * 12 AND r.y0 - s.y1 <= 0.4::DOUBLE * 12 AND least(s.x1, r.x1) - greatest(s.x0, r.x0) > 0.5::DOUBLE * (s.x1 - s.x0)""")
def underlined_spans(spark, d):
    b = lq.boxes(spark, d)
    spans = b.select("doc_id", "box", "x0", "x1", F.col("y1").alias("baseline"), F.lit(12.0).alias("size"))
    return dr.underlined(spans, b.select("doc_id", "x0", "x1", F.col("y0").alias("y")), ["doc_id"], "box")


@query("line_words", f"""
WITH {c.TURNS_SQL}, w AS (SELECT doc_id, page, pos, list_filter(string_split(replace(line, chr(9), ' '), ' '), lambda x: x <> '') AS ws FROM turn_lines)
SELECT doc_id, page, CAST(pos AS INTEGER) AS pos, CAST(len(ws) AS INTEGER) AS words, ws[1] AS first, ws[-1] AS last FROM w""")
def line_words(spark, d):
    """Words of a line with their places, from its characters."""
    chars = F.transform(F.split("line", ""), lambda ch, i: F.struct(ch.alias("c"), i.cast("double").alias("x0"), (i + 1).cast("double").alias("x1")))
    lines = c.turn_lines(spark, d).select("doc_id", "page", "pos", dr.words_of(F.filter(chars, lambda x: x["c"] != "")).alias("w"))
    return lines.select("doc_id", "page", "pos", F.size("w").alias("words"), F.try_element_at("w", F.lit(1))["text"].alias("first"), F.try_element_at("w", F.lit(-1))["text"].alias("last"))
