"""Queries over boxes, edit plans, style chains and target documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import edits as ed
from lectern.operators import layout as ly
from lectern.operators.fold import fold_by_doc
from lectern.sources import corpus as c

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


BOXES_SQL = """
b AS (SELECT o_orderkey AS box, o_custkey AS doc_id, CAST(o_orderkey % 97 AS DOUBLE) * 5 AS x0, CAST(o_orderkey % 89 AS DOUBLE) * 6 AS y0,
  CAST(o_orderkey % 97 AS DOUBLE) * 5 + 40 + o_orderkey % 7 * 20 AS x1, CAST(o_orderkey % 89 AS DOUBLE) * 6 + 20 + o_orderkey % 5 * 15 AS y1 FROM orders)"""


def boxes(spark, d):
    """A customer's orders as boxes on one page."""
    k = F.col("o_orderkey")
    x, y = (k % 97).cast("double") * 5, (k % 89).cast("double") * 6
    return c.read(spark, d, "orders").select(k.alias("box"), F.col("o_custkey").alias("doc_id"), x.alias("x0"), y.alias("y0"), (x + 40 + k % 7 * 20).alias("x1"), (y + 20 + k % 5 * 15).alias("y1"))


@query("contained_points", f"""
WITH {BOXES_SQL}, p AS (SELECT box AS point, doc_id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM b),
m AS (SELECT point, box, row_number() OVER (PARTITION BY point ORDER BY (x1 - x0) * (y1 - y0), box) AS r FROM p JOIN b ON p.doc_id = b.doc_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND point <> box)
SELECT p.point, p.doc_id, m.box FROM p LEFT JOIN m ON p.point = m.point AND r = 1""")
def contained_points(spark, d):
    """Each box's centre with the smallest other box around it."""
    b = boxes(spark, d)
    points = b.select(F.col("box").alias("point"), "doc_id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    # a centre's own box is no answer: it counts as the last
    own = F.when(F.col("r.box") == F.col("point"), 1).otherwise(0)
    found = ly.contained(points, b, ["doc_id"], "point", "box", [own, ly.area(), "box"])
    return found.select("point", "doc_id", F.when(F.col("box") != F.col("point"), F.col("box")).alias("box"))


@query("title_rows", f"""
WITH {BOXES_SQL}, m AS (SELECT t.box, l.box AS line, row_number() OVER (PARTITION BY t.box ORDER BY l.y1 DESC, l.box DESC) AS r FROM b t JOIN b l ON t.doc_id = l.doc_id AND l.y1 <= t.y0 + 1 AND t.y0 - l.y1 <= 16)
SELECT b.doc_id, b.box, m.line FROM b LEFT JOIN m ON b.box = m.box AND r = 1""")
def title_rows(spark, d):
    b = boxes(spark, d)
    return ly.above(b, b.withColumnRenamed("box", "line"), ["doc_id"], "box", "line")


@query("glyph_mates", f"""
WITH {BOXES_SQL}, m AS (SELECT g.box AS glyph, t.box AS mate, row_number() OVER (PARTITION BY g.box ORDER BY t.x0 - g.x1, t.box) AS r FROM b g JOIN b t ON g.doc_id = t.doc_id
  AND least(g.y1, t.y1) - greatest(g.y0, t.y0) > 0.5::DOUBLE * least(g.y1 - g.y0, t.y1 - t.y0) AND t.x0 - g.x1 > 0 AND t.x0 - g.x1 <= 40)
SELECT glyph, mate FROM m WHERE r = 1""")
def glyph_mates(spark, d):
    b = boxes(spark, d)
    return ly.mates(b.withColumnRenamed("box", "glyph"), b.withColumnRenamed("box", "mate"), ["doc_id"], "glyph", "mate")


@query("connector_lines", f"""
WITH {BOXES_SQL}, s AS (SELECT * FROM b WHERE box % 3 = 0), l AS (SELECT * FROM b WHERE box % 3 <> 0),
n AS (SELECT l.box AS line, s.box, greatest(s.x0 - l.x0, l.x0 - s.x1, 0) <= 50 AND greatest(s.y0 - l.y0, l.y0 - s.y1, 0) <= 50 AS h, greatest(s.x0 - l.x1, l.x1 - s.x1, 0) <= 50 AND greatest(s.y0 - l.y1, l.y1 - s.y1, 0) <= 50 AS t FROM l JOIN s USING (doc_id))
SELECT DISTINCT a.line FROM n a JOIN n z ON a.line = z.line AND a.h AND z.t AND a.box <> z.box""")
def connector_lines(spark, d):
    b = boxes(spark, d)
    return ly.connectors(b.where("box % 3 <> 0").withColumnRenamed("box", "line"), b.where("box % 3 = 0"), ["doc_id"], "line", "box")


@query("foreign_shapes", f"""
WITH {BOXES_SQL}, c AS (SELECT * FROM b WHERE box % 2 = 0)
SELECT doc_id, box FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = b.doc_id AND abs(b.x0 - c.x0) <= 2 AND abs(b.y0 - c.y0) <= 2 AND abs(b.x1 - c.x1) <= 2 AND abs(b.y1 - c.y1) <= 2)""")
def foreign_shapes(spark, d):
    b = boxes(spark, d)
    return ly.foreign(b, b.where("box % 2 = 0").select("doc_id", "x0", "y0", "x1", "y1"), ["doc_id"], "box")


@query("touching_boxes", f"""
WITH RECURSIVE {BOXES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY box) - 1 AS i FROM b),
t AS (SELECT a.doc_id, a.i, z.i AS j FROM k a JOIN k z ON a.doc_id = z.doc_id AND a.x0 <= z.x1 + 2 AND z.x0 <= a.x1 + 2 AND a.y0 <= z.y1 + 2 AND z.y0 <= a.y1 + 2),
r AS (SELECT doc_id, i, j FROM t UNION SELECT r.doc_id, r.i, t.j FROM r JOIN t ON r.doc_id = t.doc_id AND r.j = t.i)
SELECT k.doc_id, k.box, CAST(g AS BIGINT) AS "group" FROM k JOIN (SELECT doc_id, i, min(j) AS g FROM r GROUP BY doc_id, i) m ON k.doc_id = m.doc_id AND k.i = m.i""")
def touching_boxes(spark, d):
    return fold_by_doc(boxes(spark, d), ["doc_id"], ["box"], ly.touching, "doc_id bigint, box bigint, group bigint")


@query("baseline_parts", """
WITH e AS (SELECT user_id AS doc_id, event_id AS pos, value AS y, 10.0::DOUBLE + event_id % 3 AS size FROM events),
j AS (SELECT *, lag(y) OVER w AS py, lag(size) OVER w AS ps FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, CAST(sum(CASE WHEN py IS NULL OR (abs(y - py) > 0.3::DOUBLE * size AND abs(size - ps) <= 0.15::DOUBLE * ps) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM j""")
def baseline_parts(spark, d):
    e = c.read(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.col("value").alias("y"), (F.lit(10.0) + F.col("event_id") % 3).alias("size"))
    return ly.baseline_parts(e, ["doc_id"], "pos", "y", "size").select("doc_id", "pos", "part")


@query("margin_boxes", f"""WITH {BOXES_SQL} SELECT doc_id, box, y0 < 600 * 0.12::DOUBLE OR y0 >= 600 * (1 - 0.1::DOUBLE) AS margin FROM b""")
def margin_boxes(spark, d):
    return boxes(spark, d).select("doc_id", "box", ly.in_margin(F.col("y0"), F.lit(600)).alias("margin"))


@query("slide_order", f"""WITH {BOXES_SQL} SELECT doc_id, box, row_number() OVER (PARTITION BY doc_id ORDER BY round_even(y0 / 12, 0), x0, y0) AS place FROM (SELECT doc_id, min(box) AS box, x0, y0 FROM b GROUP BY doc_id, x0, y0)""")
def slide_order(spark, d):
    b = boxes(spark, d).groupBy("doc_id", "x0", "y0").agg(F.min("box").alias("box"))
    return ly.slide_order(b, ["doc_id"]).select("doc_id", "box", F.col("place").cast("long").alias("place"))


BLOCKS_SQL = f"""
{c.TURNS_SQL}, k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS pos, line AS text,
  CASE WHEN pos = 0 THEN 'heading' WHEN pos % 4 = 3 THEN 'paragraph' ELSE 'bullet' END AS kind, CASE WHEN pos > 0 AND pos % 4 <> 3 THEN pos % 2 ELSE 0 END AS level,
  CASE WHEN pos = 0 THEN 'HEADING_2' ELSE 'NORMAL_TEXT' END AS style, pos % 8 = 7 AS hanging FROM turn_lines),
o AS (SELECT *, length(body) + len(regexp_extract_all(body, '[\\x{{10000}}-\\x{{10FFFF}}]')) AS n FROM (SELECT *, CASE WHEN kind = 'bullet' THEN repeat(chr(9), level) ELSE '' END || replace(text, chr(9), ' ') AS body FROM k)),
p AS (SELECT *, CAST(1 + coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM o),
q AS (SELECT *, CAST(start + n + 1 AS BIGINT) AS "end" FROM p)"""


def line_blocks(spark, d):
    """Turns as blocks: the first line a heading, others bullets of two levels and paragraphs."""
    lines = c.turn_lines(spark, d)
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "pos")) - 1
    kind = F.when(F.col("pos") == 0, "heading").when(F.col("pos") % 4 == 3, "paragraph").otherwise("bullet")
    level = F.when((F.col("pos") > 0) & (F.col("pos") % 4 != 3), F.col("pos") % 2).otherwise(0)
    return lines.select(
        "doc_id", pos.cast("long").alias("pos"), F.col("line").alias("text"), kind.alias("kind"), level.alias("level"), F.when(F.col("pos") == 0, "HEADING_2").otherwise("NORMAL_TEXT").alias("style"),
        (F.col("pos") % 8 == 7).alias("hanging"), F.lit(None).cast("string").alias("numbered"), F.lit(False).alias("list_start"), F.lit(False).alias("in_list"),
    )


@query("edit_plans", f"""
WITH {BLOCKS_SQL}, w AS (SELECT doc_id, min(start) AS start, max("end") AS "end", string_agg(body || chr(10), '' ORDER BY pos) AS body FROM q GROUP BY doc_id),
s AS (SELECT doc_id, any_value(style) AS style, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *, CASE WHEN lag(style) OVER (PARTITION BY doc_id ORDER BY pos) = style THEN 0 ELSE 1 END AS c FROM q)) GROUP BY doc_id, r),
g AS (SELECT doc_id, min(start) AS start, max("end") AS "end" FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM q WHERE kind = 'bullet') GROUP BY doc_id, r),
e AS (
  SELECT doc_id, 0 AS phase, 'insertText' AS op, start, start AS "end", body AS payload FROM w UNION ALL
  SELECT doc_id, 1, 'deleteParagraphBullets', start, "end", '' FROM w UNION ALL
  SELECT doc_id, 2, 'updateParagraphStyle', start, "end", style FROM s UNION ALL
  SELECT doc_id, 3, 'zeroIndent', start, "end", '0/0' FROM q WHERE kind <> 'bullet' AND NOT hanging UNION ALL
  SELECT doc_id, 4, 'hangingIndent', start, "end", '18/36' FROM q WHERE kind <> 'bullet' AND hanging UNION ALL
  SELECT doc_id, 6, 'resetTextStyle', start, "end", '' FROM w UNION ALL
  SELECT doc_id, 7, 'createParagraphBullets', start, "end", 'plain' FROM g)
SELECT doc_id, phase, CAST(row_number() OVER (PARTITION BY doc_id, phase ORDER BY CASE WHEN phase = 7 THEN -start ELSE start END, "end") AS INTEGER) AS seq, op, start, "end", payload FROM e""")
def edit_plans(spark, d):
    return ed.edit_plan(line_blocks(spark, d)).select("doc_id", "phase", "seq", "op", "start", "end", "payload")
