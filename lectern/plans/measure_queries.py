"""Queries over events, orders and order items as positions, headings, lists and tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import markers as m
from lectern.operators import blocks as bl
from lectern.operators import furniture as fu
from lectern.operators import sequences as s
from lectern.operators import tables as tb
from lectern.sources import corpus as c

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


CLUSTERS_SQL = """
g AS (SELECT user_id, event_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 6 THEN 1 WHEN row_number() OVER (PARTITION BY user_id ORDER BY value) = 1 THEN 1 ELSE 0 END AS b FROM events),
k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY value RANGE UNBOUNDED PRECEDING) AS cluster FROM g)"""


def positions(spark, d):
    return c.read(spark, d, "events").select("user_id", "event_id", "value")


def clustered(spark, d):
    """A value's cluster: positions are made distinct first, so equal values can't be told apart by order."""
    xs = positions(spark, d)
    found = s.clusters(xs.select("user_id", "value").distinct(), ["user_id"], "value", 6.0)
    return xs.join(found, ["user_id", "value"])


@query("value_clusters", f"""
WITH {CLUSTERS_SQL} SELECT user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS members, round(avg(value), 4) AS centre FROM k GROUP BY user_id, cluster""")
def value_clusters(spark, d):
    return clustered(spark, d).groupBy("user_id", "cluster").agg(F.count("*").alias("members"), F.round(F.avg("value"), 4).alias("centre"))


@query("bullet_levels", f"""
WITH {CLUSTERS_SQL}, c AS (SELECT user_id, cluster - 1 AS level, round(avg(value), 4) AS centre FROM k GROUP BY user_id, cluster),
n AS (SELECT e.event_id, c.level, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(c.centre - e.value), c.level) AS r FROM events e JOIN c ON e.user_id = c.user_id)
SELECT event_id, CAST(level AS BIGINT) AS level FROM n WHERE r = 1""")
def bullet_levels(spark, d):
    """Each position's level is the number of its nearest cluster's centre, of equally near ones the first."""
    centres = value_clusters(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("centres"))
    near = F.array_min(F.transform("centres", lambda x: F.struct(F.abs(x["centre"] - F.col("value")).alias("gap"), (x["cluster"] - 1).alias("level"))))
    return positions(spark, d).join(centres, "user_id").select("event_id", near["level"].alias("level"))


@query("floor_percentiles", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS a, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (WHERE a = least(n - 1, floor(0.5::DOUBLE * n))) AS p50, max(value) FILTER (WHERE a = least(n - 1, floor(0.9::DOUBLE * n))) AS p90 FROM r GROUP BY event_type""")
def floor_percentiles(spark, d):
    e = c.read(spark, d, "events").select("event_type", "value")
    return s.floor_percentile(e, ["event_type"], "value", 0.5, "p50").join(s.floor_percentile(e, ["event_type"], "value", 0.9, "p90"), "event_type")


@query("body_sizes", f"""
WITH i AS (SELECT l_suppkey AS doc_id, round_even(l_extendedprice / 10000, 0) AS v, l_quantity AS w, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, {", ".join(c.ITEM_ORDER)}) AS o FROM lineitem),
g AS (SELECT doc_id, v, sum(w) AS w, min(o) AS o FROM i GROUP BY doc_id, v), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, o) AS r FROM g)
SELECT doc_id, CASE WHEN w > 0 THEN v ELSE 11.0::DOUBLE END AS body_size FROM r WHERE r = 1""")
def body_sizes(spark, d):
    """The commonest rounded size of a document, by characters."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", *c.ITEM_ORDER)
    spans = c.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_extendedprice") / 10000).alias("size"), F.col("l_quantity").alias("chars"), F.row_number().over(w).alias("o"))
    return s.weighted_mode(spans, ["doc_id"], F.bround("size", 0), "chars", "o", 11.0, "body_size")


@query("line_pitch", """
WITH e AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE - lag(epoch_us(ts) / 1000000.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dy FROM events),
q AS (SELECT user_id, round(dy / 40000, 6) AS x FROM e WHERE dy > 0 AND dy <= 3 * 40000),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x) - 1 AS a, count(*) OVER (PARTITION BY user_id) AS n FROM q)
SELECT user_id, max(x) AS pitch FROM r WHERE a = least(n - 1, floor(0.5::DOUBLE * n)) GROUP BY user_id""")
def line_pitch(spark, d):
    """The usual distance of lines, in multiples of the size, from neighbours no further apart than three sizes."""
    e = c.read(spark, d, "events").select("user_id", "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("y"))
    dy = F.col("y") - F.lag("y").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    ratios = e.withColumn("dy", dy).where("dy > 0 and dy <= 3 * 40000").select("user_id", F.round(F.col("dy") / 40000, 6).alias("x"))
    return s.floor_percentile(ratios, ["user_id"], "x", 0.5, "pitch")


@query("gutters", """
WITH i AS (SELECT user_id, value AS x0, value + 4 AS x1 FROM events),
r AS (SELECT *, max(x1) OVER (PARTITION BY user_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
SELECT user_id, reach AS gap_from, x0 AS gap_to FROM r WHERE x0 - reach >= 18""")
def gutters(spark, d):
    return s.gaps(c.read(spark, d, "events").select("user_id", F.col("value").alias("x0"), (F.col("value") + 4).alias("x1")), ["user_id"], "x0", "x1", 18.0)


HEADINGS_SQL = """
h AS (SELECT o_custkey AS doc_id, o_orderkey, CAST(o_orderpriority[1] AS INTEGER) AS level, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders)"""


def headings(spark, d):
    """A customer's orders as headings; their priority is the level."""
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return c.read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), pos.cast("long").alias("pos"))


@query("section_ends", f"""
WITH {HEADINGS_SQL} SELECT a.doc_id, a.pos, a.level, min(b.pos) AS "end" FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.level <= a.level GROUP BY ALL""")
def section_ends(spark, d):
    return s.section_ends(headings(spark, d), ["doc_id"], ["pos"], "level", "pos")


@query("outline_parents", f"""
WITH {HEADINGS_SQL}, k AS (SELECT doc_id, pos, CASE WHEN level = 5 THEN 0 ELSE level END AS level FROM h)
SELECT a.doc_id, a.pos, a.level, max(b.pos) AS parent FROM k a LEFT JOIN k b ON a.doc_id = b.doc_id AND b.pos < a.pos AND b.level > 0 AND (a.level = 0 OR b.level < a.level) GROUP BY ALL""")
def outline_parents(spark, d):
    rows = headings(spark, d).withColumn("level", F.when(F.col("level") == 5, 0).otherwise(F.col("level")))
    return s.parents(rows, ["doc_id"], ["pos"], "level", "pos")


@query("valid_lists", f"""
WITH {c.ITEMS_SQL} SELECT doc_id, count(*) AS items, bool_and(number = pos + 1) AND count(*) >= 2 AS valid FROM order_items GROUP BY doc_id""")
def valid_lists(spark, d):
    """A typed list stands when it has two items or more and counts up from 1 by one."""
    return c.order_items(spark, d).groupBy("doc_id").agg(F.count("*").alias("items"), (F.bool_and(F.col("number") == F.col("pos") + 1) & (F.count("*") >= 2)).alias("valid"))


@query("list_labels", f"""
WITH {HEADINGS_SQL}, k AS (SELECT doc_id, pos, (level - 1) % 3 AS level, level < 5 AS numbered FROM h),
b AS (SELECT *, CASE level WHEN 0 THEN sum(CASE WHEN NOT numbered THEN 1 ELSE 0 END) OVER w WHEN 1 THEN sum(CASE WHEN NOT numbered OR level < 1 THEN 1 ELSE 0 END) OVER w
   ELSE sum(CASE WHEN NOT numbered OR level < 2 THEN 1 ELSE 0 END) OVER w END AS g FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
n AS (SELECT doc_id, pos, level, numbered, CASE WHEN numbered THEN row_number() OVER (PARTITION BY doc_id, level, numbered, g ORDER BY pos) END AS n FROM b)
SELECT doc_id, pos, CASE WHEN NOT numbered THEN NULL WHEN level = 0 THEN n || '.' WHEN level = 1 THEN chr(CAST(97 + (n - 1) % 26 AS INTEGER)) || '.'
  ELSE ['', 'x', 'xx', 'xxx'][n // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] || '.' END AS label FROM n""")
def list_labels(spark, d):
    """What a numbered list shows: 1. a. i. by level, deeper counters starting anew; a row that isn't numbered ends the list."""
    rows = headings(spark, d).withColumn("numbered", F.col("level") < 5).withColumn("level", (F.col("level") - 1) % 3)
    n = bl.counters(rows, ["doc_id"], ["pos"], "level", F.col("numbered"), 3)
    label = F.when(F.col("level") == 0, F.col("n").cast("string")).when(F.col("level") == 1, m.wrapped_letter(F.col("n"))).otherwise(m.roman(F.col("n")))
    return n.select("doc_id", "pos", F.when(F.col("numbered"), F.concat(label, F.lit("."))).alias("label"))


@query("column_widths", """
SELECT l_orderkey AS doc_id, l_linenumber AS col, l_partkey, l_quantity AS weight, greatest(5.0::DOUBLE, round_even(4680.0::DOUBLE * (l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey)), 0) / 10) AS width FROM lineitem""")
def column_widths(spark, d):
    cols = c.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("col"), "l_partkey", F.col("l_quantity").alias("weight"))
    return tb.column_widths(cols, ["doc_id"], "weight")


@query("image_scales", """
WITH i AS (SELECT p_partkey, p_retailprice AS w, CAST(p_size AS DOUBLE) * 10 AS h FROM part), s AS (SELECT *, CASE WHEN w = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 468.0::DOUBLE / w) END AS s FROM i)
SELECT p_partkey, round_even(w * s, 1) AS width, round_even(h * s, 1) AS height FROM s""")
def image_scales(spark, d):
    w, h = F.col("p_retailprice"), F.col("p_size").cast("double") * 10
    scale = F.when(w == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(468.0) / w))
    return c.read(spark, d, "part").select("p_partkey", F.bround(w * scale, 1).alias("width"), F.bround(h * scale, 1).alias("height"))


@query("slide_decks", """
SELECT p_brand AS doc_id, avg(CASE WHEN p_retailprice > 1.15::DOUBLE * p_size * 30 THEN 1.0 ELSE 0.0 END) >= 0.8 AND avg(p_size) >= 15 AS deck FROM part GROUP BY p_brand""")
def slide_decks(spark, d):
    """Four fifths of the pages lie across and the text is large."""
    across = (F.col("p_retailprice") > 1.15 * F.col("p_size") * 30).cast("int")
    return c.read(spark, d, "part").groupBy(F.col("p_brand").alias("doc_id")).agg(((F.avg(across) >= 0.8) & (F.avg("p_size") >= 15)).alias("deck"))


@query("body_tops", f"""
WITH i AS (SELECT l_suppkey AS doc_id, l_orderkey AS page, l_extendedprice AS y, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY {", ".join(c.ITEM_ORDER)}) AS o FROM lineitem),
f AS (SELECT doc_id, page, y, dense_rank() OVER (PARTITION BY doc_id ORDER BY page) AS n, count(*) OVER (PARTITION BY doc_id) AS pages FROM i WHERE o = 1)
SELECT doc_id, min(y) AS body_top FROM f WHERE n > 1 OR pages = 1 GROUP BY doc_id""")
def body_tops(spark, d):
    """Where body text starts: the least first line of all pages but the first."""
    order = F.struct(*c.ITEM_ORDER)
    pages = c.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page")).agg(F.min_by("l_extendedprice", order).alias("y"))
    w = Window.partitionBy("doc_id")
    ranked = pages.withColumns({"n": F.row_number().over(w.orderBy("page")), "pages": F.count("*").over(w)})
    return ranked.where("n > 1 or pages = 1").groupBy("doc_id").agg(F.min("y").alias("body_top"))


@query("bounding_boxes", """
SELECT l_orderkey AS doc_id, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity + l_tax) AS x1, max(l_extendedprice + l_discount) AS y1 FROM lineitem GROUP BY l_orderkey""")
def bounding_boxes(spark, d):
    return c.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.min("l_quantity").alias("x0"), F.min("l_extendedprice").alias("y0"), F.max(F.col("l_quantity") + F.col("l_tax")).alias("x1"), F.max(F.col("l_extendedprice") + F.col("l_discount")).alias("y1"))


@query("repeated_images", """
WITH i AS (SELECT DISTINCT c_nationkey AS doc_id, c_custkey AS page, o_orderpriority AS image FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT doc_id, count(DISTINCT page) AS n FROM i GROUP BY doc_id)
SELECT doc_id, image, pages FROM (SELECT doc_id, image, count(*) AS pages FROM i GROUP BY doc_id, image) JOIN n USING (doc_id) WHERE n >= 3 AND pages >= greatest(3, 0.3::DOUBLE * n)""")
def repeated_images(spark, d):
    customer = c.read(spark, d, "customer").select(F.col("c_custkey").alias("page"), F.col("c_nationkey").alias("doc_id"))
    seen = c.read(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderpriority").alias("image")).distinct().join(customer, "page")
    n = seen.groupBy("doc_id").agg(F.count_distinct("page").alias("n"))
    found = seen.groupBy("doc_id", "image").agg(F.count("*").alias("pages")).join(n, "doc_id")
    return found.where((F.col("n") >= 3) & (F.col("pages") >= F.greatest(F.lit(3.0), fu.IMAGE_SHARE * F.col("n")))).select("doc_id", "image", "pages")


@query("list_id_modes", """
WITH g AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS f, min(event_id) AS i FROM events WHERE event_type <> 'view' GROUP BY ALL)
SELECT user_id, event_type AS list_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, i) AS r FROM g) WHERE r = 1""")
def list_id_modes(spark, d):
    """The list most used, of equally used ones the first seen; one kind passed over."""
    g = c.read(spark, d, "events").where("event_type <> 'view'").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("i"))
    return g.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", (-F.col("i")).alias("i"))).alias("list_id"))


@query("recent_top10", """
SELECT CAST(user_id AS VARCHAR) AS doc_id, max(ts) AS last_used FROM events GROUP BY user_id ORDER BY last_used DESC, doc_id LIMIT 10""")
def recent_top10(spark, d):
    """The ten documents used last."""
    used = c.read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("doc_id")).agg(F.max("ts").alias("last_used"))
    return used.orderBy(F.desc("last_used"), "doc_id").limit(10)


@query("running_mean_x", """
SELECT event_id, CAST(sum(CASE WHEN event_type = 'click' THEN v END) OVER w AS DOUBLE) / count(CASE WHEN event_type = 'click' THEN v END) OVER w AS letters,
  CAST(sum(CASE WHEN event_type <> 'click' THEN v END) OVER w AS DOUBLE) / count(CASE WHEN event_type <> 'click' THEN v END) OVER w AS romans
FROM (SELECT *, CAST(value AS DECIMAL(18, 2)) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_mean_x(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)

    def mean(own):
        x = F.when(own, F.col("value").cast("decimal(18,2)"))
        return F.try_divide(F.sum(x).over(w).cast("double"), F.count(x).over(w))

    own = F.col("event_type") == "click"
    return c.read(spark, d, "events").select("event_id", mean(own).alias("letters"), mean(~own).alias("romans"))


@query("reading_order", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, round_even(value / 12, 0), ts, event_id) AS place FROM events""")
def reading_order(spark, d):
    band = F.when(F.col("event_type") == "view", 0).otherwise(1)
    w = Window.partitionBy("user_id").orderBy(band, F.bround(F.col("value") / 12, 0), "ts", "event_id")
    return c.read(spark, d, "events").select("event_id", F.row_number().over(w).cast("long").alias("place"))


@query("title_shapes", """
SELECT user_id AS doc_id, arg_min(event_id, (value, event_id)) AS title, arg_max(event_id, (value, event_id)) AS lowest FROM events GROUP BY user_id""")
def title_shapes(spark, d):
    key = F.struct("value", "event_id")
    return c.read(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.min_by("event_id", key).alias("title"), F.max_by("event_id", key).alias("lowest"))


PIPES_SQL = f"""
{c.LINES_SQL}, p AS (SELECT doc_id, pos, string_split(line, ' | ') AS cells FROM lines WHERE contains(line, ' | '))"""


def pipe_rows(spark, d):
    return c.lines(spark, d).where(F.col("line").contains(" | ")).select("doc_id", "pos", F.split("line", r" \| ", -1).alias("cells"))


@query("pipe_tables", f"""
WITH {PIPES_SQL}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM p)
SELECT doc_id, min(pos) AS first_line, count(*) AS n_rows, CAST(max(len(cells)) AS BIGINT) AS n_cols FROM i GROUP BY doc_id, g""")
def pipe_tables(spark, d):
    """Neighbouring lines with bars are the rows of one table."""
    rows = pipe_rows(spark, d)
    starts = F.col("pos") != F.lag("pos").over(Window.partitionBy("doc_id").orderBy("pos")) + 1
    cells = s.islands(rows, ["doc_id"], ["pos"], starts, "t").select("doc_id", "t", "pos", F.posexplode("cells").alias("col", "text"))
    placed = cells.withColumn("row", F.col("pos") - F.min("pos").over(Window.partitionBy("doc_id", "t"))).withColumns({"rowspan": F.lit(1), "colspan": F.lit(1)})
    first = placed.groupBy("doc_id", "t").agg(F.min("pos").cast("long").alias("first_line"))
    return tb.shape(placed, ["doc_id", "t"]).join(first, ["doc_id", "t"]).select("doc_id", "first_line", F.col("n_rows").cast("long").alias("n_rows"), F.col("n_cols").cast("long").alias("n_cols"))


@query("split_tables", f"""
WITH {PIPES_SQL}, t AS (SELECT doc_id, pos, lower(trim(regexp_replace(array_to_string(cells, ' | '), '\\s+', ' ', 'g'))) AS header, CAST(len(cells) AS INTEGER) AS n_cols FROM p),
b AS (SELECT *, coalesce(header <> '' AND lag(header) OVER w = header AND lag(n_cols) OVER w = n_cols AND lag(pos) OVER w = pos - 1, false) AS g FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i AS (SELECT *, sum(CASE WHEN g THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last, any_value(header) AS header, any_value(n_cols) AS n_cols, CAST(count(*) + 1 AS BIGINT) AS n_rows, count(*) AS parts FROM i GROUP BY doc_id, k""")
def split_tables(spark, d):
    """Each line with bars as a table of two rows; those that repeat their neighbour's whole header and column count go on."""
    tables = pipe_rows(spark, d).select("doc_id", "pos", tb.header_key(F.col("cells")).alias("header"), F.size("cells").alias("n_cols"), F.lit(2).alias("n_rows"))
    return tb.merge_split(tables, ["doc_id"], "pos", "header", "n_cols", "n_rows")


@query("split_table_cells", f"""
WITH {PIPES_SQL}, t AS (SELECT doc_id, pos, cells, lower(trim(regexp_replace(array_to_string(cells, ' | '), '\\s+', ' ', 'g'))) AS header, len(cells) AS n_cols FROM p),
b AS (SELECT *, coalesce(header <> '' AND lag(header) OVER w = header AND lag(n_cols) OVER w = n_cols AND lag(pos) OVER w = pos - 1, false) AS g FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i AS (SELECT *, max(CASE WHEN NOT g THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS first FROM b),
c AS (SELECT doc_id, first, pos, g, 0 AS row, unnest(cells) AS text, unnest(range(len(cells))) AS col FROM i UNION ALL SELECT doc_id, first, pos, g, 1, unnest(cells) || '!', unnest(range(len(cells))) FROM i)
SELECT doc_id, CAST(first AS INTEGER) AS first, CAST(row + pos - first AS INTEGER) AS row, CAST(col AS INTEGER) AS col, text FROM c WHERE NOT (g AND row = 0)""")
def split_table_cells(spark, d):
    """The cells of split_tables after the merge; a table's second row is its first, called out."""
    rows = pipe_rows(spark, d)
    tables = rows.select("doc_id", "pos", tb.header_key(F.col("cells")).alias("header"), F.size("cells").alias("n_cols"), F.lit(2).alias("n_rows"))
    two = rows.select("doc_id", "pos", F.explode(F.array(F.struct(F.lit(0).alias("row"), F.col("cells").alias("cells")), F.struct(F.lit(1).alias("row"), F.transform("cells", lambda x: F.concat(x, F.lit("!"))).alias("cells")))).alias("r"))
    cells = two.select("doc_id", "pos", "r.row", F.posexplode("r.cells").alias("col", "text"))
    return tb.merged_cells(tables, cells, ["doc_id"], "pos", "header", "n_cols", "n_rows")


BLOCKS_SQL = """
b AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id % 4 = 0 AS spacer, event_id % 5 <> 0 AS selected,
  CASE WHEN event_id % 4 = 0 THEN 'paragraph' WHEN event_id % 7 = 0 THEN 'heading' WHEN event_id % 11 = 0 THEN 'table' WHEN event_id % 3 = 0 THEN 'bullet' ELSE 'paragraph' END AS kind,
  CAST(event_id % 3 AS INTEGER) AS level FROM events)"""


def event_blocks(spark, d):
    """Events as blocks: some blank, some headings, tables or bullets."""
    i = F.col("event_id")
    kind = F.when(i % 4 == 0, "paragraph").when(i % 7 == 0, "heading").when(i % 11 == 0, "table").when(i % 3 == 0, "bullet").otherwise("paragraph")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return c.read(spark, d, "events").select(F.col("user_id").alias("doc_id"), pos.cast("long").alias("pos"), (i % 4 == 0).alias("spacer"), (i % 5 != 0).alias("selected"), kind.alias("kind"), (i % 3).cast("int").alias("level"))


@query("tidy_spacers", f"""
WITH {BLOCKS_SQL}, w AS (SELECT *, last_value(CASE WHEN NOT spacer THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
  first_value(CASE WHEN NOT spacer THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n,
  coalesce(lag(spacer) OVER (PARTITION BY doc_id ORDER BY pos), false) AS twice FROM b)
SELECT doc_id, pos, kind FROM w WHERE NOT spacer OR (p IS NOT NULL AND n IS NOT NULL AND p NOT IN ('heading', 'table', 'image') AND n NOT IN ('heading', 'table', 'image') AND NOT twice)""")
def tidy_spacers(spark, d):
    return bl.tidy_spacers(event_blocks(spark, d), ["doc_id"], ["pos"]).select("doc_id", "pos", "kind")


@query("spacer_ticks", f"""
WITH {BLOCKS_SQL} SELECT doc_id, pos, CASE WHEN spacer THEN coalesce(last_value(CASE WHEN NOT spacer THEN selected END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), selected) ELSE selected END AS selected FROM b""")
def spacer_ticks(spark, d):
    return bl.spacers_follow(event_blocks(spark, d), ["doc_id"], ["pos"]).select("doc_id", "pos", "selected")


@query("bullets_from_top", f"""
WITH {BLOCKS_SQL}, g AS (SELECT *, lag(kind) OVER w AS pk, lag(level) OVER w AS pl FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i AS (SELECT *, sum(CASE WHEN kind <> 'bullet' OR pk IS NULL OR pk <> 'bullet' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS r FROM g)
SELECT doc_id, pos, kind, CASE WHEN kind = 'bullet' THEN level - (min(level) OVER (PARTITION BY doc_id, r) - first_value(coalesce(pl, 0)) OVER (PARTITION BY doc_id, r ORDER BY pos)) ELSE level END AS level FROM i""")
def bullets_from_top(spark, d):
    return bl.bullets_from_top(event_blocks(spark, d), ["doc_id"], ["pos"]).select("doc_id", "pos", "kind", "level")


@query("text_segments", f"""
WITH RECURSIVE {BLOCKS_SQL}, g AS (SELECT doc_id, pos, kind IN ('table', 'image') AS alone, kind = 'bullet' AND level > 0 AS stays FROM b),
w AS (SELECT doc_id, CAST(-1 AS BIGINT) AS pos, true AS alone, 0 AS n, CAST(0 AS BIGINT) AS segment FROM (SELECT DISTINCT doc_id FROM g)
  UNION ALL SELECT g.doc_id, g.pos, g.alone, CASE WHEN g.alone OR w.alone OR (w.n >= 5 AND NOT g.stays) THEN 1 ELSE w.n + 1 END, w.segment + CASE WHEN g.alone OR w.alone OR (w.n >= 5 AND NOT g.stays) THEN 1 ELSE 0 END
  FROM w JOIN g ON g.doc_id = w.doc_id AND g.pos = w.pos + 1)
SELECT doc_id, pos, segment FROM w WHERE pos >= 0""")
def text_segments(spark, d):
    """Bullets below the top level stand for rows inside a numbered list: no cut before them."""
    whole = (F.col("kind") == "bullet") & (F.col("level") > 0)
    return bl.text_segments(event_blocks(spark, d), ["doc_id"], "pos", whole=whole, limit=5).select("doc_id", "pos", "segment")


@query("kept_edges", """
WITH RECURSIVE v AS (SELECT user_id, list_sort(list(DISTINCT value)) AS xs FROM events GROUP BY user_id),
r AS (SELECT user_id, xs, xs[1] AS k FROM v UNION ALL SELECT user_id, xs, list_filter(xs, lambda x: x - k > 25)[1] FROM r WHERE len(list_filter(xs, lambda x: x - k > 25)) > 0)
SELECT user_id, k AS edge FROM r""")
def kept_edges(spark, d):
    """Edges a table keeps: each more than the tolerance beyond the last one kept."""
    xs = c.read(spark, d, "events").groupBy("user_id").agg(F.collect_set("value").alias("xs"))
    return xs.select("user_id", F.explode(s.kept_apart(F.col("xs"), 25.0)).alias("edge"))
