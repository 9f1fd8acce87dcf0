"""Queries that convert typed lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import numbering as nb
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


P = "paragraph"


@query("order_lists", f"""
WITH RECURSIVE {c.ITEMS_SQL}, o AS (SELECT doc_id, list(number ORDER BY pos) AS ns FROM order_items GROUP BY doc_id),
w AS (SELECT doc_id, ns, 1 AS i, CAST(NULL AS BIGINT) AS last, 0 AS strays, 0 AS stray, 0 AS list, 0 AS took FROM o
  UNION ALL SELECT doc_id, ns, CASE WHEN restarts THEN i WHEN ends THEN CASE WHEN strays = 0 THEN i ELSE stray END ELSE i + 1 END, CASE WHEN fits THEN ns[i] WHEN restarts OR ends THEN NULL ELSE last END,
    CASE WHEN fits OR restarts OR ends THEN 0 ELSE strays + 1 END, CASE WHEN strays = 0 THEN i ELSE stray END, CASE WHEN restarts OR ends THEN list + 1 ELSE list END, CASE WHEN fits THEN i ELSE 0 END
  FROM (SELECT *, NOT fits AND ns[i] = 1 AS restarts, NOT fits AND ns[i] <> 1 AND strays + 1 >= {nb.STRAYS} AS ends
    FROM (SELECT *, last IS NULL OR ns[i] = last + 1 AS fits FROM w WHERE i <= len(ns)))),
t AS (SELECT doc_id, took - 1 AS pos, ns[took] AS number, count(*) OVER l AS n, min(ns[took]) OVER l AS least FROM w WHERE took > 0 WINDOW l AS (PARTITION BY doc_id, list))
SELECT i.doc_id, CAST(i.pos AS INTEGER) AS pos, CASE WHEN t.n >= 2 AND t.least = 1 THEN 'bullet' ELSE 'paragraph' END AS kind, CASE WHEN t.n >= 2 AND t.least = 1 THEN t.number || '.' END AS label
FROM order_items i LEFT JOIN t ON i.doc_id = t.doc_id AND i.pos = t.pos""")
def order_lists(spark, d):
    """Every order as typed paragraphs, however its items count: lists restart, strays stay within or end them, and lists that
    don't count up from 1 stay text."""
    rows = c.order_items(spark, d).select("doc_id", "pos", F.lit(P).alias("kind"), F.concat(F.col("number").cast("string"), F.lit(". "), "name").alias("text"), F.lit(0).alias("level"))
    return fold_by_doc(rows, ["doc_id"], ["pos"], nb.converted, "doc_id bigint, pos int, kind string, label string")
