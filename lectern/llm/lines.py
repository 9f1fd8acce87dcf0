"""Line dedup by content-defined chunks of lines, in DataFrame operations only.

A rolling hash over the hashes of the last WINDOW lines closes a chunk where it is divisible by DIVISOR, so equal runs of lines
give equal chunks wherever they stand. A chunk of two or more lines that stands in several places is kept where it comes first
(by doc_id, then place) and removed elsewhere, after its bytes were compared with the first one's.

Only keys and hashes of chunks are grouped; bytes are fetched for chunks whose hash stands in several places, and meet the
bytes of their hash's first place, one row for each hash, in a join that Spark splits where a hash is hot. The rows of a
document come together only as its own list of chunk numbers.

Defined cases: lines end at line feeds only; a null text has no lines and stays null; the last chunk ends with the text; rows
equal in doc_id and text are one document and are all treated alike; a null doc_id comes first; a chunk whose hash equals but
whose bytes differ from the first one's stays; when all lines go the text is empty. An empty table gives no rows.

`least` (1 or 2) is the least length of a chunk in lines. With 2, no chunk closes after a single line, and a last single line joins
the chunk before it, so a repeated text of two lines or more goes as a whole. With 1, op5's rule, single lines stay wherever
they are cut off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import fresh, staged, table

WINDOW, BASE, DIVISOR = 2, 31, 3
LEAST_LINES = 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often and deep inside the body names it.

    A column of a projection below would not do: the optimizer may move its expression up into a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_chunks(text: str, body: Callable[[Column, Column], Column], least: int = 1) -> Column:
    """body(lines, chunks) of a text; chunks is an array of (no, first, n), counted from 1, of `least` lines or more."""
    def hashes(lines: Column) -> Column:
        return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))

    def ends(h: Column) -> Column:
        def rolled(i: Column) -> Column:
            return sum((F.coalesce(F.get(h, i - 1 - j), F.lit(0)) * BASE**j for j in range(1, WINDOW)), F.get(h, i - 1))

        def closes(i: Column) -> Column:
            return F.pmod(rolled(i), F.lit(DIVISOR)) == 0

        every = F.sequence(F.lit(1), F.size(h))
        if least == 1:
            return F.filter(every, lambda i: (i == F.size(h)) | closes(i))

        def may(i: Column) -> Column:
            return closes(i) & (i >= least) & (i <= F.size(h) - least)

        # Of lines in a row that might each close a chunk, the first does and then every second one.
        first, last = F.filter(every, lambda i: may(i) & ~may(i - 1)), F.filter(every, lambda i: may(i) & ~may(i + 1))
        inner = F.flatten(F.zip_with(first, last, lambda a, b: F.sequence(a, b, F.lit(least))))
        return F.concat(inner, F.array(F.size(h)))

    def chunks(e: Column) -> Column:
        def chunk(end: Column, k: Column) -> Column:
            before = F.coalesce(F.get(e, k - 1), F.lit(0))
            return F.struct((k + 1).alias("no"), (before + 1).alias("first"), (end - before).alias("n"))

        return F.transform(e, chunk)

    return let(F.split(F.col(text), "\n", -1), lambda lines: let(hashes(lines), lambda h: let(ends(h), lambda e: let(chunks(e), lambda c: body(lines, c)))))


def _joined(lines: Column, c: Column) -> Column:
    return F.array_join(F.slice(lines, c["first"], c["n"]), "\n")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 1) -> DataFrame:
    """docs with repeated chunks (of `least` lines or more) gone from the text, and n_lines, n_removed (lines; of a null text 0)."""
    n_lines, n_removed, t, made, gone, d, kt = fresh(docs.columns, "n_lines", "n_removed", "t", "made", "gone", "d", "kt")
    own = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))

    def hashed(lines: Column, chunks: Column) -> Column:
        return F.transform(F.filter(chunks, lambda c: c["n"] >= LEAST_LINES), lambda c: F.struct(c["no"].alias("no"), F.xxhash64(_joined(lines, c)).alias("h")))

    places = staged(own.select("d", "t", F.explode(with_chunks("text", hashed, least)).alias("c")).select("d", "t", "c.no", "c.h"), "line-chunks")

    place = F.struct("d", "t", "no")
    # Written first, so that the join reads it by an exchange of its own and Spark can split a hot hash.
    firsts = staged(places.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"), "line-firsts")
    marked = places.join(firsts, "h").select("d", "t", F.struct("no", "h", (place == F.col("first")).alias("is_first")).alias("c"))
    wanted = marked.groupBy("d", "t").agg(F.collect_set("c").alias("wanted")).withColumnRenamed("d", "wd").withColumnRenamed("t", "wt")
    some = own.join(wanted, F.col("d").eqNullSafe(F.col("wd")) & (F.col("t") == F.col("wt"))).drop("wd", "wt")

    def bytes_of(lines: Column, chunks: Column) -> Column:
        return F.transform("wanted", lambda w: F.struct(w["no"].alias("no"), w["h"].alias("h"), w["is_first"].alias("is_first"), _joined(lines, F.get(chunks, w["no"] - 1)).alias("bytes")))

    fetched = some.select("d", "t", F.explode(with_chunks("text", bytes_of, least)).alias("c")).select("d", "t", "c.*")
    fetched = staged(fetched, "line-bytes")
    first_bytes = fetched.where("is_first").select("h", F.col("bytes").alias("first_bytes"))
    again = fetched.where("not is_first").join(first_bytes, "h").where(F.col("bytes") == F.col("first_bytes"))
    removed = again.groupBy("d", "t").agg(F.collect_set("no").alias(gone)).withColumnRenamed("d", d).withColumnRenamed("t", kt)

    met = docs.withColumn(t, F.xxhash64(text)).join(removed, F.col(key).eqNullSafe(F.col(d)) & (F.col(t) == F.col(kt)), "left")
    met = met.drop(d, kt, t)

    def rebuilt(lines: Column, chunks: Column) -> Column:
        stays = F.array_except(F.sequence(F.lit(1), F.size(chunks)), gone)  # by a hash set, in order
        return F.struct(
            F.size(lines).cast("long").alias("n"), F.aggregate(gone, F.lit(0), lambda a, no: a + F.get(chunks, no - 1)["n"]).cast("long").alias("gone"),
            F.array_join(F.flatten(F.transform(stays, lambda no: F.slice(lines, F.get(chunks, no - 1)["first"], F.get(chunks, no - 1)["n"]))), "\n").alias("text"),
        )

    touched = met.where(F.col(gone).isNotNull()).withColumn(made, with_chunks(text, rebuilt, least))
    touched = touched.withColumns({n_lines: F.col(made)["n"], n_removed: F.col(made)["gone"], text: F.col(made)["text"]})
    whole = met.where(F.col(gone).isNull()).withColumns({n_lines: F.coalesce(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long"), n_removed: F.lit(0).cast("long")})
    columns = [*docs.columns, n_lines, n_removed]
    return touched.select(*columns).unionByName(whole.select(*columns))


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST(('0x' || substr(md5(line), 1, 8)) AS BIGINT) AS h FROM l),
r AS (SELECT *, h + {BASE} * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) AS rolled FROM h),
c AS (SELECT *, coalesce(sum(CASE WHEN rolled % {DIVISOR} = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM r),
k AS (SELECT doc_id, no, string_agg(line, chr(10) ORDER BY i) AS bytes, count(*) AS n FROM c GROUP BY doc_id, no),
f AS (SELECT *, n >= {LEAST_LINES} AND row_number() OVER (PARTITION BY n >= {LEAST_LINES}, bytes ORDER BY doc_id, no) > 1 AS gone FROM k),
o AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN n ELSE 0 END) AS BIGINT) AS n_removed,
        coalesce(string_agg(bytes, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS kept FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed, 0) AS n_removed, sha256(o.kept) AS kept_sha256
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
