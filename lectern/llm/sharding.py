"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id), so that equal texts lie side by side. Every round counts, in one distributed
aggregation, the exact bytes in the buckets around each candidate boundary and narrows it to one bucket, STEP bits at a time,
until the bytes below one of the bucket's edges are within tolerance of the wanted share. The sums over buckets stay in the cluster; one
row for each open boundary comes to the driver.
Then rows are dealt out once, by piece; a shard is a fixed number of neighbouring pieces, so that the sort inside a shard is
shared by many tasks however few shards there are. Pieces grow in number with the rows, up to MOST_PIECES; only a shard's
boundaries must meet the tolerance, others may be off by a quarter of a piece.

Defined cases: a null text has size 1 and CRC 0 and comes before all others, apart from the empty text; a null doc_id comes first in its
group. A group of equal texts stays whole unless a boundary within tolerance needs it cut, which then happens by doc_id;
rows equal in both text and doc_id stay together. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import crc32_of, fresh, staged, table

LEAST = -(1 << 63)
#: Bits of a text's hash, and bits by which one round narrows a boundary.
HASH_BITS, STEP = 60, 11
MOST_PIECES = 8192


def text_hash(text: str):
    """The first HASH_BITS bits of the text's MD5; -1 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(F.col(text).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long"), F.lit(-1))


def _narrow(keys: DataFrame, column: str, bits: int, cuts: dict[int, tuple[int, int, int, int]]) -> dict[int, tuple]:
    """Boundaries on one column of `bits` bits.

    cuts: number -> (scope, bytes wanted below, tolerance, bytes below the scope); only keys of that scope count.
    Gives number -> ("cut", bound) or ("group", value, bytes below the value, nearer to its lower end) when one value alone is too large.
    """
    found: dict = {}
    open_cuts = {j: (scope, None, low) for j, (scope, _, _, low) in cuts.items()}
    shift = bits
    while open_cuts:
        finer = max(0, shift - STEP)
        asked = [(j, s, p, cuts[j][1] - low) for j, (s, p, low) in open_cuts.items()]
        asked = keys.sparkSession.createDataFrame(asked, "j int, scope bigint, prefix bigint, rest bigint")
        wide = shift == bits
        part = keys.select("scope", "size", F.lit(None).cast("long").alias("prefix") if wide else F.shiftright(column, shift).alias("prefix"), F.shiftright(column, finer).alias("bucket"))
        on = F.expr("a.scope <=> b.scope and a.prefix <=> b.prefix")
        part = part.alias("a").join(F.broadcast(asked.select("scope", "prefix").distinct()).alias("b"), on, "left_semi")  # at most MOST_PIECES rows
        counted = part.groupBy("scope", "prefix", "bucket").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        high = F.sum("b").over(Window.partitionBy("scope", "prefix").orderBy("bucket"))  # over at most 2**STEP buckets
        counted = counted.withColumn("high", high).withColumn("low", F.col("high") - F.col("b"))
        hit = counted.alias("a").join(F.broadcast(asked).alias("b"), on & F.expr("a.low < b.rest and b.rest <= a.high"))
        still = {}
        for j, bucket, n, low, high_ in hit.select("j", "bucket", "n", "low", "high").collect():  # one row for each open boundary
            scope, wanted, slack, _ = cuts[j]
            base = open_cuts[j][2]
            below, above = wanted - base - low, base + high_ - wanted
            near_low = below <= above
            if min(below, above) <= slack or (finer == 0 and n == 1):
                found[j] = ("cut", (bucket if near_low else bucket + 1) << finer)
            elif finer == 0:
                found[j] = ("group", bucket, base + low, near_low)
            else:
                still[j] = (scope, bucket, base + low)
        open_cuts, shift = still, finer
    return found


def splitters(keys: DataFrame, pieces: int, every: int, total: int, tolerance: float) -> list[tuple[int, int]]:
    """pieces - 1 boundaries (hash, id), in order, of keys (h, d, size)."""
    slack = [int(tolerance * every * total / pieces), total // (4 * pieces)]
    cuts = {j: (0, max(1, j * total // pieces), slack[j % every > 0], 0) for j in range(1, pieces)}
    first = _narrow(keys.withColumn("scope", F.lit(0).cast("long")), "h", HASH_BITS, cuts)
    bounds = {j: (x[1], LEAST) for j, x in first.items() if x[0] == "cut"}
    groups = {j: (x[1], cuts[j][1], cuts[j][2], x[2]) for j, x in first.items() if x[0] == "group"}
    if groups:
        inner = _narrow(keys.withColumn("scope", F.col("h")), "d", 64, groups)
        for j, x in inner.items():  # rows with one text and one id can't be told apart
            bounds[j] = (groups[j][0], x[1] if x[0] == "cut" else x[1] + (not x[3]))
    out = sorted(bounds.values())
    return [(h, min(d, (1 << 63) - 1)) for h, d in out]


def _numbers(values: list[int]):
    """The values as an array of longs; parsed at once, as there may be thousands."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def histogram_sort(docs: DataFrame, shards: int = 8, tolerance: float = 0.01, rows_per_piece: int = 250_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with size, text_crc32, shard and slot (the place in the shard, gapless from 0); shards have nearly equal bytes.

    tolerance: how far a shard's boundary may be off, as a share of a shard's bytes."""
    size, crc, shard, slot, h, d, piece = fresh(docs.columns, "size", "text_crc32", "shard", "slot", "h", "d", "piece")
    keyed = docs.withColumns({
        size: (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
        crc: crc32_of(text),
        h: text_hash(text),
        d: F.coalesce(F.col(key).cast("long"), F.lit(LEAST)),
    })
    keys = staged(keyed.select(F.col(size).alias("size"), F.col(h).alias("h"), F.col(d).alias("d")), "shard-keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    each = min(max(1, MOST_PIECES // shards), max(8, -(-rows // (shards * rows_per_piece))))
    bounds = splitters(keys, shards * each, each, total, tolerance) if rows else []
    n, top = len(bounds), 1 << max(0, len(bounds).bit_length() - 1)

    def place(hash_, id_):
        """How many boundaries are at or below a row: a binary search."""
        if not n:
            return F.lit(0)
        hs, ds = (_numbers([b[i] for b in bounds]) for i in (0, 1))
        steps = F.array(*[F.lit(top >> i) for i in range(top.bit_length())])

        def step(low, by):
            at = low + by
            bh, bd = F.get(hs, at - 1), F.get(ds, at - 1)
            return F.when((at <= n) & ((hash_ > bh) | ((hash_ == bh) & (id_ >= bd))), at).otherwise(low)

        return F.aggregate(steps, F.lit(0), step)

    counts = {r[0]: r[1] for r in keys.groupBy(place(F.col("h"), F.col("d")).alias("piece")).count().collect()}  # at most MOST_PIECES rows
    starts = [sum(counts.get(q, 0) for q in range(p - p % each, p)) for p in range(shards * each)]
    order = Window.partitionBy(piece).orderBy(h, d, size, crc)
    return (
        keyed.withColumn(piece, place(F.col(h), F.col(d)))
        .withColumn(slot, (F.get(_numbers(starts), F.col(piece)) + F.row_number().over(order) - 1).cast("long"))
        .withColumn(shard, F.floor(F.col(piece) / each).cast("int"))
        .select(*docs.columns, size, crc, shard, slot)
    )


def op1_histogram_sort(spark, sf_dir):
    out = histogram_sort(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: For each boundary and round: the bucket that holds the wanted byte, and the bytes below and up to its end; the first round in
#: which an end is near enough (or a single row is left) gives the boundary. Groups of one hash are cut by the row that holds it.
SQL = f"""
WITH k AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS hx,
             coalesce(CAST(('0x' || substr(md5(text), 1, 15)) AS BIGINT), -1) AS h, coalesce(doc_id, {LEAST}) AS d FROM documents),
r AS (SELECT h, d, sum(size) AS size, count(*) AS n FROM k GROUP BY h, d),
c AS (SELECT *, CAST(sum(size) OVER (ORDER BY h, d) AS BIGINT) AS high FROM r),
t AS (SELECT j, greatest(1, j * total // 8) AS want, CAST(floor(0.01::DOUBLE * total / 8) AS BIGINT) AS slack FROM (SELECT CAST(sum(size) AS BIGINT) AS total FROM k), (SELECT unnest(range(1, 8)) AS j)),
x AS (SELECT t.*, c.h, c.d, c.n, c.high - c.size AS row_low, c.high AS row_high FROM t JOIN c ON c.high - c.size < want AND want <= c.high),
s AS (SELECT unnest([49, 38, 27, 16, 5, 0]) AS s),
e AS (SELECT j, want, slack, s, x.h >> s AS bucket, CAST(sum(size) FILTER (WHERE (c.h >> s) < (x.h >> s)) AS BIGINT) AS below, CAST(sum(size) FILTER (WHERE (c.h >> s) = (x.h >> s)) AS BIGINT) AS own,
        CAST(sum(c.n) FILTER (WHERE (c.h >> s) = (x.h >> s)) AS BIGINT) AS n
      FROM x, s, c GROUP BY ALL),
f AS (SELECT *, want - coalesce(below, 0) AS lower, coalesce(below, 0) + own - want AS upper FROM e),
g AS (SELECT j, max(s) AS s FROM f WHERE least(lower, upper) <= slack OR s = 0 AND n = 1 GROUP BY j),
b AS (SELECT x.j, CASE WHEN g.j IS NULL THEN x.h ELSE (f.bucket + CASE WHEN f.lower <= f.upper THEN 0 ELSE 1 END) << g.s END AS h,
        CASE WHEN g.j IS NULL THEN x.d + CASE WHEN x.want - x.row_low <= x.row_high - x.want THEN 0 ELSE 1 END ELSE {LEAST} END AS d
      FROM x LEFT JOIN g ON g.j = x.j LEFT JOIN f ON f.j = g.j AND f.s = g.s),
p AS (SELECT k.*, CAST((SELECT count(*) FROM b WHERE k.h > b.h OR k.h = b.h AND k.d >= b.d) AS INTEGER) AS shard FROM k),
tab AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i] || list_transform(range(8), lambda q: 0), lambda v, q: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
bytes AS (SELECT *, list_transform(range(1, length(hx) + 1, 2), lambda i: CAST(('0x' || hx[i:i+1]) AS BIGINT)) AS bs FROM p),
crc AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || bs, lambda v, q: xor(v >> 8, tab[(xor(v, q) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, tab)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM crc
"""
