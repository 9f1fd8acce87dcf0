"""Exact top-k by integer inner product with a KD-tree for each shard.

Vectors are dealt to shards by a hash of vec_id. A shard's tree splits at the median of its widest dimension, down to LEAF
vectors, and keeps the tight box of each node; the largest inner product that a box can hold is the sum of the larger of
q*low and q*high, and nodes are visited from the largest such bound until the bound falls below the kth best score so far.
Each query first searches one shard, its own; the kth score found there goes with the query to the other shards, which
return only what reaches it. Queries meet shards in blocks, so both sides of a task are bounded. Bounds that equal the kth
score are searched too, as a tie may have a smaller vec_id.

Defined cases: rows without vec_id, null and empty vectors, and vectors with null or non-finite components take no part; vectors of
different lengths are never paired; repeated equal rows count once; a query never meets rows of its own vec_id. Rows that
share a vec_id but not the vector are rows of their own: each is a candidate, and a query's ranking is the best of what all its rows find.
Scaled components beyond a long are cut to its ends (2**63 - 1 either way), and so are scores; up to there scores are exact,
in floating point where sums stay below 2**53, in longs below 2**63, with unbounded whole numbers beyond. Other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import staged, table

LEAF = 512
SHARD_ROWS, BLOCK_QUERIES = 16_384, 4_096
MOST = (1 << 63) - 1
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def products(points: np.ndarray, query: np.ndarray, size: int) -> np.ndarray:
    """Exact inner products of whole numbers as longs; `size` bounds their absolute sums."""
    if size < 1 << 63:
        return points @ query
    exact = (points.astype(object) * query.astype(object)).sum(1)
    return np.array([max(-MOST, min(MOST, x)) for x in exact], np.int64)


class Tree:
    """Median splits with tight boxes; node 0 is the root."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order, self.spans, self.children, low, high = np.arange(len(ids)), [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            own, me = points[order[a:b]], len(self.spans)
            low.append(own.min(0)), high.append(own.max(0))
            self.spans.append((a, b)), self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            wide = int((high[-1] - low[-1]).argmax())
            if b - a > LEAF and high[-1][wide] > low[-1][wide]:
                mid = (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], mid - a)]
                todo += [(a, mid, me), (mid, b, me)]
        self.ids, self.points, self.low, self.high = ids[order], points[order], np.array(low).astype(np.float64), np.array(high).astype(np.float64)
        self.floats, self.largest = self.points.astype(np.float64), int(np.abs(points).max(initial=0))

    def sizes(self, queries: np.ndarray) -> list[int]:
        """A bound of the absolute sums in each query's products."""
        return [int(m) * self.largest * self.points.shape[1] for m in np.abs(queries).max(1, initial=0).tolist()]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest product that each node's box can hold, with some room where floating point may round."""
        q = queries.astype(np.float64)
        out = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        room = np.array([0.0 if n < 1 << 53 else n * 1e-9 for n in self.sizes(queries)])
        return np.maximum(out + room[:, None], -0.99 * MOST)  # a cut score is never below its bound

    def search(self, query: np.ndarray, bounds: np.ndarray, size: int, own: int, k: int, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the best k that reach kth."""
        heap, ids, scores = [(-bounds[0], 0)], np.empty(0, np.int64), np.empty(0, np.int64)
        as_float = query.astype(np.float64) if size < 1 << 53 else None
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            a, b = self.spans[node]
            got = self.floats[a:b] @ as_float if as_float is not None else products(self.points[a:b], query, size)
            at = np.flatnonzero(got >= kth)
            at = at[self.ids[a:b][at] != own]
            if len(at):
                ids, scores = np.concatenate([ids, self.ids[a:b][at]]), np.concatenate([scores, got[at].astype(np.int64)])
                if len(ids) > k:
                    best = np.lexsort((ids, ~scores))[:k]  # ~x falls as x rises, without overflow
                    ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    kth = max(kth, int(scores.min()))
        return ids, scores


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _search(k: int):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(points) or not len(queries):
            return FOUND.empty_table()
        tree = Tree(points["vec_id"].to_numpy(), _matrix(points["v"], len(points)))
        asked, ids = _matrix(queries["query"], len(queries)), queries["query_id"].to_numpy()
        least, out = queries["kth"].to_pylist(), []
        for start in range(0, len(ids), 512):
            part = asked[start : start + 512]
            for i, (row, size) in enumerate(zip(tree.bounds(part), tree.sizes(part), strict=True), start):
                got, scores = tree.search(asked[i], row, size, ids[i], k, float("-inf") if least[i] is None else least[i])
                out.append((np.full(len(got), ids[i]), got, scores))
        return pa.Table.from_arrays([np.concatenate(x) for x in zip(*out, strict=True)], schema=FOUND)

    return run


def scaled(embeddings: DataFrame, factor: float = 64.0) -> DataFrame:
    """vec_id, v (whole numbers) of the vectors that take part, each once."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = embeddings.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(sound)
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.greatest(F.floor(x.cast("double") * factor), F.lit(-MOST))).alias("v")).dropDuplicates()


def top_k(points: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(vec_id, v) each: query_id, rank, vec_id, score of each query's k best."""
    n, asked = points.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_queries))

    def dealt(df: DataFrame, id_: str, vector: str) -> DataFrame:
        return df.select(
            F.col("vec_id").alias(id_), F.col("v").alias(vector), F.size("v").alias("dim"),
            F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
        )

    p, q = dealt(points, "vec_id", "v"), dealt(queries, "query_id", "query")
    schema, keys = "query_id bigint, vec_id bigint, score bigint", ("dim", "shard", "block")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    spread = p.withColumn("block", every_block) if blocks > 1 else p
    search = _search(k)
    first = staged(spread.groupBy(*keys).cogroup(q.withColumn("kth", F.lit(None).cast("long")).groupBy(*keys)).applyInArrow(lambda a, b: search(a, b), schema), "topk-first")
    found = first
    if shards > 1:
        by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        kth = first.withColumn("at", F.row_number().over(by_score)).where(F.col("at") == k).select("query_id", F.col("score").alias("kth"))
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("shard")))
        sent = q.join(kth, "query_id", "left").withColumn("shard", others)
        found = first.unionByName(spread.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(lambda a, b: search(a, b), schema))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_kd_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = staged(scaled(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "topk-vectors")
    return top_k(points, points.where(F.col("vec_id") % 20 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
w AS (SELECT vec_id, i, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS c FROM v),
s AS (SELECT q.vec_id AS query_id, p.vec_id, CAST(sum(q.c * p.c) AS BIGINT) AS score
      FROM w q JOIN w p ON q.i = p.i AND q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
