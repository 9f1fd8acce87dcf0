"""Near copies by the Jaccard similarity of their word shingles, verified on the shingles themselves.

Texts of similarity SIMILARITY share one at least of the smallest shingle hashes of each, n - ceil(SIMILARITY * n) + 1 of n; so
each text is filed under those. Under one key, pairs whose sizes and sketches allow the similarity link their texts to groups of
candidates; a sketch is the least hash in each of BINS bins, and pairs that agree in under PROBABLE of the filled bins are let
go (at 64 bins a pair of similarity 0.8 falls there about once in 10**8). All pairs of a group of candidates are then compared
on their full sets of shingles. Groups are cut into chunks, and each pair of chunks is a task's work of its own; each passes on
no more than one link for each text.

Defined cases: A-Z are lower-cased, other letters not; a text of fewer than WORDS words is one shingle; a text without a word
(a null one, too) is similar to none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fresh, give_back, slices, staged
from lectern.llm.components import components
from lectern.llm.simhash import shingle_hashes

WORDS, SIMILARITY = 5, 0.8
BINS, PROBABLE = 64, 0.5
#: Texts in a chunk, when sketches and when shingles are compared; shingles or pairs compared at a time; shingles of a group counted at a time.
CHUNK, CHUNK_FULL, COLUMNS, COUNTED = 512, 128, 4096, 1 << 18


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes, in order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, WORDS)]))


def sketch(found: np.ndarray) -> np.ndarray:
    """A byte of the least hash in each bin, 0 where a bin has none."""
    out = np.zeros(BINS, np.uint8)
    bins, first = np.unique(found % np.uint64(BINS), return_index=True)
    out[bins.astype(np.int64)] = found[first] // np.uint64(BINS) % np.uint64(255) + np.uint64(1)
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sizes, marks, least = [], [], []
        for x in batch.column("text"):
            found = shingles(x.as_py())
            n = len(found)
            sizes.append(n), marks.append(sketch(found).tobytes())
            least.append(found[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1 if n else 0].view(np.int64).copy())
        columns = [batch.column("t"), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(least, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["t", "n", "sketch", "least"])


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each of n places reaches by links a - b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _by_key(batches: Iterator[pa.RecordBatch], links) -> Iterator[pa.RecordBatch]:
    """links(t, batch) of rows sorted by key, whole keys at a time; a batch's last key waits for the next batch."""
    held = None

    def done(rows: pa.RecordBatch) -> pa.RecordBatch:
        u, v = links(rows)
        t = rows.column("t").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(t[u]), pa.array(t[v])], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        keys = held.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield done(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None:
        yield done(held)
    held = None
    give_back()


def probable_links(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    marks = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for shift in range(1, len(key)):
        at = np.flatnonzero(key[:-shift] == key[shift:])
        if not len(at):
            break
        at = at[np.minimum(n[at], n[at + shift]) >= SIMILARITY * np.maximum(n[at], n[at + shift]) - 1e-6]
        for part in np.split(at, range(COLUMNS, len(at), COLUMNS)):
            x, y = marks[part], marks[part + shift]
            part = part[((x == y) & (x > 0)).sum(1) >= PROBABLE * ((x | y) > 0).sum(1)]
            a.append(part), b.append(part + shift)
    label = labels(len(key), np.concatenate(a), np.concatenate(b))
    at = np.flatnonzero(label != np.arange(len(key)))
    return at, label[at]


def similar_pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of similarity SIMILARITY or more; the sets are ordered, and counted by ranges of hashes so that memory is bounded."""
    n = np.array([len(s) for s in sets])
    both = np.zeros((len(sets), len(sets)), np.int32)
    ranges = 1 + int(n.sum()) // COUNTED
    bounds = [int(i * 2**64 // ranges) for i in range(1, ranges)]
    cuts = [np.concatenate([[0], np.searchsorted(s, np.array(bounds, np.uint64)), [len(s)]]) for s in sets]
    for r in range(ranges):
        _count_shared([s[c[r] : c[r + 1]] for s, c in zip(sets, cuts, strict=True)], both)
    either = n[:, None] + n[None, :] - both
    return np.nonzero(np.triu(both >= SIMILARITY * either - 1e-6, 1))


def _count_shared(sets: list[np.ndarray], both: np.ndarray) -> None:
    """Adds to both[i, j] how many members sets i and j have in common."""
    n = [len(s) for s in sets]
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), n)
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = owner[np.argsort(which, kind="stable")]  # by shingle
    starts = np.cumsum(times) - times
    for i, own in enumerate(np.split(which, np.cumsum(n)[:-1])):
        own = own[times[own] > 1]
        for at in range(0, len(own), COLUMNS):
            part = own[at : at + COLUMNS]
            size = times[part]
            place = np.repeat(starts[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            both[i] += np.bincount(holders[place], minlength=len(sets)).astype(np.int32)


def verified_links(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    key = rows.column("key").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
    a, b = [], []
    for i, j in zip(starts, [*starts[1:], len(key)], strict=True):
        x, y = similar_pairs([np.frombuffer(s, np.uint64) for s in rows.column("found").slice(i, j - i).to_pylist()])
        label = labels(j - i, x, y)
        at = np.flatnonzero(label != np.arange(j - i))
        a.append(at + i), b.append(label[at] + i)
    return np.concatenate(a), np.concatenate(b)


def _probable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _by_key(batches, probable_links)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _by_key(batches, verified_links)


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 256):
        found = pa.array([shingles(x.as_py()).tobytes() for x in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("root"), batch.column("count"), found], names=["t", "root", "count", "found"])


def _dealt(rows: DataFrame, key: str, chunk: int) -> DataFrame:
    """rows (t, key, count, ...) under a key for each pair of chunks that a row's chunk is in, sorted."""
    n = F.ceil(F.col("count") / chunk).cast("int")
    own = F.pmod(F.xxhash64("t"), n).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.xxhash64(key, F.least(own, j), F.greatest(own, j))))
    rest = [c for c in rows.columns if c not in (key, "count")]
    return rows.select(pair.alias("key"), *rest).repartition("key").sortWithinPartitions("key")


def similar_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(t, root): xxhash64 of each text that is linked to another by similar texts, and the least such hash it reaches."""
    own = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    marks = staged(own.mapInArrow(_sketched, "t bigint, n bigint, sketch binary, least array<bigint>"), "similar-sketches")
    places = marks.select(F.explode("least").alias("key"), "t")
    counts = staged(places.groupBy("key").agg(F.count("*").alias("count")).where("count > 1"), "similar-counts")
    shared = staged(places.join(counts, "key"), "similar-places")
    met = shared.join(marks.drop("least").dropDuplicates(["t"]), "t").select("key", "t", "count", "n", "sketch")
    roots = components(_dealt(met, "key", CHUNK).mapInArrow(_probable, "u bigint, v bigint"))
    group = roots.select(F.col("u").alias("t"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("t"), F.col("v").alias("root")).distinct())
    sizes = roots.groupBy(F.col("v").alias("root")).agg((F.count("*") + 1).alias("count"))
    texts = own.join(staged(group.join(sizes, "root"), "similar-candidates"), "t").select("t", "root", "count", "text").dropDuplicates(["t"])
    full = staged(texts.mapInArrow(_full, "t bigint, root bigint, count bigint, found binary"), "similar-shingles")
    found = components(_dealt(full, "root", CHUNK_FULL).mapInArrow(_verified, "u bigint, v bigint"))
    return found.select(F.col("u").alias("t"), F.col("v").alias("root")).unionByName(found.select(F.col("v").alias("t"), F.col("v").alias("root")).distinct())


def drop_similar(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs; of each group linked by similar texts only the text with the smallest key stays (a null one only where there is no other)."""
    t, gone = fresh(docs.columns, "t", "gone_t")
    groups = staged(similar_groups(docs, text).withColumnRenamed("t", "gt"), "similar-groups")
    ids = docs.select(F.xxhash64(text).alias("t"), F.col(key).alias("k")).join(groups, F.col("t") == F.col("gt")).select("t", "k", "root")
    first = ids.groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("without"), "k", "t")).alias("first")).select("root", F.col("first.t").alias("first_t"))
    out = staged(ids.join(first, "root").where("t <> first_t").select(F.col("t").alias(gone)).distinct(), "similar-gone")
    return docs.withColumn(t, F.xxhash64(text)).join(out, F.col(t) == F.col(gone), "left_anti").select(*docs.columns)
