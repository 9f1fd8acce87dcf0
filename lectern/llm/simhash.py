"""SimHash near-dedup with pivot distance tables.

The table: for each distinct fingerprint its Hamming distances to PIVOTS reference fingerprints. Fingerprints that differ in at
most MOST_BITS bits have distances that differ by MOST_BITS at most in every coordinate, so pairs are discarded by their
largest coordinate difference, and survivors are verified bit by bit.

Which pairs meet: one of three parts of the bits (of 22, 21 and 21) is equal in fingerprints that differ in two bits; and each
of the first CELLED coordinates puts both in one of its cells of CELL distances, if a fingerprint stands in its own cell and in the next one
where that is MOST_BITS or less away. A fingerprint is filed under each part with each choice of its cells (some ten keys), and
only fingerprints under one key meet. There they are ordered by the next coordinate, each looks no further than MOST_BITS along
it, and the whole table discards before bits are compared. Pivots alone could not bring pairs together at scale: a coordinate
that may differ by two tells about a bit and a half, which is why a part of the bits is in the key.

Keys with many fingerprints are split twofold. Up to SPLIT of them, the group is cut into chunks and each pair of chunks is
a group of its own. Beyond, the key takes in further bits: of three sub-parts of the bits still free one must be equal, which
repeats until few bits are free. Each group passes on no more than one link for each fingerprint, to the least it reaches.
Components are those of the distinct fingerprints; copies only join in at the end.

Defined cases: A-Z are lower-cased, other letters not; null and empty texts, or blanks only, have fingerprint zero, which links
like any other; fewer than three words are one shingle; rows repeated are nodes of one component; a null doc_id counts for no
component's smallest. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lectern.llm.common import fresh, give_back, slices, staged, table
from lectern.llm.components import components

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Pivots; of those, how many choose cells of the key, and the width of a cell.
PIVOTS, CELLED, CELL = 16, 4, 6
CHUNK, SPLIT = 128, 8192
#: Shingles hashed at a time.
BLOCK = 1 << 14
BLANK, LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER[0x41:0x5B] += 32


def shingle_hashes(text: str | None, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of `size` words, in blocks."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    blank = BLANK[raw]
    kept = ~blank
    last = np.flatnonzero(kept & np.append(blank[1:], True))  # of each word
    if not len(last):
        return
    kept[last[:-1] + 1] = True  # one blank after each word but the last
    whole = np.where(blank, np.uint8(0x20), LOWER[raw])[kept].tobytes()
    if len(last) < size:
        yield np.array([xxh64_intdigest(whole, SEED)], np.uint64)
        return
    ends = np.cumsum(kept)[last]
    starts, ends = np.append(0, ends[:-size] + 1), ends[size - 1 :]
    for a in range(0, len(ends), BLOCK):
        cut = [whole[i:j] for i, j in zip(starts[a : a + BLOCK].tolist(), ends[a : a + BLOCK].tolist(), strict=True)]
        yield np.fromiter(map(xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(cut))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(texts: list[str | None]) -> np.ndarray:
    out, held, sizes, rows = np.zeros(len(texts), np.uint64), [], [], []

    def add_up() -> None:
        if held:
            n = np.array(sizes)
            counts = np.add.reduceat(_bits(np.concatenate(held)), np.cumsum(n) - n, axis=0, dtype=np.int32)
            out[rows] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
            held.clear(), sizes.clear(), rows.clear()

    for i, text in enumerate(texts):
        n, counts, first = 0, None, None
        for block in shingle_hashes(text):
            if n == 0:
                first = block
            else:  # a long text, block by block
                counts = (counts if counts is not None else _bits(first).sum(0, dtype=np.int64)) + _bits(block).sum(0, dtype=np.int64)
            n += len(block)
        if counts is not None:
            out[i] = np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]
        elif n:
            held.append(first), sizes.append(n), rows.append(i)
            if sum(sizes) >= BLOCK:
                add_up()
    add_up()
    return out


def _fingerprinted(column: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            got = pa.array(fingerprints(batch.column(column).to_pylist()).view(np.int64))
            rest = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != column]
            yield pa.RecordBatch.from_arrays([*rest, got], names=names)

    return run


def fingerprinted(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs without the text, with the fingerprint as a signed long."""
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{name}` bigint"])
    return docs.mapInArrow(_fingerprinted(text, [*(f.name for f in rest), name]), schema)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def first_masks() -> list[int]:
    return [_signed(((1 << n) - 1) << at) for at, n in ((0, 22), (22, 21), (43, 21))]


def finer_masks(mask: int) -> list[int]:
    """The mask with a third more of the free bits each."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [_signed((mask | sum(1 << b for b in free[i::3])) & (1 << 64) - 1) for i in range(3)]


def pivots() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, PIVOTS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def cells(fp: str) -> Column:
    """A number for each choice of a cell in each of the first CELLED coordinates."""
    distances = [F.bit_count(F.col(fp).bitwiseXOR(F.lit(_signed(int(p))))) for p in pivots()[:CELLED]]
    choices = F.array(F.lit(0))
    for d in distances:
        choices = _times(choices, F.array_distinct(F.array(F.floor(d / CELL).cast("int"), F.floor((d + MOST_BITS) / CELL).cast("int"))))
    return choices


def _times(choices: Column, own: Column) -> Column:
    """Each number with each cell appended; there are at most 12 cells."""
    return F.flatten(F.transform(choices, lambda c: F.transform(own, lambda x: c * 16 + x)))


def group_links(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group: a link from each fingerprint to the least place it reaches within its group."""
    n, table = len(fp), np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.lexsort((table[:, CELLED], group))  # along one coordinate that no key has used
    group, table, bits = group[order], table[order], fp[order]
    along, near, a, b = table[:, CELLED], np.arange(n), [], []
    for shift in range(1, n):
        near = near[: np.searchsorted(near, n - shift)]
        near = near[(group[near] == group[near + shift]) & (along[near + shift] - along[near] <= MOST_BITS)]
        if not len(near):
            break
        at = near
        for p in range(PIVOTS):  # coordinate by coordinate, as most pairs fall at the first
            at = at[np.abs(table[at, p] - table[at + shift, p]) <= MOST_BITS]
        at = at[np.bitwise_count(bits[at] ^ bits[at + shift]) <= MOST_BITS]
        a.append(order[at]), b.append(order[at + shift])
    label = np.arange(n)
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key; a batch's last group waits for the next batch."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def done(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        u, v = group_links(k, f)
        return pa.RecordBatch.from_arrays([pa.array(f[u].view(np.int64)), pa.array(f[v].view(np.int64))], names=["u", "v"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
        if len(keys):
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield done(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield done(keys, fps)
    give_back()


def _filed(rows: DataFrame, key: str, masks: Column) -> DataFrame:
    """(fp, mask, key): the rows under each mask; the key is a hash of the old key, the mask and the bits there."""
    out = rows.select("fp", F.col(key).alias("old"), F.explode(masks).alias("mask"))
    return out.select("fp", "mask", F.xxhash64("old", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))


def links(distinct: DataFrame) -> DataFrame:
    """(fp) distinct -> (u, v): links that connect all fingerprints at MOST_BITS or fewer bits."""
    def literals(masks: list[int]) -> Column:
        return F.array(*[F.lit(m).cast("long") for m in masks])

    sizes, ready = first_masks(), None
    filed = _filed(distinct.select("fp", F.explode(cells("fp")).alias("cells")), "cells", literals(sizes))
    for last in (False, False, False, True):  # 43 bits free, then 28 or 29, 19, 13: at most 2**13 fingerprints
        counts = staged(filed.groupBy("key").count().where("count > 1"), "simhash-counts")
        met = staged(filed.join(counts, "key"), "simhash-filed")
        fit = met if last else met.where(F.col("count") <= SPLIT)
        ready = fit if ready is None else ready.unionByName(fit)
        hot = met.where(F.col("count") > SPLIT)
        if last or hot.isEmpty():
            break
        finer = F.create_map(*[x for m in sizes for x in (F.lit(m).cast("long"), literals(finer_masks(m & (1 << 64) - 1)))])
        filed = _filed(hot, "key", F.element_at(finer, F.col("mask")))
        sizes = [y for m in sizes for y in finer_masks(m & (1 << 64) - 1)]
    n = F.ceil(F.col("count") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("fp"), n).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.xxhash64("key", F.least(chunk, j), F.greatest(chunk, j)))).alias("key")
    dealt = ready.select("fp", pair).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_links, "u bigint, v bigint")


def near_groups(rows: DataFrame, fp: str = "fp", key: str = "doc_id") -> DataFrame:
    """rows with component_id (the smallest key reachable) and component_fp (the least fingerprint reachable)."""
    component, root, f = fresh(rows.columns, "component_id", "component_fp", "f")
    distinct = staged(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp")))
    placed = staged(distinct.join(roots, distinct["fp"] == roots["u"], "left").select("fp", "least", F.coalesce("v", "fp").alias("root")), "simhash-placed")
    # Written first: the rows of a giant component, or of a text with very many copies, are then split by the join.
    smallest = staged(placed.groupBy("root").agg(F.min("least").alias(component)), "simhash-smallest")
    by_fp = staged(placed.join(smallest, "root").select(F.col("fp").alias(f), component, F.col("root").alias(root)), "simhash-roots")
    return rows.join(by_fp, F.col(fp) == F.col(f)).drop(f)


def op4_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(fingerprinted(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "fp"), "simhash")
    return near_groups(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
