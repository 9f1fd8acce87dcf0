"""Substring dedup with prefix-partitioned suffix trees.

A word goes if a window of LENGTH words around it also starts in a document with a smaller doc_id. Suffixes of all texts that
agree in LENGTH words hang below one deep node of the corpus's suffix tree, so a window goes if a smaller doc_id hangs below its node.

The tree is built in parts, each for the suffixes under one prefix, none larger than GROUP segments:
* Of the PREFIX-word prefixes inside a window, that with the least hash is the window's anchor. Equal windows have equal
  anchors at equal offsets, so windows are dealt by their anchor's prefix, and neighbouring windows with one anchor travel together
  as a segment (some 20 windows). Prefixes that stay within one document have no deep node in two documents and go at
  once. Equal segments become one leaf, with their least and largest doc_id. A prefix with one distinct segment is a path
  without branches and needs no further work.
* Prefixes of more than GROUP distinct segments are made longer: a segment is cut into stretches of up to 12, then 4, then single
  windows by where the anchor stands in them. All windows of such a stretch share 39, then 47, then all 50 words around
  the anchor, and by those they are dealt anew, until GROUP or fewer are left together. What stays in one document goes at every step.
  At full length all windows together hang below one deep node; its least doc_id is a map-side sum, whatever their number.
* For every other prefix a subtree is built from the words themselves: its suffixes are sorted by doubling, the ranks kept on the way give the
  words shared by neighbours, and stretches that share LENGTH words or more are the topmost deep nodes. All
  nodes below them (longer repeats) have the same leaves or fewer, so the topmost decide what goes.

Hashes (of words 64 bits, of segments and full windows 128 bits) deal windows and fold equal segments; inside subtrees words are
compared as they are.

Defined cases: null text has no words; a text of under LENGTH words loses none; a row without doc_id neither removes nor loses words;
rows with the same doc_id don't remove each other's; the kept text of a row from which all goes is empty. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lectern.llm.common import fresh, slices, staged, table

LENGTH, PREFIX = 50, 12
#: Distinct segments (or parts of such) of a subtree at most, and the windows that a part of a segment has at most where groups are larger.
GROUP, WIDE, NARROW = 256, 12, 4
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bytes of text worked on at a time, and words whose hash is remembered.
BLOCK, REMEMBERED = 1 << 20, 200_000
ANCHORS = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("prefix", pa.int64()), ("seg", pa.int64()), ("seg2", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
ANCHORS_DDL = "doc_id bigint, t bigint, prefix bigint, seg bigint, seg2 bigint, start int, n int"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _words() -> _Hashes:
    return _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolled:
    """Hashes of any stretches of a row of words."""

    def __init__(self, words: np.ndarray, base: int):
        size = 1 << max(12, int(len(words) + 1).bit_length())
        power, self.inverse = _powers(base, size)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[: len(words)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return _mixed((self.sums[start + length] - self.sums[start]) * self.inverse[start])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in each stretch of that width."""
    best, at, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[:-step], best[step:]
        later = right < left
        best, at, have = np.where(later, right, left), np.where(later, at[step:], at[:-step]), have + step
    return at


def segments(words: np.ndarray, sizes: np.ndarray):
    """For texts laid end to end: text number, prefix hash, two segment hashes, first window's place in its text, number of windows."""
    if len(words) < LENGTH:
        return None
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    one = Rolled(words, BASES[0])
    prefix = one(np.arange(len(words) - PREFIX + 1), PREFIX)
    anchor = sliding_argmin(prefix, LENGTH - PREFIX + 1)  # of the window that starts here
    windows = len(words) - LENGTH + 1
    inside = text[:windows] == text[LENGTH - 1 :]
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return None
    last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    n, at, length = last - first + 1, anchor[first] - first, last - first + LENGTH
    two = Rolled(words, BASES[1])
    shape = (at.astype(np.uint64) << np.uint64(16)) + n.astype(np.uint64)
    which = text[first]
    return which, prefix[anchor[first]], one(first, length) ^ _mixed(shape), two(first, length), first - starts[which], n


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 512, BLOCK):
        ids, ts = (batch.column(c).to_numpy() for c in ("doc_id", "t"))
        texts = [(x.as_py() or "").encode().split() for x in batch.column("text")]
        found = segments(word_hashes([w for t in texts for w in t]), np.fromiter(map(len, texts), np.int64, len(texts)))
        if found:
            row, prefix, seg, seg2, first, n = found
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], ts[row], prefix.view(np.int64), seg.view(np.int64), seg2.view(np.int64), first.astype(np.int32), n.astype(np.int32))], schema=ANCHORS)


SEGMENT = ("prefix", "seg", "seg2")
FETCHED = pa.schema([("doc_id", pa.int64()), ("prefix", pa.int64()), ("seg", pa.int64()), ("seg2", pa.int64()), ("in_group", pa.int64()), ("words", pa.binary())])
FETCHED_DDL = "doc_id bigint, prefix bigint, seg bigint, seg2 bigint, in_group bigint, words binary"


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each wanted segment."""
    for batch in slices(batches, "text", 256):
        out = []
        for doc_id, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
            words = (text.as_py() or "").encode().split()
            for w in wanted:
                out.append((doc_id, w["prefix"], w["seg"], w["seg2"], w["in_group"], b" ".join(words[w["start"] : w["start"] + w["n"] + LENGTH - 1])))
                if len(out) == 4096:
                    yield _batch(out, FETCHED)
                    out = []
        if out:
            yield _batch(out, FETCHED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of each pair (a, b) in their order."""
    return np.unique(a.astype(np.uint64) * np.uint64(int(b.max(initial=0)) + 1) + b.astype(np.uint64), return_inverse=True)[1]


def suffix_order(group: np.ndarray, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `starts` ordered by group and suffix, and how many symbols each shares with the one before it (in its group).

    Every segment in `symbols` ends with a symbol found nowhere else, so suffixes differ at last."""
    ranks, depth = [_dense(group, symbols)], 1
    while int(ranks[-1].max(initial=0)) + 1 < len(symbols):
        ranks.append(_dense(ranks[-1], np.append(ranks[-1][depth:] + 1, np.zeros(min(depth, len(symbols)), np.int64))))
        depth *= 2
    order = np.argsort(ranks[-1][starts], kind="stable")
    at = starts[order]
    shared = np.zeros(max(len(at) - 1, 0), np.int64)
    for level in reversed(range(len(ranks) - 1)):  # a step of 2**level where the next 2**level symbols are equal
        a, b = at[:-1] + shared, at[1:] + shared
        shared += np.where(ranks[level][a] == ranks[level][b], 1 << level, 0)
    return order, np.append(0, shared)[: len(at)]


def deep_nodes(group: np.ndarray, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For segments in prefix groups: segment, offset and topmost node of LENGTH words or more of each of their windows."""
    sizes = np.array([len(w) for w in words])
    numbers: dict[bytes, int] = {}
    laid = np.empty(int(sizes.sum()) + len(words), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    ends_mask = np.zeros(len(laid), bool)
    ends_mask[ends] = True
    laid[~ends_mask] = np.fromiter((numbers.setdefault(w, len(numbers)) for x in words for w in x), np.int64, int(sizes.sum()))
    laid[ends] = len(numbers) + np.arange(len(words))
    n = np.maximum(sizes - LENGTH + 1, 0)
    which = np.repeat(np.arange(len(words)), n)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    order, shared = suffix_order(np.repeat(group, sizes + 1), laid, (ends - sizes)[which] + offset)
    return which[order], offset[order], np.cumsum(shared < LENGTH) - 1


ROW = pa.schema([("group", pa.int64()), ("doc_id", pa.int64()), ("prefix", pa.int64()), ("seg", pa.int64()), ("seg2", pa.int64()), ("at", pa.int32()), ("words", pa.binary())])
ROW_DDL = "group bigint, doc_id bigint, prefix bigint, seg bigint, seg2 bigint, at int, words binary"
FLAGGED = pa.schema([("prefix", pa.int64()), ("seg", pa.int64()), ("seg2", pa.int64()), ("flags", pa.list_(pa.int32()))])
FLAGGED_DDL = "prefix bigint, seg bigint, seg2 bigint, flags array<int>"


def subtree_flags(doc: np.ndarray, key: np.ndarray, words: list[list[bytes]]) -> list[np.ndarray]:
    """For whole prefix groups (key): of each segment, the windows that a smaller document has too."""
    which, offset, node = deep_nodes(np.unique(key, return_inverse=True)[1], words)
    least = np.full(int(node.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, doc[which])
    hit = least[node] < doc[which]
    which, offset = which[hit], offset[hit]
    by = np.lexsort((offset, which))
    return np.split(offset[by], np.searchsorted(which[by], np.arange(1, len(words))))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ROW sorted by group; the last group of a batch waits for the next batch."""
    def done(t: pa.Table) -> pa.RecordBatch:
        words, at = [w.split(b" ") for w in t["words"].to_pylist()], t["at"].to_numpy()
        flags = subtree_flags(t["doc_id"].to_numpy(), t["group"].to_numpy(), words)
        some = [i for i, f in enumerate(flags) if len(f)]
        picked = t.select(list(SEGMENT)).take(pa.array(some, pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([*(picked[c].combine_chunks() for c in SEGMENT), pa.array([flags[i] + at[i] for i in some], pa.list_(pa.int32()))], schema=FLAGGED)

    held = None
    for batch in slices(batches, "words", 1024):
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        group = held["group"].to_numpy()
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield done(held.slice(0, cut))
            held = held.slice(cut).combine_chunks()
    if held is not None:
        yield done(held)


FOURS = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("key", pa.int64())])
ONES = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("check", pa.int64())])
PARTS_DDL = "doc_id bigint, prefix bigint, seg bigint, seg2 bigint, at int, n int, key bigint, fours array<struct<at:int,n:int,key:bigint>>, ones array<struct<at:int,n:int,key:bigint,check:bigint>>"


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run; `new` says where one starts."""
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments cut into parts of WIDE windows, each with its narrower parts and single windows, and a hash of the words that
    all windows of the part share (for single windows two hashes)."""
    for batch in slices(batches, "words", 1024, 1 << 19):
        words = [word_hashes(w.split(b" ")) for w in batch.column("words").to_pylist()]
        sizes = np.array([len(w) for w in words])
        n, starts, laid = sizes - LENGTH + 1, np.cumsum(sizes) - sizes, np.concatenate(words)
        one, two = (Rolled(laid, b) for b in BASES)
        prefix = batch.column("prefix").to_numpy().view(np.uint64)
        # The anchor: the first place from the last window's start on that has the prefix.
        anchor = np.empty(len(words), np.int64)
        for i, (a, count) in enumerate(zip(starts.tolist(), n.tolist(), strict=True)):
            anchor[i] = count - 1 + np.flatnonzero(one(np.arange(a + count - 1, a + LENGTH - PREFIX + 1), PREFIX) == prefix[i])[0]
        which = np.repeat(np.arange(len(words)), n)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        behind = anchor[which] - offset  # words of the window before its anchor, 0 to LENGTH - PREFIX

        def shared(width: int, roll: Rolled = one) -> np.ndarray:
            """For each window: a hash of the words that all windows of its class share."""
            low = behind // width * width
            high = np.minimum(low + width - 1, LENGTH - PREFIX)
            start = (starts + anchor)[which] - low
            return _mixed(roll(start, LENGTH - high + low) ^ _mixed(prefix[which] + low.astype(np.uint64))).view(np.int64)

        def first_of(width: int) -> np.ndarray:
            return np.append(True, (which[1:] != which[:-1]) | (behind[1:] // width != behind[:-1] // width))

        wide, wide_n = _runs(first_of(WIDE))
        narrow, narrow_n = _runs(first_of(NARROW))
        int32 = np.int32
        fours = pa.StructArray.from_arrays([pa.array(offset[narrow].astype(int32)), pa.array(narrow_n.astype(int32)), pa.array(shared(NARROW)[narrow])], fields=list(FOURS))
        ones = pa.StructArray.from_arrays([pa.array(offset.astype(int32)), pa.array(np.ones(len(which), int32)), pa.array(shared(1)), pa.array(shared(1, two))], fields=list(ONES))
        same = [batch.column(c).take(pa.array(which[wide])) for c in ("doc_id", *SEGMENT)]
        fours = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(narrow, wide), len(narrow)).astype(int32)), fours)
        ones = pa.ListArray.from_arrays(pa.array(np.append(wide, len(which)).astype(int32)), ones)
        columns = [*same, pa.array(offset[wide].astype(int32)), pa.array(wide_n.astype(int32)), pa.array(shared(WIDE)[wide]), fours, ones]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *SEGMENT, "at", "n", "key", "fours", "ones"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments with `dealt` (at, n, group): the words of those parts."""
    for batch in slices(batches, "words", 256, 1 << 19):
        out = []
        for doc_id, prefix, seg, seg2, words, dealt in zip(*(batch.column(c).to_pylist() for c in ("doc_id", *SEGMENT, "words", "dealt")), strict=True):
            cut = words.split(b" ")
            out += [(d["group"], doc_id, prefix, seg, seg2, d["at"], b" ".join(cut[d["at"] : d["at"] + d["n"] + LENGTH - 1])) for d in dealt]
        if out:
            yield _batch(out, ROW)


def _hot_flags(hot: DataFrame) -> DataFrame:
    """(prefix, seg, seg2, flags) of the segments (FETCHED) of crowded prefixes, whose shared words are made more step by step."""
    rest, fits, flags = staged(hot.mapInArrow(_parts, PARTS_DDL), "parts"), None, None
    for finer, own in (("fours", ["key"]), ("ones", ["key"]), (None, ["key", "check"])):
        in_two = staged(rest.groupBy(*own).agg(F.count("*").alias("together"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"), "longer-prefixes")
        met = staged(rest.join(in_two, own), "parts-dealt")
        fit = met.where(F.col("together") <= GROUP).select(*SEGMENT, F.struct("at", "n", F.col("key").alias("group")).alias("one"))
        fits = fit if fits is None else fits.unionByName(fit)
        crowded = met.where(F.col("together") > GROUP)
        if crowded.isEmpty():
            break
        if finer is None:
            flags = crowded.where("lo < doc_id").groupBy(*SEGMENT).agg(F.collect_set("at").alias("flags"))
        elif finer == "fours":
            rest = crowded.select("doc_id", *SEGMENT, F.explode("fours").alias("part"), "ones")
            inside = F.filter("ones", lambda w: (w["at"] >= F.col("part.at")) & (w["at"] < F.col("part.at") + F.col("part.n")))
            rest = rest.select("doc_id", *SEGMENT, "part.*", inside.alias("ones"))
        else:
            rest = crowded.select("doc_id", *SEGMENT, F.explode("ones").alias("part")).select("doc_id", *SEGMENT, "part.*")
    dealt = staged(fits.groupBy(*SEGMENT).agg(F.collect_list("one").alias("dealt")), "parts-wanted")
    rows = hot.join(dealt, list(SEGMENT)).mapInArrow(_cut_out, ROW_DDL).repartition("group").sortWithinPartitions("group")
    found = rows.mapInArrow(_subtrees, FLAGGED_DDL)
    return found if flags is None else found.unionByName(flags)


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text), t a hash of the text -> (doc_id, t, first, last): stretches of words that a smaller document has too."""
    anchors = staged(docs.where("doc_id is not null and text is not null").select("doc_id", "t", "text").mapInArrow(_anchors, ANCHORS_DDL), "anchors")
    # What a join looks up is written first: it then comes by an exchange of its own, and Spark can split a hot key's rows.
    shared = staged(anchors.groupBy("prefix").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("prefix"), "prefixes-shared")
    places = staged(anchors.join(shared, "prefix"), "anchors-shared")
    distinct = places.groupBy(*SEGMENT).agg(F.min(F.struct("doc_id", "t", "start", "n")).alias("least"), F.max("doc_id").alias("hi"))
    distinct = staged(distinct.select(*SEGMENT, "least.*", "hi"), "segments")

    groups = staged(distinct.groupBy("prefix").agg(F.count("*").alias("in_group")).where("in_group > 1"), "prefix-groups")
    in_trees = distinct.join(groups, "prefix").groupBy("doc_id", "t").agg(F.collect_list(F.struct(*SEGMENT, "start", "n", "in_group")).alias("wanted"))
    texts = docs.select(F.col("doc_id").alias("d"), F.col("t").alias("dt"), "text")
    asked = in_trees.join(texts, (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("dt"))).select("doc_id", "text", "wanted")
    fetched = staged(asked.mapInArrow(_fetched, FETCHED_DDL), "segment-words")

    fit = fetched.where(F.col("in_group") <= GROUP).select(F.col("prefix").alias("group"), "doc_id", *SEGMENT, F.lit(0).alias("at"), "words")
    flags = fit.repartition("group").sortWithinPartitions("group").mapInArrow(_subtrees, FLAGGED_DDL)
    hot = fetched.where(F.col("in_group") > GROUP)
    if not hot.isEmpty():
        flags = flags.unionByName(_hot_flags(hot))
    flags = staged(flags, "segment-flags").groupBy(*SEGMENT).agg(F.flatten(F.collect_list("flags")).alias("flags"))

    told = staged(distinct.select(*SEGMENT, F.col("doc_id").alias("lo"), "hi").join(flags, list(SEGMENT), "left").where("hi > lo or flags is not null").drop("hi"), "segments-told")
    hits = places.join(told, list(SEGMENT))
    whole = hits.where("doc_id > lo").select("doc_id", "t", F.col("start").alias("first"), (F.col("start") + F.col("n") + LENGTH - 1).alias("last"))
    some = hits.where("doc_id = lo and flags is not null").select("doc_id", "t", "start", F.explode("flags").alias("at"))
    return whole.unionByName(some.select("doc_id", "t", (F.col("start") + F.col("at")).alias("first"), (F.col("start") + F.col("at") + LENGTH).alias("last")))


def _kept(whole_text: str, covering: str, names: list[str], keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, whole_text, 256):
            out = []
            for text, spans in zip(batch.column(whole_text), batch.column(covering).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                n, kept = len(words), words
                if spans:
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, [s["first"] for s in spans], 1)
                    np.add.at(step, [s["last"] for s in spans], -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(step)[:n] == 0).tolist()]
                joined = b" ".join(kept)
                row = n, n - len(kept), hashlib.sha256(joined).hexdigest()
                out.append((*row, joined.decode()) if keep else row)
            rest = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in (whole_text, covering)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=False))], names=names)

    return run


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: bool = True) -> DataFrame:
    """docs without the text, with n_words, n_removed, kept_sha256 and, if keep, kept (the words left, joined by blanks); columns of these names give way."""
    made = ["n_words", "n_removed", "kept_sha256", *["kept"] * keep]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    rest = [c for c in docs.columns if c != text]
    t, d, dt, spans_, whole = fresh(docs.columns, "t", "d", "dt", "spans", "whole_text")
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    spans = covered(own).groupBy(F.col("doc_id").alias(d), F.col("t").alias(dt)).agg(F.collect_list(F.struct("first", "last")).alias(spans_))
    keyed = docs.withColumn(t, F.xxhash64(text))
    met = keyed.join(spans, (F.col(key).cast("long") == F.col(d)) & (F.col(t) == F.col(dt)), "left")
    met = met.select(*rest, F.col(text).alias(whole), spans_)
    kinds = {"n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string", "kept": "string"}
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), *(f"{c} {kinds[c]}" for c in made)])
    return met.mapInArrow(_kept(whole, spans_, [*rest, *made], keep), schema)


def op2_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)


SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS s FROM w),
h AS (SELECT doc_id, s, md5(array_to_string(list_slice(ws, s, s + 49), ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
g AS (SELECT h.doc_id, h.s FROM h JOIN m USING (h) WHERE m.least < h.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM g),
k AS (SELECT w.doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
r AS (SELECT k.doc_id, CAST(count(c.i) AS BIGINT) AS n_removed, coalesce(string_agg(k.word, ' ' ORDER BY k.i) FILTER (WHERE c.i IS NULL), '') AS kept
      FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.i = c.i GROUP BY k.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(r.n_removed, 0) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""
