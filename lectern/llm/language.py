"""Language ID with language-bitmask n-gram filters.

Each letter of a text, with its neighbours, is a 3-gram (characters that aren't letters count as one blank). A language
contains a 3-gram if that is about as frequent in its training texts as in any other's. A bit-sliced Bloom filter holds for each slot one bit
for each language, so one look-up (the AND of HASHES slots) returns all languages that contain a 3-gram. A text's language is
that with most 3-grams, each count freed of the hits that its slice of the filter gives by chance.

Training reads at most about ROWS rows of each language (a documented bound: they are chosen by a hash of doc_id, so the number
varies around it), of those documents whose crc32(doc_id as text) mod 3 is not 1. Prediction reads the text alone.

Defined cases: a null text, or one without a letter, or any text when nothing could be learned, is `und` with score 0; ties go to
the first language by code point; a null doc_id is neither held out nor learned from; null lang is never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import fresh, slices, table

ROWS = 2_000
SLOT_BITS, HASHES = 20, 3
#: A language contains a 3-gram seen there LEAST times or more, at SHARE of the highest frequency in any language or more.
LEAST, SHARE = 3, 0.4
#: Characters whose 3-grams are held at a time.
PART = 1 << 18
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, n, found): the 3-grams around letters, PART characters at a time; n of them for each owner, the number of a text.

    A long text comes in parts, each with its neighbouring characters."""
    held: list[tuple[int, str, int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        low = text.lower()
        for a in range(0, max(len(low), 1), PART):
            b = min(a + PART, len(low))
            held.append((i, low[max(a - 1, 0) : b + 1], min(a, 1), int(b < len(low))))
            size += b - a
            if size >= PART:
                yield _grams(held)
                held, size = [], 0
    if held:
        yield _grams(held)


def _grams(parts: list[tuple[int, str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of parts (owner, characters, how many of them only go before, only go after)."""
    owner, texts, before_it, after_it = zip(*parts, strict=True)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    own = np.where(letter, codes, 0).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    full = starts[sizes > 0]
    before[full] = 0
    after[full[1:] - 1] = 0
    centre = letter.copy()
    centre[starts[np.array(before_it) > 0]] = False
    centre[(starts + sizes - 1)[np.array(after_it) > 0]] = False
    found = ((before << np.uint64(42)) | (own << np.uint64(21)) | after)[centre]
    ends = np.concatenate([[0], np.cumsum(centre)])
    return np.array(owner), ends[starts + sizes] - ends[starts], found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            for _, _, found in grams([t for t, x in zip(batch.column("text").to_pylist(), langs, strict=True) if x == lang]):
                g, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


class Filters:
    """Slices of up to eight languages each: one byte for each slot."""

    def __init__(self, contained: dict[str, np.ndarray]):
        self.languages = sorted(contained)
        self.tables = []
        for at in range(0, len(self.languages), 8):
            t = np.zeros(1 << SLOT_BITS, np.uint8)
            for bit, lang in enumerate(self.languages[at : at + 8]):
                for slot in self.slots(contained[lang].astype(np.uint64)):
                    t[slot] |= np.uint8(1 << bit)
            self.tables.append(t)
        fill = [float(np.mean(self.tables[i // 8] >> np.uint8(i % 8) & 1)) for i in range(len(self.languages))]
        self.chance = np.array(fill) ** HASHES

    @staticmethod
    def slots(found: np.ndarray) -> list[np.ndarray]:
        mixed = found ^ (found >> np.uint64(29))
        return [(mixed * m) >> np.uint64(64 - SLOT_BITS) for m in MULTIPLIERS[:HASHES]]

    def hits(self, found: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For stretches of n 3-grams: how many each language seems to contain."""
        out, some, starts = np.zeros((len(n), len(self.languages))), n > 0, np.cumsum(n) - n
        slots = self.slots(found)
        for i in range(len(self.languages)):
            if i % 8 == 0:
                t = self.tables[i // 8]
                mask = t[slots[0]]
                for s in slots[1:]:
                    mask = mask & t[s]
            out[some, i] = np.add.reduceat(mask >> np.uint8(i % 8) & 1, starts[some], dtype=np.int64)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        total, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        for owner, n, found in grams(texts):
            np.add.at(total, owner, n)
            if len(found) and self.languages:
                np.add.at(hits, owner, self.hits(found, n))
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        sure = np.clip((hits - total[:, None] * self.chance) / (1 - np.minimum(self.chance, 0.99)), 0, None)
        best = sure.argmax(1)
        score = np.clip(sure.max(1) / np.maximum(total, 1), 0, 1)
        return [self.languages[b] if k else "und" for b, k in zip(best, total, strict=True)], np.where(total > 0, score, 0)


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS) -> Filters:
    """Filters from labelled rows that aren't held out, about `rows` of each language at most."""
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("key").isNotNull() & ~held_out("key"))
    there = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not there:
        return Filters({})
    parts = F.create_map(*[F.lit(x) for k, n in there.items() for x in (k, min(1.0, rows / n))])
    chosen = labelled.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 20)) < F.element_at(parts, F.col("lang")) * (1 << 20))
    counted = chosen.select("text", "lang").mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.where(F.col("n") >= LEAST).toPandas()  # 3-grams of a bounded sample
    got["share"] = got.n / got.groupby("lang").n.transform("sum")
    got = got[got.share >= SHARE * got.groupby("gram").share.transform("max")]
    return Filters({k: v.gram.to_numpy() for k, v in got.groupby("lang")})


def _predicted(model, column: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            langs, scores = model.value.predict([t or "" for t in batch.column(column).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return run


def identify(docs: DataFrame, filters: Filters, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language of each text and its score (the share of its 3-grams that the language contains)."""
    made = fresh(docs.columns, *names)
    model = docs.sparkSession.sparkContext.broadcast(filters)  # 2**SLOT_BITS bytes for each eight languages
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"{made[0]} string, {made[1]} double"])
    return docs.mapInArrow(_predicted(model, text, [*docs.columns, *made]), schema)


def op8_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = learn(docs)
    return identify(docs.select("doc_id", "text"), filters).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
