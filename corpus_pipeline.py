"""From raw documents to token ids: five stages, each over all that the one before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again
before the next. run() does so in the shared folder.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language, lines, mixing, pieces, simhash, similar
from lectern.llm.common import fresh, staged, table


def _like(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, n_chars (where there is one) counted anew."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents without any language go: null texts and such without a letter, also where no language could be learned."""
    predicted, score = fresh(docs.columns, "lang_pred", "score")
    filters = language.learn(docs)
    if not filters.languages:  # identify() would find none in any text; one without 3-grams tells texts that have a letter
        filters = language.Filters({"any": np.empty(0, np.uint64)})
    out = language.identify(docs, filters, names=(predicted, score))
    return out.where(F.col(predicted) != "und").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str, least: int = 1) -> DataFrame:
    """Repeated chunks of lines (of `least` or more) go from the texts; documents of which nothing is left go too."""
    out = lines.dedup_lines(docs, least=least)
    return _like(out.where("text is null or text <> ''"), docs)


def dedup_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies by fingerprints go first, then such by five-word shingles of similarity 0.8: of what stays, no two texts are similar."""
    return similar.drop_similar(staged(dedup_near(spark, docs, sf_dir), "near-first"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints the document with the smallest doc_id stays (a null one only where there is no other)."""
    near = simhash.near_groups(staged(simhash.fingerprinted(docs.select("doc_id", "text"), "text", "fp"), "simhash"))
    near = staged(near.where("doc_id <=> component_id").select("doc_id", "fp", "component_fp"), "near-kept")
    one = near.groupBy("doc_id", "component_fp").agg(F.min("fp").alias("fp")).select(F.col("doc_id").alias("kept_id"), F.col("fp").alias("kept_fp"))
    kept = docs.join(one, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    again = near.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again_id"))
    if again.isEmpty():
        return kept.select(*docs.columns)
    # rows that share a doc_id: one row of each group, that with the least fingerprint and text
    single = kept.join(again, F.col("doc_id").eqNullSafe(F.col("again_id")), "left_anti")
    twice = kept.join(again, F.col("doc_id").eqNullSafe(F.col("again_id")), "left_semi")
    fp = simhash.fingerprinted(twice.select(*docs.columns).withColumn("whole_text", F.col("text")), "whole_text", "row_fp")
    picked = fp.join(one, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("row_fp") == F.col("kept_fp"))).dropDuplicates(["doc_id", "row_fp"])
    return single.select(*docs.columns).unionByName(picked.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    size, taken = fresh(docs.columns, "size", "source_size", "target", "taken")[::3]
    out = mixing.mix(docs).where(F.col(size) > 0)
    times = F.expr(f"cast({taken} div {size} as int)")
    return out.withColumn(size, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with their digests."""
    return pieces.encode_decode(docs, pieces.default_model(), keep=True).drop("decoded")


STAGES = [
    ("language", identify_language),
    ("lines", partial(dedup_lines, least=lines.LEAST_LINES)),
    ("near", dedup_similar),
    ("mix", mix_sources),
    ("encode", encode),
]
#: No SQL has the language filters, XXH64 fingerprints or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
