import hashlib
import random
from collections import Counter

import corpus_pipeline as cp
import plain
import pytest
from plain import fingerprint, linked, sha
from plain import lines as plain_lines
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.llm import lines, pieces, similar


def test_each_stage_against_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    kept = cp.identify_language(spark, docs, small).cache()
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}

    lined = cp.dedup_lines(spark, kept, small).cache()
    want = {i: t for (i, _), (_, _, t) in plain_lines([(r.doc_id, r.text) for r in kept.collect()]).items() if t}
    assert {r.doc_id: r.text for r in lined.collect()} == want and lined.columns == columns
    assert lined.where("n_chars <> length(text)").isEmpty()

    near = cp.dedup_near(spark, lined, small).cache()
    rows = sorted((r.doc_id, r.text) for r in lined.collect())
    groups = linked([fingerprint(t) for _, t in rows], lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for g, (i, _) in zip(groups, rows, strict=True):
        first.setdefault(g, i)
    assert sorted(r.doc_id for r in near.collect()) == sorted(first.values()) and near.columns == columns

    mixed = cp.mix_sources(spark, near, small).cache()
    times = Counter(r.doc_id for r in mixed.collect())
    assert max(times.values()) <= 3 and mixed.columns == columns
    assert {r.doc_id: r.text for r in mixed.collect()}.items() <= {r.doc_id: r.text for r in near.collect()}.items()

    ids = {r.doc_id: r.ids for r in cp.encode(spark, mixed, small).collect()}
    library = pieces.encoder(pieces.default_model()).vocabulary.library
    for r in mixed.dropDuplicates(["doc_id"]).collect():
        assert ids[r.doc_id] == library.encode(r.text)


def test_run_and_odd_rows(spark, odd, none, tmp_path):
    for df in (odd, none):
        df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        out = cp.run(spark, str(tmp_path))
        rows = out.collect()
        assert all(r.ids_sha256 == sha(",".join(map(str, r.ids))) for r in rows)
    assert [n for n, _ in cp.STAGES] == ["language", "lines", "near", "mix", "encode"]


def test_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "quite another text here"), (None, "one more text without id"), (None, "x y z w v u"), (2, "a b c d e")]
    out = cp.dedup_near(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(set(rows) - {(2, "a b c d e")})


def test_language_stage_keeps_texts_where_nothing_could_be_learned(spark, odd, odd_rows):
    for lang in ("cast(null as string)", "if(doc_id = 4, 'en', null)"):  # crc32('4') % 3 is 1: held out
        docs = odd.withColumn("lang", F.expr(lang))
        got = Counter((r.doc_id, r.text) for r in cp.identify_language(spark, docs, "").collect())
        assert got == Counter(r[:2] for r in odd_rows if any(c.isalpha() for c in r[1] or ""))


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n[:2] == "op" and n[2].isdigit()} == set(range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def least_chunks(text):
    """No chunk closes after a single line; a last single line joins the chunk before it."""
    out, run, before = [], [], 0
    for i, x in enumerate(text.split("\n")):
        h = int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
        run.append(x)
        if len(run) > 1 and (h + 31 * before * (i > 0)) % 3 == 0:
            out.append(run)
            run = []
        before = h
    if len(run) == 1 and out:
        out[-1] += run
    elif run:
        out.append(run)
    return out


def test_lines_stage_empties_copies_of_texts_of_several_lines(spark, monkeypatch):
    texts = ["\n".join(f"line {k} of {i}" for k in range(2 + i)) for i in range(30)]
    texts.append("head\n" + "\n".join(texts[20:23]) + "\ntail")  # long passages within another text
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)]
    out = dict(cp.STAGES)["lines"](spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    got = {r.doc_id: r.text for r in out.collect()}
    assert max(got) == 30 and {i: got[i] for i in range(30)} == dict(enumerate(texts[:30]))
    monkeypatch.setattr(plain, "chunks", least_chunks)
    assert got == {i: t for (i, _), (_, _, t) in plain_lines(rows).items() if t} and len(got[30]) < len(texts[30])


def test_chunks_of_two_lines_at_least(spark):
    texts = ["\n".join(f"w{(i * 7 + k * k) % 23}" for k in range(i)) for i in range(1, 60)] + [f"{x}\n" * 30 for x in "abcdef"] + ["\n", ""]
    sizes = lines.with_chunks("text", lambda _, c: F.transform(c, lambda x: x["n"]), 2)
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", sizes.alias("n")).collect()
    assert {r.text: r.n for r in got} == {t: [len(c) for c in least_chunks(t)] for t in texts}
    assert all(min(r.n) > 1 or r.n == [1] for r in got)


def word_set(text, size=5):
    w = plain.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9 and bool(a | b)


@pytest.mark.parametrize("chunks", [(512, 128), (4, 3)])
def test_near_stage_leaves_no_similar_texts(spark, small, monkeypatch, chunks):
    monkeypatch.setattr(similar, "CHUNK", chunks[0])
    monkeypatch.setattr(similar, "CHUNK_FULL", chunks[1])
    rng = random.Random(6)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(100).collect()]
    for g, length in enumerate((7, 12, 60, 200, 400)):
        base = [f"w{rng.randrange(900)}" for _ in range(length)]
        for i in range(12):
            near = list(base)
            for _ in range(rng.randrange(1 + length // 30)):
                near[rng.randrange(length)] = f"x{rng.randrange(9)}"
            rows.append((10_000 + 100 * g + i, " ".join(near[: length - i % 3])))
    rows += [(None, rows[-1][1] + " tail"), (None, "nothing is like this text at all"), (20_000, None), (20_001, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    before = [(r.doc_id, r.text) for r in cp.dedup_near(spark, docs, "").collect()]
    got = [(r.doc_id, r.text) for r in dict(cp.STAGES)["near"](spark, docs, "").collect()]
    before.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    groups = linked([word_set(t) for _, t in before], alike)
    assert Counter(got) == Counter(r for i, r in enumerate(before) if groups[i] == i) and len(got) < len(before) - 10
