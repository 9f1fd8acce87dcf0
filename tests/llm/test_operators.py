import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from plain import WORD, chunks, crc, fingerprint, linked, sha
from plain import lines as plain_lines
from plain import substrings as plain_substrings
from pyspark.sql import functions as F

from lectern.llm import components, language, lines, media, mixing, pieces, sharding, simhash, substrings, topk, warc


def test_shards_are_even_gapless_and_in_order(odd, odd_rows):
    out = sharding.histogram_sort(odd, 4, rows_per_piece=10)
    assert out.columns == [*odd.columns, "_size", "text_crc32", "shard", "slot"]  # size was taken
    got = out.collect()
    assert len(got) == len(odd_rows)
    assert all(r._size == len((r.text or "").encode()) + 1 and r.text_crc32 == crc(r.text) for r in got)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


@pytest.mark.parametrize("hot", [0, 0.4])
def test_shard_bytes_are_near_equal(spark, hot):
    rng = random.Random(1)
    rows = [(i, "hot " * 20 if rng.random() < hot else "w" * rng.randrange(200)) for i in range(4000)]
    got = sharding.histogram_sort(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()
    by = Counter()
    for r in got:
        by[r.shard] += r.size
    assert sorted(by) == list(range(8))
    assert max(by.values()) < 1.03 * min(by.values())


@pytest.mark.parametrize("most", [8, 8192])
def test_shards_are_stretches_of_the_order_with_exact_boundaries(spark, monkeypatch, most):
    """Every row's shard and slot against a plain sort; a boundary is off by no more than the tolerance or half a row."""
    monkeypatch.setattr(sharding, "MOST_PIECES", most)
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot text", None, "", f"t{i} " * rng.randrange(60), f"t{i}"])) for i in range(3000)] + [(None, "hot text"), (5, "x"), (5, "x")]
    got = sharding.histogram_sort(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), rows_per_piece=20).collect()

    def order(r):
        h = -1 if r.text is None else int(hashlib.md5(r.text.encode()).hexdigest()[:15], 16)
        return h, r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32

    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    got.sort(key=order)
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    slots, sums = Counter(), Counter()
    for r in got:
        assert r.slot == slots[r.shard]
        slots[r.shard] += 1
        sums[r.shard] += r.size
    total, below = sum(sums.values()), 0
    for s in range(7):
        below += sums[s]
        assert abs(below - (s + 1) * total / 8) <= max(0.01 * total / 8, max(r.size for r in got) / 2 + 1) + 1


def test_equal_texts_stay_together_while_they_fit(spark):
    rows = [(i, f"text {i // 4} " * 5) for i in range(4000)]
    got = sharding.histogram_sort(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_substrings_equal_the_plain_version(odd, odd_rows):
    want = plain_substrings([r[:2] for r in odd_rows])
    got = substrings.dedup_substrings(odd.withColumn("whole", F.col("text"))).collect()
    assert len(got) == len(odd_rows) and any(r.n_removed for r in got)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id, r.whole]
        assert sha(r.kept) == r.kept_sha256


@pytest.mark.parametrize("limit", [4, 10, 256])
def test_substrings_of_hot_passages_with_many_edges(spark, monkeypatch, limit):
    """Over GROUP different texts around one passage: longer prefixes."""
    monkeypatch.setattr(substrings, "GROUP", limit)
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([f"a{rng.randrange(99)}" for _ in range(40)] + passage[rng.randrange(15) :] + [f"b{rng.randrange(99)}" for _ in range(40)])) for i in range(150)]
    rows += [(150 + i, " ".join(["only", "these"] * 60)) for i in range(3)]
    rows += [(160 + i, " ".join(passage[:25] + [f"c{i // 2}"] * 3 + passage[28:] + [f"d{i // 3}"] * 9)) for i in range(30)]
    want = plain_substrings(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(df, keep=False).collect()}
    assert got == {i: want[i, t] for i, t in rows}


def test_suffixes_are_in_order_and_share_what_they_say(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(substrings, "LENGTH", 4)
    words = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(4, 30))] for _ in range(40)] + [[b"a"] * 20] * 3
    group = np.array([i // 9 for i in range(len(words))])
    which, offset, node = substrings.deep_nodes(group, words)
    assert Counter(zip(which.tolist(), offset.tolist(), strict=True)) == Counter((i, o) for i, w in enumerate(words) for o in range(len(w) - 3))
    nodes = {}
    for i, o, n in zip(which.tolist(), offset.tolist(), node.tolist(), strict=True):
        nodes.setdefault((group[i], tuple(words[i][o : o + 4])), set()).add(n)
    assert all(len(x) == 1 for x in nodes.values()) and len(nodes) == node.max() + 1

    laid, starts, owner = [], [], []
    for i, w in enumerate(words):
        starts += range(len(laid), len(laid) + len(w))
        owner += [i] * (len(w) + 1)
        laid += [{b"a": 0, b"b": 1, b"c": 2}[x] for x in w] + [10 + i]
    order, shared = substrings.suffix_order(group[owner], np.array(laid), np.array(starts))

    def suffix(k):
        at = starts[k]
        return group[owner[at]], laid[at : laid.index(10 + owner[at]) + 1]

    told = [suffix(k) for k in order.tolist()]
    assert told == sorted(told)
    for x, y, n in zip(told, told[1:], shared[1:].tolist(), strict=False):
        same = next((i for i, (p, q) in enumerate(zip(x[1], y[1], strict=False)) if p != q), 0) if x[0] == y[0] else 0
        assert n == same


def test_pieces_equal_the_library(odd):
    e = pieces.Encoder(pieces.default_model())
    texts = ["", " ", "  a", "\n", "a\n\nb", "▁x ▁▁", "a\tb", "日本語 テスト🎉", "x" * 300 + " " * 40 + "y", "<s> </s> <0x0A>", "\x00a"]
    assert e.encode(texts) == e.vocabulary.library.encode(texts)
    assert e.vocabulary._by_heap("▁elephantine") == e.vocabulary._by_list("▁elephantine")
    got = pieces.encode_decode(odd.withColumn("whole", F.col("text")), pieces.default_model()).collect()
    for r in got:
        ids = e.vocabulary.library.encode(r.whole or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == sha(",".join(map(str, ids)))
        assert r.decoded == (r.whole or "") and r.decoded_sha256 == sha(r.decoded)


def test_simhash_equals_all_pairs(odd, odd_rows):
    out = simhash.near_groups(simhash.fingerprinted(odd.select("doc_id", "text", "h", "score").withColumn("whole", F.col("text")), "text", "fp"))
    fps = [fingerprint(r[1]) for r in odd_rows]
    groups = linked(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for g, r in zip(groups, odd_rows, strict=True):
        least[g] = min([x for x in (least.get(g), r[0]) if x is not None], default=None)
    want = Counter((r[0], r[1], f, least[g]) for g, f, r in zip(groups, fps, odd_rows, strict=True))
    assert Counter((r.doc_id, r.whole, r.fp % (1 << 64), r.component_id) for r in out.collect()) == want


@pytest.mark.parametrize("split,chunk", [(8192, 128), (40, 8)])
def test_links_of_crowded_keys_lose_nothing(spark, monkeypatch, split, chunk):
    monkeypatch.setattr(simhash, "SPLIT", split)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for x in list(fps)[:20]:
        for _ in range(20):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
    fps |= {0xABCD << 48 | rng.getrandbits(8) << rng.choice([0, 20]) for _ in range(300)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    roots = {r.u % (1 << 64): r.v % (1 << 64) for r in components.components(simhash.links(df)).collect()}
    want = linked(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    got = [roots.get(x, x) for x in fps]
    assert len({*zip(want, got, strict=True)}) == len({*want}) == len({*got})


def test_a_very_long_text_has_the_same_fingerprint_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprints([text])[0]
    monkeypatch.setattr(simhash, "BLOCK", 700)
    assert simhash.fingerprints([None, text, "a"])[1] == whole == fingerprint(text)


def test_lines_equal_the_plain_version(odd, odd_rows):
    want = plain_lines([r[:2] for r in odd_rows])
    got = lines.dedup_lines(odd.withColumn("whole", F.col("text"))).collect()
    assert len(got) == len(odd_rows) and any(r.n_removed for r in got)
    for r in got:
        assert (r.n_lines, r.n_removed, r.text) == want[r.doc_id, r.whole]
    assert chunks("a") == [["a"]]


def test_warc_round_trip_and_revisits(spark, monkeypatch):
    big = "<p>é" * 60_000
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (9, "u", big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "WARC/1.0\r\n\r\n\r\n"), (None, "u", big), (9, "u", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    table = warc.write_archives(pages).cache()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(table).collect())

    def one(p, html):
        data = (html or "").encode()
        revisit = html == big and p != 9
        return p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None

    assert got == Counter(one(p, html) for p, _, html in rows)
    assert table.agg(F.max("chunk_no")).first()[0] > 2 and table.agg(F.max(F.length("data"))).first()[0] < 2 * warc.CHUNK
    for a in table.select("archive").distinct().collect():  # an archive's bytes, read by length
        data = b"".join(r.data for r in table.where(F.col("archive") == a.archive).orderBy("seq", "chunk_no").collect())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.0\r\n")
            size = int(head.split(b"Content-Length: ")[1])
            assert rest[size : size + 4] == b"\r\n\r\n"
            data = rest[size + 4 :]
    heads = [r.data.split(b"\r\n\r\n")[0].decode() for r in table.where("chunk_no = 0").collect()]
    fields = [dict(x.split(": ", 1) for x in h.split("\r\n")[1:]) for h in heads]
    responses = {f["WARC-Record-ID"] for f in fields if f["WARC-Type"] == "response"}
    assert {f["WARC-Refers-To"] for f in fields if f["WARC-Type"] == "revisit"} <= responses  # each names a record there is
    broken = table.withColumn("data", F.when(F.col("chunk_no") == 1, F.lit(b"?")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="doesn't match|wrong"):
        warc.read_archives(broken).collect()
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_of_odd_urls_repeated_rows_and_clashing_names(spark):
    long = "http://a/" + "é" * 50_000
    rows = [(1, long, "x" * 200_000, "d", 1, b"s"), (1, long, "x" * 200_000, "d", 1, b"s"), (2, "u", "x" * 200_000, None, None, None), (None, long, "y" * 70_000, "", 2, b""), (None, None, None, "", 2, b"")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, digest string, size int, payload binary").repartition(2)
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.url, r.n_chunks) for r in got) == Counter(
        [(1, 200_000, "revisit", 2, long, 1), (1, 200_000, "revisit", 2, long, 1), (2, 200_000, "response", None, "u", 4), (None, 70_000, "response", None, long, 2), (None, 0, "response", None, None, 1)])


def test_top_k_equals_all_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)], i) for i in range(400)]
    rows += [(1000 + i, rows[20][1], 0) for i in range(30)]  # ties
    rows += [rows[5], (None, rows[0][1], 0), (2000, None, 0), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (2002, [float("nan")] * 6, 0), (2003, [float("inf")] * 6, 0), (2020, [1.0, 2.0], 0), (2040, [], 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    points = topk.scaled(table).cache()
    v = {i: np.floor(64 * np.array(e)).astype(int) for i, e, _ in rows if i is not None and e is not None and None not in e and np.isfinite(e).all()}
    want = set()
    for q in (i for i in v if i % 20 == 0):
        best = sorted((-int(v[q] @ v[p]), p) for p in v if p != q and len(v[p]) == len(v[q]))[:20]
        want |= {(q, r, p, -s) for r, (s, p) in enumerate(best, 1)}
    for sizes in ((16_384, 4_096), (50, 7)):
        assert {tuple(r) for r in topk.top_k(points, points.where("vec_id % 20 = 0"), 20, *sizes).collect()} == want
    empty = points.limit(0)
    assert topk.top_k(empty, empty).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e9, 1e17, 1e30])
def test_top_k_of_large_components_and_repeated_ids(spark, scale):
    """Exact up to a long, cut to its ends beyond; rows that share an id; columns with names that the operator uses."""
    rng = np.random.default_rng(5)
    rows = [(int(i // 2), [float(x) * scale for x in rng.normal(size=3)], 1, "s", 2) for i in range(120)]
    rows += [(200 + i, [float(x) for x in rng.integers(-3, 3, 3)], 1, "s", 2) for i in range(40)] + [(300, [scale, -scale, 0.5], 1, None, 2), (300, [-1.7e308, 1.0, 1.0], 1, None, 2)]
    points = topk.scaled(spark.createDataFrame(rows, "vec_id int, embedding array<double>, shard int, query_id string, kth int")).cache()
    most = 2**63 - 1

    def whole(x):
        x = x * 64
        return max(-most, min(most, math.floor(x))) if abs(x) < 1e300 else int(math.copysign(most, x))

    own = {(r[0], tuple(whole(x) for x in r[1])) for r in rows}
    want = Counter()
    for q in {i for i, _ in own if i % 20 == 0}:
        found = []
        for _, a in (x for x in own if x[0] == q):
            best = sorted((-max(-most, min(most, sum(x * y for x, y in zip(a, b, strict=True)))), p) for p, b in own if p != q)
            found += best[:20]
        want += Counter((q, r, p, -s) for r, (s, p) in enumerate(sorted(found)[:20], 1))
    for sizes in ((16_384, 4_096), (40, 3)):
        assert Counter(tuple(r) for r in topk.top_k(points, points.where("vec_id % 20 = 0"), 20, *sizes).collect()) == want


def test_tree_search_prunes_and_is_exact():
    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(size=(3000, 3)) * 50).astype(np.int64)
    tree = topk.Tree(np.arange(3000), points)
    q = np.array([[5, -3, 2]])
    ids, scores = tree.search(q[0], tree.bounds(q)[0], tree.sizes(q)[0], -1, 10, float("-inf"))
    best = np.lexsort((np.arange(3000), -(points @ q[0])))[:10]
    assert sorted(ids) == sorted(best) and sorted(scores) == sorted((points @ q[0])[best])


def test_language_of_held_out_texts(spark, small):
    rows = language.op8_language_filters(spark, small).join(spark.read.parquet(f"{small}/documents.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(odd, odd_rows, none):
    filters = language.learn(odd)
    got = language.identify(odd, filters).collect()
    assert len(got) == len(odd_rows) and got[0].asDict().keys() >= {"lang_pred", "_score"}
    for r in got:
        bare = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == bare and r.lang_pred in ("und", "en", "de", "fr")
    nothing = language.learn(none)
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}


def plain_grams(text):
    low = (text or "").lower()
    own = [ord(c) if c.isalpha() else 0 for c in low]
    return [((own[i - 1] if i else 0) << 42) | (c << 21) | (own[i + 1] if i + 1 < len(own) else 0) for i, c in enumerate(own) if c]


def plain_slots(gram):
    mixed = gram ^ (gram >> 29)
    return [(mixed * int(m) % 2**64) >> (64 - language.SLOT_BITS) for m in language.MULTIPLIERS]


@pytest.mark.parametrize("part", [7, 1 << 18])
def test_filters_equal_a_plain_n_gram_version(spark, small, odd, monkeypatch, part):
    """Counts, the choice of 3-grams, filters, hits, the correction and the decision, with dictionaries and sets."""
    monkeypatch.setattr(language, "PART", part)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id") + 10_000))
    rows, seen = docs.collect(), {}
    for r in rows:
        if r.text is not None and r.lang is not None and r.doc_id is not None and crc(str(r.doc_id)) % 3 != 1:
            seen.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    kept = {k: {g: n for g, n in c.items() if n >= language.LEAST} for k, c in seen.items()}
    share = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in kept.items()}
    top = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    contained = {k: [g for g, x in s.items() if x >= language.SHARE * top[g]] for k, s in share.items()}
    learned = language.learn(docs)
    plain = language.Filters({k: np.array(sorted(g), np.uint64) for k, g in contained.items()})
    assert learned.languages == plain.languages and all((a == b).all() for a, b in zip(learned.tables, plain.tables, strict=True))
    filled = {k: {s for g in own for s in plain_slots(g)} for k, own in contained.items()}
    chance = {k: (len(s) / 2**language.SLOT_BITS) ** language.HASHES for k, s in filled.items()}
    order = {g: plain_slots(g) for r in rows for g in plain_grams(r.text)}
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.identify(docs, learned).collect()}
    for r in rows:
        found = plain_grams(r.text)
        sure = {k: max(0, (sum(all(x in filled[k] for x in order[g]) for g in found) - len(found) * chance[k]) / (1 - chance[k])) for k in sorted(filled)}
        best = max(sure, key=sure.get)
        pred, score = got[r.doc_id, r.text]
        assert pred == (best if found else "und") and score == pytest.approx(min(1, sure[best] / len(found)) if found else 0)


def test_filters_of_many_languages_and_chance():
    own = {f"l{i:02}": np.arange(i * 1000, i * 1000 + 500) + 97 for i in range(20)}
    f = language.Filters(own)
    assert len(f.tables) == 3 and (f.chance < 1e-6).all()
    found = np.concatenate([own["l03"][:40], own["l17"][:30], own["l17"][:5]]).astype(np.uint64)
    hits = f.hits(found, np.array([40, 0, 30, 5]))
    assert hits[0, 3] == 40 and hits[2, 17] == 30 and hits[3, 17] == 5 and not hits[1].any()
    assert f.predict(["", "1", None or ""]) [0] == ["und"] * 3


def test_audio_round_trip():
    for text in (None, "", "a", "x" * 576, "é" * 1000, "long text " * 3000):
        row, stored, mels, spans = media.features(text)
        payload = bytes(media.samples(stored))
        data = (text or "").encode()
        assert payload[: len(data)] == data and set(payload[len(data) :]) <= {255} and len(payload) % 576 == 0 < len(payload)
        assert row[:3] == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert row[4:6] == (len(stored), hashlib.sha256(stored).hexdigest())
        batch = pa.ipc.open_stream(media.tensors(mels)).read_next_batch()
        assert batch.column("log_mel").type == pa.fixed_shape_tensor(pa.int16(), (media.FRAMES, media.BANDS))
        assert (media.frames_of(media.tensors(mels)) == mels).all()
        assert (spans[:, 0] < spans[:, 1]).all() and (spans[1:, 0] > spans[:-1, 1]).all()


def test_features_equal_plain_sums_of_whole_numbers(monkeypatch):
    """Filter, frames, transform, mel bands and logarithms, one number at a time."""
    pcm = np.random.default_rng(3).integers(0, 256, 1100).astype(np.uint8)
    x = [int(v) - 128 for v in pcm]
    n, sound = len(pcm) * media.UP // media.DOWN, []
    for m in range(n):
        p, last = m * media.DOWN % media.UP, m * media.DOWN // media.UP
        sound.append(sum(int(media.phases()[p][k]) * x[last - k] for k in range(media.TAPS) if 0 <= last - k < len(x)) // 2**media.DROP_SOUND)
    assert media.resampled(pcm, 0, n).tolist() == sound and media.resampled(pcm, 301, 77).tolist() == sound[301:378]
    got = media.log_mels(pcm)
    assert len(got) == 1 + (n - media.FRAME) // media.HOP
    bins, top = media.FRAME // 2 + 1, media.RATE * media.UP / media.DOWN / 2
    edges = [700 * (10 ** (i * math.log10(1 + top / 700) / (media.BANDS + 1)) - 1) for i in range(media.BANDS + 2)]
    for f, row in enumerate(got.tolist()):
        frame = [s * round(256 * 0.5 * (1 - math.cos(2 * math.pi * i / (media.FRAME - 1)))) for i, s in enumerate(sound[f * media.HOP : f * media.HOP + media.FRAME])]
        power = []
        for k in range(bins):
            re, im = (sum(v * round(1024 * g(2 * math.pi * (i * k % media.FRAME) / media.FRAME)) for i, v in enumerate(frame)) // 2**media.DROP_SPECTRUM for g in (math.cos, math.sin))
            power.append(re * re + im * im)
        for b, value in enumerate(row):
            low, mid, high = edges[b : b + 3]
            energy = sum(e * round(64 * max(0, min((k * top / (bins - 1) - low) / (mid - low), (high - k * top / (bins - 1)) / (high - mid)))) for k, e in enumerate(power))
            first = (energy + 1) >> max(0, (energy + 1).bit_length() - 11)  # its first eleven digits
            assert value == math.floor(256 * math.log2(first) + 1e-9) + 256 * max(0, (energy + 1).bit_length() - 11)
    monkeypatch.setattr(media, "BLOCK", 3)
    assert (media.log_mels(pcm) == got).all()


def test_tables_of_the_filterbank_are_far_from_a_rounding_edge():
    t = (np.arange(media.TAPS * media.UP) - (media.TAPS * media.UP - 1) / 2) / media.UP
    taps = (np.sinc(t * media.UP / media.DOWN) * np.hamming(len(t))).reshape(media.TAPS, media.UP).T
    for x in (np.hanning(media.FRAME) * 256, np.cos(2 * np.pi * np.arange(media.FRAME) / media.FRAME) * 1024, taps / taps.sum(1, keepdims=True) * 4096):
        assert (np.abs(x - np.floor(x) - 0.5) > 1e-9).all()


def test_segments_equal_a_plain_switch():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 60, 500):
        mels = np.repeat(rng.integers(0, 9000, (-(-n // 3), media.BANDS)), 3, 0)[:n].astype(np.int16)
        energy = [sum(r) for r in mels.tolist()]
        mean = Fraction(sum(energy), n)
        variance = sum((e - mean) ** 2 for e in energy) / n
        on, want = False, []
        for i, e in enumerate(energy):
            if e > mean and 4 * (e - mean) ** 2 > variance:
                on = True
            elif e < mean:
                on = False
            if on and want and want[-1][1] == i:
                want[-1][1] = i + 1
            elif on:
                want.append([i, i + 1])
        assert media.active(mels).tolist() == want


def test_audio_of_odd_rows(odd, odd_rows):
    got = media.audio_features(odd.withColumn("whole", F.col("text"))).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert r.n_bytes == len((r.whole or "").encode()) and len(r.media) == r.media_bytes
    by = {}
    for r in got:
        by.setdefault(r.whole, set()).add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by.values())


def test_audio_query_digests_what_it_stored(spark, small, odd, tmp_path, monkeypatch):
    for text in (None, "", "a", "x" * 576, "é" * 1000, "long text " * 3000):
        row, stored, mels, spans = media.features(text)
        ends = [{"start_s": media.seconds(a), "end_s": media.seconds(b - 1) + media.FRAME * media.DOWN / media.UP / media.RATE} for a, b in spans.tolist()]
        assert media.digests(stored, media.tensors(mels), ends) == row
        assert media.digests(stored, media.tensors(mels + 1), ends)[:-1] == row[:-1] and media.digests(stored, media.tensors(mels + 1), ends)[-1] != row[-1]
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    monkeypatch.setattr(media, "staged", lambda df, label, f=media.staged: kept.append(f(df, label)) or kept[-1])
    got = media.op9_audio_features(spark, str(tmp_path))
    want = media.audio_features(odd.select("doc_id", "text"), keep=False)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert kept[0].columns == ["doc_id", "media", "tensors", "segments"] and kept[0].where("tensors is null or media is null").isEmpty()


def test_mix_meets_targets(odd, odd_rows):
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        n = len(WORD.findall(r.text or ""))
        assert r._size == n and r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        sizes[r.source] += n
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], n)
    targets = {r.source: r.target for r in got}
    weight = dict(zip(sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None], [5, 2, 1, 5, 2], strict=False))
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        want = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in sizes if x not in full) for s in sizes}
        over = {s for s in sizes if s not in full and want[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in sizes:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - targets[s]) <= largest[s]
    assert {(r.doc_id, r.text, r.taken) for r in mixing.mix(odd).collect()} == {(r.doc_id, r.text, r.taken) for r in got}


def test_empty_tables(none):
    assert sharding.histogram_sort(none).count() == 0
    assert language.identify(none, language.learn(none)).count() == 0
    assert substrings.dedup_substrings(none).count() == 0
    assert pieces.encode_decode(none, pieces.default_model()).count() == 0
    assert simhash.near_groups(simhash.fingerprinted(none.select("doc_id", "text"), "text", "fp")).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert media.audio_features(none).count() == 0
    assert mixing.mix(none).count() == 0
