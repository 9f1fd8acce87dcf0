import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, fp string, h int, t string, d string, key string, spans string, score string"


def words(rng, n):
    return [rng.choice(["alpha", "be", "Cé", "delta,", "e1", "föö", "go.", "日本", "x"]) + str(rng.randrange(40)) for _ in range(n)]


def rows():
    """Documents with every odd case; the columns after n_chars have names that operators use inside."""
    rng = random.Random(3)
    passage = words(rng, 80)
    blocks = ["\n".join(" ".join(words(rng, 5)) for _ in range(14)) for _ in range(2)]
    texts = [None, "", " ", "\n\n", "One", "one two", "A b C", "a B c", "日本語テスト 🎉", "\x00\x0b\x0c a b", "0 1 2 3", "x" * 5000]
    texts += [" ".join(words(rng, 30) + passage[:60] + words(rng, 20)), " ".join(words(rng, 10) + passage[10:]), " ".join(passage), " ".join(passage)]
    texts += [f"{blocks[0]}\n{blocks[1]}", f"head 1\n{blocks[0]}", f"head 2\n{blocks[0]}\ntail"]
    long = " ".join(words(rng, 30_000))
    texts += [long, long, "same same same " * 300, "copy of this text " * 20]
    texts += ["copy of this text " * 20] * 30
    near = words(rng, 400)
    for i in range(30):
        near[rng.randrange(400)] = f"edit{i}"
        texts.append(" ".join(near))
    texts += [" ".join(words(rng, rng.randrange(1, 200))) for _ in range(40)]
    out = [(i, t, [None, "en", "de", "fr"][i % 4], [None, "s1", "s2", "é", "", "s1", "s1"][i % 7], None, i, "fp", i, "t", "d", "key", "spans", "s") for i, t in enumerate(texts)]
    out += [out[14], out[20], (None, "no id at all " * 30, "en", "s1", 3, 1, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd_rows():
    return rows()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
