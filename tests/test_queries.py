"""Every query against the SQL it is meant to equal, on the smallest tables; vectors of folds; invariants."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import vectors

SF = "/root/testdata/sf0.001"


def own():
    return {n: f for plan in entry.PLANS for n, f in plan.QUERIES.items()}


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(own()))
def test_query_equals_its_sql(spark, duck, name):
    df = own()[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted((repr([plain(r[c]) for c in names]) for r in df.collect()))
    if name not in entry.oracle_sql():
        assert rows
        return
    result = duck.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in result.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(vectors.VECTORS))
def test_vectors(spark, duck, name):
    df = vectors.VECTORS[name](spark, SF)
    names = sorted(df.columns)
    result = duck.execute(vectors.SQL[name])
    columns = [x[0] for x in result.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_offsets_never_overlap(spark):
    rows = own()["paragraph_offsets"](spark, SF).orderBy("doc_id", "pos").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        assert a.start + a.units + 1 == a.end and (a.doc_id != b.doc_id or a.end == b.start)


def test_no_shuffle_of_documents_where_a_window_shares_its_partitioning(spark):
    plan = own()["style_ranges"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") <= 2


def test_every_order_reaches_the_list_converter(spark):
    from lectern.sources import corpus

    rows = own()["order_lists"](spark, SF).collect()
    numbers = {(r.doc_id, r.pos): r.number for r in corpus.order_items(spark, SF).collect()}
    assert {(r.doc_id, r.pos) for r in rows} == set(numbers) and len(rows) == len(numbers)
    assert {r.kind for r in rows} == {"bullet", "paragraph"} and all(r.label == f"{numbers[r.doc_id, r.pos]}." for r in rows if r.kind == "bullet")


def test_tables_go_on_only_where_the_whole_header_repeats(spark, tmp_path):
    """The letter of the first cell and the column count modulo 3 agree in all of these lines with bars."""
    text = "Act | Section\n act  |  SECTION \nAct | Section\nAct | Part\nAct | b | c | d | e\nAct | b | c | d | e\nplain\nAct | b | c | d | e"
    spark.createDataFrame([(1, "s", "en", text)], "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = own()["split_tables"](spark, str(tmp_path)).orderBy("first").collect()
    assert [(r.first, r.last, r.header, r.n_cols, r.n_rows, r.parts) for r in rows] == [
        (0, 2, "act | section", 2, 4, 3), (3, 3, "act | part", 2, 2, 1), (4, 5, "act | b | c | d | e", 5, 3, 2), (7, 7, "act | b | c | d | e", 5, 2, 1),
    ]


def test_letters_go_on_past_four(spark, tmp_path):
    """The SQL spells four letters at most, up to 475254; word processors count on."""
    def letters(n):
        out = ""
        while n > 0:
            n, r = divmod(n - 1, 26)
            out = chr(97 + r) + out
        return out

    keys = [e + i for e in (26, 702, 18278, 475254, 1200000, 12356630) for i in range(-7, 6)]
    spark.createDataFrame([(k,) for k in keys], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    rows = own()["letter_labels"](spark, str(tmp_path)).collect()
    assert {r.p_partkey: r.letters for r in rows} == {k: letters(k + 1) for k in keys} and len(rows) == len(keys)
    assert all(r.label == letters(r.p_partkey + 1) for r in rows if r.format == "lowerLetter")
    assert all(r.label == letters(r.p_partkey + 1).upper() for r in rows if r.format == "upperLetter")
