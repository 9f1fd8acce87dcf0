"""Literal rows for the rules: small cases with the rows that are due, for operators whose tables show few of their corners."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import colour as co
from lectern.functions import links as ln
from lectern.functions import markers as m
from lectern.functions import runs as rn
from lectern.functions import symbols as sy
from lectern.functions import text as t
from lectern.operators import definitions as df
from lectern.operators import drawn as dr
from lectern.operators import edits as ed
from lectern.operators import layout as ly
from lectern.operators import numbering as nb
from lectern.operators import paragraphs as pg
from lectern.operators import slides as sl
from lectern.operators.fold import fold_by_doc
from lectern.plans.line_queries import hyphen_joined
from lectern.plans.scalar_queries import settings, vectors
from lectern.schemas import RUN
from lectern.sources import target as tg

VECTORS, SQL = {}, {}


def query(name: str, sql: str):
    def put(f):
        VECTORS[name], SQL[name] = f, sql
        return f

    return put


ADJUSTED = [("accent1", 0.2, 0.8, None, None, "#DAE3F3"), ("accent1", 0.75, None, None, None, "#2F5597"), ("bg1", 0.5, None, None, None, "#808080"), ("tx1", 0.5, 0.5, None, None, "#808080"),
            ("accent2", None, None, 0.5, None, "#F6BE98"), ("accent6", None, None, None, 0.5, "#385624"), ("dk2", None, None, None, None, "#44546A"), ("accent4", 0.4, 0.6, None, None, "#FFE699")]


@query("theme_colours", vectors(*[(r[0], r[5]) for r in ADJUSTED], names="scheme, code"))
def theme_colours(spark, d):
    rows = spark.createDataFrame([r[:5] for r in ADJUSTED], "scheme string, lum_mod double, lum_off double, tint double, shade double")
    steps = [("lumMod", F.col("lum_mod")), ("lumOff", F.col("lum_off")), ("tint", F.col("tint")), ("shade", F.col("shade"))]
    return rows.select("scheme", co.adjusted(co.theme_base(F.col("scheme")), steps).alias("code"))


HIGHLIT = [("yellow", None, "#FFFF00"), ("none", "d9d9d9", "#D9D9D9"), (None, "auto", None), (None, "FFFFFF", None), (None, "abc123", "#ABC123"), ("mauve", "abc123", None), (None, None, None), ("darkGray", None, "#808080")]


@query("highlights", vectors(*HIGHLIT, names="name, fill, code"))
def highlights(spark, d):
    rows = spark.createDataFrame([r[:2] for r in HIGHLIT], "name string, fill string")
    return rows.select("name", "fill", co.highlight(F.col("name"), F.col("fill")).alias("code"))


# Each: text, then letters of its styles (b i u p s), colour, highlight.
def run(text: str, styles: str = "", color: str | None = None, hl: str | None = None) -> tuple:
    return (text, *(x in styles for x in "biups"), color, hl)


RUNS = {
    "joined": [run("ab", "b"), run("", "i"), run("cd", "b")],
    "blank_between": [run("one", "i"), run(" "), run("two", "i")],
    "blank_first": [run("  "), run("x", "b")],
    "underlined_blank": [run("a"), run(" ", "u"), run("b")],
    "spaces": [run("  a \t"), run("  b ", "b"), run(" c  ")],
    "all_blank": [run("  "), run("\t", "b")],
    "all_bold": [run("Head", "b"), run(" "), run("line", "bi")],
    "some_bold": [run("Head", "b"), run(" line")],
    "nested": [run(" x ", "biup"), run("y", "s", "#FF0000", "#FFFF00")],
    "marker": [run("(a", "b"), run(")  First"), run(" point", "i")],
    "lines": [run("one\ntw"), run("o\r\r", "b"), run("  \nthree", "i")],
    "none": [],
}


def run_rows(spark):
    return spark.createDataFrame(list(RUNS.items()), f"name string, runs array<{RUN}>")


@query("runs_rendered", vectors(
    ("joined", "**abcd**"), ("blank_between", "*one two*"), ("blank_first", "  **x**"), ("underlined_blank", "a b"), ("spaces", "  a \t  **b ** c  "), ("all_blank", "  \t"),
    ("all_bold", "**Head** ***line***"), ("some_bold", "**Head** line"), ("nested", " ***__^{x}__*** {hl #FFFF00|{#FF0000|_{y}}}"), ("marker", "**(a**)  First *point*"),
    ("lines", "one\ntw**o\r\r**  *\nthree*"), ("none", ""), names="name, text"))
def runs_rendered(spark, d):
    return run_rows(spark).select("name", rn.rendered(rn.merged(F.col("runs"))).alias("text"))


@query("runs_normalised", vectors(
    ("joined", "**abcd**", 1), ("blank_between", "*one two*", 1), ("blank_first", "**x**", 1), ("underlined_blank", "a b", 3), ("spaces", "a **b** c", 3), ("all_blank", "", 0),
    ("all_bold", "**Head** ***line***", 2), ("some_bold", "**Head** line", 2), ("nested", "***__^{x}__*** {hl #FFFF00|{#FF0000|_{y}}}", 2), ("marker", "**(a**) First *point*", 3),
    ("lines", "one tw**o** *three*", 3), ("none", "", 0), names="name, text, n"))
def runs_normalised(spark, d):
    out = run_rows(spark).select("name", rn.normalised(F.col("runs")).alias("runs"))
    return out.select("name", rn.rendered(F.col("runs")).alias("text"), F.size("runs").alias("n"))


@query("runs_without_uniform_style", vectors(
    ("joined", "abcd"), ("blank_between", "one two"), ("blank_first", "x"), ("underlined_blank", "a b"), ("all_bold", "Head *line*"), ("some_bold", "**Head** line"), names="name, text"))
def runs_without_uniform_style(spark, d):
    rows = run_rows(spark).where(F.col("name").isin("joined", "blank_between", "blank_first", "underlined_blank", "all_bold", "some_bold"))
    return rows.select("name", rn.rendered(rn.without_uniform(rn.normalised(F.col("runs")), "bold", "italic")).alias("text"))


@query("runs_without_marker", vectors(("marker", "First *point*", "(a)  First point"), ("some_bold", "**d** line", "Head line"), ("none", "", ""), names="name, rest, text"))
def runs_without_marker(spark, d):
    rows = run_rows(spark).where(F.col("name").isin("marker", "some_bold", "none"))
    return rows.select("name", rn.rendered(rn.without_marker(F.col("runs"), F.lit(3))).alias("rest"), rn.text_of(F.col("runs")).alias("text"))


@query("runs_split_lines", vectors(("lines", 0, "one"), ("lines", 1, "tw**o**"), ("lines", 2, "*three*"), names="name, line, text"))
def runs_split_lines(spark, d):
    rows = run_rows(spark).where("name = 'lines'")
    return rows.select("name", F.posexplode(rn.split_lines(F.col("runs"))).alias("line", "r")).select("name", "line", rn.rendered(F.col("r")).alias("text"))


@query("run_flags", vectors(("all_bold", True, 1.0, "bold,italic"), ("some_bold", False, 0.5, "bold"), ("none", False, 0.0, ""), ("nested", False, 0.5, "bold,italic,underline,baselineOffset,foregroundColor,backgroundColor"), names="name, all_bold, ratio, fields"))
def run_flags(spark, d):
    rows = run_rows(spark).where(F.col("name").isin("all_bold", "some_bold", "none", "nested"))
    fields = F.array_join(F.array_distinct(F.flatten(F.transform("runs", lambda r: rn.style_fields(r)))), ",")
    return rows.select("name", rn.all_bold(F.col("runs")).alias("all_bold"), rn.bold_ratio(F.col("runs")).cast("decimal(2,1)").alias("ratio"), fields.alias("fields"))


SYMBOLS = [("Stocks", "Calibri", "Wingdings", "Stocks"), ("b", "Symbol", None, "β"), (" go", "Calibri", "Wingdings", "→ go"), ("", "Arial", None, "•"), ("a 1", "Symbol", None, "α 1"),
           ("x", "Arial", None, "x"), ("l", "Wingdings", None, "●"), ("\U0001f389w", "Wingdings 2", None, "\U0001f389◆"), ("", "Symbol", None, "")]


@query("symbol_texts", vectors(*SYMBOLS, names="text, font, symbol_font, shown"))
def symbol_texts(spark, d):
    rows = spark.createDataFrame([r[:3] for r in SYMBOLS], "text string, font string, symbol_font string")
    return rows.select("text", "font", "symbol_font", sy.shown(F.col("text"), F.col("font"), F.col("symbol_font")).alias("shown"))


LONG = "1aB_c-D2eF3gH4iJ5kL6mN7oP8"


LINKS = [(f"https://host/document/d/{LONG}/edit?tab=t.x1#h", LONG, "t.x1"), (f"  {LONG} ", LONG, None), ("https://elsewhere.example/x", None, None), (f"https://host/document/d/{LONG}/edit", LONG, None), ("", None, None), ("short", None, None)]


@query("document_links", vectors(*LINKS, names="link, doc_id, tab_id"))
def document_links(spark, d):
    rows = spark.createDataFrame([(r[0],) for r in LINKS], "link string")
    return rows.select("link", ln.document_id(F.col("link")).alias("doc_id"), ln.tab_id(F.col("link")).alias("tab_id"))


STYLES = [("width:96pt;height:18pt", 96.0, 18.0), ("height:7.5pt", 120.0, 7.5), ("", 120.0, 30.0), ("width:1pt;width:2pt", 2.0, 30.0)]


@query("box_sizes", vectors(*STYLES, names="style, width, height").replace("SELECT *", "SELECT style, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height"))
def box_sizes(spark, d):
    rows = spark.createDataFrame([(r[0],) for r in STYLES], "style string")
    return rows.select("style", ln.box_size(F.col("style")).alias("b")).select("style", "b.width", "b.height")


@query("settings_maps", vectors(
    (0, "alpha", "HEADING_3", 3), (0, "decimal", "HEADING_2", 2), (0, "other", "NORMAL_TEXT", 0), (1, "alpha", "HEADING_5", 5), (1, "decimal", "HEADING_2", 2), (1, "other", "NORMAL_TEXT", 0),
    (2, "alpha", "HEADING_3", 3), (2, "decimal", "NORMAL_TEXT", 0), (2, "other", "NORMAL_TEXT", 0), names="id, style_key, named, rank"))
def settings_maps(spark, d):
    raw = spark.createDataFrame([(0, "not json"), (1, '{"heading_map": {"alpha": "HEADING_5", "decimal": "BANNER"}}'), (2, '{"heading_map": {"decimal": "NORMAL_TEXT", "other": "HEADING_1"}}')], "id int, raw string")
    keyed = raw.select("id", settings(F.col("raw")).alias("m"), F.explode(F.array(F.lit("alpha"), F.lit("decimal"), F.lit("other"))).alias("style_key"))
    named = F.coalesce(F.element_at("m", F.col("style_key")), F.lit("NORMAL_TEXT"))
    return keyed.select("id", "style_key", named.alias("named"), F.coalesce(F.expr("try_cast(nullif(regexp_extract(coalesce(m[style_key], ''), 'HEADING_([1-6])', 1), '') AS int)"), F.lit(0)).alias("rank"))


@query("rejected_files", vectors(("a.PDF", None, "no reader"), ("b.docx", "docx", None), ("c.doc", None, "old format"), ("d.ppt", None, "old format"), ("e.txt", None, "unknown format"), ("f", None, "unknown format"), names="path, format, error"))
def rejected_files(spark, d):
    from lectern.sources.files import format_of

    return format_of(spark.createDataFrame([("a.PDF",), ("b.docx",), ("c.doc",), ("d.ppt",), ("e.txt",), ("f",)], "path string"), "path")


@query("marker_vectors", """
SELECT * FROM (VALUES ('1. X', 'decimal', '1', '1.', '1'), ('(ii) X', 'paren', 'ii', '(ii)', 'ii'), ('1.5 m', NULL, NULL, NULL, NULL), ('Section 1', NULL, NULL, NULL, NULL),
  ('Dr. Tan', NULL, NULL, NULL, NULL), ('MR. S', NULL, NULL, NULL, NULL), ('b) x', NULL, NULL, NULL, 'b'), ('12.', 'decimal', '12', '12.', NULL), ('(AA) x', 'paren', 'aa', '(AA)', 'AA'),
  ('iv. x', NULL, NULL, NULL, 'iv'), ('(1234) x', NULL, NULL, NULL, NULL), ('1.1 x', NULL, NULL, NULL, NULL)) v(line, scheme, token, label, item)""")
def marker_vectors(spark, d):
    rows = spark.sql("SELECT * FROM VALUES ('1. X'), ('(ii) X'), ('1.5 m'), ('Section 1'), ('Dr. Tan'), ('MR. S'), ('b) x'), ('12.'), ('(AA) x'), ('iv. x'), ('(1234) x'), ('1.1 x') AS v(line)")
    return rows.select("line", m.heading_marker(F.col("line")).alias("mk"), m.item_marker(F.col("line")).alias("item")).select("line", "mk.scheme", "mk.token", "mk.label", "item")


@query("roman_values", """
WITH n AS (SELECT CAST(unnest(range(1, 4000)) AS INTEGER) AS n),
r AS (SELECT n, repeat('m', n // 1000) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1]
  || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] AS numeral FROM n)
SELECT n, numeral, n AS back, true AS well_formed FROM r""")
def roman_values(spark, d):
    n = spark.range(1, 4000).select(F.col("id").cast("int").alias("n"))
    r = n.withColumn("numeral", m.roman(F.col("n")))
    return r.select("n", "numeral", m.roman_value(F.col("numeral")).alias("back"), m.is_roman(F.col("numeral")).alias("well_formed"))


@query("letter_labels", """
WITH n AS (SELECT CAST(unnest(range(1, 2000)) AS INTEGER) AS n)
SELECT n, CASE WHEN n > 702 THEN chr(97 + (n - 703) // 676) ELSE '' END || CASE WHEN n > 26 THEN chr(97 + ((n - 27) // 26) % 26) ELSE '' END || chr(97 + (n - 1) % 26) AS base26,
  chr(97 + (n - 1) % 26) AS wrapped, CASE WHEN n < 10 THEN '0' || n ELSE CAST(n AS VARCHAR) END AS zero_padded FROM n""")
def letter_labels(spark, d):
    n = spark.range(1, 2000).select(F.col("id").cast("int").alias("n"))
    zero = m.number_label(F.lit("decimalZero"), F.col("n"))
    return n.select("n", m.number_label(F.lit("lowerLetter"), F.col("n")).alias("base26"), m.wrapped_letter(F.col("n")).alias("wrapped"), zero.alias("zero_padded"))


@query("next_letters", """
SELECT * FROM (VALUES (NULL, 'a'), ('a', 'b'), ('h', 'i'), ('z', 'aa'), ('zz', 'aaa'), ('aa', 'bb'), ('ab', 'ac'), ('B', 'c')) v(token, following)""")
def next_letters(spark, d):
    return spark.sql("SELECT * FROM VALUES (NULL), ('a'), ('h'), ('z'), ('zz'), ('aa'), ('ab'), ('B') AS v(token)").select("token", m.next_letter(F.col("token")).alias("following"))


@query("utf16_vectors", """SELECT * FROM (VALUES ('abc', 3), ('é', 1), ('𝒜b', 3), ('🎉🎉', 4), ('', 0)) v(text, units)""")
def utf16_vectors(spark, d):
    return spark.sql("SELECT * FROM VALUES ('abc'), ('é'), ('𝒜b'), ('🎉🎉'), ('') AS v(text)").select("text", t.utf16_length(F.col("text")).cast("int").alias("units"))


@query("hyphen_vectors", """
SELECT * FROM (VALUES (1, 'insol-', 'vency', 'insolvency'), (1, 'decision-', 'specific', 'decision-specific'), (1, 're-', 'possess', 're-possess'), (1, 'Word-', 'UK', 'Word- UK'), (2, 'insol-', 'vency', 'insol-vency')) v(doc_id, left_part, right_part, joined)""")
def hyphen_vectors(spark, d):
    rows = spark.sql("SELECT * FROM VALUES (1, 'insol-', 'vency'), (1, 'decision-', 'specific'), (1, 're-', 'possess'), (1, 'Word-', 'UK'), (2, 'insol-', 'vency') AS v(doc_id, left_part, right_part)")
    words = spark.sql("SELECT doc_id, lower(w) AS w, true AS known FROM VALUES (1, 'Insolvency'), (1, 'repossess') AS v(doc_id, w)")
    return hyphen_joined(rows, words).select("doc_id", "left_part", "right_part", "joined")


@query("recents_upsert", """
WITH r AS (SELECT 'id' || i AS doc_id, 'old ' || i AS title, CAST(i AS DOUBLE) AS last_used FROM (SELECT unnest(range(0, 12)) AS i)), a AS (SELECT 'id3' AS doc_id, 'new' AS title, 100.0::DOUBLE AS last_used)
SELECT * FROM (SELECT * FROM r WHERE doc_id NOT IN (SELECT doc_id FROM a) UNION ALL SELECT * FROM a) ORDER BY last_used DESC LIMIT 10""")
def recents_upsert(spark, d):
    old = spark.range(12).select(F.concat(F.lit("id"), "id").alias("doc_id"), F.concat(F.lit("old "), "id").alias("title"), F.col("id").cast("double").alias("last_used"))
    return df.remembered(old, spark.sql("SELECT 'id3' AS doc_id, 'new' AS title, 100.0D AS last_used"))


PAREN = {
    "N1": ("1. (a) (b) (i) (ii) (c)", "D A A R R A"), "N2": ("1. (a) (b) (c) (d) (e) (f) (g) (h) (i) 2.", "D A A A A A A A A A D"), "N3": ("(g) (h) (i) (ii) (j)", "A A R R A"),
    "N4": ("(f) (g) (i) (h)", "A A R A"), "N5": ("(a) (i) (ii) (iii) (iv) (v) (b)", "A R R R R R A"), "N6": ("(a) (b) (c) (d)", "A A A A"),
    "N7": ("(a) (i) (b) (c) (d) (e) (f) (g) (h) (i) (ii)", "A R A A A A A A A A R"),
}


KIND = {"D": "decimal", "A": "alpha", "R": "roman"}


def paren_rows():
    for name, (tokens, _) in PAREN.items():
        for i, t in enumerate(tokens.split()):
            x = 0.0 if name != "N7" else 100.0 if i in (1, 10) else 72.0
            yield name, i, "paren" if t[0] == "(" else "decimal", t.strip("()."), x


@query("paren_markers", vectors(*[(n, i, KIND[k]) for n, (_, ks) in PAREN.items() for i, k in enumerate(ks.split())], names="doc_id, pos, kind"))
def paren_markers(spark, d):
    rows = spark.createDataFrame(list(paren_rows()), "doc_id string, pos int, scheme string, token string, x double")
    return nb.paren_kinds(rows, ["doc_id"], "pos").select("doc_id", "pos", "kind")


P, H, B = "paragraph", "heading", "bullet"


LISTS = {
    "L1": ([(P, "1. x"), (P, "a. x"), (P, "b. x"), (P, "2. x")], [(B, 0, "1.", False, False), (B, 1, "a.", False, False), (B, 1, "b.", False, False), (B, 0, "2.", False, False)]),
    "L2": ([(P, "(1) x"), (P, "plain")], [(P, 0, None, False, False)] * 2),
    "L3": ([(P, "(3) x"), (P, "(4) x")], [(P, 0, None, False, False)] * 2),
    "L4": ([(P, "1. x"), (P, "2. x"), (P, "1. x"), (P, "2. x")], [(B, 0, "1.", False, False), (B, 0, "2.", False, False), (B, 0, "1.", True, False), (B, 0, "2.", False, False)]),
    "L5": ([(P, "1. x"), (B, "own"), (P, "2. x")], [(B, 0, "1.", False, False), (B, 1, None, False, True), (B, 0, "2.", False, False)]),
    "L6": ([(P, "1. x"), (P, "(a) x"), (P, "plain"), (P, "2. x"), (H, "head"), (P, "3. x"), (P, "ii. stray"), (P, "4. x")],
           [(B, 0, "1.", False, False), (B, 1, "a.", False, False), (P, 2, None, False, True), (B, 0, "2.", False, False), (H, 0, None, False, True), (B, 0, "3.", False, False), (P, 1, None, False, True), (B, 0, "4.", False, False)]),
    "L7": ([(P, "1. x"), (P, "2. x"), (H, "head"), (P, "a. x"), (P, "b. x")], [(B, 0, "1.", False, False), (B, 0, "2.", False, False), (H, 0, None, False, False), (P, 0, None, False, False), (P, 0, None, False, False)]),
}


@query("converted_lists", vectors(*[(n, i, *r) for n, (_, out) in LISTS.items() for i, r in enumerate(out)], names="doc_id, pos, kind, level, label, list_start, in_list"))
def converted_lists(spark, d):
    rows = spark.createDataFrame([(n, i, k, t, 0) for n, (blocks, _) in LISTS.items() for i, (k, t) in enumerate(blocks)], "doc_id string, pos int, kind string, text string, level int")
    return fold_by_doc(rows, ["doc_id"], ["pos"], lambda r: nb.converted(r, gaps=r[0]["doc_id"] in ("L6", "L7")), "doc_id string, pos int, kind string, level int, label string, list_start boolean, in_list boolean")


WORD = [  # num_id, level, override
    ("n1", 0, None), ("n1", 1, None), ("n1", 1, None), ("n1", 0, None), ("n1", 1, None), ("n2", 0, None), ("n3", 0, 5), ("n3", 0, 5), ("n1", 2, None), ("n1", 0, None),
]


WORD_LABELS = ["1.", "1.a)", "1.b)", "2.", "2.a)", "3.", "5.", "6.", "(i)", "7."]


@query("word_labels", vectors(*[(i, x) for i, x in enumerate(WORD_LABELS)], names="pos, label"))
def word_labels(spark, d):
    rows = spark.createDataFrame(
        [(1, i, n, "abs", lv, o, ["decimal", "lowerLetter", "lowerRoman"], ["%1.", "%1.%2)", "(%3)"], [1, 1, 1]) for i, (n, lv, o) in enumerate(WORD)],
        "doc_id int, pos int, num_id string, abstract_id string, level int, override int, formats array<string>, templates array<string>, starts array<int>",
    )
    return nb.word_numbers(rows, ["doc_id"], "pos").select("pos", "label")


HANG = [(P, "a. x", 0), (P, "(i) y", 0), (B, "own", 0), (P, "text", 0), (P, "b. z", 0), (H, "head", 0), (P, "(ii) w", 1)]


HANG_OUT = [(P, 0, True), (P, 1, True), (B, 2, False), (P, 0, False), (P, 0, True), (H, 0, False), (P, 1, True)]


@query("hanging_items", vectors(*[(i, *r) for i, r in enumerate(HANG_OUT)], names="pos, kind, level, hanging"))
def hanging_items(spark, d):
    rows = spark.createDataFrame([(1, i, *r) for i, r in enumerate(HANG)], "doc_id int, pos int, kind string, text string, level int")
    return nb.hanging(rows, ["doc_id"], "pos").select("pos", "kind", "level", "hanging")


@query("joined_paragraphs", vectors((1, "An insol­vency case"), (2, "We re-possess it"), (3, "Word- UK rest"), (4, "one two"), names="doc_id, text"))
def joined_paragraphs(spark, d):
    rows = spark.createDataFrame([(1, 0, "An insol-"), (1, 1, "vency case"), (2, 0, "We re-"), (2, 1, "possess it"), (3, 0, "Word-"), (3, 1, "UK "), (3, 2, "rest"), (4, 0, "one"), (4, 1, " two ")], "doc_id int, pos int, line string")
    lines = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return lines.select("doc_id", nb.joined_lines(F.transform("lines", lambda x: x["line"])).alias("text"))


PIECES = [(1, 0, 10, 20), (1, 1, 12, 22), (1, 2, 21, 31), (1, 3, 30, 40), (1, 4, 11, 15), (2, 0, 0, 5), (2, 1, 2.5, 9)]


@query("visual_lines", vectors((1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 0), (2, 0, 0), (2, 1, 1), names="doc_id, pos, line"))
def visual_lines(spark, d):
    rows = spark.createDataFrame([(a, b, float(y), float(z)) for a, b, y, z in PIECES], "doc_id int, pos int, y0 double, y1 double")
    return ly.visual_lines(rows, ["doc_id"], "pos").select("doc_id", "pos", "line")


@query("distinct_rects", vectors((1, 0), (1, 2), (1, 3), names="doc_id, pos"))
def distinct_rects(spark, d):
    rows = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 9.0), (1, 1, 0.5, 0.0, 9.0, 8.5), (1, 2, 1.4, 0.0, 9.0, 9.0), (1, 3, 0.0, 5.0, 9.0, 9.0)], "doc_id int, pos int, x0 double, y0 double, x1 double, y1 double")
    return ly.distinct_boxes(rows, ["doc_id"], "pos").select("doc_id", "pos")


@query("grid_tables", vectors((0, 0, 0, 1, 2), (1, 1, 0, 1, 1), (2, 1, 1, 1, 1), (3, 0, 2, 2, 1), names="pos, row, col, rowspan, colspan"))
def grid_tables(spark, d):
    cells = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 20.0), (1, 1, 0.5, 20.0, 50.0, 41.0), (1, 2, 50.5, 20.5, 100.0, 40.0), (1, 3, 101.0, 0.0, 150.0, 40.5)], "doc_id int, pos int, x0 double, y0 double, x1 double, y1 double")
    return ly.grid_cells(cells, ["doc_id"]).select("pos", "row", "col", "rowspan", "colspan")


NUMBERED = [  # kind, level, numbered, list_start, in_list, hanging
    ("bullet", 0, "decimal", False, False, False), ("bullet", 1, "decimal", False, False, False), ("paragraph", 1, None, False, True, False), ("bullet", 0, "decimal", False, False, False),
    ("bullet", 0, "decimal", True, False, False), ("paragraph", 1, None, False, False, True), ("bullet", 0, None, False, False, False), ("bullet", 2, None, False, False, False),
]


@query("bullet_groups", vectors((1, 16, 18, "plain"), (2, 9, 11, "decimal"), (3, 1, 9, "decimal"), names="seq, start, \"end\", preset").replace("16, 18", "14, 20").replace("9, 11", "10, 12").replace("1, 9,", "1, 10,"))
def bullet_groups(spark, d):
    """Texts of one letter: places follow from letters, line ends and the tabs of levels."""
    rows = spark.createDataFrame([(1, i, k, "x", lv, "NORMAL_TEXT", n, s, li, h) for i, (k, lv, n, s, li, h) in enumerate(NUMBERED)],
                                 "doc_id int, pos int, kind string, text string, level int, style string, numbered string, list_start boolean, in_list boolean, hanging boolean")
    plan = ed.edit_plan(rows).where("op = 'createParagraphBullets'")
    return plan.select("seq", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("payload").alias("preset"))


@query("cell_edits", vectors((1, 2, 1, "updateTableCellStyle", "#00FF00"), (2, 0, 0, "mergeTableCells", "1x2"), (3, 0, 0, "updateTableCellStyle", "#FF0000"), names="seq, row, col, op, payload"))
def cell_edits(spark, d):
    cells = spark.createDataFrame([(1, 0, 0, 1, 2, "#FF0000"), (1, 1, 0, 1, 1, None), (1, 2, 1, 1, 1, "#00FF00")], "doc_id int, row int, col int, rowspan int, colspan int, background string")
    return ed.cell_edits(cells).select("seq", "row", "col", "op", "payload")


@query("inherited_styles", vectors((1, "base", True, None), (1, "mid", True, 2), (1, "leaf", False, 2), (1, "loop", None, 1), (2, "base", None, None), names="doc_id, style_id, bold, level"))
def inherited_styles(spark, d):
    rows = spark.createDataFrame([(1, "base", None, True, None), (1, "mid", "base", None, 2), (1, "leaf", "mid", False, None), (1, "loop", "loop", None, 1), (2, "base", None, None, None)], "doc_id int, style_id string, base_id string, bold boolean, level int")
    return df.inherited(rows, ["bold", "level"])


@query("list_definitions", vectors((1, "a", 0, "lowerRoman", 4), (1, "b", 0, "decimal", 1), (1, "c", 0, None, 1), names="doc_id, num_id, level, format, start"))
def list_definitions(spark, d):
    """num_id -> abstract list -> level, with overrides of the start."""
    used = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (1, "c", 0)], "doc_id int, num_id string, level int")
    nums = spark.createDataFrame([(1, "a", "A"), (1, "b", "B")], "doc_id int, num_id string, abstract_id string")
    levels = spark.createDataFrame([(1, "A", 0, "lowerRoman", 2), (1, "B", 0, "decimal", 1)], "doc_id int, abstract_id string, level int, format string, start int")
    overrides = spark.createDataFrame([(1, "a", 0, 4)], "doc_id int, num_id string, level int, override int")
    return df.list_levels(used, nums, levels, overrides)


@query("list_presets", vectors(("l1", "BULLET_DISC"), ("l2", "NUMBERED"), ("l3", "BULLET_DISC"), names="list_id, preset"))
def list_presets(spark, d):
    """A list's preset by its first glyph, a disc where that is unknown."""
    lists = spark.createDataFrame([("l1", "●"), ("l2", "%0."), ("l3", "?")], "list_id string, glyph string")
    return lists.select("list_id", df.list_preset(F.col("glyph")).alias("preset"))


@query("usable_widths", vectors((1, 468.0), (2, 100.0), (3, 468.0), names="doc_id, width").replace("SELECT *", "SELECT doc_id, CAST(width AS DOUBLE) AS width"))
def usable_widths(spark, d):
    """Page less margins, 100 at least, 468 where unknown."""
    pages = spark.createDataFrame([(1, 612.0, 72.0, 72.0), (2, 200.0, 72.0, 72.0), (3, None, None, None)], "doc_id int, page double, left_margin double, right_margin double")
    return pages.select("doc_id", df.usable_width(F.col("page"), F.col("left_margin"), F.col("right_margin")).alias("width"))


def para(start, text, style="NORMAL_TEXT", bullet=""):
    return '{"startIndex": %d, "endIndex": %d, "paragraph": {"elements": [{"textRun": {"content": "%s\\\\n"}}], "paragraphStyle": {"namedStyleType": "%s"}%s}}'.replace("\\\\", "\\") % (start, start + len(text) + 1, text, style, bullet)


BODY = [para(1, "Top", "TITLE"), para(5, "one"), para(9, "Sub", "HEADING_2"), para(13, "two", bullet=', "bullet": {"listId": "k1"}'), '{"startIndex": 17, "endIndex": 30, "table": {"rows": 2, "columns": 1}}', para(30, "")]


RAW = '{"body": {"content": [{"endIndex": 1, "sectionBreak": {}}, %s]}, "tabs": [{"tabProperties": {"tabId": "t.1", "title": "A"}, "childTabs": [{"tabProperties": {"tabId": "t.2", "title": "B"}, "childTabs": [{"tabProperties": {"tabId": "t.3", "title": "C"}}]}]}, {"tabProperties": {"tabId": "t.4", "title": "D"}}]}' % ", ".join(BODY)


def target(spark):
    return spark.createDataFrame([("d1", RAW)], "doc_id string, raw string")


@query("target_tabs", vectors(("t.1", "A", 1, 1), ("t.2", "B", 2, 2), ("t.3", "C", 3, 3), ("t.4", "D", 1, 4), names="tab_id, title, depth, place"))
def target_tabs(spark, d):
    return tg.tabs(target(spark)).select("tab_id", "title", "depth", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")).alias("place"))


@query("target_headings", vectors(("d1", 1, "Top", 1), ("d1", 9, "Sub", 2), names="doc_id, start_index, text, level").replace("SELECT *", "SELECT doc_id, CAST(start_index AS BIGINT) AS start_index, text, level"))
def target_headings(spark, d):
    return tg.headings(tg.body(target(spark))).select("doc_id", "start_index", "text", "level")


@query("target_ends", vectors(("d1", 30, True, True), names='doc_id, "end", blank, after_table').replace("SELECT *", 'SELECT doc_id, CAST("end" AS BIGINT) AS "end", blank, after_table'))
def target_ends(spark, d):
    return tg.end_state(tg.body(target(spark)))


@query("rematched_headings", vectors(("d1", 9, "Sub", 9), ("d1", 77, "Top", 1), ("d1", 5, "gone", None), names='doc_id, start_index, text, "now"').replace("SELECT *", 'SELECT doc_id, CAST(start_index AS BIGINT) AS start_index, text, CAST("now" AS BIGINT) AS "now"'))
def rematched_headings(spark, d):
    wanted = spark.createDataFrame([("d1", 9, "Sub"), ("d1", 77, "Top"), ("d1", 5, "gone")], "doc_id string, start_index bigint, text string")
    return tg.rematched(tg.headings(tg.body(target(spark))), wanted)


# doc, page, x0, x1, y0, text, bold, bullet, text_x; size 11, page 600 wide, text from 72 to 520.
LINES = [
    (1, 1, 72, 120, 100, "1. X", 1.0, None, 72), (1, 1, 72, 130, 130, "(a) Y", 1.0, None, 72), (1, 1, 72, 510, 160, "first point goes", 0.0, "•", 90), (1, 1, 90, 300, 173, "on here", 0.0, None, 90),
    (1, 1, 90, 300, 200, "below", 0.0, "•", 108),
    (2, 1, 250, 350, 80, "A title", 1.0, None, 250), (2, 1, 72, 515, 120, "Text of insol-", 0.0, None, 72), (2, 1, 72, 515, 133, "vency that goes on", 0.0, None, 72), (2, 1, 72, 200, 146, "and ends.", 0.0, None, 72),
    (2, 1, 72, 515, 159, "Another one that runs", 0.0, None, 72), (2, 2, 72, 300, 60, "over the page.", 0.0, None, 72), (2, 2, 72, 300, 73, "a. an item", 0.0, None, 72), (2, 2, 86, 300, 86, "wraps here", 0.0, None, 86),
    (2, 2, 72, 300, 112, "-----", 0.0, None, 72), (2, 2, 72, 300, 125, "b. the next", 0.0, None, 72),
    (3, 1, 72, 200, 60, "1. One", 1.0, None, 72), (3, 1, 72, 200, 90, "2. Two", 0.0, None, 72), (3, 1, 72, 200, 120, "3. Three", 1.0, None, 72), (3, 1, 72, 200, 150, "I. INTRODUCTION", 1.0, None, 72),
    (3, 1, 72, 200, 163, "AND MORE", 1.0, None, 72), (3, 1, 72, 200, 200, "A. Sources", 1.0, None, 72),
]


def page_lines(spark):
    rows = [(d, i, p, float(x0), float(x1), float(y), 11.0, txt, b, g, float(tx), False, False, 600.0) for i, (d, p, x0, x1, y, txt, b, g, tx) in enumerate(LINES)]
    return spark.createDataFrame(rows, "doc_id int, line int, page int, x0 double, x1 double, y0 double, size double, text string, bold double, bullet string, text_x double, in_box boolean, blank boolean, page_width double")


@query("document_blocks", vectors(
    (1, 0, "heading", "1. X", "1.", "decimal", 0, True), (1, 1, "heading", "(a) Y", "(a)", "alpha", 0, True), (1, 2, "bullet", "first point goes on here", None, None, 0, True), (1, 3, "bullet", "below", None, None, 1, True),
    (2, 0, "paragraph", "A title", None, None, 0, False), (2, 1, "paragraph", "Text of insolvency that goes on and ends.", None, None, 0, True), (2, 2, "paragraph", "Another one that runs over the page.", None, None, 0, True),
    (2, 3, "paragraph", "a. an item wraps here", None, None, 0, True), (2, 4, "paragraph", "b. the next", None, None, 0, True),
    (3, 0, "paragraph", "1. One", None, None, 0, True), (3, 1, "paragraph", "2. Two", None, None, 0, True), (3, 2, "paragraph", "3. Three", None, None, 0, True), (3, 3, "heading", "I. INTRODUCTION AND MORE", None, "decimal", 0, True), (3, 4, "heading", "A. Sources", None, "alpha", 0, True),
    names="doc_id, pos, kind, text, label, style, level, selected"))
def document_blocks(spark, d):
    return pg.document_blocks(page_lines(spark)).drop("page")


PROSE = "this quoted sentence is long enough to be prose and not a formula, so it joins"


SLIDES = {  # kind, text, level, x
    "B1": [("paragraph", "intro:", 0, 60), ("paragraph", PROSE, 0, 90), ("paragraph", "text", 0, 60)],
    "B2": [("paragraph", "intro", 0, 60), ("paragraph", "(a) one;", 0, 60), ("paragraph", "(b) two,", 0, 60), ("paragraph", "lower-case tail", 0, 60)],
    "B3": [("paragraph", "one", 0, 60), ("bullet", "own", 0, 60)],
    "B4": [("paragraph", "T1:", 0, 60), ("paragraph", "(a) x", 0, 60), ("paragraph", "(b) y", 0, 60), ("paragraph", "T2:", 0, 60), ("paragraph", "A sentence", 0, 60)],
    "B5": [("paragraph", "para", 0, 60), ("bullet", "own", 0, 60), ("paragraph", "para two", 0, 60), ("paragraph", "a. x", 0, 60), ("paragraph", "b. y", 0, 60), ("paragraph", "Last", 0, 60)],
    "B6": [("paragraph", "Start", 0, 60), ("paragraph", "1. x", 0, 60), ("paragraph", "Point", 0, 60), ("paragraph", "(a) y", 0, 60)],
}


POINTS = [
    ("B1", 0, "bullet", 0, f"intro: {PROSE}"), ("B1", 1, "bullet", 0, "text"), ("B2", 0, "paragraph", 0, "1. intro"), ("B2", 1, "paragraph", 0, "(a) one;"), ("B2", 2, "paragraph", 0, "(b) two, lower-case tail"),
    ("B3", 0, "paragraph", 0, "one"), ("B3", 1, "bullet", 0, "own"), ("B4", 0, "paragraph", 0, "1. T1:"), ("B4", 1, "paragraph", 0, "(a) x"), ("B4", 2, "paragraph", 0, "(b) y"), ("B4", 3, "paragraph", 0, "2. T2: A sentence"),
    ("B5", 0, "bullet", 0, "para"), ("B5", 1, "bullet", 1, "own"), ("B5", 2, "bullet", 0, "para two"), ("B5", 3, "paragraph", 1, "a. x"), ("B5", 4, "paragraph", 1, "b. y"), ("B5", 5, "bullet", 0, "Last"),
    ("B6", 0, "paragraph", 0, "Start"), ("B6", 1, "paragraph", 0, "1. x"), ("B6", 2, "paragraph", 0, "1. Point"), ("B6", 3, "paragraph", 0, "(a) y"),
]


@query("slide_points", vectors(*POINTS, names="slide, pos, kind, level, text"))
def slide_points(spark, d):
    rows = spark.createDataFrame([(n, i, k, x, lv, float(at), False, False) for n, r in SLIDES.items() for i, (k, x, lv, at) in enumerate(r)], "slide string, pos int, kind string, text string, level int, x double, bold boolean, starts_bold boolean")
    return pg.slide_points(rows, ["slide"], "pos", F.col("slide") == "B5")


@query("process_banners", vectors((0,), (1,), (2,), names="box"))
def process_banners(spark, d):
    boxes = [(1, 0, 0.0, 100.0, 20.0, 60.0, 0.0, 0.1), (1, 1, 105.0, 200.0, 22.0, 61.0, 0.95, 1.0), (1, 2, 190.0, 300.0, 20.0, 60.0, 0.9, 1.0), (1, 3, 310.0, 400.0, 20.0, 60.0, 0.1, 1.0), (1, 4, 0.0, 100.0, 100.0, 140.0, 1.0, 1.0)]
    rows = spark.createDataFrame(boxes, "doc_id int, box int, x0 double, x1 double, y0 double, y1 double, fill double, opacity double")
    return fold_by_doc(rows, ["doc_id"], ["box"], pg.banner_boxes, "box int")


@query("derived_texts", vectors(("cell", "abcd / one two"), ("row", "abcd | one two"), names="what, text"))
def derived_texts(spark, d):
    """A cell joins its blocks by strokes, a row its cells by bars."""
    rows = run_rows(spark).where(F.col("name").isin("joined", "blank_between")).select("name", rn.text_of(F.col("runs")).alias("text"))
    parts = rows.agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("name") == "joined", 0).otherwise(1).alias("o"), "text"))).alias("p")).select(F.transform("p", lambda x: x["text"]).alias("p"))
    return parts.select(F.explode(F.array(F.struct(F.lit("cell").alias("what"), df.cell_text(F.col("p")).alias("text")), F.struct(F.lit("row").alias("what"), df.row_text(F.col("p")).alias("text")))).alias("x")).select("x.*")


SEPARATORS = [(1, True, False, False, 10, 12, None, 0), (2, False, True, False, 10, 12, 12, 2), (3, False, False, True, 10, 12, 10, 1), (4, False, False, False, 10, 12, 10, 2)]


@query("separators", vectors(*[(r[0], r[6], r[7]) for r in SEPARATORS], names="doc_id, place, line_feeds"))
def separators(spark, d):
    """What stands between old and new text: nothing in an empty document; before the anchor after a table; a blank line is used again."""
    rows = spark.createDataFrame([r[:6] for r in SEPARATORS], "doc_id int, empty boolean, after_table boolean, blank boolean, line_end int, anchor int")
    place, feeds = df.separator(*[F.col(x) for x in ("empty", "after_table", "blank", "line_end", "anchor")])
    return rows.select("doc_id", place.alias("place"), feeds.alias("line_feeds"))


@query("span_lines", vectors((1, "a bc d", None), (2, "• x", "•"), (3, "- y", "-"), (4, "-z", None), names="line, text, bullet"))
def span_lines(spark, d):
    spans = spark.createDataFrame([(1, "a", 0.0, 5.0), (1, "b", 8.0, 12.0), (1, "c ", 12.5, 20.0), (1, "d", 30.0, 33.0), (2, "•", 0.0, 4.0), (2, "x", 9.0, 12.0), (3, "- y", 0.0, 9.0), (4, "-z", 0.0, 9.0)], "line int, text string, x0 double, x1 double")
    lines = spans.groupBy("line").agg(F.collect_list(F.struct("x0", "x1", "text")).alias("spans"))
    return lines.select("line", sl.line_text(F.col("spans"), F.lit(11.0)).alias("text")).withColumn("bullet", sl.leading_bullet(F.col("text")))


@query("column_gaps", vectors((1, 52.0, 60.0, 3), names="doc_id, x0, x1, support").replace("SELECT *", "SELECT doc_id, CAST(x0 AS DOUBLE) AS x0, CAST(x1 AS DOUBLE) AS x1, support"))
def column_gaps(spark, d):
    rows = spark.createDataFrame([(1, 0, 50.0, 60.0), (1, 1, 52.0, 66.0), (1, 2, 45.0, 61.0), (1, 0, 100.0, 110.0), (1, 1, 100.0, 104.0)], "doc_id int, row int, x0 double, x1 double")
    return sl.column_gaps(rows, rows.limit(0).select("doc_id", F.col("x0").alias("x")), ["doc_id"])


@query("diagram_texts", vectors((1, "A B C"), names='doc_id, text'))
def diagram_texts(spark, d):
    shapes = [(1, 0, "text", "B", 60.0, 3.0, 100.0, 20.0), (1, 1, "text", "A", 0.0, 0.0, 40.0, 20.0), (1, 2, "connector", "", 40.0, 10.0, 60.0, 11.0), (1, 3, "text", "C", 0.0, 21.0, 40.0, 40.0), (1, 4, "text", "far", 300.0, 0.0, 340.0, 20.0)]
    rows = spark.createDataFrame(shapes, "doc_id int, pos int, kind string, text string, x0 double, y0 double, x1 double, y1 double")
    grouped = fold_by_doc(rows, ["doc_id"], ["pos"], ly.touching, "doc_id int, pos int, kind string, text string, x0 double, y0 double, x1 double, y1 double, group int")
    return sl.diagrams(grouped, ["doc_id"]).select("doc_id", "text")


NUMBERS = [(0, "arabicPeriod", None, "1."), (1, "alphaLcParenR", None, "a)"), (1, "alphaLcParenR", None, "b)"), (0, "arabicPeriod", None, "2."), (1, "alphaLcParenR", None, "a)"), (0, None, None, None), (0, "arabicPeriod", 5, "5."), (0, "romanUcParenBoth", None, "(I)"), (0, "romanUcParenBoth", None, "(II)")]


@query("shape_numbers", vectors(*[(i, r[3]) for i, r in enumerate(NUMBERS)], names="pos, label"))
def shape_numbers(spark, d):
    rows = spark.createDataFrame([(1, i, *r[:3]) for i, r in enumerate(NUMBERS)], "doc_id int, pos int, level int, scheme string, start int")
    return sl.shape_numbers(rows, ["doc_id"], "pos").select("pos", "label")


TABLES = [  # pos, page, header, n_cols, n_rows, titled, widths
    (0, 1, "h", 2, 2, False, [1.0, 1.0]), (1, 1, "h", 2, 3, False, [1.0, 1.0]), (2, 2, "g", 2, 2, False, [1.1, 1.0]), (4, 2, "g", 2, 2, False, None), (5, 3, "x", 2, 1, False, [1.0, 3.0]), (6, 5, "y", 2, 1, False, [1.0, 3.0]), (7, 5, "t", 2, 4, True, None),
]


@query("split_deck_tables", vectors(("document", 0, 4, 2), ("document", 2, 2, 1), ("document", 4, 2, 1), ("document", 5, 1, 1), ("document", 6, 1, 1), ("document", 7, 4, 1),
                                    ("slides", 0, 6, 3), ("slides", 4, 3, 2), ("slides", 6, 1, 1), ("slides", 7, 4, 1), names="layout, pos, n_rows, parts"))
def split_deck_tables(spark, d):
    rows = spark.createDataFrame([(lay, *r) for lay in ("document", "slides") for r in TABLES], "layout string, pos int, page int, header string, n_cols int, n_rows int, titled boolean, widths array<double>")
    return dr.merged_tables(rows, ["layout"], F.col("layout") == "slides").select("layout", F.col("first").alias("pos"), "n_rows", "parts")


@query("cell_blocks", vectors((0, "paragraph", 0, "One line and its wrap"), (1, "bullet", 0, "point"), (2, "paragraph", 0, "Far below"), names="pos, kind, level, text"))
def cell_blocks(spark, d):
    lines = [(0, 10.0, "One line", None), (1, 23.0, "and its wrap", None), (2, 40.0, "point", "•"), (3, 90.0, "Far below", None)]
    rows = spark.createDataFrame([(1, i, 1, 72.0, 200.0, y, 11.0, x, 0.0, b, 72.0, False, False, 600.0) for i, y, x, b in lines], "doc_id int, line int, page int, x0 double, x1 double, y0 double, size double, text string, bold double, bullet string, text_x double, in_box boolean, blank boolean, page_width double")
    return pg.flow_blocks(rows).drop("doc_id")


@query("box_tables", vectors((0, 0, 0, 0), (1, 0, 0, 1), (2, 0, 1, 0), (3, 0, 1, 1), names='box, "table", row, col'))
def box_tables(spark, d):
    boxes = [(0, 0.0, 0.0, 50.0, 20.0), (1, 51.0, 0.0, 100.0, 20.0), (2, 0.0, 21.0, 50.0, 40.0), (3, 51.0, 21.0, 100.0, 40.0), (4, 0.0, 100.0, 50.0, 120.0), (5, 51.0, 100.0, 100.0, 120.0), (6, 300.0, 0.0, 310.0, 90.0)]
    rows = spark.createDataFrame([(1, *b) for b in boxes], "doc_id int, box int, x0 double, y0 double, x1 double, y1 double")
    return fold_by_doc(rows, ["doc_id"], ["box"], dr.box_tables, "box int, table int, row int, col int")


@query("ruled_bands", vectors((1, None), (3, 0), (4, 0), (7, 1), (9, None), names="item, band"))
def ruled_bands(spark, d):
    items = [(1, "line", 0.0, 90.0), (2, "rule", 0.0, 400.0), (3, "line", 0.0, 90.0), (4, "line", 0.0, 90.0), (5, "rule", 0.0, 50.0), (6, "rule", 10.0, 400.0), (7, "line", 0.0, 90.0), (8, "rule", 0.0, 400.0), (9, "line", 0.0, 90.0)]
    rows = spark.createDataFrame([(1, i, k, a, b, float(i * 10), 600.0) for i, k, a, b in items], "doc_id int, item int, kind string, x0 double, x1 double, y0 double, page_width double")
    return dr.ruled_bands(rows, ["doc_id"], "item").select("item", "band")
