"""Queries that derive runs, markers, lists, boxes, styles and target documents from the tables, for operators whose own kind of data they lack."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import colour as co
from lectern.functions import links as ln
from lectern.functions import markers as m
from lectern.functions import runs as rn
from lectern.functions import symbols as sy
from lectern.operators import definitions as df
from lectern.operators import drawn as dr
from lectern.operators import edits as ed
from lectern.operators import layout as ly
from lectern.operators import numbering as nb
from lectern.operators import paragraphs as pg
from lectern.operators import slides as sl
from lectern.operators.fold import fold_by_doc
from lectern.plans.layout_queries import BOXES_SQL, boxes
from lectern.plans.scalar_queries import HEADING_MAP, NAMED_STYLES, settings
from lectern.sources import corpus as c
from lectern.sources import documents
from lectern.sources import target as tg
from lectern.sources.files import format_of

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def values(rows, names: str) -> str:
    """A table of fixed values for SQL."""
    def lit(x):
        return "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names}))"


# Runs: the words of a line, each with the style that its letters give it.

RUNS_SQL = f"""
{c.TURNS_SQL}, ws AS (SELECT doc_id, page, CAST(pos AS INTEGER) AS pos, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n
  FROM (SELECT *, regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r\\x{{A0}}]+') AS w FROM turn_lines)),
wr AS (SELECT *, regexp_matches(word, '^[A-Z]') AS b, regexp_matches(word, '[0-9]') AS i_, length(word) = 4 AS u, regexp_matches(word, 's$') AS r FROM ws),
wg AS (SELECT *, sum(CASE WHEN lag_b IS NULL OR lag_b <> b OR lag_i <> i_ OR lag_u <> u OR lag_r <> r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, pos ORDER BY i ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, lag(b) OVER w AS lag_b, lag(i_) OVER w AS lag_i, lag(u) OVER w AS lag_u, lag(r) OVER w AS lag_r FROM wr WINDOW w AS (PARTITION BY doc_id, page, pos ORDER BY i))),
ir AS (SELECT doc_id, page, pos, g, any_value(b) AS b, any_value(i_) AS i_, any_value(u) AS u, any_value(r) AS r, string_agg(word, ' ' ORDER BY i) AS core, max(i) = max(n) AS at_end FROM wg GROUP BY doc_id, page, pos, g)"""


def marked_sql(bold: str = "b", italic: str = "i_") -> str:
    inner = f"CASE WHEN u THEN '__' || core || '__' ELSE core END"
    inner = f"CASE WHEN {italic} THEN '*' || {inner} || '*' ELSE {inner} END"
    inner = f"CASE WHEN {bold} THEN '**' || {inner} || '**' ELSE {inner} END"
    return f"CASE WHEN r THEN '{{#FF0000|' || {inner} || '}}' ELSE {inner} END"


def run_lines(spark, d, blanks: str = " "):
    """Turn lines as runs: a word each, with blanks after all but the last."""
    words = F.regexp_extract_all("line", F.lit(r"[^ \t\n\x0B\f\r ]+"), F.lit(0))

    def run(word, i):
        text = F.when(i < F.size("w") - 1, F.concat(word, F.lit(blanks))).otherwise(word)
        no = F.lit(False)
        return F.struct(
            text.alias("text"), word.rlike("^[A-Z]").alias("bold"), word.rlike("[0-9]").alias("italic"), (F.length(word) == 4).alias("underline"), no.alias("superscript"), no.alias("subscript"),
            F.when(word.rlike("s$"), "#FF0000").alias("color"), F.lit(None).cast("string").alias("highlight"),
        )

    lines = c.turn_lines(spark, d).select("doc_id", "page", "pos", words.alias("w")).where(F.size("w") > 0)
    return lines.select("doc_id", "page", "pos", F.transform("w", run).alias("runs"))


@query("runs_rendered", f"WITH {RUNS_SQL} SELECT doc_id, page, pos, string_agg({marked_sql()} || CASE WHEN at_end THEN '' ELSE ' ' END, '' ORDER BY g) AS text FROM ir GROUP BY doc_id, page, pos")
def runs_rendered(spark, d):
    return run_lines(spark, d).select("doc_id", "page", "pos", rn.rendered(rn.merged(F.col("runs"))).alias("text"))


@query("runs_normalised", f"WITH {RUNS_SQL} SELECT doc_id, page, pos, string_agg({marked_sql()} || CASE WHEN at_end THEN '' ELSE ' ' END, '' ORDER BY g) AS text, CAST(count(*) AS INTEGER) AS n FROM ir GROUP BY doc_id, page, pos")
def runs_normalised(spark, d):
    """Words with two blanks and a tab between them come out with one."""
    out = run_lines(spark, d, " \t ").select("doc_id", "page", "pos", rn.normalised(F.col("runs")).alias("runs"))
    return out.select("doc_id", "page", "pos", rn.rendered(F.col("runs")).alias("text"), F.size("runs").alias("n"))


@query("runs_without_uniform_style", f"""
WITH {RUNS_SQL}, a AS (SELECT *, bool_and(b) OVER (PARTITION BY doc_id, page, pos) AS ab, bool_and(i_) OVER (PARTITION BY doc_id, page, pos) AS ai FROM wr),
s AS (SELECT *, b AND NOT ab AS b2, i_ AND NOT ai AS i2 FROM a),
g AS (SELECT *, sum(CASE WHEN lb IS NULL OR lb <> b2 OR li <> i2 OR lu <> u OR lr <> r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, pos ORDER BY i ROWS UNBOUNDED PRECEDING) AS k
  FROM (SELECT *, lag(b2) OVER w AS lb, lag(i2) OVER w AS li, lag(u) OVER w AS lu, lag(r) OVER w AS lr FROM s WINDOW w AS (PARTITION BY doc_id, page, pos ORDER BY i))),
j AS (SELECT doc_id, page, pos, k, any_value(b2) AS b2, any_value(i2) AS i2, any_value(u) AS u, any_value(r) AS r, string_agg(word, ' ' ORDER BY i) AS core, max(i) = max(n) AS at_end FROM g GROUP BY doc_id, page, pos, k)
SELECT doc_id, page, pos, string_agg({marked_sql('b2', 'i2')} || CASE WHEN at_end THEN '' ELSE ' ' END, '' ORDER BY k) AS text FROM j GROUP BY doc_id, page, pos""")
def runs_without_uniform_style(spark, d):
    return run_lines(spark, d).select("doc_id", "page", "pos", rn.rendered(rn.without_uniform(F.col("runs"), "bold", "italic")).alias("text"))


@query("runs_without_marker", f"""
WITH {RUNS_SQL}, l AS (SELECT doc_id, page, pos, string_agg(word, ' ' ORDER BY i) AS text FROM wr GROUP BY doc_id, page, pos)
SELECT doc_id, page, pos, ltrim(substr(text, 4)) AS rest FROM l""")
def runs_without_marker(spark, d):
    return run_lines(spark, d).select("doc_id", "page", "pos", rn.text_of(rn.without_marker(F.col("runs"), F.lit(3))).alias("rest"))


@query("runs_split_lines", """
WITH l AS (SELECT conv_id AS doc_id, turn AS page, string_split(text, chr(10)) AS ls FROM conversations),
o AS (SELECT doc_id, page, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS i, unnest(list_transform(range(1, len(ls) + 1), lambda i: length(array_to_string(ls[1:i - 1], chr(10))) + CASE WHEN i > 1 THEN 1 ELSE 0 END)) AS start FROM l),
k AS (SELECT *, (start + length(text) - 1) // 40 - start // 40 + 1 AS runs FROM o WHERE NOT regexp_matches(text, '^[ \\t]*$'))
SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY i) - 1 AS INTEGER) AS line, text, CAST(runs AS INTEGER) AS runs FROM k""")
def runs_split_lines(spark, d):
    """Each turn as runs of forty characters, which end within lines."""
    no, none = F.lit(False), F.lit(None).cast("string")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 40).cast("int")), lambda i: F.struct(
        F.col("text").substr(i * 40 + 1, F.lit(40)).alias("text"), (i % 2 == 0).alias("bold"), no.alias("italic"), no.alias("underline"), no.alias("superscript"), no.alias("subscript"), none.alias("color"), none.alias("highlight")))
    turns = c.read(spark, d, "conversations").where(F.length("text") > 0).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), pieces.alias("runs"))
    lines = turns.select("doc_id", "page", F.posexplode(rn.split_lines(F.col("runs"))).alias("line", "r"))
    return lines.select("doc_id", "page", "line", rn.text_of(F.col("r")).alias("text"), F.size("r").alias("runs"))


@query("run_flags", f"""
WITH {RUNS_SQL}, l AS (SELECT doc_id, page, pos, string_agg(word, ' ' ORDER BY i) AS text, bool_and(b) AS b, CAST(sum(CASE WHEN b THEN length(word) ELSE 0 END) AS DOUBLE) / sum(length(word)) AS ratio,
  bool_or(b) AS ob, bool_or(i_) AS oi, bool_or(u) AS ou, bool_or(r) AS orr FROM wr GROUP BY doc_id, page, pos)
SELECT doc_id, page, pos, b AND length(text) <= 120 AND NOT ends_with(text, '.') AS all_bold, ratio, concat_ws(',', CASE WHEN ob THEN 'bold' END, CASE WHEN orr THEN 'foregroundColor' END, CASE WHEN oi THEN 'italic' END, CASE WHEN ou THEN 'underline' END) AS fields FROM l""")
def run_flags(spark, d):
    fields = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: rn.style_fields(r))))), ",")
    return run_lines(spark, d).select("doc_id", "page", "pos", rn.all_bold(F.col("runs")).alias("all_bold"), rn.bold_ratio(F.col("runs")).alias("ratio"), fields.alias("fields"))


@query("derived_texts", f"WITH {c.TURNS_SQL}, r AS (SELECT doc_id, page, string_agg(line, ' / ' ORDER BY pos) AS cell FROM turn_lines GROUP BY doc_id, page) SELECT doc_id, string_agg(cell, ' | ' ORDER BY page) AS text FROM r GROUP BY doc_id")
def derived_texts(spark, d):
    """A turn's lines as the blocks of a cell, a conversation's turns as the cells of a row."""
    cells = c.turn_lines(spark, d).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("b"))
    cells = cells.select("doc_id", "page", df.cell_text(F.transform("b", lambda x: x["line"])).alias("cell"))
    rows = cells.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "cell"))).alias("r"))
    return rows.select("doc_id", df.row_text(F.transform("r", lambda x: x["cell"])).alias("text"))


# Numerals, letters and labels of part numbers.


@query("roman_values", """
WITH n AS (SELECT p_partkey, p_partkey % 3999 + 1 AS n FROM part)
SELECT p_partkey, repeat('m', n // 1000) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1]
  || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] AS numeral, CAST(n AS INTEGER) AS value, true AS sound, n IN (2, 20, 200) AS reversed FROM n""")
def roman_values(spark, d):
    """Numbers as numerals and back; a numeral read from its end is seldom one."""
    rows = c.read(spark, d, "part").select("p_partkey", m.roman(F.col("p_partkey") % 3999 + 1).alias("numeral"))
    odd = F.concat("numeral", F.lit("iiii"))
    return rows.select("p_partkey", "numeral", m.roman_value(F.col("numeral")).alias("value"), m.is_roman(F.col("numeral")).alias("sound"), (m.is_roman(odd) | F.col("numeral").isin("ii", "xx", "cc")).alias("reversed"))


@query("next_letters", """
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN repeat(chr(CAST(97 + p_partkey % 26 AS INTEGER)), CAST(p_size % 3 + 1 AS INTEGER)) WHEN p_partkey % 3 = 1 THEN chr(CAST(97 + p_partkey % 26 AS INTEGER)) || chr(CAST(97 + p_size % 25 AS INTEGER)) ELSE '' END AS token FROM part)
SELECT p_partkey, token, CASE WHEN token = '' THEN 'a' WHEN replace(token, token[1], '') = '' THEN CASE WHEN token[1] = 'z' THEN repeat('a', length(token) + 1) ELSE repeat(chr(ascii(token) + 1), length(token)) END
  ELSE token[1:-2] || chr(ascii(token[-1]) + 1) END AS follows FROM t""")
def next_letters(spark, d):
    k = F.col("p_partkey")
    token = F.when(k % 3 == 0, F.repeat(F.char(97 + k % 26), (F.col("p_size") % 3 + 1).cast("int"))).when(k % 3 == 1, F.concat(F.char(97 + k % 26), F.char(97 + F.col("p_size") % 25))).otherwise("")
    rows = c.read(spark, d, "part").select("p_partkey", token.alias("token"))
    return rows.select("p_partkey", "token", m.next_letter(F.col("token")).alias("follows"))


@query("letter_labels", """
WITH n AS (SELECT p_partkey, p_partkey + 1 AS n, ['decimal', 'decimalZero', 'lowerLetter', 'upperLetter', 'lowerRoman', 'none'][p_partkey % 6 + 1] AS format FROM part),
l AS (SELECT *, CASE WHEN n <= 26 THEN chr(CAST(96 + n AS INTEGER)) WHEN n <= 702 THEN chr(CAST(97 + (n - 27) // 26 AS INTEGER)) || chr(CAST(97 + (n - 27) % 26 AS INTEGER))
  WHEN n <= 18278 THEN chr(CAST(97 + (n - 703) // 676 AS INTEGER)) || chr(CAST(97 + (n - 703) // 26 % 26 AS INTEGER)) || chr(CAST(97 + (n - 703) % 26 AS INTEGER))
  ELSE chr(CAST(97 + (n - 18279) // 17576 AS INTEGER)) || chr(CAST(97 + (n - 18279) // 676 % 26 AS INTEGER)) || chr(CAST(97 + (n - 18279) // 26 % 26 AS INTEGER)) || chr(CAST(97 + (n - 18279) % 26 AS INTEGER)) END AS letters,
  repeat('m', n % 3999 // 1000) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n % 3999 // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n % 3999 // 10 % 10 + 1]
  || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 3999 % 10 + 1] AS numeral FROM n)
SELECT p_partkey, format, letters, chr(CAST((n - 1) % 26 + 97 AS INTEGER)) AS wrapped,
  CASE format WHEN 'decimal' THEN CAST(n AS VARCHAR) WHEN 'decimalZero' THEN CASE WHEN n < 10 THEN '0' ELSE '' END || n WHEN 'lowerLetter' THEN letters WHEN 'upperLetter' THEN upper(letters) WHEN 'none' THEN '' ELSE numeral END AS label FROM l""")
def letter_labels(spark, d):
    n = F.col("p_partkey") + 1
    formats = F.array(*[F.lit(x) for x in ("decimal", "decimalZero", "lowerLetter", "upperLetter", "lowerRoman", "none")])
    rows = c.read(spark, d, "part").select("p_partkey", F.get(formats, (F.col("p_partkey") % 6).cast("int")).alias("format"))
    label = F.when(F.col("format") == "lowerRoman", m.roman(n % 3999)).otherwise(m.number_label(F.col("format"), n))
    return rows.select("p_partkey", "format", m.base26(n).alias("letters"), m.wrapped_letter(n).alias("wrapped"), label.alias("label"))


# Symbols, colours, sizes, settings, files.


@query("symbol_texts", f"""
WITH s AS {values(sy.SYMBOL.items(), 'code, x')}, w AS {values(sy.DINGBATS.items(), 'code, x')},
p AS (SELECT p_partkey, p_partkey % 256 AS low, 97 + p_partkey % 26 AS plain, ['Symbol', 'Wingdings', 'Arial', 'Wingdings 2'][p_partkey % 4 + 1] AS font, CASE WHEN p_partkey % 8 = 2 THEN 'Symbol' END AS other FROM part),
f AS (SELECT *, CASE WHEN font <> 'Arial' OR other IS NULL THEN font ELSE other END AS name FROM p)
SELECT p_partkey, CASE WHEN name LIKE 'Wing%' THEN coalesce(a.x, '') WHEN name = 'Symbol' THEN coalesce(b.x, '') ELSE coalesce(b.x, a.x, '') END || CASE WHEN font = 'Arial' THEN chr(CAST(plain AS INTEGER)) WHEN font = 'Symbol' THEN coalesce(y.x, chr(CAST(plain AS INTEGER))) ELSE coalesce(z.x, chr(CAST(plain AS INTEGER))) END || ' 7' AS shown
FROM f LEFT JOIN w a ON a.code = low LEFT JOIN s b ON b.code = low LEFT JOIN s y ON y.code = plain LEFT JOIN w z ON z.code = plain""")
def symbol_texts(spark, d):
    """A private-use character and a letter in picture fonts and others; a blank and a digit stay."""
    k = F.col("p_partkey")
    private = F.decode(F.unhex(F.hex(61440 + k % 256)), "UTF-16BE")
    font = F.get(F.array(*[F.lit(x) for x in ("Symbol", "Wingdings", "Arial", "Wingdings 2")]), (k % 4).cast("int"))
    rows = c.read(spark, d, "part").select("p_partkey", F.concat(private, F.char(97 + k % 26), F.lit(" 7")).alias("text"), font.alias("font"), F.when(k % 8 == 2, "Symbol").alias("other"))
    return rows.select("p_partkey", sy.shown(F.col("text"), F.col("font"), F.col("other")).alias("shown"))


SCHEMES = [*co.THEME, *co.ALIASES]


@query("theme_colours", f"""
WITH t AS {values([(i, co.THEME[co.ALIASES.get(s, s)]) for i, s in enumerate(SCHEMES)], 'i, code')},
p AS (SELECT p_partkey, code, p_partkey % 4 AS how, (p_size % 10 + 1) / 10.7::DOUBLE AS a, CAST('0x' || code[2:3] AS INTEGER) / 255.0::DOUBLE AS r, CAST('0x' || code[4:5] AS INTEGER) / 255.0::DOUBLE AS g, CAST('0x' || code[6:7] AS INTEGER) / 255.0::DOUBLE AS b
  FROM part JOIN t ON i = p_partkey % {len(SCHEMES)}),
h AS (SELECT *, (greatest(r, g, b) + least(r, g, b)) / 2 AS l, greatest(r, g, b) - least(r, g, b) AS c FROM p),
l AS (SELECT *, CASE WHEN how = 2 THEN l * a ELSE least(1, l * a + (1 - a)) END AS l2, CASE WHEN c = 0 THEN 0 WHEN l <= 0.5 THEN c / (2 * l) ELSE c / (2 - 2 * l) END AS s FROM h),
k AS (SELECT *, CASE WHEN c = 0 THEN 0 ELSE s * CASE WHEN l2 <= 0.5 THEN 2 * l2 ELSE 2 - 2 * l2 END END AS c2 FROM l),
x AS (SELECT *, list_transform([r, g, b], lambda v: CASE how WHEN 0 THEN v + (1 - v) * (1 - a) WHEN 1 THEN v * a ELSE l2 + CASE WHEN c = 0 THEN 0 ELSE (v - l) / c * c2 END END) AS v FROM k)
SELECT p_partkey, printf('#%02X%02X%02X', CAST(round_even(v[1] * 255, 0) AS INTEGER), CAST(round_even(v[2] * 255, 0) AS INTEGER), CAST(round_even(v[3] * 255, 0) AS INTEGER)) AS code FROM x""")
def theme_colours(spark, d):
    """Theme colours tinted, shaded, darkened, and darkened and lifted. The SQL scales each channel's distance from the lightness instead of turning hues."""
    k = F.col("p_partkey")
    a = (F.col("p_size") % 10 + 1) / F.lit(10.7)
    rows = c.read(spark, d, "part").select("p_partkey", F.get(F.array(*[F.lit(x) for x in SCHEMES]), (k % len(SCHEMES)).cast("int")).alias("scheme"), (k % 4).alias("how"), a.alias("a"))
    how, a = F.col("how"), F.col("a")
    steps = [("lumMod", F.when(how >= 2, a)), ("lumOff", F.when(how == 3, 1 - a)), ("tint", F.when(how == 0, a)), ("shade", F.when(how == 1, a))]
    return rows.select("p_partkey", co.adjusted(co.theme_base(F.col("scheme")), steps).alias("code"))


@query("highlights", f"""
WITH h AS {values(co.HIGHLIGHTS.items(), 'name, code')}, n AS {values(list(enumerate([*co.HIGHLIGHTS, 'mauve', 'none'])), 'i, name')},
p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN n.name END AS name, ['auto', 'FFFFFF', 'd9d9' || CAST(10 + p_size AS VARCHAR), ''][p_partkey % 4 + 1] AS fill FROM part JOIN n ON i = p_partkey // 3 % {len(co.HIGHLIGHTS) + 2})
SELECT p_partkey, CASE WHEN p.name IS NOT NULL AND p.name <> 'none' THEN h.code WHEN lower(fill) NOT IN ('auto', 'ffffff', '') THEN '#' || upper(fill) END AS code FROM p LEFT JOIN h ON h.name = p.name""")
def highlights(spark, d):
    k = F.col("p_partkey")
    names = F.array(*[F.lit(x) for x in [*co.HIGHLIGHTS, "mauve", "none"]])
    fills = F.array(F.lit("auto"), F.lit("FFFFFF"), F.concat(F.lit("d9d9"), (F.col("p_size") + 10).cast("string")), F.lit(""))
    rows = c.read(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, F.get(names, (F.floor(k / 3) % (len(co.HIGHLIGHTS) + 2)).cast("int"))).alias("name"), F.get(fills, (k % 4).cast("int")).alias("fill"))
    return rows.select("p_partkey", co.highlight(F.col("name"), F.col("fill")).alias("code"))


@query("box_sizes", """
SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) + 0.5::DOUBLE ELSE 120 END AS width, CASE WHEN p_partkey % 4 = 0 THEN 30 WHEN p_partkey % 4 = 1 THEN 7 ELSE CAST(p_partkey % 100 AS DOUBLE) END AS height FROM part""")
def box_sizes(spark, d):
    """Styles with a width, a height, both or two heights."""
    k = F.col("p_partkey")
    width = F.when(k % 3 != 0, F.concat(F.lit("width:"), F.col("p_size").cast("string"), F.lit(".5pt")))
    height = F.when(k % 4 != 0, F.concat(F.lit("height:"), (k % 100).cast("string"), F.lit("pt")))
    rows = c.read(spark, d, "part").select("p_partkey", F.concat_ws(";", width, height, F.when(k % 4 == 1, "height:7pt")).alias("style"))
    return rows.select("p_partkey", ln.box_size(F.col("style")).alias("b")).select("p_partkey", "b.width", "b.height")


@query("settings_maps", f"""
WITH u AS {values(HEADING_MAP.items(), 'style_key, usual')}, k AS (SELECT c_custkey, style_key, usual, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN style_key = 'alpha' THEN 'HEADING_' || c_custkey % 8 WHEN style_key = 'decimal' AND c_custkey % 2 = 0 THEN 'NORMAL_TEXT' WHEN style_key = 'title' THEN 'BANNER' END AS own FROM customer, u),
f AS (SELECT c_custkey, style_key, CASE WHEN own IN ({', '.join(f"'{x}'" for x in NAMED_STYLES)}) THEN own ELSE usual END AS named FROM k)
SELECT c_custkey, style_key, named, CASE WHEN regexp_matches(named, '^HEADING_[1-6]$') THEN CAST(right(named, 1) AS INTEGER) ELSE 0 END AS rank FROM f""")
def settings_maps(spark, d):
    """Each customer's own settings: some not JSON, some with styles or keys that don't exist."""
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, "not json").otherwise(F.to_json(F.struct(F.map_filter(F.create_map(
        F.lit("alpha"), F.concat(F.lit("HEADING_"), (k % 8).cast("string")), F.lit("decimal"), F.when(k % 2 == 0, "NORMAL_TEXT"), F.lit("title"), F.lit("BANNER"), F.lit("other"), F.lit("HEADING_1")), lambda _, v: v.isNotNull()).alias("heading_map"))))
    rows = c.read(spark, d, "customer").select("c_custkey", F.explode(settings(raw)).alias("style_key", "named"))
    return rows.select("c_custkey", "style_key", "named", F.coalesce(F.expr("try_cast(nullif(regexp_extract(named, 'HEADING_([1-6])', 1), '') AS int)"), F.lit(0)).alias("rank"))


@query("rejected_files", """
WITH f AS (SELECT page_id, ['pdf', 'DOCX', 'pptx', 'doc', 'PPT', 'txt', ''][page_id % 7 + 1] AS s FROM pages)
SELECT 'folder.v1/file' || page_id || CASE WHEN s <> '' THEN '.' || s ELSE '' END AS path, CASE WHEN lower(s) IN ('docx', 'pptx') THEN lower(s) END AS format,
  CASE WHEN lower(s) IN ('docx', 'pptx') THEN NULL WHEN lower(s) IN ('doc', 'ppt') THEN 'old format' WHEN lower(s) = 'pdf' THEN 'no reader' ELSE 'unknown format' END AS error FROM f""")
def rejected_files(spark, d):
    suffix = F.get(F.array(*[F.lit(x) for x in (".pdf", ".DOCX", ".pptx", ".doc", ".PPT", ".txt", "")]), (F.col("page_id") % 7).cast("int"))
    return format_of(c.read(spark, d, "pages").select(F.concat(F.lit("folder.v1/file"), F.col("page_id").cast("string"), suffix).alias("path")), "path")


# Styles, lists and page widths.


@query("inherited_styles", """
WITH RECURSIVE s AS (SELECT c_nationkey AS doc_id, c_custkey AS id, lag(c_custkey, CAST(c_custkey % 3 + 1 AS INTEGER)) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS base, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 2 = 0 END AS bold, CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey % 9 AS INTEGER) END AS level FROM customer),
b AS (SELECT doc_id, id, id AS at, base, bold, level, 0 AS hops FROM s UNION ALL SELECT b.doc_id, b.id, s.id, s.base, s.bold, s.level, hops + 1 FROM b JOIN s ON s.doc_id = b.doc_id AND s.id = b.base WHERE hops < 31)
SELECT doc_id, CAST(id AS VARCHAR) AS style_id, arg_min(bold, hops) FILTER (WHERE bold IS NOT NULL) AS bold, arg_min(level, hops) FILTER (WHERE level IS NOT NULL) AS level FROM b GROUP BY doc_id, id""")
def inherited_styles(spark, d):
    """Customers of a nation as styles, each based on one of the three before it."""
    k, w = F.col("c_custkey"), Window.partitionBy("c_nationkey").orderBy("c_custkey")
    base = F.when(k % 3 == 0, F.lag(k, 1).over(w)).when(k % 3 == 1, F.lag(k, 2).over(w)).otherwise(F.lag(k, 3).over(w))
    styles = c.read(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), k.cast("string").alias("style_id"), base.cast("string").alias("base_id"), F.when(k % 5 == 0, k % 2 == 0).alias("bold"), F.when(k % 7 == 0, (k % 9).cast("int")).alias("level"))
    return df.inherited(styles, ["bold", "level"])


@query("list_definitions", """
WITH u AS (SELECT DISTINCT o_custkey % 50 AS doc_id, 'n' || o_orderkey % 9 AS num_id, CAST(o_orderkey % 3 AS INTEGER) AS level, o_orderkey % 9 AS k FROM orders)
SELECT doc_id, num_id, level, CASE WHEN k < 6 THEN ['decimal', 'lowerLetter', 'lowerRoman'][(k // 2 + level) % 3 + 1] END AS format, CAST(CASE WHEN k = 1 AND level = 0 THEN 7 WHEN k < 6 THEN k // 2 + 1 ELSE 1 END AS INTEGER) AS start FROM u""")
def list_definitions(spark, d):
    """Six of nine lists are defined, two by two alike; one starts elsewhere."""
    used = c.read(spark, d, "orders").select((F.col("o_custkey") % 50).alias("doc_id"), F.concat(F.lit("n"), (F.col("o_orderkey") % 9).cast("string")).alias("num_id"), (F.col("o_orderkey") % 3).cast("int").alias("level")).distinct()
    docs = used.select("doc_id").distinct()
    k, lv = F.explode(F.sequence(F.lit(0), F.lit(5))), F.explode(F.sequence(F.lit(0), F.lit(2)))
    nums = docs.select("doc_id", k.alias("k")).select("doc_id", F.concat(F.lit("n"), F.col("k").cast("string")).alias("num_id"), F.floor(F.col("k") / 2).cast("string").alias("abstract_id"))
    formats = F.array(*[F.lit(x) for x in ("decimal", "lowerLetter", "lowerRoman")])
    levels = nums.select("doc_id", "abstract_id").distinct().select("doc_id", "abstract_id", lv.alias("level"))
    levels = levels.select("*", F.get(formats, ((F.col("abstract_id").cast("int") + F.col("level")) % 3)).alias("format"), (F.col("abstract_id").cast("int") + 1).alias("start"))
    overrides = docs.select("doc_id", F.lit("n1").alias("num_id"), F.lit(0).alias("level"), F.lit(7).alias("override"))
    return df.list_levels(used, nums, levels, overrides)


@query("list_presets", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'BULLET_DISC' WHEN 1 THEN 'BULLET_DIAMOND' WHEN 2 THEN 'NUMBERED' ELSE 'BULLET_DISC' END AS preset FROM part""")
def list_presets(spark, d):
    glyph = F.get(F.array(*[F.lit(x) for x in ("●", "❖", "%0.", "?")]), (F.col("p_partkey") % 4).cast("int"))
    return c.read(spark, d, "part").select("p_partkey", df.list_preset(glyph).alias("preset"))


@query("usable_widths", """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 468.0::DOUBLE ELSE greatest(100, p_retailprice - p_size * 10 - 72.0::DOUBLE) END AS width FROM part""")
def usable_widths(spark, d):
    known = F.col("p_partkey") % 6 != 0
    page, left = F.when(known, F.col("p_retailprice").cast("double")), F.when(known, F.col("p_size") * F.lit(10.0))
    return c.read(spark, d, "part").select("p_partkey", df.usable_width(page, left, F.lit(72.0)).alias("width"))


@query("separators", """
WITH s AS (SELECT o_orderkey, o_orderkey % 11 = 0 AS empty, o_orderkey % 3 = 0 AS after_table, o_orderkey % 4 = 0 AS blank, CAST(o_custkey AS BIGINT) AS line_end, CAST(o_custkey + 2 AS BIGINT) AS anchor FROM orders)
SELECT o_orderkey, CASE WHEN empty THEN NULL WHEN after_table THEN anchor ELSE line_end END AS place, CASE WHEN empty THEN 0 WHEN blank AND NOT after_table THEN 1 ELSE 2 END AS line_feeds FROM s""")
def separators(spark, d):
    k = F.col("o_orderkey")
    place, feeds = df.separator(k % 11 == 0, k % 3 == 0, k % 4 == 0, F.col("o_custkey").cast("long"), F.col("o_custkey").cast("long") + 2)
    return c.read(spark, d, "orders").select("o_orderkey", place.alias("place"), feeds.alias("line_feeds"))


@query("recents_upsert", """
WITH a AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, max(ts) FILTER (WHERE event_id % 2 = 0) AS old, max(ts) FILTER (WHERE event_id % 2 = 1) AS new FROM events GROUP BY user_id)
SELECT doc_id, coalesce(new, old) AS last_used FROM a ORDER BY last_used DESC, doc_id LIMIT 10""")
def recents_upsert(spark, d):
    """Documents used in odd events are put in a list that the even ones made; a new time counts even if it is an earlier one."""
    events = c.read(spark, d, "events").withColumn("doc_id", F.col("user_id").cast("string"))
    old, new = (events.where(F.col("event_id") % 2 == odd).groupBy("doc_id").agg(F.max("ts").alias("last_used")) for odd in (0, 1))
    return df.remembered(old, new)


# Target documents: a customer's orders as paragraphs, headings and tables, with nested tabs.

TARGET_SQL = """
o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders),
e AS (SELECT o_custkey AS doc_id, n AS ord, n = c AND o_orderkey % 2 = 0 AS empty, o_orderkey % 7 = 3 AND n < c AS is_table, 'Order ' || o_orderkey AS words, CASE o_orderkey % 4 WHEN 0 THEN 'TITLE' WHEN 1 THEN 'HEADING_' || (o_orderkey % 6 + 1) WHEN 2 THEN 'SUBTITLE' ELSE 'NORMAL_TEXT' END AS style FROM o),
l AS (SELECT *, CASE WHEN empty THEN 1 WHEN is_table THEN 12 ELSE length(words) + 1 END AS units FROM e),
x AS (SELECT *, CAST(1 + coalesce(sum(units) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_index, CAST(1 + sum(units) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS end_index FROM l)"""


def target_documents(spark, d):
    """doc_id, raw: JSON as the remote service gives it."""
    k = F.col("o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = c.read(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("n"), F.count("*").over(Window.partitionBy("o_custkey")).alias("c"))
    last = F.col("n") == F.col("c")
    style = F.when(k % 4 == 0, "TITLE").when(k % 4 == 1, F.concat(F.lit("HEADING_"), (k % 6 + 1).cast("string"))).when(k % 4 == 2, "SUBTITLE").otherwise("NORMAL_TEXT")
    o = o.withColumns({"empty": last & (k % 2 == 0), "is_table": (k % 7 == 3) & ~last, "words": F.concat(F.lit("Order "), k.cast("string")), "style": style})
    units = F.when(F.col("empty"), 1).when(F.col("is_table"), 12).otherwise(F.length("words") + 1)
    ahead = F.coalesce(F.sum("units").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    o = o.withColumn("units", units).withColumn("start", ahead)
    text = F.when(F.col("empty"), F.lit("\n")).otherwise(F.concat("words", F.lit("\n")))
    paragraph = F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("textRun"))).alias("elements"), F.struct(F.col("style").alias("namedStyleType")).alias("paragraphStyle"))
    table = F.struct(F.lit(2).alias("rows"), F.lit(1).alias("columns"))
    element = F.struct(F.col("start").alias("startIndex"), (F.col("start") + F.col("units")).alias("endIndex"), F.when(~F.col("is_table"), paragraph).alias("paragraph"), F.when(F.col("is_table"), table).alias("table"))
    tab = F.struct(F.struct(k.cast("string").alias("tabId"), F.col("words").alias("title")).alias("tabProperties"), F.when(k % 3 == 0, F.array(F.struct(F.struct(F.concat(k.cast("string"), F.lit(".1")).alias("tabId"), F.lit("below").alias("title")).alias("tabProperties"), F.when(
        k % 2 == 0, F.array(F.struct(F.struct(F.concat(k.cast("string"), F.lit(".1.1")).alias("tabId"), F.lit("deepest").alias("title")).alias("tabProperties")))).alias("childTabs")))).alias("childTabs"))
    rows = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n", element.alias("e"), tab.alias("t")))).alias("r"))
    return rows.select("doc_id", F.to_json(F.struct(F.struct(F.transform("r", lambda x: x["e"]).alias("content")).alias("body"), F.transform("r", lambda x: x["t"]).alias("tabs"))).alias("raw"))


@query("target_tabs", f"""
WITH {TARGET_SQL}, t AS (SELECT o_custkey AS doc_id, n, CAST(o_orderkey AS VARCHAR) AS tab_id, 'Order ' || o_orderkey AS title, 1 AS depth FROM o
  UNION ALL SELECT o_custkey, n, o_orderkey || '.1', 'below', 2 FROM o WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_custkey, n, o_orderkey || '.1.1', 'deepest', 3 FROM o WHERE o_orderkey % 6 = 0)
SELECT doc_id, tab_id, title, depth, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, depth) AS INTEGER) AS place FROM t""")
def target_tabs(spark, d):
    tabs = tg.tabs(target_documents(spark, d))
    return tabs.select("doc_id", "tab_id", "title", "depth", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")).alias("place"))


@query("target_headings", f"WITH {TARGET_SQL} SELECT doc_id, start_index, words AS text, CASE WHEN style = 'TITLE' THEN 1 ELSE CAST(right(style, 1) AS INTEGER) END AS level FROM x WHERE NOT empty AND NOT is_table AND (style = 'TITLE' OR style LIKE 'HEADING_%')")
def target_headings(spark, d):
    return tg.headings(tg.body(target_documents(spark, d))).select("doc_id", "start_index", "text", "level")


@query("target_ends", f"""
WITH {TARGET_SQL} SELECT doc_id, end_index - 1 AS "end", empty AS blank, coalesce(p, false) AS after_table FROM (SELECT *, lag(is_table) OVER (PARTITION BY doc_id ORDER BY ord) AS p, lead(ord) OVER (PARTITION BY doc_id ORDER BY ord) AS nx FROM x) WHERE nx IS NULL""")
def target_ends(spark, d):
    return tg.end_state(tg.body(target_documents(spark, d)))


@query("rematched_headings", f"""
WITH {TARGET_SQL}, h AS (SELECT doc_id, start_index, words AS text FROM x WHERE NOT empty AND NOT is_table AND (style = 'TITLE' OR style LIKE 'HEADING_%')),
w AS (SELECT o_custkey AS doc_id, CAST(o_orderkey % 40 AS BIGINT) AS start_index, 'Order ' || o_orderkey AS text FROM orders)
SELECT w.doc_id, w.start_index, w.text, (SELECT coalesce(min(h.start_index) FILTER (WHERE h.start_index = w.start_index), min(h.start_index)) FROM h WHERE h.doc_id = w.doc_id AND h.text = w.text) AS "now" FROM w""")
def rematched_headings(spark, d):
    wanted = c.read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 40).alias("start_index"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("text"))
    return tg.rematched(tg.headings(tg.body(target_documents(spark, d))), wanted)


# Markers and lists: the items of an order, each with a token that its part gives it.

ITEM_SQL = f"""
it AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(c.ITEM_ORDER)}) - 1 AS INTEGER) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey AS k, l_suppkey AS s, l_linenumber AS line FROM lineitem)"""
TOKENS = ("1", "a", "b", "c", "i", "ii", "iii", "h", "j", "v", "x")


def items(spark, d):
    """doc_id (the order), pos, n (items of the order), k (part), s (supplier), line."""
    w = Window.partitionBy("l_orderkey")
    rows = c.read(spark, d, "lineitem").select("l_orderkey", *c.ITEM_ORDER)
    return rows.select(F.col("l_orderkey").alias("doc_id"), (F.row_number().over(w.orderBy(*c.ITEM_ORDER)) - 1).alias("pos"), F.count("*").over(w).alias("n"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("line"))


NEXT_SQL = "CASE WHEN {0} IS NULL THEN 'a' WHEN replace({0}, {0}[1], '') = '' THEN repeat(chr(ascii({0}) + 1), length({0})) ELSE {0}[1:-2] || chr(ascii({0}[-1]) + 1) END"


@query("paren_markers", f"""
WITH RECURSIVE {ITEM_SQL}, v AS {values([("i", 1, "ii"), ("ii", 2, "iii"), ("iii", 3, "iv"), ("v", 5, "vi"), ("x", 10, "xi"), ("c", 100, "ci")], "token, value, after")},
t AS (SELECT it.doc_id, pos, list_extract({list(TOKENS)}, CAST(k % {len(TOKENS)} AS INTEGER) + 1) AS token, CAST(s % 3 * 4 + line AS DOUBLE) AS x FROM it),
u AS (SELECT t.*, v.value, v.after, (SELECT arg_min(CASE WHEN b.token = v.after THEN 1 ELSE 0 END, b.pos) FROM t b LEFT JOIN v w ON w.token = b.token
    WHERE b.doc_id = t.doc_id AND b.pos > t.pos AND (b.token = '1' OR b.token = v.after OR b.token = {NEXT_SQL.format("t.token")} OR w.token IS NULL)) AS ahead FROM t LEFT JOIN v ON v.token = t.token),
r AS (SELECT doc_id, CAST(-1 AS INTEGER) AS pos, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS letter, 0 AS number, 0.0::DOUBLE AS ax, 0 AS an, 0.0::DOUBLE AS rx, 0 AS rn FROM (SELECT DISTINCT doc_id FROM it)
  UNION ALL SELECT doc_id, pos, kind, CASE kind WHEN 'alpha' THEN token WHEN 'roman' THEN letter END, CASE WHEN kind = 'roman' THEN value ELSE 0 END, ax + CASE WHEN kind = 'alpha' THEN x ELSE 0 END, an + CASE WHEN kind = 'alpha' THEN 1 ELSE 0 END,
    rx + CASE WHEN kind = 'roman' THEN x ELSE 0 END, rn + CASE WHEN kind = 'roman' THEN 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN token = '1' THEN 'decimal' WHEN CASE WHEN al AND ro THEN CASE WHEN an > 0 AND rn > 0 AND abs(ax / an - rx / rn) > 4 THEN abs(x - rx / rn) < abs(x - ax / an) ELSE coalesce(ahead, 0) = 1 END
      WHEN al OR ro THEN ro ELSE value IS NOT NULL AND letter IS NOT NULL AND (length(token) > 1 OR token IN ('i', 'v', 'x')) END THEN 'roman' ELSE 'alpha' END AS kind
    FROM (SELECT u.*, r.letter, r.number, r.ax, r.an, r.rx, r.rn, u.token = {NEXT_SQL.format("r.letter")} AS al, coalesce(u.value = r.number + 1, false) AS ro FROM r JOIN u ON u.doc_id = r.doc_id AND u.pos = r.pos + 1)))
SELECT doc_id, pos, kind FROM r WHERE pos >= 0""")
def paren_markers(spark, d):
    token = F.get(F.array(*[F.lit(x) for x in TOKENS]), (F.col("k") % len(TOKENS)).cast("int"))
    rows = items(spark, d).select("doc_id", "pos", token.alias("token"), (F.col("s") % 3 * 4 + F.col("line")).cast("double").alias("x"))
    return nb.paren_kinds(rows.withColumn("scheme", F.when(F.col("token") == "1", "decimal").otherwise("paren")), ["doc_id"], "pos").select("doc_id", "pos", "kind")


LISTED_SQL = f"""
{ITEM_SQL}, b AS (SELECT doc_id, pos, CASE WHEN k % 11 < 6 THEN 'paragraph' WHEN k % 11 < 8 THEN 'bullet' WHEN k % 11 = 8 THEN 'heading' WHEN k % 11 = 9 THEN 'table' ELSE 'paragraph' END AS kind,
  CASE WHEN k % 11 < 6 THEN ['1. x', 'a. x', '(i) x', 'B. x', 'IV. x', 'c) x'][k % 11 + 1] ELSE 'plain' END AS text, CASE WHEN k % 11 < 6 THEN ['decimal', 'alpha', 'roman', 'ALPHA', 'ROMAN', 'alpha'][k % 11 + 1] END AS type, CAST(s % 3 AS INTEGER) AS level FROM it)"""


def listed(spark, d):
    k = F.col("k") % 11
    kind = F.when(k < 6, "paragraph").when(k < 8, "bullet").when(k == 8, "heading").when(k == 9, "table").otherwise("paragraph")
    text = F.when(k < 6, F.get(F.array(*[F.lit(x) for x in ("1. x", "a. x", "(i) x", "B. x", "IV. x", "c) x")]), k.cast("int"))).otherwise("plain")
    return items(spark, d).select("doc_id", "pos", kind.alias("kind"), text.alias("text"), (F.col("s") % 3).cast("int").alias("level"))


@query("hanging_items", f"""
WITH {LISTED_SQL}, p AS (SELECT *, sum(CASE WHEN kind IN ('table', 'heading') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM b),
t AS (SELECT a.*, (SELECT arg_min(z.level, z.pos) FROM p z WHERE z.doc_id = a.doc_id AND z.part = a.part AND z.type IS NOT NULL)
    + (SELECT count(*) FROM (SELECT z.type, min(z.pos) AS f FROM p z WHERE z.doc_id = a.doc_id AND z.part = a.part AND z.type IS NOT NULL GROUP BY z.type) q
       WHERE q.f < (SELECT min(y.pos) FROM p y WHERE y.doc_id = a.doc_id AND y.part = a.part AND y.type = a.type)) AS hung FROM p a WHERE type IS NOT NULL),
l AS (SELECT p.*, t.hung, last_value(CASE WHEN p.kind <> 'bullet' THEN coalesce(t.hung, -1) END IGNORE NULLS) OVER (PARTITION BY p.doc_id ORDER BY p.pos) AS above FROM p LEFT JOIN t ON t.doc_id = p.doc_id AND t.pos = p.pos)
SELECT doc_id, pos, kind, CAST(CASE WHEN kind = 'bullet' THEN level + coalesce(above, -1) + 1 ELSE coalesce(hung, level) END AS INTEGER) AS level, type IS NOT NULL AS hanging FROM l""")
def hanging_items(spark, d):
    return nb.hanging(listed(spark, d), ["doc_id"], "pos").select("doc_id", "pos", "kind", F.col("level").cast("int").alias("level"), "hanging")


@query("converted_lists")
def converted_lists(spark, d):
    """Typed items of all kinds between bullets, headings and tables; the vectors of the tests say what is due."""
    schema = "doc_id bigint, pos int, kind string, level int, label string, list_start boolean, in_list boolean"
    return fold_by_doc(listed(spark, d), ["doc_id"], ["pos"], lambda r: nb.converted(r, gaps=True), schema)


@query("word_labels", f"""
WITH RECURSIVE {ITEM_SQL}, w AS (SELECT doc_id, pos, CAST(k % 3 AS INTEGER) AS level, s % 2 = 0 AS second, row_number() OVER (PARTITION BY doc_id, s % 2, k % 3 ORDER BY pos) = 1 AND s % 2 = 0 AND k % 3 = 1 AS anew FROM it),
r AS (SELECT doc_id, CAST(-1 AS INTEGER) AS pos, 0 AS level, CAST(NULL AS INTEGER) AS a, CAST(NULL AS INTEGER) AS b, CAST(NULL AS INTEGER) AS c FROM (SELECT DISTINCT doc_id FROM it)
  UNION ALL SELECT w.doc_id, w.pos, w.level, CASE WHEN w.level = 0 THEN coalesce(r.a, 0) + 1 ELSE r.a END, CASE WHEN w.level = 0 THEN NULL WHEN w.level = 1 THEN CASE WHEN w.anew THEN 5 ELSE coalesce(r.b, 1) + 1 END ELSE r.b END,
    CASE WHEN w.level = 2 THEN coalesce(r.c, 2) + 1 END FROM r JOIN w ON w.doc_id = r.doc_id AND w.pos = r.pos + 1)
SELECT doc_id, pos, CASE level WHEN 0 THEN a || '.' WHEN 1 THEN coalesce(a, 1) || '.' || chr(96 + b) || ')' ELSE '(' || coalesce(a, 1) || '-' || chr(96 + coalesce(b, 2)) || '-' || (['', 'X', 'XX', 'XXX', 'XL'][c // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][c % 10 + 1]) || ')' END AS label FROM r WHERE pos >= 0""")
def word_labels(spark, d):
    """Two lists of numbers that share their levels; the second starts its letters at e."""
    text = [F.array(*[F.lit(x) for x in xs]) for xs in (("decimal", "lowerLetter", "upperRoman"), ("%1.", "%1.%2)", "(%1-%2-%3)"), (1, 2, 3))]
    second = F.col("s") % 2 == 0
    rows = items(spark, d).select("doc_id", "pos", F.when(second, "n2").otherwise("n1").alias("num_id"), F.lit("A").alias("abstract_id"), (F.col("k") % 3).cast("int").alias("level"),
                                  text[0].alias("formats"), text[1].alias("templates"), text[2].alias("starts"), F.when(second & (F.col("k") % 3 == 1), 5).alias("override"))
    return nb.word_numbers(rows, ["doc_id"], "pos", levels=3).select("doc_id", "pos", "label")


@query("joined_paragraphs", f"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+|[\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+$', '', 'g')) AS ls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_reduce(ls, lambda out, x: CASE WHEN regexp_matches(out, '[A-Za-z]-$') AND regexp_matches(x, '^[a-z]') THEN CASE WHEN list_contains({list(nb.KEEP)}, lower(regexp_extract(out, '([A-Za-z]+)-$', 1))) THEN out || x ELSE left(out, length(out) - 1) || chr(173) || x END
  WHEN out = '' THEN x ELSE out || ' ' || x END) AS text FROM l""")
def joined_paragraphs(spark, d):
    """A document's lines as one paragraph."""
    return c.read(spark, d, "documents").where("text is not null").select("doc_id", nb.joined_lines(F.split("text", "\n", -1)).alias("text"))


@query("shape_numbers", f"""
WITH {ITEM_SQL}, r AS (SELECT doc_id, pos, CAST(k % 3 AS INTEGER) AS level, ['arabicPeriod', 'alphaLcParenR', 'romanUcParenBoth', NULL, 'arabicPeriod'][s % 5 + 1] AS scheme, CASE WHEN k % 5 = 0 THEN 4 END AS start FROM it),
b AS (SELECT a.*, (SELECT coalesce(max(z.pos), -1) FROM r z WHERE z.doc_id = a.doc_id AND z.pos <= a.pos AND (z.level < a.level OR z.level = a.level AND z.scheme IS DISTINCT FROM a.scheme)) AS since FROM r a),
n AS (SELECT b.*, (SELECT CAST(count(*) - 1 + coalesce(arg_min(coalesce(z.start, 1), z.pos), 1) AS INTEGER) FROM r z WHERE z.doc_id = b.doc_id AND z.level = b.level AND z.pos > b.since AND z.pos <= b.pos) AS n FROM b)
SELECT doc_id, pos, CASE scheme WHEN 'arabicPeriod' THEN n || '.' WHEN 'alphaLcParenR' THEN chr(97 + (n - 1) % 26) || ')' WHEN 'romanUcParenBoth' THEN '(' || ['', 'X', 'XX', 'XXX', 'XL'][n // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] || ')' END AS label FROM n""")
def shape_numbers(spark, d):
    scheme = F.get(F.array(F.lit("arabicPeriod"), F.lit("alphaLcParenR"), F.lit("romanUcParenBoth"), F.lit(None), F.lit("arabicPeriod")), (F.col("s") % 5).cast("int"))
    rows = items(spark, d).select("doc_id", "pos", (F.col("k") % 3).cast("int").alias("level"), scheme.alias("scheme"), F.when(F.col("k") % 5 == 0, 4).alias("start"))
    return sl.shape_numbers(rows, ["doc_id"], "pos", levels=3).select("doc_id", "pos", "label")


# Boxes: the items of an order as cells three to a row, and a customer's orders as boxes of a page.

CELLS_SQL = f"""
{ITEM_SQL}, ce AS (SELECT *, pos % 3 AS col, pos // 3 AS row, 1 + CASE WHEN pos % 3 < 2 THEN s % 2 ELSE 0 END AS span FROM it)"""


def order_cells(spark, d):
    """Cells with edges that are off by up to a point."""
    pos, k, s = F.col("pos"), F.col("k"), F.col("s")
    col, row = pos % 3, F.floor(pos / 3).cast("int")
    span = F.when(col < 2, s % 2).otherwise(0) + 1
    return items(spark, d).select(
        "doc_id", "pos", "n", "k", "s", row.alias("own_row"), col.alias("own_col"), span.cast("int").alias("span"), (col * 50 + k % 3 * 0.5).cast("double").alias("x0"), ((col + span) * 50 + s % 3 * 0.5).cast("double").alias("x1"),
        (row * 20 + k % 2 * 0.75).cast("double").alias("y0"), (row * 20 + 20 + s % 2 * 0.75).cast("double").alias("y1"),
    )


@query("grid_tables", f"""
WITH {CELLS_SQL}, e AS (SELECT DISTINCT doc_id, col AS x FROM ce UNION SELECT doc_id, col + span FROM ce), y AS (SELECT DISTINCT doc_id, row AS y FROM ce UNION SELECT doc_id, row + 1 FROM ce)
SELECT doc_id, pos, CAST((SELECT count(*) FROM y WHERE y.doc_id = ce.doc_id AND y.y < ce.row) AS INTEGER) AS row, CAST((SELECT count(*) FROM e WHERE e.doc_id = ce.doc_id AND e.x < ce.col) AS INTEGER) AS col, 1 AS rowspan,
  CAST((SELECT count(*) FROM e WHERE e.doc_id = ce.doc_id AND e.x >= ce.col AND e.x < ce.col + ce.span) AS INTEGER) AS colspan FROM ce""")
def grid_tables(spark, d):
    return ly.grid_cells(order_cells(spark, d), ["doc_id"]).select("doc_id", "pos", "row", "col", "rowspan", "colspan")


@query("cell_edits", f"""
WITH {CELLS_SQL}, e AS (SELECT doc_id, row, col, 'updateTableCellStyle' AS op, '#FF0000' AS payload FROM ce WHERE k % 4 = 0 UNION ALL SELECT doc_id, row, col, 'mergeTableCells', '1x' || span FROM ce WHERE span > 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY row DESC, col DESC, op) AS INTEGER) AS seq, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, op, payload FROM e""")
def cell_edits(spark, d):
    cells = order_cells(spark, d).select("doc_id", F.col("own_row").alias("row"), F.col("own_col").cast("int").alias("col"), F.lit(1).alias("rowspan"), F.col("span").alias("colspan"), F.when(F.col("k") % 4 == 0, "#FF0000").alias("background"))
    return ed.cell_edits(cells).select("doc_id", "seq", "row", "col", "op", "payload")


@query("box_tables", f"""
WITH {ITEM_SQL} SELECT doc_id, pos AS box, 0 AS "table", CAST(pos // 3 AS INTEGER) AS row, CAST(pos % 3 AS INTEGER) AS col FROM it WHERE n // 3 >= 2 AND pos < n // 3 * 3""")
def box_tables(spark, d):
    """Boxes three to a row: full rows are a table where there are two of them; a short last row is none."""
    cells = order_cells(spark, d)
    rows = cells.select("doc_id", F.col("pos").alias("box"), (F.col("own_col") * 51.0).alias("x0"), F.col("y0"), (F.col("own_col") * 51.0 + 50).alias("x1"), F.col("y1"))
    return fold_by_doc(rows, ["doc_id"], ["box"], dr.box_tables, "doc_id bigint, box int, table int, row int, col int")


@query("process_banners", f"""
WITH {ITEM_SQL}, l AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM it WHERE s % 10 > 3)
SELECT doc_id, pos AS box FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM l) WHERE n > 2""")
def process_banners(spark, d):
    """Boxes side by side; three light ones without a dark one between are a process."""
    rows = items(spark, d).select("doc_id", F.col("pos").alias("box"), (F.col("pos") * 105.0).alias("x0"), (F.col("pos") * 105.0 + 100).alias("x1"), (F.col("k") % 2 + 20.0).alias("y0"), F.lit(60.0).alias("y1"), F.when(F.col("s") % 10 > 3, 0.9).otherwise(0.2).alias("fill"), F.lit(1.0).alias("opacity"))
    return fold_by_doc(rows, ["doc_id"], ["box"], pg.banner_boxes, "doc_id bigint, box int")


@query("visual_lines", f"""
WITH RECURSIVE {BOXES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY box) AS i FROM b),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS box, CAST([] AS STRUCT(a DOUBLE, z DOUBLE)[]) AS ls, CAST(NULL AS BIGINT) AS line FROM (SELECT DISTINCT doc_id FROM b)
  UNION ALL SELECT doc_id, i, box, CASE WHEN ix = len(ls) THEN list_append(ls, {{'a': y0, 'z': y1}}) ELSE list_transform(ls, lambda l, j: CASE WHEN j = ix + 1 THEN {{'a': least(l.a, y0), 'z': greatest(l.z, y1)}} ELSE l END) END, ix
  FROM (SELECT k.doc_id, k.i, k.box, r.ls, k.y0, k.y1, CAST(coalesce(list_position(list_transform(r.ls, lambda l: least(l.z, k.y1) - greatest(l.a, k.y0) > 0.5 * least(l.z - l.a, k.y1 - k.y0)), true) - 1, len(r.ls)) AS BIGINT) AS ix
        FROM r JOIN k ON k.doc_id = r.doc_id AND k.i = r.i + 1))
SELECT doc_id, box, CAST(line AS INTEGER) AS line FROM r WHERE i > 0""")
def visual_lines(spark, d):
    return ly.visual_lines(boxes(spark, d), ["doc_id"], "box").select("doc_id", "box", "line")


@query("distinct_rects", """
WITH RECURSIVE k AS (SELECT o_custkey AS doc_id, o_orderkey AS box, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey % 7 * 0.375 AS x, o_orderkey % 4 * 0.625 AS y FROM orders),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS box, CAST([] AS STRUCT(x DOUBLE, y DOUBLE)[]) AS ks, false AS new FROM (SELECT DISTINCT doc_id FROM k)
  UNION ALL SELECT doc_id, i, box, CASE WHEN new THEN list_append(ks, {'x': x, 'y': y}) ELSE ks END, new
  FROM (SELECT k.doc_id, k.i, k.box, k.x, k.y, r.ks, len(list_filter(r.ks, lambda q: abs(q.x - k.x) <= 1 AND abs(q.y - k.y) <= 1)) = 0 AS new FROM r JOIN k ON k.doc_id = r.doc_id AND k.i = r.i + 1))
SELECT doc_id, box FROM r WHERE new""")
def distinct_rects(spark, d):
    """Boxes that lie within a few points of each other."""
    k = F.col("o_orderkey")
    x, y = k % 7 * F.lit(0.375), k % 4 * F.lit(0.625)
    rows = c.read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("box"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 20).alias("y1"))
    return ly.distinct_boxes(rows, ["doc_id"], "box").select("doc_id", "box")


@query("ruled_bands", f"""
WITH {BOXES_SQL}, r AS (SELECT *, box % 4 = 0 AS rule, box % 8 = 0 AS wide FROM b), w AS (SELECT doc_id, box, rule, count(*) FILTER (WHERE wide) OVER (PARTITION BY doc_id ORDER BY y0, box) AS above, count(*) FILTER (WHERE wide) OVER (PARTITION BY doc_id) AS n FROM r)
SELECT doc_id, box, CASE WHEN above > 0 AND above < n THEN above - 1 END AS band FROM w WHERE NOT rule""")
def ruled_bands(spark, d):
    """Every fourth box as a rule, every other of those wide."""
    b = boxes(spark, d)
    width = F.when(F.col("box") % 8 == 0, 400.0).otherwise(50.0)
    rows = b.select("doc_id", "box", F.when(F.col("box") % 4 == 0, "rule").otherwise("line").alias("kind"), F.lit(0.0).alias("x0"), width.alias("x1"), "y0", F.lit(600.0).alias("page_width"))
    return dr.ruled_bands(rows, ["doc_id"], "box").select("doc_id", "box", "band")


@query("diagram_texts", f"""
WITH RECURSIVE {BOXES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY box) - 1 AS i FROM b),
t AS (SELECT a.doc_id, a.i, z.i AS j FROM k a JOIN k z ON a.doc_id = z.doc_id AND a.x0 <= z.x1 + 2 AND z.x0 <= a.x1 + 2 AND a.y0 <= z.y1 + 2 AND z.y0 <= a.y1 + 2),
r AS (SELECT doc_id, i, j FROM t UNION SELECT r.doc_id, r.i, t.j FROM r JOIN t ON r.doc_id = t.doc_id AND r.j = t.i),
g AS (SELECT k.*, m.g FROM k JOIN (SELECT doc_id, i, min(j) AS g FROM r GROUP BY doc_id, i) m ON k.doc_id = m.doc_id AND k.i = m.i)
SELECT doc_id, string_agg('T' || box, ' ' ORDER BY round_even(y0 / 20, 0), x0, 'T' || box) FILTER (WHERE box % 3 <> 0) AS text FROM g GROUP BY doc_id, g HAVING count(*) FILTER (WHERE box % 3 <> 0) >= 2 AND count(*) FILTER (WHERE box % 3 = 0) >= 1""")
def diagram_texts(spark, d):
    """Every third box as a connector."""
    line = F.col("box") % 3 == 0
    shapes = boxes(spark, d).withColumns({"kind": F.when(line, "connector").otherwise("text"), "text": F.when(line, "").otherwise(F.concat(F.lit("T"), F.col("box").cast("string")))})
    schema = "doc_id bigint, box bigint, kind string, text string, x0 double, y0 double, x1 double, y1 double, group int"
    return sl.diagrams(fold_by_doc(shapes, ["doc_id"], ["box"], ly.touching, schema), ["doc_id"]).select("doc_id", "text")


@query("column_gaps", f"""
WITH RECURSIVE {ITEM_SQL}, g AS (SELECT doc_id, CAST(40 + k % 4 * 8 AS DOUBLE) AS x0, CAST(40 + k % 4 * 8 + 3 + s % 8 AS DOUBLE) AS x1 FROM it), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x0, x1) AS i FROM g),
r AS (SELECT doc_id, i, x0, x1, 1 AS edge FROM o WHERE i = 1 UNION ALL
  SELECT o.doc_id, o.i, CASE WHEN o.x0 < r.x1 THEN greatest(o.x0, r.x0) ELSE o.x0 END, CASE WHEN o.x0 < r.x1 THEN least(o.x1, r.x1) ELSE o.x1 END, r.edge + CASE WHEN o.x0 < r.x1 THEN 0 ELSE 1 END FROM r JOIN o ON o.doc_id = r.doc_id AND o.i = r.i + 1),
e AS (SELECT doc_id, edge, arg_max(x0, i) AS x0, arg_max(x1, i) AS x1, count(*) AS n FROM r GROUP BY doc_id, edge)
SELECT doc_id, x0, x1, support FROM (SELECT e.*, n + (SELECT count(*) FROM it WHERE it.doc_id = e.doc_id AND abs(it.s % 60 + 20 - e.x1) <= 4) AS support FROM e) WHERE support >= 3""")
def column_gaps(spark, d):
    rows = items(spark, d)
    x0 = (F.col("k") % 4 * 8 + 40).cast("double")
    gaps = rows.select("doc_id", x0.alias("x0"), (x0 + 3 + F.col("s") % 8).alias("x1"))
    return sl.column_gaps(gaps, rows.select("doc_id", (F.col("s") % 60 + 20).alias("x")), ["doc_id"])


@query("span_lines", f"""
WITH {c.TURNS_SQL}, w AS (SELECT doc_id, page, CAST(pos AS INTEGER) AS pos, regexp_extract_all(line, '[^ \t\n\\x0B\f\r]+') AS ws FROM turn_lines),
t AS (SELECT doc_id, page, pos, coalesce(list_reduce(list_transform(ws, lambda x, i: CASE WHEN i > 1 AND i % 3 <> 1 THEN ' ' ELSE '' END || x), lambda a, x: a || x), '') AS text FROM w)
SELECT doc_id, page, pos, text, nullif(regexp_extract(text, '^\\s*([•◦▪■●○‣⁃➢❖✔])', 1), '') AS bullet FROM t""")
def span_lines(spark, d):
    """Words as spans; before every third one the gap is too small for a blank."""
    words = F.regexp_extract_all("line", F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))
    spans = F.transform("w", lambda x, i: F.struct((i * 100.0 - F.when(i % 3 == 0, 2.0).otherwise(0.0)).alias("x0"), (i * 100.0 + 97.0).alias("x1"), x.alias("text")))
    rows = c.turn_lines(spark, d).select("doc_id", "page", "pos", words.alias("w")).select("doc_id", "page", "pos", sl.line_text(spans, F.lit(11.0)).alias("text"))
    return rows.withColumn("bullet", sl.leading_bullet(F.col("text")))


# Blocks: the lines of a conversation, a turn to a page, set at thirteen points a line.

ITEM_RE = "'^\\s*(\\((\\d{1,3}|[a-zA-Z]|[ivxlcIVXLC]{1,4})\\)|(\\d{1,3}|[a-zA-Z]|[ivxlcIVXLC]{1,4})[.)])\\s'"


def flow_sql(cell: bool) -> str:
    """Each line with the first line of its block. Cells: nothing ends a block but its place, and each turn is one of its own."""
    own = "doc_id, page" if cell else "doc_id"
    same = "k.doc_id = r.doc_id AND k.page = r.page" if cell else "k.doc_id = r.doc_id"
    short = "false" if cell else "r.fin IN ('.', '?', '!', ':') AND r.x1 < k.edge - 0.15::DOUBLE * (k.edge - 72)"
    return f"""
{c.TURNS_SQL}, f AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS INTEGER) AS line, page, 60.0::DOUBLE + pos * 13 + pos // 4 * 9 AS y0, 72.0::DOUBLE + length(line) * 5 AS x1, line AS text FROM turn_lines),
s AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS gaps FROM (SELECT *, trim(text) = '' AS blank, regexp_matches(text, {ITEM_RE}) AS item, right(rtrim(text), 1) AS fin FROM f)),
m AS (SELECT doc_id, coalesce(min(y) FILTER (WHERE later), min(y)) AS top FROM (SELECT doc_id, y, page > min(page) OVER (PARTITION BY doc_id) AS later FROM (SELECT doc_id, page, arg_min(y0, line) AS y FROM s WHERE NOT blank GROUP BY doc_id, page)) GROUP BY doc_id),
q AS (SELECT doc_id, x1 AS edge FROM (SELECT doc_id, x1, row_number() OVER (PARTITION BY doc_id ORDER BY x1) - 1 AS a, count(*) OVER (PARTITION BY doc_id) AS n FROM s WHERE NOT blank) WHERE a = least(n - 1, CAST(floor(0.9::DOUBLE * n) AS BIGINT))),
k AS (SELECT s.*, m.top, q.edge, row_number() OVER w AS i, {'true' if cell else 'gaps = lag(gaps) OVER w'} AS near FROM s JOIN m USING (doc_id) JOIN q USING (doc_id) WHERE NOT blank AND NOT regexp_matches(text, '^[\\s*\\-–—_=~•·.]+$') WINDOW w AS (PARTITION BY {', '.join('s.' + x for x in own.split(', '))} ORDER BY line)),
r AS (SELECT doc_id, i, line, page, y0, x1, text, fin, item, line AS first, item AS first_item FROM k WHERE i = 1
  UNION ALL SELECT doc_id, i, line, page, y0, x1, text, fin, item, CASE WHEN joins THEN first ELSE line END, CASE WHEN joins THEN first_item ELSE item END
  FROM (SELECT *, near AND NOT begins AND on_ AS joins FROM (SELECT k.doc_id, k.i, k.line, k.page, k.y0, k.x1, k.text, k.fin, k.item, r.first, r.first_item, k.near,
      k.item AND NOT (r.fin <> '' AND r.fin NOT IN ('.', ':', ';', '!', '?', '-', '–', '—') AND NOT regexp_matches(ltrim(regexp_replace(k.text, {ITEM_RE}, '')), '^\\p{{Lu}}') AND NOT r.first_item) AS begins,
      CASE WHEN k.page = r.page THEN k.y0 > r.y0 AND CASE WHEN r.first_item THEN k.y0 - r.y0 <= 33 ELSE k.y0 - r.y0 <= 16.5 END AND NOT ({short})
        ELSE NOT r.first_item AND k.y0 - k.top <= 6.6 AND (r.fin NOT IN ('.', ';', '!', '?') OR regexp_matches(ltrim(k.text), '^\\p{{Ll}}')) END AS on_
    FROM r JOIN k ON {same} AND k.i = r.i + 1)))"""


def flow_lines(spark, d):
    lines = c.turn_lines(spark, d)
    w = Window.partitionBy("doc_id").orderBy("page", "pos")
    y0 = F.lit(60.0) + F.col("pos") * 13 + F.floor(F.col("pos") / 4) * 9
    return lines.select(
        "doc_id", F.row_number().over(w).alias("line"), "page", F.lit(72.0).alias("x0"), (F.lit(72.0) + F.length("line") * 5).alias("x1"), y0.alias("y0"), F.lit(11.0).alias("size"), F.col("line").alias("text"), F.lit(0.0).alias("bold"),
        F.lit(None).cast("string").alias("bullet"), F.lit(72.0).alias("text_x"), F.lit(False).alias("in_box"), (F.trim("line") == "").alias("blank"), F.lit(1e9).alias("page_width"),
    )


@query("document_blocks", f"WITH RECURSIVE {flow_sql(False)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS pos, min(page) AS page, count(*) AS lines FROM r GROUP BY doc_id, first")
def document_blocks(spark, d):
    """How many lines each block of a conversation has; the vectors of the tests cover headings, bullets and titles."""
    told = pg.opened(flow_lines(spark, d))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1
    return told.groupBy("doc_id", "first").agg(F.min("page").alias("page"), F.count("*").alias("lines")).select("doc_id", pos.alias("pos"), "page", "lines")


@query("cell_blocks", f"WITH RECURSIVE {flow_sql(True)} SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY first) - 1 AS INTEGER) AS pos, count(*) AS lines FROM r GROUP BY doc_id, page, first")
def cell_blocks(spark, d):
    """A turn as a cell: how many lines each of its blocks has."""
    own = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page").cast("string"))
    told = pg.opened(flow_lines(spark, d).withColumn("doc_id", own), headings=False)
    blocks = told.groupBy("doc_id", "page", "first").agg(F.count("*").alias("lines"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1
    return blocks.select(F.split_part("doc_id", F.lit("/"), F.lit(1)).cast("bigint").alias("doc_id"), "page", pos.alias("pos"), "lines")


@query("slide_points")
def slide_points(spark, d):
    """A turn as a slide, its lines as paragraphs and, where they begin with a dash, own bullets."""
    rows = c.turn_lines(spark, d).select(
        F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page").cast("string")).alias("slide"), "pos", F.when(F.col("line").startswith("- "), "bullet").otherwise("paragraph").alias("kind"), F.col("line").alias("text"),
        (F.col("pos") % 2).alias("level"), (F.col("pos") % 3 * 30.0).alias("x"), F.lit(False).alias("bold"), F.lit(False).alias("starts_bold"),
    )
    return pg.slide_points(rows, ["slide"], "pos", F.lit(True))


@query("split_deck_tables", f"""
WITH RECURSIVE {ITEM_SQL}, t AS (SELECT doc_id, pos, CAST(line AS INTEGER) AS page, CASE WHEN k % 5 = 0 THEN '' ELSE 'h' || k % 2 END AS header, CAST(2 + s % 2 AS INTEGER) AS n_cols, CAST(1 + k % 3 AS INTEGER) AS n_rows, k % 11 = 0 AS titled, CASE WHEN k % 4 <> 0 THEN 1.0::DOUBLE + k % 4 / 2.0::DOUBLE END AS w FROM it),
r AS (SELECT *, pos AS first, page AS last_page, 0 AS off FROM t WHERE pos = 0
  UNION ALL SELECT doc_id, pos, page, CASE WHEN same OR deck THEN h ELSE header END, n_cols, n_rows, CASE WHEN same OR deck THEN ti ELSE titled END, CASE WHEN same OR deck THEN fw ELSE w END, CASE WHEN same OR deck THEN first ELSE pos END, page, CASE WHEN same THEN 1 ELSE 0 END
  FROM (SELECT t.*, r.header AS h, r.titled AS ti, r.w AS fw, r.first, t.header <> '' AND t.header = r.header AND t.n_cols = r.n_cols AS same,
      t.doc_id % 2 = 0 AND t.n_cols = r.n_cols AND NOT r.titled AND NOT t.titled AND t.page - r.last_page BETWEEN 0 AND 1 AND (t.w IS NULL OR r.w IS NULL OR abs(t.w / (t.w + t.n_cols - 1) - r.w / (r.w + t.n_cols - 1)) <= 0.15::DOUBLE) AS deck
    FROM r JOIN t ON t.doc_id = r.doc_id AND t.pos = r.pos + 1))
SELECT doc_id, first, CAST(max(pos) AS INTEGER) AS last, CAST(sum(n_rows - off) AS INTEGER) AS n_rows, CAST(count(*) AS INTEGER) AS parts FROM r GROUP BY doc_id, first""")
def split_deck_tables(spark, d):
    """Every other order as a deck; the first column's width differs, or is unknown."""
    k, cols = F.col("k"), (F.col("s") % 2 + 2).cast("int")
    widths = F.when(k % 4 != 0, F.concat(F.array((k % 4 / 2.0 + 1.0).cast("double")), F.array_repeat(F.lit(1.0), cols - 1)))
    rows = items(spark, d).select("doc_id", "pos", F.col("line").cast("int").alias("page"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("h"), (k % 2).cast("string"))).alias("header"), cols.alias("n_cols"), (k % 3 + 1).cast("int").alias("n_rows"), (k % 11 == 0).alias("titled"), widths.alias("widths"))
    return dr.merged_tables(rows, ["doc_id"], F.col("doc_id") % 2 == 0).select("doc_id", "first", "last", "n_rows", "parts")


# Files: web pages packed as Word files, read back through the readers; some cut short, some of other formats.


def packed(batches):
    """Rows (doc_id, blocks) as path and content of a Word file."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    import pyarrow as pa

    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/><w:pPr><w:outlineLvl w:val="{v}"/></w:pPr></w:style>' for i, n, v in (("T", "Title", 0), ("H", "heading 2", 1)))
    marks = {"title": '<w:pStyle w:val="T"/>', "h1": '<w:pStyle w:val="H"/>', "li": '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'}
    for batch in batches:
        paths, contents = [], []
        for page, blocks in zip(batch.column("doc_id").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
            body = "".join(f'<w:p><w:pPr>{marks.get(b["tag"], "")}</w:pPr><w:r><w:t xml:space="preserve">{escape(b["text"])}</w:t></w:r></w:p>' for b in blocks)
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
                z.writestr("word/styles.xml", f'<w:styles xmlns:w="{space}">{styles}</w:styles>')
            paths.append(f"p{page}.{'pdf' if page % 13 == 0 else 'docx'}")
            contents.append(held.getvalue()[:60] if page % 17 == 0 else held.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])


@query("file_outlines", f"""
WITH {c.HTML_SQL}, b AS (SELECT doc_id, pos, tag, trim(regexp_replace(text, '[\\x00-\\x1F]', '', 'g')) AS text FROM html_blocks WHERE tag <> 'footer')
SELECT 'p' || doc_id || CASE WHEN doc_id % 13 = 0 THEN '.pdf' ELSE '.docx' END AS path, CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN NULL ELSE string_agg(CASE tag WHEN 'title' THEN '# ' WHEN 'h1' THEN '## ' WHEN 'li' THEN '- ' ELSE '' END || text, chr(10) ORDER BY pos) FILTER (WHERE text <> '') END AS outline,
  doc_id % 13 = 0 OR doc_id % 17 = 0 AS failed FROM b GROUP BY doc_id""")
def file_outlines(spark, d):
    """Each page as a file, parsed and outlined; cut files and formats without a reader are error rows."""
    text = F.trim(F.regexp_replace("text", "[\\x00-\\x1F]", ""))
    blocks = c.html_blocks(spark, d).where("tag <> 'footer'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag", text.alias("text")))).alias("blocks"))
    out = documents.outline(documents.blocks_of(blocks.mapInArrow(packed, "path string, content binary")))
    return out.select("path", "outline", F.col("error").isNotNull().alias("failed"))
