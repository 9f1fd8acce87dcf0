"""Tables as they are drawn: rules, rows and columns of boxes, split tables of decks, text in cells, underlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.binding import let
from lectern.operators.fold import in_order, scan
from lectern.operators.sequences import islands


def merged_tables(tables: DataFrame, by: Sequence[str], slides: Column, alike: float = 0.15) -> DataFrame:
    """Tables (pos, page, header, n_cols, n_rows, titled: the first row is one cell; widths or null) that go on from the neighbour before as one.

    A table goes on without its first row if that repeats the header, and whole if on slides it has the same columns and no title
    row, on the same page or the next; the page that counts is the last part's. first, last, n_rows, parts."""
    kept = "header:string,n_cols:int,titled:boolean,widths:array<double>,page:int,pos:int"

    def shares(widths: Column) -> Column:
        return F.transform(widths, lambda w: w / F.aggregate(widths, F.lit(0.0), lambda a, x: a + x))

    def step(first: Column, t: Column) -> Column:
        known = (F.coalesce(F.size(first["widths"]), F.lit(0)) > 0) & (F.coalesce(F.size(t["widths"]), F.lit(0)) > 0)
        columns = ~known | F.forall(F.zip_with(shares(first["widths"]), shares(t["widths"]), lambda a, b: F.coalesce(F.abs(a - b) <= alike, F.lit(True))), lambda x: x)
        neighbour = (first["pos"] == t["pos"] - 1) & (first["n_cols"] == t["n_cols"])
        repeats = neighbour & (t["header"] != "") & (t["header"] == first["header"])
        carries = neighbour & t["slides"] & (t["n_cols"] >= 2) & ~first["titled"] & ~t["titled"] & (t["page"] - first["page"]).between(0, 1) & columns

        def told(how: Column) -> Column:
            on = how != "new"
            names = [x.split(":")[0] for x in kept.replace("array<double>", "array").split(",")]
            after = F.struct(*[(F.when(on & F.lit(n not in ("page", "pos")), first[n]).otherwise(t[n])).alias(n) for n in names])
            return F.struct(after.alias("state"), how.alias("out"))

        return let(F.when(F.coalesce(repeats, F.lit(False)), "repeats").when(F.coalesce(carries, F.lit(False)), "carries").otherwise("new"), told)

    rows = in_order(tables.withColumn("slides", slides), by, "pos")
    told = scan(F.col("rows"), F.from_json(F.lit("{}"), f"struct<{kept}>"), "string", step)
    parts = rows.select(*by, F.explode(F.zip_with("rows", told, lambda r, o: r.withField("how", o))).alias("r")).select(*by, "r.*")
    parts = islands(parts, by, ["pos"], F.col("how") == "new", "table")
    return parts.groupBy(*by, "table").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum(F.col("n_rows") - (F.col("how") == "repeats").cast("int")).cast("int").alias("n_rows"), F.count("*").cast("int").alias("parts"))


def box_tables(boxes: list[dict], tolerance: float = 3.0) -> list[dict]:
    """One page's boxes as tables: boxes of one height side by side are a row, rows with the same edges below each other a table of
    two rows and two columns or more. Adds table, row and col to the boxes of tables. A fold."""
    bands: list[list[dict]] = []
    for b in sorted(boxes, key=lambda b: (b["y0"], b["x0"])):  # boxes of one row may differ in height by the tolerance
        band = next((r for r in bands if abs(r[0]["y0"] - b["y0"]) <= tolerance and abs(r[0]["y1"] - b["y1"]) <= tolerance), None)
        bands.append([b]) if band is None else band.append(b)
    rows: list[list[dict]] = []
    for band in bands:
        ahead: dict | None = None
        for b in sorted(band, key=lambda b: b["x0"]):
            beside = ahead is not None and 0 <= b["x0"] - ahead["x1"] + tolerance <= 4 * tolerance
            rows[-1].append(b) if beside else rows.append([b])
            ahead = b
    tables: list[list[list[dict]]] = []
    for row in (r for r in rows if len(r) > 1):
        fits = next((t for t in tables if len(t[-1]) == len(row) and 0 <= row[0]["y0"] - t[-1][0]["y1"] + tolerance <= 4 * tolerance and all(abs(a["x0"] - b["x0"]) <= tolerance for a, b in zip(t[-1], row, strict=True))), None)
        if fits is None:
            tables.append([row])
        else:
            fits.append(row)
    return [b | {"table": n, "row": i, "col": j} for n, t in enumerate(t for t in tables if len(t) > 1) for i, row in enumerate(t) for j, b in enumerate(row)]


def ruled_bands(items: DataFrame, page: Sequence[str], order: str, share: float = 0.6) -> DataFrame:
    """Rules and lines of pages (kind, x0, x1, y0, page_width): rules over `share` of the width bound bands; adds `band` to the lines, null
    outside of two such rules."""
    down = Window.partitionBy(*page).orderBy("y0", order)
    wide = (F.col("kind") == "rule") & (F.col("x1") - F.col("x0") >= share * F.col("page_width"))
    above, below = F.count_if(wide).over(down.rowsBetween(Window.unboundedPreceding, 0)), F.count_if(wide).over(down.rowsBetween(1, Window.unboundedFollowing))
    marked = items.withColumn("band", F.when((above > 0) & (below > 0), above - 1))
    return marked.where(F.col("kind") != "rule")


def underlined(spans: DataFrame, rules: DataFrame, page: Sequence[str], span: str) -> DataFrame:
    """Spans with a flat rule right below: from 0.1 of the size above the baseline to 0.4 below, over half of the span's width."""
    r = rules.select(*page, F.struct("x0", "x1", "y").alias("r"))
    overlap = F.least("x1", "r.x1") - F.greatest("x0", "r.x0")
    below = F.col("r.y") - F.col("baseline")
    met = spans.join(r, list(page)).where((below >= -0.1 * F.col("size")) & (below <= 0.4 * F.col("size")) & (overlap > 0.5 * (F.col("x1") - F.col("x0"))))
    return met.select(span).distinct()


def words_of(chars):
    """Characters (c, x0, x1) in order -> words (text, x0, x1), cut at blanks."""
    def step(acc, ch):
        blank = ch["c"].rlike(r"(?U)^\s$")
        last = F.try_element_at(acc["words"], F.lit(-1))
        grown = F.struct(F.concat(last["text"], ch["c"]).alias("text"), last["x0"].alias("x0"), ch["x1"].alias("x1"))
        opened = F.struct(ch["c"].alias("text"), ch["x0"].alias("x0"), ch["x1"].alias("x1"))
        words = F.when(blank, acc["words"]).when(acc["in_word"], F.concat(F.slice(acc["words"], F.lit(1), F.greatest(F.size(acc["words"]) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc["words"], F.array(opened)))
        return F.struct((~blank).alias("in_word"), words.alias("words"))

    start = F.struct(F.lit(False).alias("in_word"), F.array().cast("array<struct<text:string,x0:double,x1:double>>").alias("words"))
    return F.aggregate(chars, start, step, lambda acc: acc["words"])
