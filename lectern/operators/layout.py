"""Rules over boxes on pages. Joins carry the page as an equal key, so none compares boxes of different pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.binding import let
from lectern.operators.fold import in_order, scan
from lectern.operators.sequences import islands, kept_apart, ordered


def contained(points: DataFrame, regions: DataFrame, page: Sequence[str], point: str, region: str, first: Sequence[str | Column]) -> DataFrame:
    """points (x, y) with the region (x0, y0, x1, y1) that holds them, the first by `first` where several do, or null."""
    r = regions.select(*[F.col(c).alias(f"_{c}") for c in page], F.struct(*regions.columns).alias("r"))
    on = [F.col(c) == F.col(f"_{c}") for c in page] + [F.col("x") >= F.col("r.x0"), F.col("x") <= F.col("r.x1"), F.col("y") >= F.col("r.y0"), F.col("y") <= F.col("r.y1")]
    met = points.join(r, on, "left").drop(*[f"_{c}" for c in page])
    best = F.min_by("r", F.struct(*[F.col(f"r.{c}") if isinstance(c, str) else c for c in first]))
    found = met.groupBy(point).agg(best.alias("r"))
    return points.join(found.select(point, F.col(f"r.{region}").alias(region)), point, "left")


def area(box: str = "r") -> Column:
    return (F.col(f"{box}.x1") - F.col(f"{box}.x0")) * (F.col(f"{box}.y1") - F.col(f"{box}.y0"))


def above(boxes: DataFrame, lines: DataFrame, page: Sequence[str], box: str, line: str, reach: float = 16.0) -> DataFrame:
    """boxes with the nearest line that ends at most `reach` above their top."""
    b = boxes.select(*page, box, F.col("y0").alias("_top"))
    met = b.join(lines.select(*page, line, F.col("y1").alias("_end")), list(page)).where((F.col("_end") <= F.col("_top") + 1) & (F.col("_top") - F.col("_end") <= reach))
    best = met.groupBy(box).agg(F.max_by(line, F.struct("_end", line)).alias(line))
    return boxes.select(*page, box).join(best, box, "left")


def mates(glyphs: DataFrame, texts: DataFrame, page: Sequence[str], glyph: str, text: str, gap: float = 40.0) -> DataFrame:
    """The nearest text right of a bullet's glyph on its row (more than half of the smaller height in common)."""
    g = glyphs.select(*page, glyph, *[F.col(c).alias(f"_{c}") for c in ("x1", "y0", "y1")])
    overlap = F.least("y1", "_y1") - F.greatest("y0", "_y0")
    small = F.least(F.col("y1") - F.col("y0"), F.col("_y1") - F.col("_y0"))
    met = g.join(texts, list(page)).withColumn("_gap", F.col("x0") - F.col("_x1")).where((overlap > 0.5 * small) & (F.col("_gap") > 0) & (F.col("_gap") <= gap))
    return met.groupBy(glyph).agg(F.min_by(text, F.struct("_gap", text)).alias(text))


def connectors(lines: DataFrame, boxes: DataFrame, page: Sequence[str], line: str, box: str, reach: float = 50.0) -> DataFrame:
    """Lines (x0, y0, x1, y1) whose ends lie near two different boxes."""
    def near(x: str, y: str) -> Column:
        dx = F.greatest(F.col("b.x0") - F.col(x), F.col(x) - F.col("b.x1"), F.lit(0.0))
        dy = F.greatest(F.col("b.y0") - F.col(y), F.col(y) - F.col("b.y1"), F.lit(0.0))
        return (dx <= reach) & (dy <= reach)

    b = boxes.select(*page, F.struct(box, "x0", "y0", "x1", "y1").alias("b"))
    met = lines.join(b, list(page)).select(line, F.col(f"b.{box}").alias("_b"), near("x0", "y0").alias("_head"), near("x1", "y1").alias("_tail")).where("_head or _tail")
    ends = met.groupBy(line).agg(F.collect_set(F.when(F.col("_head"), F.col("_b"))).alias("_h"), F.collect_set(F.when(F.col("_tail"), F.col("_b"))).alias("_t"))
    return ends.where((F.size("_h") > 0) & (F.size("_t") > 0) & (F.size(F.array_union("_h", "_t")) > 1)).select(line)


def foreign(shapes: DataFrame, cells: DataFrame, page: Sequence[str], shape: str, tolerance: float = 2.0) -> DataFrame:
    """Shapes that match no cell on all four edges."""
    c = cells.select(*page, *[F.col(x).alias(f"_{x}") for x in ("x0", "y0", "x1", "y1")])
    on = [shapes[p] == c[p] for p in page] + [F.abs(F.col(x) - F.col(f"_{x}")) <= tolerance for x in ("x0", "y0", "x1", "y1")]
    return shapes.join(c, on, "left_anti").select(*page, shape)


def touching(rows: list[dict], tolerance: float = 2.0) -> list[dict]:
    """For one page's boxes: `group`, the least place among boxes that touch, directly or through others. A fold (sweep and union)."""
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    open_: list[int] = []
    for i in sorted(parent, key=lambda i: rows[i]["x0"]):
        a = rows[i]
        open_ = [j for j in open_ if rows[j]["x1"] + tolerance >= a["x0"]]
        for j in open_:
            if a["y0"] <= rows[j]["y1"] + tolerance and rows[j]["y0"] <= a["y1"] + tolerance:
                low, high = sorted((root(i), root(j)))
                parent[high] = low
        open_.append(i)
    return [r | {"group": root(i)} for i, r in enumerate(rows)]


def _listed(df: DataFrame, page: Sequence[str], order: str, state: str, emits: str, step) -> DataFrame:
    rows = in_order(df, page, order)
    told = scan(F.col("rows"), F.struct(F.array().cast(state).alias("kept")), emits, step)
    return rows.select(*page, F.explode(F.zip_with("rows", told, lambda r, o: r.withField("_out", o))).alias("r")).select(*page, "r.*")


def distinct_boxes(df: DataFrame, page: Sequence[str], order: str, tolerance: float = 1.0) -> DataFrame:
    """Boxes of a page in order: those not within the tolerance of one kept before on all edges."""
    edges = ("x0", "y0", "x1", "y1")

    def step(state: Column, r: Column) -> Column:
        new = ~F.exists(state["kept"], lambda k: reduce(and_, [F.abs(r[e] - k[e]) <= tolerance for e in edges]))
        kept = F.when(new, F.concat(state["kept"], F.array(F.struct(*[r[e].alias(e) for e in edges])))).otherwise(state["kept"])
        return F.struct(F.struct(kept.alias("kept")).alias("state"), new.alias("out"))

    doubles = df.select(*page, order, *[F.col(e).cast("double").alias(e) for e in edges])
    return _listed(doubles, page, order, "array<struct<x0:double,y0:double,x1:double,y1:double>>", "boolean", step).where("_out").drop("_out")


def visual_lines(df: DataFrame, page: Sequence[str], order: str) -> DataFrame:
    """Pieces (y0, y1) of a page in order with `line`: the first line so far that shares more than half of the smaller height, or a new one."""
    def step(state: Column, r: Column) -> Column:
        lines = state["kept"]
        shares = F.transform(lines, lambda k: F.least(k["y1"], r["y1"]) - F.greatest(k["y0"], r["y0"]) > 0.5 * F.least(k["y1"] - k["y0"], r["y1"] - r["y0"]))
        own = F.struct(r["y0"].alias("y0"), r["y1"].alias("y1"))

        def put(at: Column) -> Column:
            grown = F.transform(lines, lambda k, i: F.when(i == at, F.struct(F.least(k["y0"], r["y0"]).alias("y0"), F.greatest(k["y1"], r["y1"]).alias("y1"))).otherwise(k))
            return F.struct(F.struct(F.when(at == F.size(lines), F.concat(lines, F.array(own))).otherwise(grown).alias("kept")).alias("state"), at.alias("out"))

        return let(F.when(F.exists(shares, lambda x: x), (F.array_position(shares, True) - 1).cast("int")).otherwise(F.size(lines)), put)

    doubles = df.withColumns({"y0": F.col("y0").cast("double"), "y1": F.col("y1").cast("double")})
    return _listed(doubles, page, order, "array<struct<y0:double,y1:double>>", "int", step).withColumnRenamed("_out", "line")


def baseline_parts(df: DataFrame, line: Sequence[str], order: str, y: str, size: str) -> DataFrame:
    """`part`: pieces of a line fall apart where the baseline jumps by over 0.3 of the size, between sizes alike within 15 %."""
    w = ordered(line, [order])
    jump = (F.abs(F.col(y) - F.lag(y).over(w)) > 0.3 * F.col(size)) & (F.abs(F.col(size) - F.lag(size).over(w)) <= 0.15 * F.lag(size).over(w))
    return islands(df, line, [order], jump, "part")


def in_margin(y: Column, height: Column, top: float = 0.12, bottom: float = 0.10) -> Column:
    """Where headers and footers stand."""
    return (y < height * top) | (y >= height * (1 - bottom))


def grid_cells(cells: DataFrame, page: Sequence[str], tolerance: float = 3.0) -> DataFrame:
    """cells (x0, y0, x1, y1) of a table -> row, col, rowspan, colspan by the edges that all its cells share."""
    edges = cells.groupBy(*page).agg(kept_apart(F.array_union(F.collect_set("x0"), F.collect_set("x1")), tolerance).alias("_xs"), kept_apart(F.array_union(F.collect_set("y0"), F.collect_set("y1")), tolerance).alias("_ys"))

    def at(edge: str, x: str) -> Column:
        return F.array_min(F.transform(edge, lambda e, i: F.struct(F.abs(e - F.col(x)).alias("gap"), i.alias("i"))))["i"]

    met = cells.join(edges, list(page)).withColumns({"row": at("_ys", "y0"), "col": at("_xs", "x0"), "_r": at("_ys", "y1"), "_c": at("_xs", "x1")})
    return met.withColumns({"rowspan": F.greatest(F.col("_r") - F.col("row"), F.lit(1)), "colspan": F.greatest(F.col("_c") - F.col("col"), F.lit(1))}).drop("_xs", "_ys", "_r", "_c")


def slide_order(df: DataFrame, page: Sequence[str], name: str = "place") -> DataFrame:
    """Rows of twelve points from the top, then from the left."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*page).orderBy(F.bround(F.col("y0") / 12, 0), "x0", "y0")))
