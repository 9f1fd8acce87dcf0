"""Word and slide files as rows, with nothing but zip and XML from the standard library.

Files come through Spark's binaryFile reader, so any store that Spark reads will do; each is parsed in an Arrow batch of its own.
A file that can't be read gives an error row, not a failed job.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lectern.schemas import RUN

# Namespaces of the formats, and units of a point.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
EMU = 12700
#: Placeholders that repeat on every slide.
FURNITURE = ("sldNum", "dt", "ftr", "hdr")

BLOCKS = f"path string, pos int, kind string, text string, runs array<{RUN}>, level int, style string, selected boolean, spacer boolean, num_id string, row int, col int, rowspan int, colspan int, background string, width double, height double, error string"
SHAPES = "path string, slide int, ord int, kind string, ph string, x0 double, y0 double, x1 double, y1 double, row int, col int, level int, text string, error string"


def _on(el: ElementTree.Element | None, name: str) -> bool:
    found = el.find(W + name) if el is not None else None
    return found is not None and found.get(W + "val", "1") not in ("0", "false", "none")


def _runs(paragraph: ElementTree.Element) -> list[dict]:
    out = []
    for r in paragraph.iter(W + "r"):
        props = r.find(W + "rPr")
        text = ""
        for el in r:
            text += el.text or "" if el.tag == W + "t" else "\t" if el.tag == W + "tab" else "\n" if el.tag in (W + "br", W + "cr") else ""
        if not text:
            continue
        align = props.find(W + "vertAlign") if props is not None else None
        color = props.find(W + "color") if props is not None else None
        code = color.get(W + "val", "auto").upper() if color is not None else "AUTO"
        dark = code == "AUTO" or max(int(code[i : i + 2], 16) for i in (0, 2, 4)) < 0x30
        out.append({
            "text": text, "bold": _on(props, "b"), "italic": _on(props, "i"), "underline": _on(props, "u"), "superscript": align is not None and align.get(W + "val") == "superscript",
            "subscript": align is not None and align.get(W + "val") == "subscript", "color": None if dark else "#" + code, "highlight": None,
        })
    return out


def _by_line(runs: list[dict]) -> list[list[dict]]:
    lines: list[list[dict]] = [[]]
    for r in runs:
        for i, part in enumerate(r["text"].replace("\r", "\n").split("\n")):
            if i:
                lines.append([])
            if part:
                lines[-1].append(r | {"text": part})
    return [x for x in lines if "".join(r["text"] for r in x).strip()]


def _styles(package: zipfile.ZipFile) -> dict[str, dict]:
    """Style id -> name, heading level, own or nearest ancestor's."""
    if "word/styles.xml" not in package.namelist():
        return {}
    own = {}
    for s in ElementTree.fromstring(package.read("word/styles.xml")).iter(W + "style"):
        name, base, outline = s.find(W + "name"), s.find(W + "basedOn"), s.find(f"{W}pPr/{W}outlineLvl")
        own[s.get(W + "styleId")] = {"name": name.get(W + "val") if name is not None else "", "base": base.get(W + "val") if base is not None else None, "level": int(outline.get(W + "val")) if outline is not None else None}
    for s in own.values():
        at, hops = s, 0
        while at is not None and at["level"] is None and hops < 20:
            at, hops = own.get(at["base"]), hops + 1
        s["heading"] = at["level"] if at is not None else None
    return own


def docx_blocks(data: bytes) -> Iterator[dict]:
    package = zipfile.ZipFile(io.BytesIO(data))
    styles = _styles(package)
    body = ElementTree.fromstring(package.read("word/document.xml")).find(W + "body")

    def walk(parent: ElementTree.Element) -> Iterator[ElementTree.Element]:
        for el in parent:
            if el.tag == W + "sdt":
                content = el.find(W + "sdtContent")
                if content is not None:
                    yield from walk(content)
            elif el.tag in (W + "p", W + "tbl"):
                yield el

    def paragraph(p: ElementTree.Element) -> Iterator[dict]:
        props = p.find(W + "pPr")
        style = props.find(W + "pStyle") if props is not None else None
        style = styles.get(style.get(W + "val") if style is not None else "", {"name": "", "heading": None})
        if style["name"].lower().startswith("toc"):
            return
        number = props.find(W + "numPr") if props is not None else None
        num_id = number.find(W + "numId").get(W + "val") if number is not None and number.find(W + "numId") is not None else None
        depth = number.find(W + "ilvl") if number is not None else None
        title = style["name"].lower() == "title"
        heading = style["heading"] if not title else 0
        for d in p.iter(WP + "inline"):
            size = d.find(WP + "extent")
            yield {"kind": "image", "text": (d.find(WP + "docPr").get("descr") or "") if d.find(WP + "docPr") is not None else "", "width": int(size.get("cx")) / EMU, "height": int(size.get("cy")) / EMU}
        lines = _by_line(_runs(p))
        if not lines and p.find(f".//{WP}inline") is None:
            yield {"kind": "paragraph", "text": "", "spacer": True}
        for runs in lines:
            kind = "heading" if heading is not None and heading < 9 else "bullet" if num_id not in (None, "0") else "paragraph"
            yield {"kind": kind, "text": "".join(r["text"] for r in runs), "runs": runs, "style": style["name"] or None, "selected": not title, "num_id": num_id,
                   "level": heading + 1 if kind == "heading" else int(depth.get(W + "val")) if depth is not None else 0}

    def table(t: ElementTree.Element) -> Iterator[dict]:
        open_: dict[int, dict] = {}
        for row, tr in enumerate(t.findall(W + "tr")):
            col = 0
            for tc in tr.findall(W + "tc"):
                props = tc.find(W + "tcPr")
                span = props.find(W + "gridSpan") if props is not None else None
                merge = props.find(W + "vMerge") if props is not None else None
                shade = props.find(W + "shd") if props is not None else None
                fill = shade.get(W + "fill", "auto") if shade is not None else "auto"
                width = int(span.get(W + "val")) if span is not None else 1
                if merge is not None and merge.get(W + "val") != "restart" and col in open_:
                    open_[col]["rowspan"] += 1
                else:
                    text = " / ".join(x for p in tc.iter(W + "p") if (x := "".join(r["text"] for r in _runs(p)).strip()))
                    cell = {"kind": "cell", "text": text, "row": row, "col": col, "rowspan": 1, "colspan": width, "background": None if fill.lower() in ("auto", "ffffff") else "#" + fill.upper()}
                    open_[col] = cell
                    yield cell
                col += width

    for el in walk(body):
        yield from paragraph(el) if el.tag == W + "p" else list(table(el))


def _tidied(blocks: list[dict]) -> list[dict]:
    """Blank paragraphs once between texts, none at the ends or beside headings, tables and images."""
    out: list[dict] = []
    apart = ("heading", "cell", "image")
    for b in blocks:
        if b.get("spacer"):
            if not out or out[-1].get("spacer") or out[-1]["kind"] in apart:
                continue
        elif b["kind"] in apart and out and out[-1].get("spacer"):
            out.pop()
        out.append(b)
    if out and out[-1].get("spacer"):
        out.pop()
    return out


def _related(package: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    rels = ElementTree.fromstring(package.read(f"{folder}/_rels/{name}.rels"))
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/") for r in rels}


def pptx_shapes(data: bytes) -> Iterator[dict]:
    package = zipfile.ZipFile(io.BytesIO(data))
    deck, related = ElementTree.fromstring(package.read("ppt/presentation.xml")), _related(package, "ppt/presentation.xml")
    slides = [related[s.get(R + "id")] for s in deck.iter(P + "sldId")]
    for number, part in enumerate(slides, 1):
        tree = ElementTree.fromstring(package.read(part)).find(f"{P}cSld/{P}spTree")
        for order, shape in enumerate(_shapes(tree, (1.0, 0.0, 1.0, 0.0))):
            yield {"slide": number, "ord": order} | shape


def _box(xfrm: ElementTree.Element | None, t: tuple) -> dict:
    if xfrm is None or xfrm.find(A + "off") is None:
        return {"x0": None, "y0": None, "x1": None, "y1": None}
    off, ext = xfrm.find(A + "off"), xfrm.find(A + "ext")
    x, y = int(off.get("x")) * t[0] + t[1], int(off.get("y")) * t[2] + t[3]
    return {"x0": x / EMU, "y0": y / EMU, "x1": (x + int(ext.get("cx")) * t[0]) / EMU, "y1": (y + int(ext.get("cy")) * t[2]) / EMU}


def _inner(xfrm: ElementTree.Element | None, t: tuple) -> tuple:
    """What takes a group's own coordinates to the slide's."""
    if xfrm is None or xfrm.find(A + "chExt") is None:
        return t
    off, ext, child, size = (xfrm.find(A + n) for n in ("off", "ext", "chOff", "chExt"))
    sx, sy = (int(ext.get(n)) / (int(size.get(n)) or 1) for n in ("cx", "cy"))
    return t[0] * sx, (int(off.get("x")) - int(child.get("x")) * sx) * t[0] + t[1], t[2] * sy, (int(off.get("y")) - int(child.get("y")) * sy) * t[2] + t[3]


def _shapes(tree: ElementTree.Element, t: tuple) -> Iterator[dict]:
    def text(p: ElementTree.Element) -> str:
        return "".join(e.text or "" if e.tag == A + "t" else "\v" if e.tag == A + "br" else "" for e in p.iter()).replace("\v", " ")

    for el in tree:
        ph = el.find(f".//{P}nvPr/{P}ph")
        kind_of = ph.get("type", "body") if ph is not None else None
        if kind_of in FURNITURE:
            continue
        if el.tag == P + "grpSp":
            yield from _shapes(el, _inner(el.find(f"{P}grpSpPr/{A}xfrm"), t))
        elif el.tag == P + "sp":
            box = _box(el.find(f"{P}spPr/{A}xfrm"), t)
            for p in el.iter(A + "p"):
                if line := text(p).strip():
                    props = p.find(A + "pPr")
                    yield {"kind": "text", "ph": kind_of, "level": int(props.get("lvl", 0)) if props is not None else 0, "text": line} | box
        elif el.tag == P + "cxnSp":
            yield {"kind": "connector", "text": ""} | _box(el.find(f"{P}spPr/{A}xfrm"), t)
        elif el.tag == P + "pic":
            yield {"kind": "picture", "text": el.find(f"{P}nvPicPr/{P}cNvPr").get("descr", "")} | _box(el.find(f"{P}spPr/{A}xfrm"), t)
        elif el.tag == P + "graphicFrame":
            box = _box(el.find(P + "xfrm"), t)
            if (table := el.find(f".//{A}tbl")) is None:
                yield {"kind": "chart", "text": ""} | box
                continue
            for row, tr in enumerate(table.findall(A + "tr")):
                for col, tc in enumerate(tr.findall(A + "tc")):
                    if tc.get("hMerge") not in ("1", "true") and tc.get("vMerge") not in ("1", "true"):
                        yield {"kind": "cell", "row": row, "col": col, "text": " / ".join(x for p in tc.iter(A + "p") if (x := text(p).strip()))} | box


def _reader(parse, schema: str):
    names = [x.strip().split()[0] for x in schema.replace(RUN, "run").split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = list(parse(bytes(data)))
                except Exception as e:  # whatever a file holds, it is one row: packages may be cut, locked, or lack any part
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                out = pd.DataFrame([{"pos": i, "selected": True, "spacer": False, "level": 0} | r | {"path": path} for i, r in enumerate(rows)], columns=names)
                yield out.astype(object).where(out.notna(), None)

    return run


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def docx_rows(contents: DataFrame) -> DataFrame:
    """Blocks of Word files given as path and content."""
    return contents.select("path", "content").mapInPandas(_reader(lambda data: _tidied(list(docx_blocks(data))), BLOCKS), BLOCKS)


def pptx_rows(contents: DataFrame) -> DataFrame:
    """Shapes of slide files given as path and content, in the order of slides and of drawing; groups are laid out on the slide."""
    return contents.select("path", "content").mapInPandas(_reader(pptx_shapes, SHAPES), SHAPES)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all Word files below a path."""
    return docx_rows(files(spark, path, "*.docx"))


def read_pptx(spark: SparkSession, path: str) -> DataFrame:
    """Shapes of all slide files below a path."""
    return pptx_rows(files(spark, path, "*.pptx"))


def is_metafile(data):
    """Placeable or plain Windows metafiles, by their first bytes."""
    from pyspark.sql import functions as F

    first = F.hex(F.substring(data, 1, 4))
    return (first == "D7CDC69A") | (first == "01000900") | (first == "02000900")
