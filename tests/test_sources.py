import zipfile

from pyspark.sql import functions as F

from lectern.sources import office
from lectern.sources.files import format_of

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
S = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def docx(path):
    def p(text, style="", more="", props=""):
        return f'<w:p><w:pPr>{f"<w:pStyle w:val=\'{style}\'/>" if style else ""}{props}</w:pPr>{more}<w:r><w:t>{text}</w:t></w:r></w:p>' if text else "<w:p/>"

    body = p("Title", "T") + p("One", "H1") + p("Two", "H2") + p("x", "TOC") + p("") + p("", "")
    body += '<w:p><w:r><w:rPr><w:b/><w:color w:val="ff0000"/></w:rPr><w:t>bold</w:t></w:r><w:r><w:rPr><w:i/><w:b w:val="0"/></w:rPr><w:t> it</w:t><w:br/><w:t>next</w:t></w:r></w:p>' + p("") + p("")
    body += "<w:sdt><w:sdtContent>" + p("item", props='<w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr>') + "</w:sdtContent></w:sdt>" + p("")
    body += '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/><w:shd w:fill="d9d9d9"/></w:tcPr><w:p><w:r><w:t>head</w:t></w:r></w:p></w:tc></w:tr>'
    body += '<w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr>'
    body += "<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    body += '<w:p><w:r/><wp:inline><wp:extent cx="2540000" cy="1270000"/><wp:docPr descr="pic"/></wp:inline></w:p>' + p("")
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/>{b}{o}</w:style>' for i, n, b, o in (
        ("T", "Title", "", ""), ("H1", "heading 1", "", '<w:pPr><w:outlineLvl w:val="0"/></w:pPr>'), ("H2", "mine", '<w:basedOn w:val="H2b"/>', ""), ("H2b", "heading 2", "", '<w:pPr><w:outlineLvl w:val="1"/></w:pPr>'), ("TOC", "toc 1", "", "")))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")


def pptx(path):
    def sp(text, ph="", x=0, y=0):
        at = f'<a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="127000" cy="127000"/></a:xfrm>'
        return f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type=\'{ph}\'/>" if ph else ""}</p:nvPr></p:nvSpPr><p:spPr>{at}</p:spPr><p:txBody><a:p><a:pPr lvl="1"/><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'

    group = f'<p:grpSp><p:grpSpPr><a:xfrm><a:off x="1270000" y="0"/><a:ext cx="254000" cy="254000"/><a:chOff x="0" y="0"/><a:chExt cx="127000" cy="127000"/></a:xfrm></p:grpSpPr>{sp("in group", x=12700)}</p:grpSp>'
    table = '<p:graphicFrame><p:xfrm><a:off x="0" y="0"/><a:ext cx="1" cy="1"/></p:xfrm><a:tbl><a:tr><a:tc gridSpan="2"><a:p><a:r><a:t>h</a:t></a:r></a:p></a:tc><a:tc hMerge="1"/></a:tr></a:tbl></p:graphicFrame>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {S}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>')
        for n, shapes in ((1, sp("second", "title")), (2, sp("first", "title") + sp("9", "sldNum") + group + table + '<p:cxnSp><p:spPr/></p:cxnSp>')):
            z.writestr(f"ppt/slides/slide{n}.xml", f"<p:sld {S}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>")


def test_word_files(spark, tmp_path):
    docx(tmp_path / "a.docx")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    rows = office.read_docx(spark, str(tmp_path)).orderBy("path", "pos").collect()
    assert [r.error is not None for r in rows if r.path.endswith("bad.docx")] == [True]
    rows = [r for r in rows if r.path.endswith("a.docx")]
    assert [(r.kind, r.text, r.level) for r in rows if r.kind != "cell"] == [
        ("heading", "Title", 1), ("heading", "One", 1), ("heading", "Two", 2), ("paragraph", "bold it", 0), ("paragraph", "next", 0), ("paragraph", "", 0), ("bullet", "item", 1), ("image", "pic", 0)]
    assert [r.selected for r in rows[:3]] == [False, True, True] and [r.spacer for r in rows].count(True) == 1
    bold = next(r for r in rows if r.text == "bold it").runs
    assert [(r["text"], r["bold"], r["italic"], r["color"]) for r in bold] == [("bold", True, False, "#FF0000"), (" it", False, True, None)]
    assert [(r.text, r.row, r.col, r.rowspan, r.colspan, r.background) for r in rows if r.kind == "cell"] == [("head", 0, 0, 1, 2, "#D9D9D9"), ("a", 1, 0, 2, 1, None), ("b", 1, 1, 1, 1, None), ("c", 2, 1, 1, 1, None)]
    assert [(r.width, r.height) for r in rows if r.kind == "image"] == [(200.0, 100.0)]


def test_slide_files(spark, tmp_path):
    pptx(tmp_path / "a.pptx")
    rows = office.read_pptx(spark, str(tmp_path)).orderBy("slide", "ord").collect()
    assert [(r.slide, r.kind, r.ph, r.text) for r in rows] == [(1, "text", "title", "first"), (1, "text", None, "in group"), (1, "cell", None, "h"), (1, "connector", None, ""), (2, "text", "title", "second")]
    assert (rows[1].x0, rows[1].x1, rows[1].level) == (102.0, 122.0, 1)


def test_formats_and_metafiles(spark):
    rows = spark.createDataFrame([(bytes.fromhex("D7CDC69A00"),), (b"\x89PNG",), (bytes.fromhex("0100090000"),)], "data binary")
    assert [r[0] for r in rows.select(office.is_metafile(F.col("data"))).collect()] == [True, False, True]
    assert [r.error for r in format_of(spark.createDataFrame([("x.pdf",), ("x.doc",)], "path string"), "path").collect()] == ["no reader", "old format"]


def test_files_of_all_kinds_become_outlines(spark, tmp_path):
    from lectern.sources import documents

    docx(tmp_path / "a.docx")
    pptx(tmp_path / "b.pptx")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:  # a package without a body
        z.writestr("word/document.xml", f"<w:document {W}/>")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "e.pptx").write_bytes(b"PK")
    rows = {r.path.rsplit("/", 1)[1]: r for r in documents.outline(documents.read(spark, str(tmp_path))).collect()}
    assert {k for k, r in rows.items() if r.error} == {"c.docx", "d.pdf", "e.pptx"} and rows["d.pdf"].error == "no reader"
    assert rows["a.docx"].outline.split("\n") == ["# Title", "# One", "## Two", "bold it", "next", "  - item", "head", "a | b", "c", "pic"]
    assert rows["b.pptx"].outline.split("\n") == ["# first", "  - in group", "h", "# second"]
