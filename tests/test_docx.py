"""Small archives for what is peculiar to the format."""

import io
import zipfile

from docflow.sources.docx import Docx, deobfuscated, read_docx

NS = 'xmlns:w="w" xmlns:r="r" xmlns:wp="wp" xmlns:a="a"'
DOCUMENT = f"""<w:document {NS}><w:body>
<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p/><w:p></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>one</w:t><w:tab/><w:br/><w:t>x</w:t></w:r><w:r><w:t>y</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:br w:type="page"/><w:t>two</w:t></w:r></w:p>
<w:tbl><w:tblPr><w:tblW w:w="5000" w:type="pct"/></w:tblPr><w:tblGrid><w:gridCol w:w="100"/><w:gridCol w:w="300"/></w:tblGrid>
<w:tr><w:tc><w:p><w:r><w:br w:type="page"/><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:r><w:drawing><wp:inline><wp:extent cx="127000" cy="254000"/><a:blip r:embed="rId2"/></wp:inline></w:drawing></w:r></w:p>
<w:sectPr><w:headerReference w:type="default" r:id="rId1"/><w:headerReference w:type="first" r:id="rId9"/><w:pgSz w:w="10000" w:h="12000"/><w:pgMar w:left="1000" w:right="1000" w:top="1000" w:bottom="1000" w:header="500"/></w:sectPr></w:body></w:document>"""
STYLES = f'<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="24"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:styleId="B"><w:name w:val="Base"/><w:rPr><w:i/><w:sz w:val="40"/></w:rPr></w:style><w:style w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="B"/><w:rPr><w:b/></w:rPr></w:style></w:styles>'
NUMBERING = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="upperRoman"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/><w:lvlText w:val=""/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
RELS = '<Relationships><Relationship Id="rId1" Target="header1.xml"/><Relationship Id="rId2" Target="/word/media/i.png"/></Relationships>'
HEADER = f'<w:hdr {NS}><w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> page </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>1</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p></w:hdr>'
FONTS = f'<w:fonts {NS}><w:font w:name="F"><w:embedRegular r:id="rId1" w:fontKey="{{00010203-0405-0607-0809-0A0B0C0D0E0F}}"/></w:font></w:fonts>'
FONT_RELS = '<Relationships><Relationship Id="rId1" Target="fonts/f.odttf"/></Relationships>'


def archive(**more):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as file:
        for name, data in {"word/document.xml": DOCUMENT, "word/styles.xml": STYLES, "word/numbering.xml": NUMBERING, "word/_rels/document.xml.rels": RELS, "word/header1.xml": HEADER, "word/media/i.png": b"\x89PNGxx", "word/fontTable.xml": FONTS, "word/_rels/fontTable.xml.rels": FONT_RELS, "word/fonts/f.odttf": bytes(range(16)) * 3, **more}.items():
            file.writestr(name, data)
    return buffer.getvalue()


def test_archive(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(archive())
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    docx = read_docx(spark, str(tmp_path))
    g = docx.geometry().collect()
    assert len(g) == 1 and (g[0].page_w, g[0].page_h, g[0].header_margin, g[0].footer_margin) == (500.0, 600.0, 25.0, 36.0)
    body = docx.paragraphs().where("part = 'word/document.xml'").orderBy("ord").collect()
    assert [(r.text, r.list_prefix) for r in body] == [("Title", None), ("", None), ("one\txy", "III. "), ("two", "• "), ("c1", None), ("c2", None), ("", None)]
    runs = {(r.part, r.ord, r.run_no): r for r in docx.runs().collect()}
    title, first, last = runs["word/document.xml", 0, 0], runs["word/document.xml", 2, 0], runs["word/document.xml", 2, 3]
    assert (title.bold, title.italic, title.size_pt) == (True, True, 20.0)
    assert (first.bold, last.bold, last.size_pt) == (True, False, 12.0)
    assert runs["word/header1.xml", 0, 0].is_page_number
    assert {(r.role, r.part) for r in docx.headers().collect()} == {("header", "word/header1.xml"), ("header_first", "word/header1.xml")}
    assert [(r.title, r.depth, r.page) for r in docx.outline().collect()] == [("Title", 0, 0)]
    assert docx.page_counts().first().page_count == 2
    image = docx.images().first()
    assert (image.format, image.width_emu, image.height_emu) == ("png", 127000, 254000)
    assert docx.embedded_fonts().first().content == bytes(32) + bytes(range(16))
    assert {(r.row, r.cell, r.grid_span) for r in docx.table("cell").collect()} == {(0, 0, 1), (0, 1, 2)}
    assert [r.text for r in docx.page_texts().orderBy("page_index").collect()] == ["Title\n\none\txy\ntwo", ""]


def test_not_documents(spark):
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as file:
        file.writestr("ppt/slides.xml", "<x/>")
    rows = [("broken", bytearray(b"PK\x03\x04junk")), ("slides", bytearray(other.getvalue())), ("bare", bytearray(archive(**{"word/styles.xml": "<broken", "word/document.xml": f"<w:document {NS}><w:body/></w:document>"}))), ("none", None)]
    docx = Docx(spark.createDataFrame(rows, "doc_id string, content binary"))
    assert [r.doc_id for r in docx.geometry().collect()] == ["bare"]
    assert docx.paragraphs().where("part = 'word/document.xml'").count() == 0


def test_font_key():
    assert deobfuscated(b"abcd", "not a key") == b"abcd"
    assert deobfuscated(b"\x01", "01" * 16) == b"\x00"


def test_formats_and_margins(spark):
    styled = STYLES.replace("</w:styles>", '<w:style w:styleId="T0"><w:tblPr><w:tblCellMar><w:top w:w="5"/><w:left w:w="7"/></w:tblCellMar></w:tblPr></w:style><w:style w:styleId="T1"><w:basedOn w:val="T0"/><w:tblPr><w:tblCellMar><w:left w:w="9"/></w:tblCellMar></w:tblPr></w:style></w:styles>')
    document = DOCUMENT.replace("<w:tblPr>", '<w:tblPr><w:tblStyle w:val="T1"/>')
    docx = Docx(spark.createDataFrame([("a", bytearray(archive(**{"word/styles.xml": styled, "word/document.xml": document})))], "doc_id string, content binary"))
    margins = docx.cell_margins().first()
    assert (margins.top, margins.left, margins.bottom, margins.right) == (5, 9, 0, 108)
    assert [r.format for r in docx.formats().collect()] == ["docx"]
