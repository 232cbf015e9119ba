"""Word-processing archives as tables.

Archives are read with Spark's binary reader, so any path works that Spark can read. Each archive's parts become rows;
each XML part is parsed where it lies into typed rows (blocks, runs, cells, sections, styles, numbering, references);
everything that relates rows to each other - inheritance, numbering, references to parts, outline, pages - is a join or
a window over those tables (docflow.operators.structure).
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.functions.labels import ALIGN, BORDER, heading_level, image_format, is_zip
from docflow.operators import structure
from docflow.sources.storage import materialize

TWIPS, HALF_POINTS = 20.0, 2.0
# Page size and margins where a document names none (points), and the distances of header and footer.
PAGE = {"page_w": 612.0, "page_h": 792.0, "margin_l": 72.0, "margin_r": 72.0, "margin_t": 72.0, "margin_b": 72.0, "header_margin": 36.0, "footer_margin": 36.0, "page_num_start": 1}
#: Properties that a style or a run can set.
RUN_PROPERTIES = ("bold", "italic", "underline", "strike", "size_pt", "color", "font")
PARAGRAPH_PROPERTIES = ("align", "space_before", "space_after", "line_pct", "indent_left", "indent_right", "indent_first", "outline_level")
_TYPES = {"bold": "boolean", "italic": "boolean", "underline": "boolean", "strike": "boolean", "size_pt": "double", "color": "string", "font": "string", "align": "string", "outline_level": "int"}
PROPERTY_DDL = ", ".join(f"{p} {_TYPES.get(p, 'double')}" for p in (*RUN_PROPERTIES, *PARAGRAPH_PROPERTIES))
SCHEMAS = {
    "block": f"part string, ord long, kind string, style_id string, num_id int, ilvl int, text string, mark_size double, table_no long, row int, cell int, {PROPERTY_DDL}",
    "run": f"part string, ord long, run_no int, text string, is_page_number boolean, run_style string, image_rid string, anchored boolean, behind boolean, width_emu long, height_emu long, x_emu long, y_emu long, base_font string, {PROPERTY_DDL}",
    "tab": "part string, ord long, pos_dxa long, align string, leader string",
    "table": "part string, table_no long, parent_table long, style_id string, width_dxa long, width_is_pct boolean, indent_dxa long, grid array<long>, borders map<string,string>, margins map<string,long>",
    "cell": "part string, table_no long, row int, cell int, grid_span int, width_dxa long, bg_color string, row_height long, exact boolean, borders map<string,string>, margins map<string,long>",
    "geometry": "page_w double, page_h double, margin_l double, margin_r double, margin_t double, margin_b double, header_margin double, footer_margin double, page_num_start int",
    "section": "section int, header_rid string, footer_rid string",
    "style": f"style_id string, based_on string, name string, margins map<string,long>, is_default boolean, {PROPERTY_DDL}",
    "level": "abstract_id int, ilvl int, start int, fmt string, level_text string, indent_left_dxa long, hanging_dxa long",
    "number": "num_id int, abstract_id int",
    "rel": "part string, rid string, target string",
    "font": "name string, rid string, font_key string",
}


# XML --------------------------------------------------------------------------------------------------------------


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)
    closed: bool = False  # written as one tag

    def each(self, tag: str) -> Iterator[Node]:
        return (c for c in self.children if isinstance(c, Node) and c.tag == tag)

    def first(self, tag: str) -> Node | None:
        return next(self.each(tag), None)

    def all(self, *tags: str) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                if c.tag in tags:
                    yield c
                yield from c.all(*tags)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def value(self, name: str = "w:val") -> str | None:
        return self.attrs.get(name)


def parse_xml(data: bytes) -> Node:
    """The part's tree with qualified names as written; what follows an error is left out."""
    root = Node("", {})
    stack = [root]
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(tag, attrs):
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        stack.append(node)

    def end(_):
        node, place = stack.pop(), parser.CurrentByteIndex
        node.closed = not node.children and data[place - 2 : place] == b"/>"

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda text: stack[-1].children.append(text)
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        pass
    return root


def _float(text: str | None) -> float | None:
    try:
        return float(text) if text is not None else None
    except ValueError:
        return None


def _int(text: str | None) -> int | None:
    return int(text) if text is not None and text.strip().lstrip("+-").isdigit() else None


def _on(node: Node) -> bool:
    return node.value() not in ("0", "false", "off")


def _color(text: str | None) -> str | None:
    return text.upper() if text and len(text) == 6 and all(c in "0123456789abcdefABCDEF" for c in text) else None


def properties_of(node: Node) -> dict:
    """What one property element sets."""
    tag, a = node.tag, node.attrs
    if tag in ("w:b", "w:i"):
        return {"bold" if tag == "w:b" else "italic": _on(node)}
    if tag in ("w:strike", "w:dstrike"):
        return {"strike": _on(node)}
    if tag == "w:u":
        return {"underline": node.value() not in ("none", "0", "false")}
    if tag == "w:sz" and (v := _float(node.value())) is not None:
        return {"size_pt": v / HALF_POINTS}
    if tag == "w:color" and (c := _color(node.value())):
        return {"color": c}
    if tag == "w:rFonts" and (name := a.get("w:ascii") or a.get("w:hAnsi") or a.get("w:cs")):
        return {"font": name}
    if tag == "w:jc" and node.value() is not None:
        return {"align": ALIGN.get(node.value(), "left")}
    if tag == "w:outlineLvl" and (v := _int(node.value())) is not None:
        return {"outline_level": v}
    if tag == "w:spacing":
        out = {name: v / TWIPS for key, name in (("w:after", "space_after"), ("w:before", "space_before")) if (v := _float(a.get(key))) is not None}
        line, rule = _float(a.get("w:line")), a.get("w:lineRule", "")
        if line is not None and rule in ("", "auto"):
            out["line_pct"] = line / 240
        elif line is not None and rule in ("exact", "atLeast"):
            out["line_pct"] = line / TWIPS / 12
        return out
    if tag == "w:ind":
        out = {name: v / TWIPS for key, name in (("w:left", "indent_left"), ("w:right", "indent_right")) if (v := _float(a.get(key))) is not None}
        if (v := _float(a.get("w:firstLine"))) is not None:
            out["indent_first"] = v / TWIPS
        elif (v := _float(a.get("w:hanging"))) is not None:
            out["indent_first"] = -v / TWIPS
        return out
    return {}


def _sides(node: Node | None) -> dict[str, int]:
    return {side.tag[2:]: v for side in (node.children if node else ()) if isinstance(side, Node) and (v := _int(side.attrs.get("w:w"))) is not None}


def _borders(node: Node | None) -> dict[str, str]:
    """Side -> "style:eighths of a point:colour"."""
    return {s.tag[2:]: f"{BORDER.get(s.value() or '', 'none')}:{_int(s.attrs.get('w:sz')) or 0}:{_color(s.attrs.get('w:color')) or '000000'}" for s in (node.children if node else ()) if isinstance(s, Node)}


# parts ------------------------------------------------------------------------------------------------------------


class BodyReader:
    """Rows of one body, header or footer part, in document order."""

    def __init__(self, part: str):
        self.part, self.rows = part, []
        self.ord = self.tables = 0
        self.geometry: dict = {}
        self.header = self.footer = None
        self.sections = 0

    def emit(self, target: str, /, **row) -> None:
        self.rows.append((target, {"part": self.part, **{k: v for k, v in row.items() if v is not None}}))

    def read(self, root: Node) -> None:
        self.blocks(root, None, None, None)
        if self.geometry:
            self.rows.append(("geometry", self.geometry))

    def blocks(self, node: Node, table, row, cell) -> None:
        for child in node.children:
            if not isinstance(child, Node):
                continue
            if child.tag == "w:p":
                if not child.closed:  # a paragraph that is one tag does not count
                    self.paragraph(child, table, row, cell)
            elif child.tag == "w:tbl":
                self.table(child, table, row, cell)
            elif child.tag == "w:sectPr":
                self.section(child, True)
            elif table is None or child.tag not in ("w:tcPr",):
                self.blocks(child, table, row, cell)

    def section(self, node: Node, top: bool) -> None:
        for child in node.children:
            if not isinstance(child, Node):
                continue
            a = child.attrs
            if child.tag in ("w:headerReference", "w:footerReference") and a.get("w:type") == "default" and a.get("r:id"):
                if child.tag == "w:headerReference":
                    self.header = a["r:id"]
                else:
                    self.footer = a["r:id"]
            elif child.tag == "w:pgSz" and top:
                self.geometry |= {k: v / TWIPS for k, n in (("page_w", "w:w"), ("page_h", "w:h")) if (v := _float(a.get(n))) is not None}
            elif child.tag == "w:pgMar":
                if top:
                    self.geometry |= {k: v / TWIPS for k, n in (("margin_l", "w:left"), ("margin_r", "w:right"), ("margin_t", "w:top"), ("margin_b", "w:bottom")) if (v := _float(a.get(n))) is not None}
                self.geometry |= {k: v / TWIPS for k, n in (("header_margin", "w:header"), ("footer_margin", "w:footer")) if (v := _float(a.get(n))) is not None and v > 0}
            elif child.tag == "w:pgNumType" and "page_num_start" not in self.geometry and (v := _int(a.get("w:start"))) is not None:
                self.geometry["page_num_start"] = v
        self.sections += 1
        self.rows.append(("section", {k: v for k, v in (("section", self.sections), ("header_rid", self.header), ("footer_rid", self.footer)) if v is not None}))

    def paragraph(self, node: Node, table, row, cell) -> None:
        number, self.ord = self.ord, self.ord + 1
        own: dict = {}
        style = num_id = ilvl = None
        overlay: dict = {}
        base_font = run_style = None
        page_field = breaks = False
        instruction, texts, run_no = "", [], 0

        def run(**row):
            nonlocal run_no
            self.emit("run", ord=number, run_no=run_no, run_style=run_style, base_font=base_font, **overlay, **row)
            run_no += 1

        properties = node.first("w:pPr")
        for p in properties.children if properties else ():
            if not isinstance(p, Node):
                continue
            if p.tag == "w:pStyle":
                style = p.value()
            elif p.tag == "w:numPr":
                for n in p.all("w:numId", "w:ilvl"):
                    v = _int(n.value())
                    if v is not None and n.tag == "w:numId":
                        num_id = v or None
                    elif v is not None:
                        ilvl = v
            elif p.tag == "w:tabs":
                for t in p.each("w:tab"):
                    self.emit("tab", ord=number, pos_dxa=_int(t.attrs.get("w:pos")) or 0, align=t.value() if t.value() in ("right", "center", "decimal") else "left", leader=t.attrs.get("w:leader") if t.attrs.get("w:leader") in ("dot", "hyphen", "underscore") else "none")
            elif p.tag == "w:rPr":  # the mark's formatting reaches the first run
                for r in p.children:
                    if isinstance(r, Node):
                        overlay |= properties_of(r)
                base_font = overlay.get("font", base_font)
            elif p.tag == "w:sectPr":
                self.section(p, False)
                breaks = True
            else:
                own |= properties_of(p)
        mark_size = overlay.get("size_pt")
        for r in node.all("w:r"):
            for child in r.children:
                if not isinstance(child, Node):
                    continue
                if child.tag == "w:rPr":
                    for p in child.children:
                        if isinstance(p, Node):
                            if p.tag == "w:rStyle":
                                run_style, overlay = p.value(), {}
                            overlay |= {k: v for k, v in properties_of(p).items() if k in RUN_PROPERTIES}
                    base_font = overlay.get("font", base_font)
                elif child.tag == "w:t":
                    text = child.text()
                    if text or page_field:
                        run(text=text, is_page_number=page_field)
                        texts.append(text)
                    page_field = False
                elif child.tag == "w:tab":
                    run(text="\t", is_page_number=False)
                    texts.append("\t")
                elif child.tag == "w:br":
                    breaks |= child.value("w:type") == "page"
                elif child.tag == "w:instrText":
                    instruction += child.text()
                elif child.tag == "w:fldChar":
                    kind = child.attrs.get("w:fldCharType")
                    page_field = kind == "separate" and "PAGE" in instruction.upper().split()
                    if kind in ("begin", "end"):
                        instruction = ""
                elif child.tag == "w:drawing":
                    self.drawing(child, run)
            run_style, overlay = None, {}
        self.emit("block", ord=number, kind="paragraph", style_id=style, num_id=num_id, ilvl=ilvl or 0, text="".join(texts), mark_size=mark_size, table_no=table, row=row, cell=cell, **own)
        if breaks and table is None:
            self.emit("block", ord=self.ord, kind="break", text="")
            self.ord += 1

    def drawing(self, node: Node, run) -> None:
        anchor = next(node.all("wp:anchor"), None)
        blip, legacy, extent = next(node.all("a:blip"), None), next(node.all("v:imagedata"), None), next(node.all("wp:extent"), None)
        rid = (blip.attrs.get("r:embed") if blip else None) or (legacy.attrs.get("r:id") if legacy else None)
        if rid:
            at = {k: _int(p.text().strip()) or 0 for k, t in (("x_emu", "wp:positionH"), ("y_emu", "wp:positionV")) if (p := next(node.all(t), None))}
            size = {k: _int(extent.attrs.get(n)) or 0 for k, n in (("width_emu", "cx"), ("height_emu", "cy"))} if extent else {}
            run(text="", is_page_number=False, image_rid=rid, anchored=anchor is not None, behind=anchor is not None and anchor.attrs.get("behindDoc") == "1", **size, **at)

    def table(self, node: Node, parent, outer_row, outer_cell) -> None:
        number, self.tables = self.tables, self.tables + 1
        place, self.ord = self.ord, self.ord + 1
        p = node.first("w:tblPr") or Node("", {})
        width, indent, style = p.first("w:tblW"), p.first("w:tblInd"), p.first("w:tblStyle")
        grid = [v for g in (node.first("w:tblGrid") or Node("", {})).each("w:gridCol") if (v := _int(g.attrs.get("w:w"))) is not None]
        self.emit("block", ord=place, kind="table", text="", table_no=number if parent is None else parent, row=outer_row, cell=outer_cell)
        self.emit("table", table_no=number, parent_table=parent, style_id=style.value() if style else None, width_dxa=(_int(width.attrs.get("w:w")) or 0) if width else 0, width_is_pct=bool(width) and width.attrs.get("w:type") == "pct", indent_dxa=(_int(indent.attrs.get("w:w")) or 0) if indent else 0, grid=grid, borders=_borders(p.first("w:tblBorders")), margins=_sides(p.first("w:tblCellMar")))
        for i, tr in enumerate(node.each("w:tr")):
            height = next((tr.first("w:trPr") or Node("", {})).all("w:trHeight"), None)
            for k, tc in enumerate(tr.each("w:tc")):
                c = tc.first("w:tcPr") or Node("", {})
                span, cell_width, shade = c.first("w:gridSpan"), c.first("w:tcW"), c.first("w:shd")
                self.emit("cell", table_no=number, row=i, cell=k, grid_span=max(_int(span.value()) or 1, 1) if span else 1, width_dxa=(_int(cell_width.attrs.get("w:w")) or 0) if cell_width else 0, bg_color=_color(shade.attrs.get("w:fill")) if shade else None, row_height=(_int(height.value()) or 0) if height else 0, exact=bool(height) and height.attrs.get("w:hRule") == "exact", borders=_borders(c.first("w:tcBorders")), margins=_sides(c.first("w:tcMar")))
                self.blocks(tc, number, i, k)


def _styles(root: Node) -> Iterator[tuple[str, dict]]:
    for defaults in root.all("w:docDefaults"):
        own: dict = {}
        for n in defaults.all("w:b", "w:i", "w:u", "w:strike", "w:sz", "w:color", "w:rFonts", "w:jc", "w:spacing", "w:ind"):
            own |= properties_of(n)
        yield "style", {"style_id": "", "is_default": True, **own}
    for style in root.all("w:style"):
        own, row = {}, {"style_id": style.attrs.get("w:styleId"), "is_default": False}
        if row["style_id"] is None:
            continue
        for n in style.all("w:name", "w:basedOn", "w:tblCellMar", "w:b", "w:i", "w:u", "w:strike", "w:dstrike", "w:sz", "w:color", "w:rFonts", "w:jc", "w:spacing", "w:ind", "w:outlineLvl"):
            if n.tag == "w:name":
                row["name"] = n.value()
            elif n.tag == "w:basedOn":
                row["based_on"] = n.value()
            elif n.tag == "w:tblCellMar":
                row["margins"] = _sides(n)
            else:
                own |= properties_of(n)
        yield "style", {k: v for k, v in {**row, **own}.items() if v is not None}


# The number formats that labels know.
_FORMATS = ("decimal", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman", "bullet", "none")


def _numbering(root: Node) -> Iterator[tuple[str, dict]]:
    for abstract in root.all("w:abstractNum"):
        number = _int(abstract.attrs.get("w:abstractNumId"))
        if number is None:
            continue
        levels = {}
        for level in abstract.all("w:lvl"):
            at = _int(level.attrs.get("w:ilvl"))
            if at is None:
                continue
            row = {"start": 1, "fmt": "decimal", "level_text": "", "indent_left_dxa": 720, "hanging_dxa": 360}
            for n in level.all("w:start", "w:numFmt", "w:lvlText", "w:ind"):
                if n.tag == "w:start" and (v := _int(n.value())) is not None:
                    row["start"] = v
                elif n.tag == "w:numFmt":
                    row["fmt"] = n.value() if n.value() in _FORMATS else "decimal"
                elif n.tag == "w:lvlText":
                    row["level_text"] = n.value() or ""
                elif n.tag == "w:ind":
                    row |= {k: v for k, a in (("indent_left_dxa", "w:left"), ("hanging_dxa", "w:hanging")) if (v := _int(n.attrs.get(a))) is not None}
            levels[at] = row
        for at in range(max(levels, default=-1) + 1):  # levels that are left out have the defaults
            yield "level", {"abstract_id": number, "ilvl": at, **levels.get(at, {"start": 1, "fmt": "decimal", "level_text": "", "indent_left_dxa": 720, "hanging_dxa": 360})}
    for num in root.all("w:num"):
        target = num.first("w:abstractNumId")
        if (a := _int(num.attrs.get("w:numId"))) is not None and target is not None and (b := _int(target.value())) is not None:
            yield "number", {"num_id": a, "abstract_id": b}


def _rels(root: Node, part: str) -> Iterator[tuple[str, dict]]:
    """References of a part; of two with one id the last counts."""
    found = {}
    for rel in root.all("Relationship"):
        rid, target = rel.attrs.get("Id"), rel.attrs.get("Target")
        if rid is not None and target is not None:
            found[rid] = target.lstrip("/") if target.startswith("/") else f"word/{target}"
    for rid, target in found.items():
        yield "rel", {"part": part, "rid": rid, "target": target}


def _fonts(root: Node) -> Iterator[tuple[str, dict]]:
    for font in root.all("w:font"):
        for embed in font.all("w:embedRegular", "w:embedBold", "w:embedItalic", "w:embedBoldItalic"):
            if font.attrs.get("w:name") and embed.attrs.get("r:id") and embed.attrs.get("w:fontKey"):
                yield "font", {"name": font.attrs["w:name"], "rid": embed.attrs["r:id"], "font_key": embed.attrs["w:fontKey"]}


def rows_of(name: str, content: bytes) -> Iterator[tuple[str, dict]]:
    """The rows that one part gives."""
    if name.startswith("word/_rels/") and name.endswith(".rels"):
        yield from _rels(parse_xml(content), "word/" + name[len("word/_rels/") : -len(".rels")])
    elif name == "word/styles.xml":
        yield from _styles(parse_xml(content))
    elif name == "word/numbering.xml":
        yield from _numbering(parse_xml(content))
    elif name == "word/fontTable.xml":
        yield from _fonts(parse_xml(content))
    elif name == "word/document.xml" or name.startswith(("word/header", "word/footer")) and name.endswith(".xml"):
        reader = BodyReader(name)
        reader.read(parse_xml(content))
        yield from reader.rows


def deobfuscated(content: bytes, key: str) -> bytes:
    """An embedded font in the clear: its first 32 bytes are mixed with the 16 bytes of its key, unless the key is none."""
    digits = "".join(c for c in key if c in "0123456789abcdefABCDEF")
    if len(digits) != 32:
        return content
    mask = bytes.fromhex(digits) * 2
    return bytes(a ^ b for a, b in zip(content, mask)) + content[32:]


# tables -----------------------------------------------------------------------------------------------------------


class Docx:
    """The tables of a set of archives. Parsing happens where a table is used; write or persist `rows` to do it once."""

    def __init__(self, archives: DataFrame):
        """archives: doc_id string, content binary."""
        self.archives = archives.where(is_zip(F.col("content")))
        self.parts = self._parts()
        self.rows = self._rows()

    def _parts(self) -> DataFrame:
        schema = pa.schema([("doc_id", pa.string()), ("part", pa.string()), ("content", pa.binary())])

        def run(batches):
            for batch in batches:
                for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
                    try:
                        archive = zipfile.ZipFile(io.BytesIO(content))
                        names = [n for n in archive.namelist() if not n.endswith("/")]
                    except (zipfile.BadZipFile, ValueError):
                        continue
                    for name in names:
                        try:
                            data = archive.read(name)
                        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, ValueError):
                            continue
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([name]), pa.array([data], pa.binary())], schema=schema)

        return self.archives.select("doc_id", "content").mapInArrow(run, "doc_id string, part string, content binary")

    def _rows(self) -> DataFrame:
        schema = pa.schema([("doc_id", pa.string()), ("kind", pa.string()), ("payload", pa.string())])

        def run(batches):
            for batch in batches:
                for doc_id, name, content in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "content"))):
                    found = list(rows_of(name, content))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found)), pa.array([k for k, _ in found]), pa.array([json.dumps(r) for _, r in found])], schema=schema)

        wanted = F.startswith("part", F.lit("word/")) & (F.endswith("part", F.lit(".xml")) | F.endswith("part", F.lit(".rels")))
        return self.parts.where(wanted).mapInArrow(run, "doc_id string, kind string, payload string")

    def table(self, kind: str) -> DataFrame:
        return self.rows.where(F.col("kind") == kind).select("doc_id", F.from_json("payload", SCHEMAS[kind]).alias("r")).select("doc_id", "r.*")

    def loaded(self) -> DataFrame:
        """Archives that are documents: those with a main part."""
        return self.parts.where("part = 'word/document.xml'").select("doc_id").distinct()

    def formats(self) -> DataFrame:
        """What each archive holds, by the folders of its parts: docx, pptx, xlsx or unknown."""
        holds = lambda folder: F.max(F.startswith("part", F.lit(folder)))
        kind = F.when(holds("word/"), "docx").when(holds("ppt/"), "pptx").when(holds("xl/"), "xlsx").otherwise("unknown")
        return self.parts.groupBy("doc_id").agg(kind.alias("format"))

    def cell_margins(self) -> DataFrame:
        """Margins (twips) of each table's cells: its own, then those of its style and the styles that is based on; 0, 108, 0, 108 where none says."""
        sides = {"top": 0, "left": 108, "bottom": 0, "right": 108}
        styles = self.table("style").where("NOT is_default").select("doc_id", "style_id", "based_on", *(F.try_element_at("margins", F.lit(s)).alias(s) for s in sides))
        inherited = structure.inherited(styles, list(sides), "doc_id", "style_id", "based_on").select("doc_id", "style_id", *(F.col(s).alias(f"__{s}") for s in sides))
        tables = self.table("table").join(inherited, ["doc_id", "style_id"], "left")
        return tables.select("doc_id", "part", "table_no", *(F.coalesce(F.try_element_at("margins", F.lit(s)), F.col(f"__{s}"), F.lit(v)).alias(s) for s, v in sides.items()))

    def geometry(self) -> DataFrame:
        """Page size, margins and number of the first page, with defaults where a document names none."""
        named = self.rows.where("kind = 'geometry'").select("doc_id", F.from_json("payload", SCHEMAS["geometry"]).alias("r")).select("doc_id", "r.*").groupBy("doc_id").agg(*(F.first(c, True).alias(c) for c in PAGE))
        return self.loaded().join(named, "doc_id", "left").select("doc_id", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in PAGE.items()))

    @lru_cache
    def styles(self) -> DataFrame:
        """Every style with inherited properties; heading styles get their level from their name, and document defaults come last."""
        own = self.table("style")
        level = F.coalesce(heading_level(F.col("name")), F.col("outline_level"))
        named = own.where("NOT is_default").withColumn("outline_level", level)
        properties = [*RUN_PROPERTIES, *PARAGRAPH_PROPERTIES]
        resolved = structure.inherited(named, properties, "doc_id", "style_id", "based_on")
        return materialize(resolved.join(self.defaults(), "doc_id", "left").select("doc_id", "style_id", *(F.coalesce(p, f"__d{p}").alias(p) for p in properties)), "docx-styles")

    @lru_cache
    def defaults(self) -> DataFrame:
        """Each document's default properties, named with __d in front."""
        return materialize(self.table("style").where("is_default").groupBy("doc_id").agg(*(F.first(p, True).alias(f"__d{p}") for p in (*RUN_PROPERTIES, *PARAGRAPH_PROPERTIES))), "docx-defaults")

    def paragraphs(self) -> DataFrame:
        """Paragraphs of all parts with resolved paragraph properties and list labels. Lists count on from the body to headers and footers."""
        p = self.table("block").where("kind = 'paragraph'").join(self.loaded(), "doc_id", "left_semi")
        styles = self.styles().select("doc_id", "style_id", *(F.col(c).alias(f"__{c}") for c in PARAGRAPH_PROPERTIES))
        joined = p.join(styles, ["doc_id", "style_id"], "left").join(self.defaults(), "doc_id", "left")
        styled = joined.select(*(c for c in p.columns if c not in PARAGRAPH_PROPERTIES), *(F.coalesce(c, f"__{c}", f"__d{c}").alias(c) for c in PARAGRAPH_PROPERTIES))
        # one order over a document's parts: the body first
        place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.when(F.col("part") == "word/document.xml", 0).otherwise(1), "part", "ord")).cast("long")
        ordered = styled.withColumn("place", place)
        items = ordered.where("num_id IS NOT NULL").select("doc_id", "place", F.concat_ws("|", "doc_id", "num_id").alias("num_id"), "ilvl")
        numbers = self.table("number").select(F.concat_ws("|", "doc_id", "num_id").alias("num_id"), F.concat_ws("|", "doc_id", "abstract_id").alias("abstract_id"))
        levels = self.table("level").withColumn("abstract_id", F.concat_ws("|", "doc_id", "abstract_id")).drop("doc_id")
        labels = structure.numbered(items, numbers, levels, "doc_id", "place").select("doc_id", "place", "label", "indent_left_dxa", "hanging_dxa")
        labelled = ordered.join(labels, ["doc_id", "place"], "left")
        has = F.coalesce(F.col("label"), F.lit("")) != ""
        left, first = F.coalesce("indent_left", F.lit(0.0)), F.coalesce("indent_first", F.lit(0.0))
        return labelled.withColumns({
            "indent_left": F.when(has & (left == 0) & (F.col("indent_left_dxa") > 0), F.col("indent_left_dxa") / TWIPS).otherwise(left),
            "indent_first": F.when(has & (first == 0), -F.col("hanging_dxa") / TWIPS).otherwise(first),
            "list_prefix": F.when(has, F.col("label")),
        }).drop("label", "indent_left_dxa", "hanging_dxa")

    def runs(self) -> DataFrame:
        """Runs with resolved formatting: their own, then their style's, the fonts of earlier runs, the paragraph's style, the document's defaults, and 11 points."""
        runs = self.table("run").join(self.loaded(), "doc_id", "left_semi")
        styles = self.styles()
        of = lambda key, mark: styles.select("doc_id", F.col("style_id").alias(key), *(F.col(c).alias(f"{mark}{c}") for c in RUN_PROPERTIES))
        blocks = self.table("block").where("kind = 'paragraph'").select("doc_id", "part", "ord", "style_id")
        joined = runs.join(blocks, ["doc_id", "part", "ord"]).join(of("run_style", "__r"), ["doc_id", "run_style"], "left").join(of("style_id", "__p"), ["doc_id", "style_id"], "left").join(self.defaults(), "doc_id", "left")
        known = {"bold": False, "italic": False, "underline": False, "strike": False, "size_pt": 11.0, "color": "000000"}
        resolved = {c: F.coalesce(F.col(c), F.col(f"__r{c}"), *([F.col("base_font")] if c == "font" else []), F.col(f"__p{c}"), F.col(f"__d{c}"), *([F.lit(known[c])] if c in known else [])) for c in RUN_PROPERTIES}
        return joined.select("doc_id", "part", "ord", "run_no", "text", "is_page_number", "image_rid", "anchored", "behind", "width_emu", "height_emu", *(v.alias(c) for c, v in resolved.items()))

    def images(self) -> DataFrame:
        """Pictures of the runs, through their part's references: format and bytes."""
        named = self.table("run").where("image_rid IS NOT NULL").select("doc_id", "part", "ord", "run_no", F.col("image_rid").alias("rid"), "width_emu", "height_emu", "anchored", "behind")
        content = self.parts.select("doc_id", F.col("part").alias("target"), "content")
        return named.join(self.table("rel"), ["doc_id", "part", "rid"]).join(content, ["doc_id", "target"]).withColumn("format", image_format(F.col("content")))

    def embedded_fonts(self) -> DataFrame:
        """Embedded fonts in the clear, of four bytes at least."""
        rels = self.table("rel").where("part = 'word/fontTable.xml'").select("doc_id", "rid", "target")
        content = self.parts.select("doc_id", F.col("part").alias("target"), "content")
        joined = self.table("font").join(rels, ["doc_id", "rid"]).join(content, ["doc_id", "target"]).where(F.octet_length("content") >= 4).select("doc_id", "name", "font_key", "content")

        def run(batches):
            for batch in batches:
                clear = [deobfuscated(c, k) for c, k in zip(batch.column("content").to_pylist(), batch.column("font_key").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), pa.array(clear, pa.binary())], names=["doc_id", "name", "content"])

        return joined.mapInArrow(run, "doc_id string, name string, content binary")

    def headers(self) -> DataFrame:
        """Which parts are a document's header and footer, and those of its first section."""
        s = self.table("section").groupBy("doc_id").agg(*(f(c, "section").alias(n) for f, p in ((F.max_by, ""), (F.min_by, "_first")) for c, n in (("header_rid", f"header{p}"), ("footer_rid", f"footer{p}"))))
        long = s.select("doc_id", F.explode(F.create_map(*(x for n in ("header", "footer", "header_first", "footer_first") for x in (F.lit(n), F.col(n))))).alias("role", "rid")).where("rid IS NOT NULL")
        rels = self.table("rel").where("part = 'word/document.xml'").select("doc_id", "rid", F.col("target").alias("part"))
        return long.join(rels, ["doc_id", "rid"]).select("doc_id", "role", "part")

    def placed(self, chars_per_line: float = 90.0) -> DataFrame:
        """Blocks of the body with the page each starts on, by the metric model of structure.text_height (table rows: 12 points each at least)."""
        body = self.table("block").where("part = 'word/document.xml' AND (kind != 'paragraph' OR table_no IS NULL) AND NOT (kind = 'table' AND row IS NOT NULL)").select("doc_id", "ord", "kind", "table_no", "mark_size")
        p = self.paragraphs().where("part = 'word/document.xml' AND table_no IS NULL").select("doc_id", "ord", "text", "space_before", "space_after", "line_pct", "outline_level")
        sizes = self.runs().where("part = 'word/document.xml' AND image_rid IS NULL").groupBy("doc_id", "ord").agg(F.max("size_pt").alias("size"))
        images = self.table("run").where("part = 'word/document.xml' AND image_rid IS NOT NULL AND NOT coalesce(anchored, false)").groupBy("doc_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("run_no", (F.col("height_emu") / 12700.0).alias("h")))), lambda i: i["h"]).alias("images"))
        rows = self.table("cell").where("part = 'word/document.xml'").groupBy("doc_id", "table_no", "row").agg(F.greatest(F.max("row_height") / TWIPS, F.lit(12.0)).alias("h")).groupBy("doc_id", "table_no").agg(F.sum("h").alias("table_h"))
        joined = body.join(p, ["doc_id", "ord"], "left").join(sizes, ["doc_id", "ord"], "left").join(images, ["doc_id", "ord"], "left").join(rows, ["doc_id", "table_no"], "left")
        size = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, F.greatest(F.lit(11.0), F.coalesce("size", F.lit(11.0)))).otherwise(F.coalesce("mark_size", F.lit(11.0)))
        height = F.when(F.col("kind") == "table", F.coalesce("table_h", F.lit(0.0))).otherwise(structure.text_height(F.length("text"), size, F.coalesce("line_pct", F.lit(1.0)), chars_per_line) + F.coalesce("space_after", F.lit(0.0)))
        heights = joined.withColumns({"height": F.coalesce(height, F.lit(0.0)), "space_before": F.coalesce("space_before", F.lit(0.0))})
        # page heights differ between documents, so heights are counted in pages
        page = self.geometry().select("doc_id", F.greatest(F.col("page_h") - F.col("margin_t") - F.col("margin_b"), F.lit(1.0)).alias("page_height"))
        scaled = heights.join(page, "doc_id").withColumns({"height": F.col("height") / F.col("page_height") * 1000, "space_before": F.col("space_before") / F.col("page_height") * 1000, "images": F.transform("images", lambda h: h / F.col("page_height") * 1000)})
        pages = structure.paginated_with_images(scaled, 1000.0, "doc_id", "ord")
        return pages.join(joined.select("doc_id", "ord", "kind", "text", "outline_level"), ["doc_id", "ord"])

    def page_counts(self) -> DataFrame:
        return structure.page_counts(self.placed(), 1000.0, "doc_id", "ord")

    def outline(self) -> DataFrame:
        return structure.outline(self.placed().where("kind = 'paragraph'"), "doc_id", "ord", "outline_level", "text").select("doc_id", "ord", "depth", F.col("parent_idx").alias("parent_ord"), F.col("text").alias("title"), "page")

    def page_texts(self) -> DataFrame:
        """Text of each page: its paragraphs, one to a line. What search reads."""
        texts = self.placed().where("kind = 'paragraph'").groupBy("doc_id", F.col("page").alias("page_index")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda p: p["text"]), "\n").alias("text"))
        return texts


def read_docx(spark: SparkSession, path: str) -> Docx:
    """The archives at a path (a file, a folder or a pattern); doc_id is a file's path. What is no archive is left out."""
    files = spark.read.format("binaryFile").load(path)
    return Docx(files.select(F.col("path").alias("doc_id"), "content"))
