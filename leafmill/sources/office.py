"""Blocks as office files: the counterpart of the readers, so that parsed blocks can be handed on as documents.

A file is one group of blocks of a bounded number, written in one task; the caller says how blocks are grouped."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_NUMBER = re.compile(r"[1-9][0-9]{0,8}\Z")
_PREFIX = re.compile(r"(?:Columns|Row [0-9]+): ")
NAMESPACES = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "p": "http://schemas.openxmlformats.org/presentationml/2006/main", "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
}
_ALL = " ".join(f'xmlns:{k}="{v}"' for k, v in NAMESPACES.items())
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"


def _x(text: str | None) -> str:
    """Text for XML, without characters that XML can't hold."""
    return _NO_XML.sub("", text or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text.encode("utf-8", "replace"))
    return out.getvalue()


def _relations(targets: dict[str, tuple[str, str]]) -> str:
    return f'<Relationships xmlns="{RELATIONS}">' + "".join(f'<Relationship Id="{i}" Type="{NAMESPACES["r"]}/{kind}" Target="{target}"/>' for i, (kind, target) in targets.items()) + "</Relationships>"


def _table_rows(text: str | None) -> list[list[str]]:
    return [_PREFIX.sub("", line, count=1).split(" | ") if _PREFIX.match(line) else line.split(" | ") for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]


def docx(blocks: pd.DataFrame) -> bytes:
    """kind, text, style: headings are bold paragraphs, tables have a row a line and cells between " | "."""
    body = []
    for b in blocks.itertuples(index=False):
        if b.kind == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{_x(c)}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in _table_rows(b.text))
            body.append(f"<w:tbl>{rows}</w:tbl>")
        else:
            style = f'<w:pPr><w:pStyle w:val="{_x(b.style)}"/></w:pPr>' if b.style else ""
            body.append(f"<w:p>{style}<w:r>{'<w:rPr><w:b/></w:rPr>' if b.kind == 'heading' else ''}<w:t>{_x(b.text)}</w:t></w:r></w:p>")
    return _zipped({"word/document.xml": f"<w:document {_ALL}><w:body>{''.join(body)}</w:body></w:document>"})


def _paragraphs(text: str | None, bullets: bool) -> str:
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return "".join(f"<a:p>{'<a:pPr lvl=' + chr(34) + '1' + chr(34) + '/>' if bullets and x.startswith('  ') else ''}<a:r><a:t>{_x(x)}</a:t></a:r></a:p>" for x in lines)


def _shape(kind: str, text: str | None, top: int) -> str:
    place = f'<p:spPr><a:xfrm><a:off x="0" y="{top}"/></a:xfrm></p:spPr>'
    if kind == "image":
        return f'<p:pic><p:nvPicPr><p:cNvPr id="1" name="Picture"/><p:nvPr/></p:nvPicPr>{place}</p:pic>'
    if kind == "table":
        rows = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{_paragraphs(c, False)}</a:txBody></a:tc>" for c in r) + "</a:tr>" for r in _table_rows(text))
        return f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="1" name="Grid"/><p:nvPr/></p:nvGraphicFramePr><p:xfrm><a:off x="0" y="{top}"/></p:xfrm><a:graphic><a:graphicData><a:tbl>{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    holder = {"title": '<p:ph type="title"/>', "subtitle": '<p:ph type="subTitle"/>'}.get(kind, "")
    name = "Callout" if kind == "callout" else "Shape"
    return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/><p:nvPr>{holder}</p:nvPr></p:nvSpPr>{place}<p:txBody>{_paragraphs(text, kind == "bullet")}</p:txBody></p:sp>'


def pptx(blocks: pd.DataFrame) -> bytes:
    """slide, kind, text, in order: slides by number, shapes from top to bottom."""
    parts, slides = {}, {}
    for n, (_, shapes) in enumerate(blocks.groupby("slide", sort=True), 1):
        tree = "".join(_shape(b.kind, b.text, 60_000 * k) for k, b in enumerate(shapes[shapes.kind != "notes"].itertuples(index=False), 1))
        parts[f"ppt/slides/slide{n}.xml"] = f"<p:sld {_ALL}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>"
        slides[f"rId{n}"] = ("slide", f"slides/slide{n}.xml")
        if len(notes := shapes[shapes.kind == "notes"]):
            tree = "".join(_shape("text", b.text, 0) for b in notes.itertuples(index=False))
            parts[f"ppt/notesSlides/notesSlide{n}.xml"] = f"<p:notes {_ALL}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:notes>"
            parts[f"ppt/slides/_rels/slide{n}.xml.rels"] = _relations({"rId1": ("notesSlide", f"../notesSlides/notesSlide{n}.xml")})
    parts["ppt/presentation.xml"] = f"<p:presentation {_ALL}><p:sldIdLst>{''.join(f'<p:sldId r:id={chr(34)}{i}{chr(34)}/>' for i in slides)}</p:sldIdLst></p:presentation>"
    parts["ppt/_rels/presentation.xml.rels"] = _relations(slides)
    return _zipped(parts)


def _letters(n: int) -> str:
    return (_letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)


def xlsx(rows: pd.DataFrame) -> bytes:
    """sheet, row, cells: one sheet of rows; whole numbers are numeric cells."""
    body = []
    for r in rows.itertuples(index=False):
        cells = "".join(
            f'<c r="{_letters(k)}{r.row}"><v>{c}</v></c>' if _NUMBER.match(c or "") else f'<c r="{_letters(k)}{r.row}" t="inlineStr"><is><t>{_x(c)}</t></is></c>' for k, c in enumerate(r.cells, 1) if c
        )
        body.append(f'<row r="{r.row}">{cells}</row>')
    name = _x(rows["sheet"].iloc[0])
    return _zipped({
        "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{NAMESPACES["r"]}"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _relations({"rId1": ("worksheet", "worksheets/sheet1.xml")}),
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET}"><sheetData>{"".join(body)}</sheetData></worksheet>',
    })


WRITERS: dict[str, Callable[[pd.DataFrame], bytes]] = {"docx": docx, "pptx": pptx, "xlsx": xlsx}


def as_files(parts: DataFrame, doc_type: str, order: list[str]) -> DataFrame:
    """A file of each `file` of parts, as `discover` gives them: source_path, source_file, doc_type, content. `order`: of the
    rows in a file. A file is written in one task, so it must be of a bounded size."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["file"].iloc[0]
        return pd.DataFrame({"source_path": [name], "source_file": [name], "doc_type": [doc_type], "content": [WRITERS[doc_type](rows.sort_values(order, kind="stable"))]})

    return parts.groupBy("file").applyInPandas(write, "source_path string, source_file string, doc_type string, content binary")


def part_of(file: Column, number: Column, size: int) -> Column:
    """The name of the part of a file that a number (of a block, slide or row) belongs to, `size` to a part."""
    return F.concat(F.coalesce(file, F.lit("")), F.lit("/"), F.floor(F.coalesce(number, F.lit(0)) / size).cast("string"))
