"""What stands in an office file, element by element. Only the zip and XML are read here; what the elements mean
(headings, sections, tables as text, labels) is decided by DataFrame plans."""

from __future__ import annotations

import datetime as dt
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

PROPERTIES = {"lastModifiedBy": "last_modified_by"}
#: Fields of an element; what an element lacks is null.
SCHEMA = (
    "kind string, n int, text string, style string, bold boolean, rows array<array<string>>, slide int, top bigint, left bigint, placeholder string, name string, shape_path string, parent_group string, "
    "paragraphs array<struct<level:int,text:string>>, sheet string, sheet_index int, row int, cells array<struct<col:int,ref:string,value:string,formula:boolean>>, page int, facts string"
)
FIELDS = [f.split(" ")[0] for f in re.split(r", (?=\w+ )", SCHEMA)]


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relationship id to (type, part)."""
    folder, file = posixpath.split(part)
    root = _xml(z, f"{folder}/_rels/{file}.rels")
    return {} if root is None else {r.get("Id"): (r.get("Type", "").rpartition("/")[2], posixpath.normpath(posixpath.join(folder, r.get("Target", ""))).lstrip("/")) for r in root}


def _word_text(p: ET.Element) -> str:
    return "".join({"t": x.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(x.tag.removeprefix(W), "") for x in p.iter())


def docx(content: bytes) -> Iterator[dict]:
    """Paragraphs (with style and whether a run is bold) and tables (rows of cell texts) in body order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        styles = _xml(z, "word/styles.xml")
        names = {} if styles is None else {s.get(f"{W}styleId"): n.get(f"{W}val") for s in styles.iter(f"{W}style") if (n := s.find(f"{W}name")) is not None}
        for e in ET.fromstring(z.read("word/document.xml")).find(f"{W}body"):
            if e.tag == f"{W}p":
                style = e.find(f"{W}pPr/{W}pStyle")
                bold = any((b := r.find(f"{W}rPr/{W}b")) is not None and b.get(f"{W}val") not in ("0", "false") for r in e.iter(f"{W}r"))
                yield {"kind": "paragraph", "text": _word_text(e), "style": "Normal" if style is None else names.get(style.get(f"{W}val"), style.get(f"{W}val")), "bold": bold}
            elif e.tag == f"{W}tbl":
                yield {"kind": "table", "rows": [["\n".join(map(_word_text, c.findall(f"{W}p"))) for c in r.findall(f"{W}tc")] for r in e.findall(f"{W}tr")]}


def _shapes(tree: ET.Element, path: str = "", group: str | None = None) -> Iterator[tuple[ET.Element, str, str | None]]:
    """All shapes of a slide, those of groups included, with their path and group."""
    shapes = [e for e in tree if e.tag in (f"{P}sp", f"{P}pic", f"{P}graphicFrame", f"{P}grpSp", f"{P}cxnSp")]
    for k, e in enumerate(shapes, 1):
        here = f"{path}.{k}" if path else str(k)
        if e.tag == f"{P}grpSp":
            name = e.find(f"{P}nvGrpSpPr/{P}cNvPr")
            yield from _shapes(e, here, None if name is None else name.get("name"))
        else:
            yield e, here, group


def _paragraphs(e: ET.Element) -> list[tuple[int, str]]:
    out = []
    for p in e.iter(f"{A}p"):
        level = p.find(f"{A}pPr")
        text = "".join("\x0b" if x.tag == f"{A}br" else x.text or "" for x in p.iter() if x.tag in (f"{A}t", f"{A}br"))
        out.append((int(level.get("lvl", 0)) if level is not None else 0, text))
    return out


def pptx(content: bytes) -> Iterator[dict]:
    """The shapes of each slide: place, placeholder type, name, paragraphs, table rows; and the notes' shapes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = _targets(z, "ppt/presentation.xml")
        ids = [s.get(f"{R}id") for s in ET.fromstring(z.read("ppt/presentation.xml")).iter(f"{P}sldId")]
        for slide, part in enumerate((parts[i][1] for i in ids), 1):
            for e, path, group in _shapes(ET.fromstring(z.read(part)).find(f"{P}cSld/{P}spTree")):
                ph, name, off = e.find(f".//{P}nvPr/{P}ph"), e.find(f".//{P}cNvPr"), e.find(f".//{A}off")
                off = e.find(f"{P}xfrm/{A}off") if off is None else off
                table = e.find(f".//{A}tbl")
                kind = "table" if table is not None else "picture" if e.tag == f"{P}pic" else "shape"
                yield {
                    "kind": kind, "slide": slide, "name": "" if name is None else name.get("name", ""), "placeholder": None if ph is None else ph.get("type", "obj"), "shape_path": path, "parent_group": group,
                    "top": 0 if off is None else int(off.get("y", 0)), "left": 0 if off is None else int(off.get("x", 0)), "paragraphs": _paragraphs(e) if kind == "shape" else None,
                    "rows": None if table is None else [["\n".join(t for _, t in _paragraphs(c)) for c in r.findall(f"{A}tc")] for r in table.findall(f"{A}tr")],
                }
            for kind, target in _targets(z, part).values():
                if kind == "notesSlide" and (root := _xml(z, target)) is not None:
                    for e, path, _ in _shapes(root.find(f"{P}cSld/{P}spTree")):
                        if text := "\n".join(t for _, t in _paragraphs(e)).strip():
                            yield {"kind": "notes", "slide": slide, "text": text, "shape_path": path}


def _serial_date(value: float, format_: str) -> str:
    moment = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(value * 86_400))
    if value < 1:
        return moment.time().isoformat()
    return moment.isoformat(sep=" ") if re.search("[hs]", format_) or moment.time() != dt.time() else f"{moment:%Y-%m-%d} 00:00:00"


def _cell(c: ET.Element, shared: list[str], formats: list[str]) -> tuple[str, bool]:
    kind, v, f = c.get("t"), c.find(f"{M}v"), c.find(f"{M}f")
    if f is not None and f.text:
        return "=" + f.text, True
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{M}t")), False
    if v is None or v.text is None:
        return "", False
    if kind == "s":
        return shared[int(v.text)], False
    if kind == "b":
        return ("TRUE" if v.text == "1" else "FALSE"), False
    if kind is None or kind == "n":
        style = int(c.get("s", 0))
        if style < len(formats) and formats[style]:
            return _serial_date(float(v.text), formats[style]), False
        number = float(v.text)
        return (str(int(number)) if number.is_integer() and "." not in v.text and "e" not in v.text.lower() else str(number)), False
    return v.text, False


def _date_formats(z: zipfile.ZipFile) -> list[str]:
    """Of each cell style the number format if it is one of dates or times, else an empty string."""
    root = _xml(z, "xl/styles.xml")
    if root is None:
        return []
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{M}numFmt")}
    built_in = dict.fromkeys((14, 15, 16, 17), "ymd") | dict.fromkeys((18, 19, 20, 21, 45, 46, 47), "hms") | {22: "ymdhm"}
    code = lambda n: built_in.get(n, own.get(n, "") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(n, "")).lower()) else "")
    xfs = root.find(f"{M}cellXfs")
    return [] if xfs is None else [code(int(x.get("numFmtId", 0))) for x in xfs]


def xlsx(content: bytes) -> Iterator[dict]:
    """The workbook's properties, and each sheet's rows of non-empty cells. Rows count by their place in the sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = _xml(z, "xl/sharedStrings.xml")
        shared = [] if root is None else ["".join(t.text or "" for t in s.iter(f"{M}t")) for s in root]
        formats, parts = _date_formats(z), _targets(z, "xl/workbook.xml")
        sheets = list(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{M}sheet"))
        core = _xml(z, "docProps/core.xml")
        own = {} if core is None else {e.tag.rpartition("}")[2]: e.text for e in core if e.text}
        facts = {PROPERTIES.get(k, k): own[k] for k in ("creator", "title", "subject", "description", "keywords", "category", "created", "modified", *PROPERTIES) if k in own}
        yield {"kind": "workbook", "facts": json.dumps({"sheet_count": len(sheets), "sheet_names": [s.get("name") for s in sheets], **facts}, ensure_ascii=False)}
        for k, s in enumerate(sheets, 1):
            data = ET.fromstring(z.read(parts[s.get(f"{R}id")][1])).find(f"{M}sheetData")
            rows = list(data) if data is not None else []
            first = last = 0
            yield {"kind": "sheet", "sheet": s.get("name"), "sheet_index": k, "facts": json.dumps({"sheet_state": s.get("state", "visible")})}
            for r in rows:
                number = int(r.get("r", last + 1))
                first, last = first or number, number
                cells, col = [], 0
                for c in r.findall(f"{M}c"):
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    col = sum((ord(x) - 64) * 26**p for p, x in enumerate(reversed(letters))) or col + 1
                    value, formula = _cell(c, shared, formats)
                    value = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", value.replace("\r", "\n"))).strip()
                    if value:
                        cells.append((col, c.get("r", ""), value, formula))
                if cells:
                    yield {"kind": "row", "sheet": s.get("name"), "sheet_index": k, "row": number - first + 1, "cells": cells}


def pdf(content: bytes) -> Iterator[dict]:
    """The document's facts and each page's text. Needs the optional pypdf."""
    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(content))
    info = {k.lstrip("/"): str(v) for k, v in (reader.metadata or {}).items() if v is not None}
    yield {"kind": "document", "facts": json.dumps({"page_count": len(reader.pages), "is_encrypted": reader.is_encrypted, **info}, ensure_ascii=False)}
    for n, page in enumerate(reader.pages, 1):
        facts: dict = {"page_number": n}
        try:
            text = page.extract_text() or ""
        except Exception as e:  # a broken page doesn't end the file
            text, facts["extraction_error"] = "", str(e)
        try:
            facts |= {"width_points": round(float(page.mediabox.width), 2), "height_points": round(float(page.mediabox.height), 2), "rotation": int(page.rotation or 0)}
        except Exception:
            pass  # a page without a box has no dimensions
        try:
            facts["image_count"] = len(page.images)
        except Exception:
            facts["image_count"] = 0
        yield {"kind": "page", "page": n, "text": text, "facts": json.dumps(facts)}


READERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "pdf": pdf}
