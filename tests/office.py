"""Tiny office files written by hand."""

import zipfile

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
PA = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zip(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def rels(*items):
    return f'<Relationships xmlns="{RELS}">' + "".join(f'<Relationship Id="{i}" Type="{TYPE}/{t}" Target="{x}"/>' for i, t, x in items) + "</Relationships>"


def docx(path):
    p = lambda t, b=False: f"<w:p><w:r>{'<w:rPr><w:b/></w:rPr>' if b else ''}<w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = "<w:tbl>" + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("Name", "Value"), ("", ""), ("one", "1"))) + "</w:tbl>"
    body = p("Project Plan", True) + p("this is a sentence, long enough to be no heading at all, and it ends with a full stop, as the sentences of a paragraph do.") + table + p("") + p("- item")
    _zip(path, {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def pptx(path):
    def sp(name, ph, y, x, *lines):
        kind = "" if ph is None else f'<p:ph type="{ph}"/>'
        ps = "".join(f'<a:p><a:pPr lvl="{v}"/><a:r><a:t>{t}</a:t></a:r></a:p>' for v, t in lines)
        return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody>{ps}</p:txBody></p:sp>'

    tree = sp("Box", None, 900000, 5, (0, "Lower text"), (1, "A point")) + sp("Title 1", "title", 0, 0, (0, "Aims")) + sp("Date", "dt", 0, 0, (0, "2024")) + sp("Callout 2", None, 500000, 0, (0, "Mind this"))
    slide = f"<p:sld {PA}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>"
    notes = f"<p:notes {PA}><p:cSld><p:spTree>{sp('N', 'body', 0, 0, (0, 'Say hello'))}{sp('No', 'sldNum', 0, 0, (0, '1'))}{sp('E', 'body', 0, 0, (0, 'Click to add notes'))}</p:spTree></p:cSld></p:notes>"
    _zip(path, {
        "ppt/presentation.xml": f'<p:presentation {PA}><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("rId1", "slide", "slides/slide1.xml")), "ppt/slides/slide1.xml": slide,
        "ppt/slides/_rels/slide1.xml.rels": rels(("rId2", "notesSlide", "../notesSlides/n1.xml")), "ppt/notesSlides/n1.xml": notes,
    })


def xlsx(path):
    sheet = (
        f'<worksheet {M}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>When</t></is></c></row>'
        '<row r="3"><c r="A3"><v>3</v></c><c r="B3" t="b"><v>1</v></c><c r="C3" s="1"><v>45292</v></c><c r="D3"><f>A3*2</f><v>6</v></c></row></sheetData></worksheet>'
    )
    _zip(path, {
        "xl/workbook.xml": f'<workbook {M}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(("rId1", "worksheet", "worksheets/sheet1.xml")),
        "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f"<sst {M}><si><t>Key</t></si></sst>", "xl/styles.xml": f'<styleSheet {M}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    })
