"""Writes small files of the binary formats, so that the readers can be run over a table of texts."""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape


def zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def notebook(markdown: str, code: str) -> bytes:
    cells = [{"cell_type": "markdown", "source": [markdown]}, {"cell_type": "code", "source": code}, {"cell_type": "raw", "source": "left out"}, {"cell_type": "code", "source": []}]
    return json.dumps({"cells": cells}).encode()


def docx(heading: str, paragraph: str, table: list[list[str]]) -> bytes:
    text = lambda s: f"<w:r><w:t>{escape(s)}</w:t></w:r>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{text(c)}</w:p></w:tc>" for c in r) + "</w:tr>" for r in table)
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>{text(heading)}</w:p><w:tbl>{rows}</w:tbl><w:p>{text(paragraph)}</w:p>'
    return zipped({"word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>'})


def xlsx(sheet: str, rows: list[list[str]]) -> bytes:
    cells = "".join(f'<row r="{k}">' + "".join(f'<c r="{chr(65 + j)}{k}" t="inlineStr"><is><t>{escape(c)}</t></is></c>' for j, c in enumerate(r)) + "</row>" for k, r in enumerate(rows, 1))
    return zipped({"xl/workbook.xml": f'<workbook xmlns:r="urn:r"><sheets><sheet name="{escape(sheet)}" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>"})


def pptx(slides: list[str]) -> bytes:
    return zipped({f"ppt/slides/slide{k}.xml": f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><p:sp><a:p><a:r><a:t>{escape(s)}</a:t></a:r></a:p></p:sp><p:sp/></p:sld>' for k, s in enumerate(slides, 1)})
