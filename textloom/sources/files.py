"""Files of a folder as documents.

Spark's own listing leaves out names that start with ``_`` or ``.``, so the listing is a walk; the paths are
then a DataFrame, and reading, hashing and converting run in the tasks.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import SETTINGS
from textloom.functions.html import plain_text
from textloom.functions.text import suffix

#: Suffixes of readable files by kind, and folders that are never read.
TEXT = (".md", ".txt", ".rst", ".text", ".log")
CODE = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".css", ".scss", ".java",
    ".go", ".rs", ".c", ".cpp", ".h", ".hpp", ".rb", ".php",
    ".swift", ".kt", ".lua", ".sh", ".bash", ".json", ".yaml", ".yml",
    ".toml", ".xml", ".ini", ".cfg",
)
WEB = (".html", ".htm")
BINARY = (".pdf", ".docx", ".xlsx", ".pptx", ".ipynb")
SUPPORTED = (*TEXT, *CODE, ".csv", *WEB, *BINARY)
EXCLUDED = ("__pycache__", "node_modules", "venv", "env", "chroma_db", "build", "dist")
DOC_SUFFIXES = (".md", ".txt", ".rst", ".html", ".htm")


def supported(path: Column) -> Column:
    return suffix(path).isin(*SUPPORTED)


def admitted(relative: Column) -> Column:
    """Whether no part of a relative path is hidden or excluded."""
    return ~F.exists(F.split(relative, "/"), lambda p: p.startswith(".") | p.isin(*EXCLUDED))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative) of the supported files below ``root``, each once."""
    found = [(os.path.join(d, n), os.path.relpath(os.path.join(d, n), root)) for d, _, names in os.walk(root) for n in names]
    paths = spark.createDataFrame(sorted(found), "path string, relative string")
    # the suffix counts as written here, so e.MD is no file of this list
    name = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    return paths.where(name.isin(*SUPPORTED) & admitted(F.col("relative")))


def decode(content: bytes) -> str:
    """UTF-8 without its faulty bytes, with line feeds as line ends."""
    return content.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def notebook_text(content: bytes) -> str | None:
    cells = json.loads(content.decode("utf-8")).get("cells", [])
    out = []
    for c in cells:
        body = "".join(c.get("source") or [])
        if body.strip() and c.get("cell_type") in ("markdown", "code"):
            out.append(body if c["cell_type"] == "markdown" else f"```python\n{body}\n```")
    return "\n\n".join(out) or None


def table_text(rows: list[list[str]]) -> str:
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), "|" + "---|" * len(rows[0]), *map(line, rows[1:])])


def local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def attribute(e: ElementTree.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), "")


def texts_of(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if local(x) == "t")


def docx_text(content: bytes) -> str | None:
    """Paragraphs with headings 1 to 3, then the tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))[0]
    out, tables = [], []
    for e in body:
        if local(e) == "p":
            style = next((attribute(x, "val") for x in e.iter() if local(x) == "pStyle"), "")
            text = texts_of(e)
            level = re.fullmatch(r"Heading ?([123]).*", style)
            if level:
                out.append("#" * int(level[1]) + " " + text)
            elif text.strip():
                out.append(text)
        elif local(e) == "tbl":
            rows = [[texts_of(c).strip() for c in r if local(c) == "tc"] for r in e if local(r) == "tr"]
            if rows:
                tables.append(table_text(rows))
    return "\n\n".join(out + tables) or None


def xlsx_text(content: bytes, rows_kept: int = SETTINGS.sheet_rows) -> str | None:
    """A table for each sheet: its rows with a value, the first ``rows_kept`` of them."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = z.namelist()
    shared = [texts_of(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    targets = {attribute(r, "Id"): attribute(r, "Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"):
        target = targets[attribute(s, "id")].lstrip("/")
        rows = []
        for r in (e for e in ElementTree.fromstring(z.read(target if target.startswith("xl/") else "xl/" + target)).iter() if local(e) == "row"):
            cells: dict[int, str] = {}
            for c in r:
                col = 0
                for ch in re.match(r"[A-Z]*", attribute(c, "r"))[0]:
                    col = col * 26 + ord(ch) - 64
                value = next((x.text or "" for x in c if local(x) == "v"), None)
                kind = attribute(c, "t")
                if kind == "inlineStr":
                    value = texts_of(c)
                elif kind == "s" and value is not None:
                    value = shared[int(value)]
                if value is not None:
                    cells[col or len(cells) + 1] = value
            if cells:
                rows.append([cells.get(k, "") for k in range(1, max(cells) + 1)])
        if rows:
            width = max(map(len, rows))
            out.append(f"## Sheet: {attribute(s, 'name')}\n\n" + table_text([r + [""] * (width - len(r)) for r in rows[:rows_kept]]))
    return "\n\n".join(out) or None


def pptx_text(content: bytes) -> str | None:
    z = zipfile.ZipFile(io.BytesIO(content))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for k, name in enumerate(slides, 1):
        shapes = [e for e in ElementTree.fromstring(z.read(name)).iter() if local(e) == "sp"]
        texts = ["\n".join(texts_of(p) for p in s.iter() if local(p) == "p").strip() for s in shapes]
        if any(texts):
            out.append(f"## Slide {k}\n\n" + "\n\n".join(t for t in texts if t))
    return "\n\n".join(out) or None


def pdf_text(content: bytes) -> str | None:
    """By the optional library; without it no text."""
    try:
        import pypdf
    except ImportError:
        return None
    pages = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]
    return "\n\n".join(f"## Page {k}\n\n{t}" for k, t in enumerate(pages, 1) if t.strip()) or None


def file_text(path: str, content: bytes | None) -> str | None:
    """A file as Markdown-like text; null if it is blank, unreadable or its format has no reader."""
    if content is None:
        return None
    raw = decode(content)
    if not raw.strip():
        return None
    p = PurePosixPath(path)
    kind = p.suffix.lower()
    try:
        if kind in WEB:
            return plain_text(raw)
        if kind in CODE:
            return f"# {p.name}\n\n```{kind[1:]}\n{raw}\n```"
        reader = {".pdf": pdf_text, ".docx": docx_text, ".xlsx": xlsx_text, ".pptx": pptx_text, ".ipynb": notebook_text}.get(kind)
        return reader(content) if reader else raw
    except Exception:  # noqa: BLE001 - a faulty file must not end the job; it has no text
        return None


def read_files(paths: DataFrame, *, text: bool = True) -> DataFrame:
    """(path, md5, raw, text) of each path; a file that cannot be read has a null md5."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    with open(p, "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                rows.append((p, *converted(p, content, text)))
            yield pd.DataFrame(rows, columns=["path", "md5", "raw", "text"])

    return paths.select("path").mapInPandas(run, "path string, md5 string, raw string, text string")


def converted(path: str, content: bytes | None, text: bool = True) -> tuple[str | None, str | None, str | None]:
    """(md5, raw, text) of a file's bytes; all null for a file that cannot be read."""
    if content is None:
        return None, None, None
    raw = decode(content) if text and PurePosixPath(path).suffix.lower() not in BINARY else None
    return hashlib.md5(content).hexdigest(), raw, file_text(path, content) if text else None  # noqa: S324


def convert_files(files: DataFrame) -> DataFrame:
    """(path, md5, raw, text) of files given as (path, content), as Spark's reader of binary files lists them, wherever
    they lie.  (That reader leaves out names that start with ``_`` or ``.``.)"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *converted(p, c)) for p, c in zip(pdf["path"], pdf["content"])], columns=["path", "md5", "raw", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, md5 string, raw string, text string")
