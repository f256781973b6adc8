import io
import json
import os
import zipfile

import pytest

from textloom.api import Engine
from textloom.config import CollectionError, IndexingError, StoreError
from textloom.operators.store import Store
from textloom.operators.vector import HashEmbedder
from textloom.sources import remote
from textloom.sources.files import decode, file_text, list_files, read_files

BODY = "This body has more than thirty characters of text. It has two sentences."


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "docs"
    for name, text in {"a/x.md": f"# A\n{BODY}", "b/x.md": f"# B\n{BODY} b", "__init__.py": "def f():\n    return 1\n", ".hidden.md": BODY, "node_modules/x.md": BODY, "e.MD": BODY, "blank.md": " \n", "_priv/f.md": f"# P\n{BODY} p"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_listing_and_reading(spark, tree):
    (tree / "bad.md").write_bytes(b"ok \xff\xfe text\r\nline")
    files = {r.relative for r in list_files(spark, str(tree)).collect()}
    assert files == {"a/x.md", "b/x.md", "__init__.py", "blank.md", "_priv/f.md", "bad.md"}
    got = {os.path.basename(r.path): r for r in read_files(list_files(spark, str(tree))).collect()}
    assert got["bad.md"].text == "ok  text\nline" and got["blank.md"].text is None and got["blank.md"].md5
    assert got["__init__.py"].text == "# __init__.py\n\n```py\ndef f():\n    return 1\n\n```"
    gone = read_files(spark.createDataFrame([("/no/such/file.md",)], "path string")).first()
    assert gone.md5 is None and gone.text is None


def test_formats():
    nb = {"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "y = 1"}, {"cell_type": "raw", "source": "no"}, {"cell_type": "code", "source": []}]}
    assert file_text("n.ipynb", json.dumps(nb).encode()) == "# T\nx\n\n```python\ny = 1\n```"
    assert file_text("n.ipynb", b"{not json") is None and file_text("a.csv", b"a,b\n1,2") == "a,b\n1,2" and file_text("x.pdf", b"%PDF broken") is None
    assert file_text("p.html", b"<p>a</p><style>no</style>") == "a" and decode(b"a\rb\r\nc") == "a\nb\nc"
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Para</w:t></w:r></w:p></w:body></w:document>'
    assert file_text("d.docx", packed({"word/document.xml": doc})) == "## Head\n\nPara\n\n| a | b |\n|---|---|"
    rows = "".join(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c><c r="C{k}" t="s"><v>0</v></c></row>' for k in range(1, 61))
    sheet = {"xl/workbook.xml": '<workbook xmlns:r="u"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/sharedStrings.xml": "<sst><si><t>hi</t></si></sst>", "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}<row r='61'/></sheetData></worksheet>"}
    text = file_text("s.xlsx", packed(sheet))
    assert text.startswith("## Sheet: S\n\n| 1 |  | hi |\n|---|---|---|\n| 2 |") and text.count("\n|") == 51
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:r><a:t>One</a:t></a:r></a:p></p:sp><p:sp/></p:sld>'
    assert file_text("s.pptx", packed({"ppt/slides/slide1.xml": slide})) == "## Slide 1\n\nOne"


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_index_again_change_and_delete(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    first = e.index_documents(str(tree))
    assert first.indexed_files == 5 and first.unchanged == 0 and first.total == first.chunks == 4 and first.categories["a"] == 1
    assert "Indexed 4 chunks from 5 files" in first.text()
    again = e.index_documents(str(tree))
    assert (again.indexed_files, again.unchanged, again.chunks, again.total) == (0, 5, 0, 4)
    (tree / "a/x.md").write_text(f"# A2\n{BODY} changed")
    (tree / "_priv/f.md").unlink()
    third = e.index_documents(str(tree))
    assert (third.indexed_files, third.deleted, third.total) == (1, 1, 3)
    # the other file of the same name keeps its chunk
    assert {r.heading for r in e.store.chunks().collect() if r.filename == "x.md"} == {"A2", "B"}
    # a second root of the same collection leaves the first one alone
    other = tmp_path / "other"
    other.mkdir()
    (other / "o.md").write_text(f"# O\n{BODY}")
    assert e.index_documents(str(other)).total == 4
    # another collection is indexed in full, and a full run gives the same as steps
    assert e.index_documents(str(tree), "second").total == 3
    ids = lambda c: {r.chunk_id for r in e.store.chunks(c).collect()}
    before = ids("docs_v4")
    e.reindex_collection(str(tree))
    assert ids("docs_v4") == before
    assert {r.collection: r.chunks for r in e.collections().collect()} == {"docs_v4": 4, "second": 3}
    assert e.remove_source("x.md", "second") == 2
    assert e.index_documents(str(tree), "second").total == 1  # removed, unchanged files do not come back
    with pytest.raises(CollectionError):
        e.remove_source("x.md", "second")
    assert e.delete_collection("second") == 1 and e.store.chunks("second").count() == 1
    e.delete_collection("second", confirm=True)
    assert e.store.chunks("second").count() == 0
    with pytest.raises(CollectionError):
        e.delete_collection("second")
    with pytest.raises(IndexingError):
        e.index_documents(str(tmp_path / "none"))


def test_single_file_pages_and_search(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    assert e.index_file(str(tree / "a/x.md")) == 1 and e.index_file(str(tree / "a/x.md")) == 1 and e.store.chunks().count() == 1
    pages = spark.createDataFrame([("https://a.b/c", f"# Page\n{BODY}", 0), ("https://a.b/", BODY, 0)], "url string, content string, depth int")
    assert e.index_pages(pages) == 2 and e.index_pages(pages.limit(1)) == 1 and e.store.chunks().count() == 3
    assert e.status().first().chunks == 3 and e.files().count() == 3
    assert e.search("thirty characters", n_results=2).count() >= 1
    with pytest.raises(IndexingError):
        e.index_file(str(tree / "missing.md"))


def test_uris():
    assert [remote.scheme_of(u) for u in ("https://x/a.zip", "github://o/r", "npm://a", "pypi://a", "/tmp/a.ZIP")] == ["web", "github", "npm", "pypi", "zip"]
    with pytest.raises(IndexingError):
        remote.scheme_of("ftp://x")
    assert remote.parse_github("github://o/r/docs/x") == ("o", "r", "HEAD", "docs/x") and remote.parse_github("github://o/r@v2/docs") == ("o", "r", "v2/docs", "")
    assert remote.parse_npm("npm://axios@1.6") == ("axios", "1.6") and remote.parse_npm("npm://@s/p@1.0") == ("@s/p@1.0", "latest")
    assert remote.parse_pypi("pypi://a@1") == ("a", "1") and remote.parse_pypi("pypi://a") == ("a", None)
    assert remote.sitemap_candidates("https://a.b/docs/x")[-1] == "https://a.b/docs/sitemap.xml"


def test_remote_sources(spark, tmp_path):
    tree = {"tree": [{"type": "blob", "path": "docs/a.md"}, {"type": "blob", "path": "docs/b.py"}, {"type": "tree", "path": "docs"}, {"type": "blob", "path": "c.txt"}]}

    def fetch(url):
        if "api.github" in url:
            return 200, "application/json", json.dumps(tree).encode()
        if "npmjs" in url:
            return 200, "application/json", b'{"readme": "# R"}'
        if "pypi.org" in url:
            return (200, "application/json", b'{"info": {"description": "D"}}') if "/a/" in url else (404, "", b"")
        if url.endswith("sitemap.xml"):
            return 200, "application/xml", b"<loc>https://a.b/docs/1</loc><loc>https://c.d/2</loc>"
        return 200, "text/plain", b"text of " + url.encode()

    assert [r.url.rsplit("/", 1)[1] for r in remote.github_files(spark, "github://o/r/docs", fetch).collect()] == ["a.md"]
    assert remote.registry_page(spark, "npm://x", fetch).first().content == "# R"
    assert remote.registry_page(spark, "pypi://a", fetch).first().content == "D"
    with pytest.raises(IndexingError):
        remote.registry_page(spark, "pypi://b", fetch)
    assert [r.url for r in remote.sitemap_seeds(spark, "https://a.b/docs/", fetch).collect()] == ["https://a.b/docs/1"]
    z = tmp_path / "d.zip"
    z.write_bytes(packed({"r/a.md": "A", "r/b.py": "no", "blank.txt": " "}))
    assert [(r.url, r.content) for r in remote.zip_members(spark.read.format("binaryFile").load(str(z))).collect()] == [("zip://d.zip/r/a.md", "A")]


def test_one_changed_file_touches_its_own_buckets(spark, tree, tmp_path):
    for k in range(30):
        (tree / f"n{k}.md").write_text(f"# N{k}\n{BODY} {k}")
    e = Engine(spark, str(tmp_path / "db"))
    e.index_documents(str(tree))
    before = e.store._state()[1]
    (tree / "n7.md").write_text(f"# N7\n{BODY} other")
    assert e.index_documents(str(tree)).indexed_files == 1
    after = e.store._state()[1]
    for name in ("chunks", "manifest"):
        old, new = before[name]["docs_v4"], after[name]["docs_v4"]
        assert len(old) > 5 and sum(old[b] != new[b] for b in old) == 1 and set(old) == set(new)
    folders = {p.name for p in (tmp_path / "db").iterdir()}
    assert e.store.vacuum(1) >= 0 and {r.heading for r in e.store.chunks().collect()} >= {"N7", "N8", "A"}
    assert {p.name for p in (tmp_path / "db").iterdir()} < folders


def test_a_commit_that_dies_leaves_the_old_state(spark, tree, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "db"))
    e.index_documents(str(tree))
    ids = lambda: sorted(r.chunk_id for r in e.store.chunks().collect())
    before = ids()
    (tree / "a/x.md").write_text(f"# New\n{BODY} new")
    for step in ("_write", "_point"):
        with monkeypatch.context() as m:
            m.setattr(Store, step, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("dies here")))
            with pytest.raises(RuntimeError):
                e.index_documents(str(tree))
        assert ids() == before
    assert e.index_documents(str(tree)).indexed_files == 1 and ids() != before
    number = e.store._numbers()[-1]
    with pytest.raises(StoreError):  # another writer was first
        e.store._point(number, {})
    (tmp_path / "db" / f"current-{number + 1:012d}.json").write_text("{half")
    with pytest.raises(StoreError):
        e.store.chunks()


def test_a_search_embeds_its_request_only(spark, tree, tmp_path):
    class Once(HashEmbedder):
        def __call__(self, texts):
            if self.closed and any(t != "thirty characters" for t in texts):
                raise RuntimeError("a stored text is embedded again")
            return super().__call__(texts)

    model = Once()
    model.closed = False
    e = Engine(spark, str(tmp_path / "db"), embedder=model)
    e.index_documents(str(tree))
    model.closed = True
    rows = e.search("thirty characters", n_results=2).collect()
    assert rows and e.store.chunks().where("embedding IS NULL").count() == 0
    # the statistics of terms are written once and read from then on
    state = e.store._state()
    e.search("thirty characters").collect()
    assert e.store._state() == state
