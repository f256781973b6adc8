"""Sources behind a URI: archives, repositories, package registries and sitemaps.

Network access is a ``fetch`` function, (url) -> (status, content type, body), given by the caller, so every
rule here runs without a network.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import IndexingError
from textloom.functions.html import page_to_markdown
from textloom.functions.url import sitemap_urls
from textloom.schema import PAGES
from textloom.sources.files import DOC_SUFFIXES, decode

Fetch = Callable[[str], tuple[int, str, bytes]]


def scheme_of(uri: str) -> str:
    """web, github, npm, pypi or zip; web is asked first, so https://x/a.zip is a page."""
    low = uri.lower()
    for start, kind in (("http://", "web"), ("https://", "web"), ("github://", "github"), ("npm://", "npm"), ("pypi://", "pypi")):
        if low.startswith(start):
            return kind
    if low.endswith(".zip"):
        return "zip"
    raise IndexingError(f"no source for {uri!r}; known are http(s)://, github://, npm://, pypi:// and .zip")


def parse_github(uri: str) -> tuple[str, str, str, str]:
    """(owner, repository, branch, path); all after the first @ is the branch."""
    path, _, branch = uri.removeprefix("github://").partition("@")
    parts = path.split("/", 2)
    if len(parts) < 2:
        raise IndexingError(f"not a repository: {uri!r}")
    return parts[0], parts[1], branch or "HEAD", parts[2] if len(parts) > 2 else ""


def parse_npm(uri: str) -> tuple[str, str]:
    """(name, version); a scoped name keeps what follows its second @."""
    spec = uri.removeprefix("npm://")
    name, at, version = spec.rpartition("@")
    return (name, version) if at and not spec.startswith("@") else (spec, "latest")


def parse_pypi(uri: str) -> tuple[str, str | None]:
    name, at, version = uri.removeprefix("pypi://").partition("@")
    return name, version if at else None


def zip_members(paths: DataFrame) -> DataFrame:
    """Pages of the text members of archives, (path, content BINARY); nothing is extracted to disk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for info in z.infolist():
                    kind = PurePosixPath(info.filename).suffix.lower()
                    if info.is_dir() or kind not in DOC_SUFFIXES:
                        continue
                    url = f"zip://{PurePosixPath(path).name}/{info.filename}"
                    text = decode(z.read(info))
                    if kind in (".html", ".htm"):
                        text = page_to_markdown(text, url) or text
                    if text.strip():
                        rows.append((url, text, 0))
            yield pd.DataFrame(rows, columns=["url", "content", "depth"])

    return paths.select("path", "content").mapInPandas(run, PAGES)


def github_files(spark: SparkSession, uri: str, fetch: Fetch, limit: int = 300) -> DataFrame:
    owner, repo, branch, sub = parse_github(uri)
    status, _, body = fetch(f"https://api.github.com/repos/{owner}/{repo}/git/trees/{branch}?recursive=1")
    if status in (403, 404):
        raise IndexingError("the rate limit is reached" if status == 403 else f"{owner}/{repo} is missing or private")
    tree = [(k, x["path"]) for k, x in enumerate(json.loads(body).get("tree", [])) if x.get("type") == "blob"]
    listing = spark.createDataFrame(tree, "pos int, path string")
    chosen = listing.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*DOC_SUFFIXES) & F.startswith("path", F.lit(sub))).orderBy("pos").limit(limit)
    rows = []
    for r in chosen.orderBy("pos").collect():  # at most ``limit`` requests
        url = f"https://raw.githubusercontent.com/{owner}/{repo}/{branch}/{r['path']}"
        code, _, content = fetch(url)
        if code == 200 and (text := decode(content)).strip():
            rows.append((url, page_to_markdown(text, url) or text if url.lower().endswith((".html", ".htm")) else text, 0))
    return spark.createDataFrame(rows, PAGES)


def registry_page(spark: SparkSession, uri: str, fetch: Fetch) -> DataFrame:
    """The readme of an npm package or the description of a PyPI one."""
    if uri.startswith("npm://"):
        name, version = parse_npm(uri)
        api, page, field = f"https://registry.npmjs.org/{name}/{version}", f"https://www.npmjs.com/package/{name}", "$.readme"
    else:
        name, own = parse_pypi(uri)
        api, page, field = f"https://pypi.org/pypi/{name}/{own + '/' if own else ''}json", f"https://pypi.org/project/{name}/", "$.info.description"
    status, _, body = fetch(api)
    if status != 200:
        raise IndexingError(f"{uri} is not known")
    row = spark.createDataFrame([(page, decode(body))], "url string, body string")
    return row.select("url", F.get_json_object("body", field).alias("content"), F.lit(0).alias("depth")).where("content IS NOT NULL AND content <> ''")


def sitemap_candidates(base: str) -> list[str]:
    u = urlsplit(base)
    first = u.path.strip("/").split("/")[0]
    return [f"https://{u.netloc}/sitemap.xml", f"https://{u.netloc}/sitemap_index.xml", *([f"https://{u.netloc}/{first}/sitemap.xml"] if first else [])]


def sitemap_seeds(spark: SparkSession, base: str, fetch: Fetch) -> DataFrame:
    """(pos, url) of the first sitemap with a location below the base, in order."""
    prefix = re.split(r"[?#]", base)[0].rstrip("/")
    for url in sitemap_candidates(base):
        status, kind, body = fetch(url)
        if status != 200 or "xml" not in kind:
            continue
        got = spark.createDataFrame([(decode(body),)], "xml string").select(F.posexplode(sitemap_urls(F.col("xml"))).alias("pos", "url")).where(F.startswith("url", F.lit(prefix)))
        if not got.isEmpty():
            return got
    return spark.createDataFrame([], "pos int, url string")


class FetchedPages:
    """A page source that fetches in the tasks: pages answered with 200 and HTML, as Markdown."""

    def __init__(self, fetch: Fetch, extractor=None) -> None:  # noqa: ANN001
        self.get, self.extractor = fetch, extractor

    def fetch(self, frontier: DataFrame) -> DataFrame:
        get, extractor = self.get, self.extractor

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for url in pdf["url"]:
                    try:
                        status, kind, body = get(url)
                    except OSError:
                        continue
                    if status == 200 and "text/html" in kind:
                        html = decode(body)
                        rows.append((url, html, page_to_markdown(html, url, extractor)))
                yield pd.DataFrame(rows, columns=["url", "html", "content"])

        return frontier.select("url").mapInPandas(run, "url string, html string, content string")
