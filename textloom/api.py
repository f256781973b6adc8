"""The engine's Python interface: index, search, inspect, delete and watch."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import SETTINGS, CollectionError, IndexingError
from textloom.operators import stats
from textloom.operators.chunking import chunk_documents
from textloom.operators.crawl import PageSource, crawl
from textloom.operators.search import Reranker, search
from textloom.operators.store import Store
from textloom.operators.vector import Embedder, HashEmbedder, embed
from textloom.plans.materialize import materialize
from textloom.schema import QUERIES
from textloom.sources import remote
from textloom.sources.files import list_files, read_files
from textloom.streaming.watch import event_stream, watch


@dataclass(frozen=True)
class Report:
    """What an index run did."""

    collection: str
    indexed_files: int
    chunks: int
    unchanged: int
    deleted: int
    total: int
    categories: dict[str, int]
    suffixes: dict[str, int]

    def text(self) -> str:
        kinds = lambda d: ", ".join(f"{k}: {v}" for k, v in sorted(d.items()))
        return f"Indexed {self.chunks} chunks from {self.indexed_files} files ({self.unchanged} unchanged, {self.deleted} deleted)\nTotal: {self.total} chunks in '{self.collection}'\nFile types: {kinds(self.suffixes)}\nCategories: {kinds(self.categories)}"


class Engine:
    def __init__(self, spark: SparkSession, folder: str, *, embedder: Embedder | None = None, reranker: Reranker | None = None) -> None:
        self.spark, self.store, self.embedder, self.reranker = spark, Store(spark, folder), embedder or HashEmbedder(), reranker

    def _stored(self, fresh: DataFrame) -> DataFrame:
        """Chunks with their vectors, written once: a text is embedded when it is indexed, not when it is searched."""
        return materialize(embed(fresh, "text", self.embedder), "chunks")

    def index_documents(self, root: str, collection: str = SETTINGS.default_collection, force: bool = False) -> Report:
        """Index the added and changed files of a folder and forget the deleted ones."""
        root = os.path.normpath(root)
        # files are hashed first; only added and changed ones are converted
        paths = materialize(list_files(self.spark, root), "paths")
        files = materialize(read_files(paths, text=False).select("path", "md5"), "files")
        if files.isEmpty() and self.store.manifest(collection).where(F.col("root") == root).isEmpty():
            raise IndexingError(f"there is no supported file in {root}")
        states = materialize(self.store.changes(collection, root, files, force), "states")
        todo = states.where(F.col("state").isin("added", "changed")).select("path")
        fresh = self._stored(chunk_documents(read_files(todo), collection=collection, raw="raw"))
        count = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
        if sum(count.get(s, 0) for s in ("added", "changed", "deleted")):
            self.store.apply(collection, root, files, states, fresh)
        cats = {r[0]: r[1] for r in fresh.groupBy("category").count().collect()}
        kinds = {r[0]: r[1] for r in todo.groupBy(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))).count().collect()}
        return Report(collection, count.get("added", 0) + count.get("changed", 0), sum(cats.values()), count.get("unchanged", 0), count.get("deleted", 0), self.store.chunks(collection).count(), cats, kinds)

    def reindex_collection(self, root: str, collection: str = SETTINGS.default_collection) -> Report:
        return self.index_documents(root, collection, force=True)

    def index_file(self, path: str, collection: str = SETTINGS.default_collection, root: str | None = None) -> int:
        """Replace one file's chunks; returns their number."""
        path = os.path.normpath(path)
        if not os.path.isfile(path):
            raise IndexingError(f"there is no file {path}")
        files = materialize(read_files(self.spark.createDataFrame([(path,)], "path string")), "files")
        fresh = self._stored(chunk_documents(files, collection=collection, raw="raw"))
        own = os.path.normpath(root or os.path.dirname(path))
        self.store.replace_sources(collection, fresh, self.spark.createDataFrame([(path,)], "source string"), files.select(F.lit(own).alias("root"), "path", "md5"))
        return fresh.count()

    def index_pages(self, pages: DataFrame, collection: str = SETTINGS.default_collection) -> int:
        """Replace the chunks of each page's URL; returns the number of new chunks."""
        pages = materialize(pages.select("url", "content"), "pages")
        fresh = self._stored(chunk_documents(pages, collection=collection, path="url", text="content", web=True))
        self.store.replace_sources(collection, fresh, pages.select(F.col("url").alias("source")))
        return fresh.count()

    def index_url(self, uri: str, collection: str = SETTINGS.default_collection, *, fetch: remote.Fetch | None = None, source: PageSource | None = None, links: DataFrame | None = None, **limits) -> int:
        """Index what a URI names: a site (by a page source and its links), a repository, a package or an archive."""
        kind = remote.scheme_of(uri)
        if kind == "zip":
            pages = remote.zip_members(self.spark.read.format("binaryFile").load(uri))
        elif kind == "github":
            pages = remote.github_files(self.spark, uri, fetch)
        elif kind in ("npm", "pypi"):
            pages = remote.registry_page(self.spark, uri, fetch)
        elif source is None or links is None:
            raise IndexingError("a crawl needs a page source and its links")
        else:
            pages = crawl(source, links, self.spark.createDataFrame([(uri,)], "seed string"), **limits)
        return self.index_pages(pages, collection)

    def search(self, queries: DataFrame | str, **one) -> DataFrame:
        """Results of a relation of queries, or of one query text (with n_results, category, filename, collection)."""
        only = None  # a request for one collection reads no other
        if isinstance(queries, str):
            only = one.get("collection", SETTINGS.default_collection)
            row = (0, queries, one.get("n_results", 5), one.get("category"), one.get("filename"), only)
            queries = self.spark.createDataFrame([row], QUERIES)
        return search(queries, self.store.chunks(only), embedder=self.embedder, reranker=self.reranker, index=self.store.bm25_index(only))

    def status(self, collection: str = SETTINGS.default_collection) -> DataFrame:
        return stats.status(self.store.chunks(collection))

    def collections(self) -> DataFrame:
        return self.store.collections().orderBy("collection")

    def files(self, collection: str = SETTINGS.default_collection) -> DataFrame:
        return stats.files(self.store.chunks(collection), "section_ordinal").orderBy("filename")

    def remove_source(self, filename: str, collection: str = SETTINGS.default_collection, reset: bool = False) -> int:
        n = self.store.remove_source(collection, filename, reset)
        if not n:
            raise CollectionError(f"'{filename}' has no chunks in '{collection}'")
        return n

    def delete_collection(self, name: str, confirm: bool = False) -> int:
        return self.store.drop(name, confirm)

    def watch(self, root: str, events_folder: str, checkpoint: str, collection: str = SETTINGS.default_collection, **how):  # noqa: ANN201
        """Index again after each burst of the change events that arrive in a folder."""
        return watch(event_stream(self.spark, events_folder), lambda _: self.index_documents(root, collection), checkpoint, **how)
