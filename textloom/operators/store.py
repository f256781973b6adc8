"""Collections as immutable snapshots: Parquet files below a folder, and a numbered pointer to the current ones.

A collection is cut into buckets by a hash of the source.  A commit reads and writes only the buckets of the sources that change,
each into a new folder, and then the pointer ``current-N.json`` with the next number, which names the folder of
every bucket.  The highest number wins; pointers are never changed or deleted before their successor stands, so
a reader sees the old state or the new one whole, and a job that dies at any step leaves the old one.  Folders
that no kept pointer names are removed by ``vacuum``.

Chunks hold their vectors.  Beside the chunks of a bucket lie their terms, a row for each chunk, and its counts of
terms and words; the statistics of a collection's terms are added up from these when they are first asked for.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import CollectionError, StoreError
from textloom.operators.bm25 import doc_terms, size_counts, term_counts, term_stats
from textloom.operators.manifest import diff, upsert
from textloom.schema import CHUNKS, MANIFEST

WORDS = "collection string, key string, dl int, terms array<string>, tfs array<int>"
TERMS = "collection string, term string, df bigint"
SIZES = "collection string, n bigint, words bigint"
TERM_STATS = "collection string, term string, df bigint, idf double"


def names_of(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def from_file(collection: Column, filename: Column, wanted_collection: str, wanted_file: str) -> Column:
    """Whether a chunk is of the files of that name in a collection; never null."""
    return F.coalesce((collection == wanted_collection) & (filename == wanted_file), F.lit(False))


class Store:
    """``buckets`` is the number of buckets of a collection; it is fixed by the first commit of the store."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16) -> None:
        self.spark, self.folder, self._buckets = spark, folder.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # the pointer
    def _numbers(self) -> list[int]:
        root = self._path(self.folder)
        names = [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(m[1]) for m in (re.fullmatch(r"current-(\d+)\.json", n) for n in names) if m)

    def _state(self) -> tuple[int, dict]:
        numbers = self._numbers()
        if not numbers:
            return 0, {"buckets": self._buckets, "chunks": {}, "manifest": {}, "stats": {}}
        return numbers[-1], self._read_pointer(numbers[-1])

    def _read_pointer(self, number: int) -> dict:
        path = f"{self.folder}/current-{number:012d}.json"
        try:
            own = self._fs.open(self._path(path))
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(own, "UTF-8"))
            finally:
                own.close()
        except ValueError as e:
            raise StoreError(f"{path} is damaged") from e

    def _point(self, number: int, state: dict) -> None:
        temp, final = self._path(f"{self.folder}/.pointer-{uuid.uuid4().hex}"), self._path(f"{self.folder}/current-{number:012d}.json")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            raise StoreError(f"another commit has written pointer {number}")

    def bucket(self, source: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(source, F.lit(""))), F.lit(self._state()[1]["buckets"])).cast("int")

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        df = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return df.select(*names_of(schema))

    def _folders(self, state: dict, table: str, collection: str | None, buckets: list[int] | None = None, part: str = "rows") -> list[str]:
        live = state[table] if collection is None else {collection: state[table].get(collection, {})}
        return [f"{p}/{part}/bucket={b}" for c in sorted(live) for b, p in sorted(live[c].items()) if buckets is None or int(b) in buckets]

    def _write(self, state: dict, table: str, collection: str, rows: DataFrame, key: str, touched: list[int]) -> None:
        """Write the rows of the touched buckets of a collection and enter them into ``state``."""
        root = f"{self.folder}/{table}-{uuid.uuid4().hex}"
        size = state["buckets"]
        bucket = F.pmod(F.xxhash64(F.coalesce(F.col(key), F.lit(""))), F.lit(size)).cast("int").alias("bucket")
        rows.select("*", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/rows")
        live = state[table].setdefault(collection, {})
        for b in touched:
            live.pop(str(b), None)
            if self._fs.exists(self._path(f"{root}/rows/bucket={b}")):
                live[str(b)] = root
        if not live:
            del state[table][collection]
        if table == "chunks":
            schema = f"{CHUNKS}, bucket int"
            own = self.spark.read.schema(schema).parquet(f"{root}/rows")
            # a file is of one bucket, so each task writes to that of its file and nothing is shuffled
            doc_terms(own, keep=("bucket",)).write.partitionBy("bucket").parquet(f"{root}/words")
            docs = self.spark.read.schema(f"{WORDS}, bucket int").parquet(f"{root}/words")
            term_counts(docs, "bucket").write.partitionBy("bucket").parquet(f"{root}/terms")
            size_counts(docs, "bucket").write.partitionBy("bucket").parquet(f"{root}/sizes")
            state["stats"].pop(collection, None)

    def _change(self, collection: str, gone: DataFrame, fresh: DataFrame, files: DataFrame | None = None, left: DataFrame | None = None) -> None:
        """Commit: without the chunks of the sources ``gone`` (path), with ``fresh`` ones, and the manifest rows ``files``
        (root, path, md5) in place of those ``left`` (root, path)."""
        number, state = self._state()
        touched = self._touched(gone.select("path").unionByName(fresh.select(F.col("source").alias("path"))))
        if touched:
            old = self._read(self._folders(state, "chunks", collection, touched), CHUNKS)
            here = gone.select(F.lit(collection).alias("collection"), "path")
            fresh = fresh if "embedding" in fresh.columns else fresh.withColumn("embedding", F.lit(None).cast("array<float>"))
            self._write(state, "chunks", collection, upsert(old, here, fresh.select(*names_of(CHUNKS))), "source", touched)
        if files is not None:
            touched = self._touched(files.select("path").unionByName(left.select("path")))
            if touched:
                old = self._read(self._folders(state, "manifest", collection, touched), MANIFEST)
                rest = old.join(left.select("root", "path").distinct(), ["root", "path"], "left_anti").select(*names_of(MANIFEST))
                self._write(state, "manifest", collection, rest.unionByName(files.select(F.lit(collection).alias("collection"), "root", "path", "md5")), "path", touched)
        self._point(number + 1, state)

    def _touched(self, paths: DataFrame) -> list[int]:
        """The buckets of paths; at most as many as there are buckets reach the driver."""
        return sorted(r[0] for r in paths.select(self.bucket(F.col("path"))).distinct().collect())

    def chunks(self, collection: str | None = None) -> DataFrame:
        return self._read(self._folders(self._state()[1], "chunks", collection), CHUNKS)

    def manifest(self, collection: str | None = None) -> DataFrame:
        return self._read(self._folders(self._state()[1], "manifest", collection), MANIFEST)

    def bm25_index(self, collection: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(terms of chunks, document statistics, term statistics); the last are written for the collections that have changed since."""
        number, state = self._state()
        asked = [c for c in ([collection] if collection else sorted(state["chunks"])) if c in state["chunks"]]
        sizes = self._read([p for c in asked for p in self._folders(state, "chunks", c, part="sizes")], SIZES)
        stats = sizes.groupBy("collection").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))
        stale = [c for c in asked if c not in state["stats"]]
        if stale:
            root = f"{self.folder}/stats-{uuid.uuid4().hex}"
            counts = self._read([p for c in stale for p in self._present(self._folders(state, "chunks", c, part="terms"))], TERMS).groupBy("collection", "term").agg(F.sum("df").alias("df"))
            term_stats(counts, stats, counted=True).sortWithinPartitions("term").write.parquet(root)
            state["stats"] |= dict.fromkeys(stale, root)
            self._point(number + 1, state)
        roots = sorted({state["stats"][c] for c in asked})
        terms = self._read(roots, TERM_STATS).where(F.col("collection").isin(asked))
        docs, own = ([p for c in asked for p in self._folders(state, "chunks", c, part=x)] for x in ("words", "rows"))
        there = [self._fs.exists(self._path(p)) for p in docs]
        out = self._read([p for p, x in zip(docs, there) if x], WORDS)
        if not all(there):  # buckets of a store that was written before it kept terms by chunk
            out = out.unionByName(doc_terms(self._read([p for p, x in zip(own, there) if not x], CHUNKS)))
        return out, stats, terms

    def _present(self, paths: list[str]) -> list[str]:
        """A bucket whose chunks have no terms has no folder of their counts."""
        return [p for p in paths if self._fs.exists(self._path(p))]

    def collections(self) -> DataFrame:
        return collection_counts(self.chunks())

    def changes(self, collection: str, root: str, now: DataFrame, force: bool = False) -> DataFrame:
        """The state of each file of (path, md5) against the manifest of this collection and root."""
        mine = self.manifest(collection).where(F.col("root") == root)
        new = now.select(F.lit(collection).alias("collection"), F.lit(root).alias("root"), "path", "md5")
        d = diff(mine, new)
        return d.withColumn("state", F.when(F.col("state") == "unchanged", "changed").otherwise(F.col("state"))) if force else d

    def apply(self, collection: str, root: str, now: DataFrame, states: DataFrame, fresh: DataFrame) -> None:
        """Commit fresh chunks for added and changed files; chunks of changed and deleted ones go."""
        moved = states.where(F.col("state").isin("changed", "deleted", "added")).select("path", "state", F.lit(root).alias("root"))
        files = now.where("md5 IS NOT NULL").join(moved.where("state <> 'deleted'").select("path"), "path", "left_semi").select(F.lit(root).alias("root"), "path", "md5")
        self._change(collection, moved, fresh, files, moved)

    def replace_sources(self, collection: str, fresh: DataFrame, sources: DataFrame | None = None, files: DataFrame | None = None) -> None:
        """Commit fresh chunks in place of all chunks of their sources (web pages, single files), with the manifest rows
        ``files`` (root, path, md5) if given."""
        s = (sources if sources is not None else fresh.select("source")).select(F.col("source").alias("path")).distinct()
        self._change(collection, s, fresh, files, files)

    def remove_source(self, collection: str, filename: str, reset: bool = False) -> int:
        """Delete the chunks of all files of that name; their manifest rows stay, so unchanged files do not come
        back by themselves, unless ``reset``."""
        mine = self.chunks(collection)
        hit = mine.where(from_file(F.col("collection"), F.col("filename"), collection, filename))
        n = hit.count()
        if n:
            rows = self.manifest(collection).where(F.regexp_extract("path", "([^/]*)$", 1) == filename)
            sources = hit.select(F.col("source").alias("path")).distinct()
            # what else a source has, under another file name, stays
            other = mine.where(~from_file(F.col("collection"), F.col("filename"), collection, filename)).join(sources, F.col("source").eqNullSafe(F.col("path")), "left_semi")
            self._change(collection, sources, other, rows.limit(0) if reset else None, rows if reset else None)
        return n

    def drop(self, collection: str, confirm: bool = False) -> int:
        """The number of chunks of a collection, which goes with its manifest only if ``confirm``."""
        number, state = self._state()
        if collection not in state["chunks"] and collection not in state["manifest"]:
            raise CollectionError(f"there is no collection {collection!r}")
        n = self.chunks(collection).count()
        if confirm:
            for table in ("chunks", "manifest", "stats"):
                state[table].pop(collection, None)
            self._point(number + 1, state)
        return n

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the last ``keep`` pointers, and the folders that these do not name; returns the number of folders.

        Readers of older states and commits that are under way must have ended.
        """
        numbers = self._numbers()
        kept = [self._read_pointer(n) for n in numbers[-keep:]]
        named = {p for s in kept for t in ("chunks", "manifest") for live in s[t].values() for p in live.values()} | {p for s in kept for p in s["stats"].values()}
        names = {p.rsplit("/", 1)[1] for p in named}
        gone = 0
        for f in self._fs.listStatus(self._path(self.folder)) if numbers else []:
            name = f.getPath().getName()
            old = re.fullmatch(r"current-(\d+)\.json", name)
            if (old and int(old[1]) not in numbers[-keep:]) or name.startswith(".pointer-") or (re.match(r"(chunks|manifest|stats)-", name) and name not in names):
                self._fs.delete(f.getPath(), True)
                gone += f.isDirectory()
        return gone


def collection_counts(chunks: DataFrame) -> DataFrame:
    """(collection, chunks)."""
    return chunks.groupBy("collection").agg(F.count("*").alias("chunks"))
