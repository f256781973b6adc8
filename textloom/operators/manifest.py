"""Change detection between two generations of file hashes, and what follows for stored chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["collection", "root", "path"]


def latest(manifest: DataFrame) -> DataFrame:
    """One row for each file: of repeated rows that with the least hash; null hashes are unreadable files."""
    return manifest.groupBy(*KEY).agg(F.min("md5").alias("md5"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(collection, root, path, state): added, changed, unchanged, deleted or unreadable.

    A file whose new hash is null exists, but cannot be read: it is neither deleted nor indexed.
    """
    o, n = latest(old).withColumnRenamed("md5", "old"), latest(new).withColumns({"new": F.col("md5"), "here": F.lit(True)}).drop("md5")
    both = o.withColumn("there", F.lit(True)).join(n, KEY, "full")
    state = F.when(F.col("here").isNull(), "deleted").when(F.col("new").isNull(), "unreadable").when(F.col("there").isNull(), "added").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return both.select(*KEY, state.alias("state"))


def keep_chunks(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks of files that are not in ``gone`` (collection, path)."""
    g = gone.select(F.col("collection").alias("_c"), F.col("path").alias("_p")).distinct()
    return chunks.join(g, (F.col("collection") == F.col("_c")) & F.col("source").eqNullSafe(F.col("_p")), "left_anti")


def upsert(chunks: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next snapshot: without the chunks of changed and deleted files, with the fresh ones, each id once."""
    return keep_chunks(chunks, gone).unionByName(fresh.dropDuplicates(["collection", "chunk_id"]))
