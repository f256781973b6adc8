"""Reports over stored chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filled(chunks: DataFrame) -> DataFrame:
    """Chunks with the defaults that reports use for missing values."""
    return chunks.withColumns({"filename": F.coalesce("filename", F.lit("unknown")), "category": F.coalesce("category", F.lit("other")), "word_count": F.coalesce("word_count", F.lit(0))})


def files(chunks: DataFrame, order: str = "section_id") -> DataFrame:
    """(collection, filename, source, category, chunks, words): counts, and source and category of the first
    chunk in ``order``; missing ones are empty."""
    c = chunks.withColumns({"filename": F.coalesce("filename", F.lit("unknown")), "source": F.coalesce("source", F.lit("")), "category": F.coalesce("category", F.lit("")), "word_count": F.coalesce("word_count", F.lit(0))})
    return c.groupBy("collection", "filename").agg(F.min_by("source", order).alias("source"), F.min_by("category", order).alias("category"), F.count("*").alias("chunks"), F.sum("word_count").alias("words"))


def status(chunks: DataFrame) -> DataFrame:
    """(collection, chunks, files, categories, words)."""
    return filled(chunks).groupBy("collection").agg(F.count("*").alias("chunks"), F.countDistinct("filename").alias("files"), F.countDistinct("category").alias("categories"), F.sum("word_count").alias("words"))


def counts_by(chunks: DataFrame, column: str) -> DataFrame:
    return filled(chunks).groupBy("collection", column).agg(F.count("*").alias("chunks"))


def top_files(chunks: DataFrame, k: int = 10, order: str = "section_id") -> DataFrame:
    """The k files with the most chunks of each collection; of equal ones that which appears first."""
    per = filled(chunks).groupBy("collection", "filename").agg(F.count("*").alias("chunks"), F.min(order).alias("first"))
    w = Window.partitionBy("collection").orderBy(F.col("chunks").desc(), "first")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("collection", "rank", "filename", "chunks")
