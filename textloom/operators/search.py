"""The retrieval pipeline over a relation of queries."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.config import SETTINGS
from textloom.functions.render import breadcrumb, result_block, snippet
from textloom.operators import fusion
from textloom.operators.bm25 import bm25_best, bm25_of, own_index
from textloom.operators.dedup import greedy_dedup, ranked
from textloom.operators.vector import Embedder, HashEmbedder, VectorIndex, embed, vector_topk
from textloom.plans.materialize import materialize


class Reranker(Protocol):
    """Scores pairs of a query and a text."""

    def __call__(self, queries: list[str], texts: list[str]) -> list[float]: ...


def rerank(short: DataFrame, model: Reranker, chars: int = 8000) -> DataFrame:
    score = F.pandas_udf(lambda q, t: pd.Series(list(map(float, model(q.tolist(), t.tolist())))), "double")
    return short.withColumn("rerank_score", score(F.col("query"), F.substring(F.coalesce(F.col("text"), F.lit("")), 1, chars)))


def search(queries: DataFrame, chunks: DataFrame, *, key: str = "chunk_id", embedder: Embedder | None = None, reranker: Reranker | None = None, default_n: int = 5, duplicate_ratio: float = SETTINGS.duplicate_ratio, index: tuple[DataFrame, DataFrame, DataFrame] | None = None, vector_index: VectorIndex | None = None) -> DataFrame:
    """Ranked results of each query: (query_id, rank, key, filename, heading, category, text, final_score, rendered).

    ``queries`` has query_id, query, n_results, category, filename and collection.  Null and blank queries and
    queries without candidates give no row; a null n_results counts as ``default_n`` and less than one as one;
    empty and null filters do not filter.  Keys of ``chunks`` must be unique.  Chunks with a column ``embedding`` are
    not embedded again; ``index`` has stored terms and statistics of the same chunks.  The vector search is exact
    unless ``vector_index`` is given, which has assigned the chunks.
    """
    asked = queries.where(F.col("query").rlike(r"\S")).withColumn("n", F.greatest(F.lit(1), F.coalesce("n_results", F.lit(default_n))))
    model = embedder or HashEmbedder()
    variants = embed(fusion.expand_queries(asked).withColumn("fetch", F.col("n") * SETTINGS.fetch_factor), "variant_query", model)
    vectors = chunks if "embedding" in chunks.columns else embed(chunks, "text", model)
    found = vector_topk(variants, vectors, "fetch", key=key, filters=[("collection", "collection"), ("category", "category"), ("filename", "filename")], index=vector_index)
    # scores are wanted of the candidates and of the best of each query, not of all chunks; candidates are read for both
    candidates = materialize(fusion.merge_variants(found, key), "candidates")
    index = index or own_index(chunks, key=key)
    scores, best = bm25_of(candidates, asked, index), bm25_best(asked, 1, index).select("query_id", F.col("score").alias("best"))
    fused = fusion.fuse(fusion.with_bm25(candidates, scores, best), SETTINGS.rrf_k)
    short = fusion.shortlist(fused.join(asked.select("query_id", "query", "n"), "query_id"), "n", SETTINGS.rerank_factor)
    texts = chunks.select(F.col(key).alias("key"), "filename", "heading", "parent_heading", "category", "text")
    short = short.join(texts, "key")
    if reranker:
        short = rerank(short, reranker, SETTINGS.rerank_chars)
    final = fusion.final_scores(short, "rerank_score" if reranker else None, SETTINGS.hybrid_weight, SETTINGS.rerank_weight)
    kept = ranked(greedy_dedup(final, ratio=duplicate_ratio, chars=SETTINGS.duplicate_chars))
    body = result_block(F.col("rank"), breadcrumb(F.col("filename"), F.col("parent_heading"), F.col("heading")), F.col("final_score"), F.col("category"), snippet(F.col("text"), SETTINGS.result_chars))
    return kept.select("query_id", "rank", F.col("key").alias(key), "filename", "heading", "category", "text", F.round("final_score", 9).alias("final_score"), body.alias("rendered"))


def render(results: DataFrame, queries: DataFrame, reranked: bool = False) -> DataFrame:
    """(query_id, rendered): one Markdown text for each query, with its filters and method."""
    blocks = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "rendered"))).alias("b"))
    both = queries.where(F.col("query").rlike(r"\S")).join(blocks, "query_id", "left")
    c, f = F.coalesce("category", F.lit("")), F.coalesce("filename", F.lit(""))
    parts = F.concat_ws(", ", F.when(c != "", F.concat(F.lit("category="), c)), F.when(f != "", F.concat(F.lit("file="), f)))
    head = F.concat(F.lit('## Results for: "'), F.col("query"), F.lit('"\n\n'), F.when(parts != "", F.concat(F.lit("**Filters:** "), parts, F.lit("\n\n"))).otherwise(F.lit("")), F.lit(f"**Method:** Hybrid (Vector + BM25{' + Reranker' if reranked else ''})\n\n"))
    text = F.when(F.col("b").isNull(), F.concat(F.lit("No results found for: '"), F.col("query"), F.lit("'"))).otherwise(F.concat(head, F.array_join(F.transform("b", lambda x: x["rendered"]), "\n")))
    return both.select("query_id", text.alias("rendered"))
