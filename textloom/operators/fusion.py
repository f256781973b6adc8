"""Candidates, ranks and scores of hybrid retrieval.  All windows are over query_id, so one exchange serves all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Russian stems and the English terms that a query with them is widened by, in this order.
SYNONYMS = (
    ("создать", "create post make new"),
    ("получить", "get fetch list read"),
    ("обновить", "update patch put"),
    ("удалить", "delete remove drop"),
    ("найти", "find search query"),
    ("добавить", "add insert append"),
    ("ошибка", "error exception fail bug"),
)


def expand_queries(queries: DataFrame, synonyms: tuple = SYNONYMS) -> DataFrame:
    """``queries`` with one row for each variant (variant, variant_query): the query, for Cyrillic ones its lower
    case, and the English terms of the stems that it holds.  Null queries give no row."""
    low = F.lower("query")
    terms = F.concat_ws(" ", *[F.when(F.contains(low, F.lit(ru)), F.lit(en)) for ru, en in synonyms])
    variants = F.when(F.col("query").rlike(r"[Ѐ-ӿ]"), F.when(terms != "", F.array("query", low, terms)).otherwise(F.array("query", low))).otherwise(F.array("query"))
    return queries.where(F.col("query").isNotNull()).select("*", F.posexplode(variants).alias("variant", "variant_query"))


def merge_variants(found: DataFrame, key: str) -> DataFrame:
    """(query_id, key, min_vec_rank, seq) of each candidate: its best rank over the variants, and its first
    appearance in the order of variants and ranks."""
    place = F.struct("variant", "rank")
    firsts = found.groupBy("query_id", F.col(key).alias("key")).agg(F.min("rank").alias("min_vec_rank"), F.min(place).alias("first"))
    w = Window.partitionBy("query_id").orderBy("first")
    return firsts.withColumn("seq", F.row_number().over(w)).select("query_id", "key", "min_vec_rank", "seq")


def with_bm25(candidates: DataFrame, scores: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """Candidates with their BM25 score over the best of the query's whole collection; 0 without a match.  ``best`` (query_id, best)
    is given where ``scores`` has those of candidates only."""
    best = scores.groupBy("query_id").agg(F.max("score").alias("best")) if best is None else best
    joined = candidates.join(scores, ["query_id", "key"], "left").join(best, "query_id", "left")
    return joined.select(*candidates.columns, F.coalesce(F.col("score") / F.when(F.col("best") > 0, F.col("best")).otherwise(1.0), F.lit(0.0)).alias("bm25_score"))


def fuse(candidates: DataFrame, k: int = 60) -> DataFrame:
    """Adds vec_rank, bm25_rank and hybrid_score by reciprocal ranks; equal values keep the order of ``seq``."""
    q = Window.partitionBy("query_id")
    out = candidates.withColumn("vec_rank", F.row_number().over(q.orderBy("min_vec_rank", "seq"))).withColumn("bm25_rank", F.row_number().over(q.orderBy(F.col("bm25_score").desc(), "seq")))
    return out.withColumn("hybrid_score", F.lit(1.0) / (k + F.col("vec_rank")) + F.lit(1.0) / (k + F.col("bm25_rank")))


def shortlist(fused: DataFrame, n: str, factor: int = 2) -> DataFrame:
    """The ``factor`` times n best candidates of each query by hybrid score, with their place."""
    w = Window.partitionBy("query_id").orderBy(F.col("hybrid_score").desc(), "seq")
    return fused.withColumn("place", F.row_number().over(w)).where(F.col("place") <= factor * F.col(n))


def minmax(col: str, over: Window) -> F.Column:
    low, high = F.min(col).over(over), F.max(col).over(over)
    return (F.col(col) - low) / F.when(high != low, high - low).otherwise(1.0)


def final_scores(short: DataFrame, rerank: str | None = None, hybrid_weight: float = 0.4, rerank_weight: float = 0.6) -> DataFrame:
    """Adds final_score: with a reranker's column the blend of both, scaled to their range; without one the
    hybrid score over the query's best."""
    q = Window.partitionBy("query_id")
    if rerank:
        return short.withColumn("final_score", hybrid_weight * minmax("hybrid_score", q) + rerank_weight * minmax(rerank, q))
    best = F.max("hybrid_score").over(q)
    return short.withColumn("final_score", F.when(best > 0, F.col("hybrid_score") / best).otherwise(0.0))
