"""BM25 over collections: statistics, scores and top-k, all as joins and aggregates on terms.

Okapi BM25 with the public defaults k1 = 1.5, b = 0.75 and a floor for negative weights of 0.25 times the mean
inverse document frequency over all terms of the collection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import tokens
from textloom.plans.materialize import materialize


def postings(chunks: DataFrame, *, key: str = "chunk_id", text: str = "text", collection: str | None = "collection") -> DataFrame:
    """(collection, key, term, tf, dl) of each term of each chunk.  Null and blank texts give no row.

    Terms are counted in the task that reads the chunk, batch by batch on whole columns, so nothing is shuffled
    and the cost grows with the length of a text.
    """
    coll = F.col(collection) if collection else F.lit("all")
    t = chunks.select(coll.cast("string").alias("collection"), F.col(key).alias("key"), tokens(F.col(text)).alias("w")).where(F.size("w") > 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
            enc = pc.dictionary_encode(batch.column(2).flatten())
            width = max(len(enc.dictionary), 1)
            pair, tf = np.unique(np.repeat(np.arange(len(size)), size) * width + enc.indices.to_numpy(), return_counts=True)
            doc = pa.array(pair // width)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), enc.dictionary.take(pa.array(pair % width)), pa.array(tf.astype(np.int32)), pa.array(size.astype(np.int32)).take(doc)], names=["collection", "key", "term", "tf", "dl"])

    return t.mapInArrow(count, f"collection string, key {dict(chunks.dtypes)[key]}, term string, tf int, dl int")


def doc_terms(chunks: DataFrame, *, key: str = "chunk_id", text: str = "text", collection: str | None = "collection", keep: tuple[str, ...] = ()) -> DataFrame:
    """(collection, key, dl, terms, tfs and the columns of ``keep``): each chunk with its distinct terms and how often each occurs.

    One row for each chunk, without terms too, so nothing is shuffled and statistics of chunks can be added up from it.
    """
    coll = F.col(collection) if collection else F.lit("all")
    t = chunks.select(coll.cast("string").alias("collection"), F.col(key).alias("key"), tokens(F.col(text)).alias("w"), *keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
            enc = pc.dictionary_encode(batch.column(2).flatten())
            width = max(len(enc.dictionary), 1)
            pair, tf = np.unique(np.repeat(np.arange(len(size)), size) * width + enc.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(pair // width, minlength=len(size)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, enc.dictionary.take(pa.array(pair % width))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), *lists, *batch.columns[3:]], names=["collection", "key", "dl", "terms", "tfs", *keep])

    kinds = dict(chunks.dtypes)
    return t.mapInArrow(count, ", ".join([f"collection string, key {kinds[key]}, dl int, terms array<string>, tfs array<int>", *[f"{c} {kinds[c]}" for c in keep]]))


def term_counts(docs: DataFrame, *by: str) -> DataFrame:
    """(collection, term, the columns of ``by``, df) of the rows of ``doc_terms``."""
    return docs.select("collection", F.explode("terms").alias("term"), *by).groupBy("collection", "term", *by).agg(F.count("*").alias("df"))


def size_counts(docs: DataFrame, *by: str) -> DataFrame:
    """(collection, n, words, the columns of ``by``) of the rows of ``doc_terms``."""
    return docs.groupBy("collection", *by).agg(F.count("*").alias("n"), F.sum("dl").alias("words"))


def doc_stats(chunks: DataFrame, *, text: str = "text", collection: str | None = "collection") -> DataFrame:
    """(collection, n, avgdl); chunks without terms count."""
    coll = F.col(collection) if collection else F.lit("all")
    size = chunks.select(coll.alias("collection"), F.size(tokens(F.col(text))).alias("dl"))
    return size.groupBy("collection").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(post: DataFrame, stats: DataFrame, epsilon: float = 0.25, counted: bool = False) -> DataFrame:
    """(collection, term, df, idf) with the floor for terms that are in more than half of the chunks; ``counted`` says
    that ``post`` has (collection, term, df) already."""
    df = post if counted else post.groupBy("collection", "term").agg(F.count("*").alias("df"))
    raw = df.join(stats, "collection").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("collection").agg(F.avg("raw").alias("mean"))
    return raw.join(mean, "collection").select("collection", "term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def own_index(chunks: DataFrame, *, key: str = "chunk_id", text: str = "text", collection: str | None = "collection", epsilon: float = 0.25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms of chunks, document statistics, term statistics) of the chunks; the first is read often, so it is written once."""
    docs = materialize(doc_terms(chunks, key=key, text=text, collection=collection), "terms")
    stats = size_counts(docs).select("collection", "n", (F.col("words") / F.col("n")).alias("avgdl"))
    return docs, stats, term_stats(term_counts(docs), stats, epsilon, counted=True)


def weights(queries: DataFrame, terms: DataFrame, collection: str | None = "collection") -> DataFrame:
    """(query_id, collection, term, qtf, idf) of the terms that a query's collection has.  Repeated terms count as often as they occur."""
    coll = F.col(collection) if collection else F.lit("all")
    q = queries.select("query_id", coll.alias("collection"), F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "collection", "term").agg(F.count("*").alias("qtf"))
    return q.join(terms.select("collection", "term", "idf"), ["collection", "term"])


def bm25_scores(queries: DataFrame, chunks: DataFrame, *, key: str = "chunk_id", text: str = "text", collection: str | None = "collection", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, index: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, key, score) of each chunk that shares a term with a query of its collection.

    These are many: requests times chunks.  Where the best are enough ``bm25_best`` doesn't write them all.  Queries without
    terms and chunks without terms give no row.  ``index`` gives stored terms of chunks, document statistics and term
    statistics in place of the chunks' own.
    """
    if index:
        docs, stats, terms = index
        post = docs.select("collection", "key", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("collection", "key", "dl", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    else:
        # the postings are read for the statistics and for the scores, so they are written once
        post, stats = materialize(postings(chunks, key=key, text=text, collection=collection), "postings"), doc_stats(chunks, text=text, collection=collection)
        terms = term_stats(post, stats, epsilon)
    hit = weights(queries, terms, collection).join(post, ["collection", "term"]).join(stats, "collection")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query_id", "key").agg(F.round(F.sum(part), 9).alias("score"))


#: Chunks of a pack and queries of a block: their product bounds the scores that a task holds at once.
PACK, BLOCK = 2048, 512


def packs_of(docs: DataFrame) -> DataFrame:
    """The rows of ``doc_terms`` in packs of one collection: (collection, the arrays keys, dls, sizes, terms, codes, tfs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = batch.column(0).to_numpy(zero_copy_only=False)
            for c in pc.unique(batch.column(0)).drop_null().to_pylist():
                at = np.flatnonzero(name == c)
                for part in np.array_split(at, -(-len(at) // PACK)):
                    own = batch.take(pa.array(part))
                    enc = pc.dictionary_encode(own.column(3).flatten())
                    lists = [own.column(1), own.column(2), pc.list_value_length(own.column(3)), enc.dictionary, enc.indices, own.column(4).flatten()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()), *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]], names=["collection", "keys", "dls", "sizes", "terms", "codes", "tfs"])

    kind = dict(docs.dtypes)["key"]
    return docs.where(F.size("terms") > 0).select("collection", "key", "dl", "terms", "tfs").mapInArrow(run, f"collection string, keys array<{kind}>, dls array<int>, sizes array<int>, terms array<string>, codes array<int>, tfs array<int>")


def sums(d: np.ndarray, t: np.ndarray, x: np.ndarray, u: np.ndarray, q: np.ndarray, w: np.ndarray, rows: int, cols: int, width: int) -> np.ndarray:
    """The product (rows, cols) of two sparse matrices, x at (d, t) and w at (u, q), over ``width`` terms.  Terms that fill much of it are
    multiplied as dense columns, the others pair by pair."""
    here, asked = np.bincount(t, minlength=width), np.bincount(u, minlength=width)
    dense = here * asked > 0.01 * rows * cols
    many, wide = dense[t], dense[u]
    place = np.cumsum(dense) - 1
    left, right = np.zeros((rows, dense.sum())), np.zeros((dense.sum(), cols))
    left[d[many], place[t[many]]] = x[many]
    right[place[u[wide]], q[wide]] = w[wide]
    out = left @ right
    order = np.argsort(u, kind="stable")
    first = np.cumsum(asked) - asked
    d, t, x = d[~many], t[~many], x[~many]
    times = asked[t]
    pair = np.repeat(np.arange(len(t)), times)
    to = order[np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times) + first[t][pair]]
    return out + np.bincount(d[pair] * cols + q[to], weights=x[pair] * w[to], minlength=rows * cols).reshape(rows, cols)


def bm25_best(queries: DataFrame, k: int, index: tuple[DataFrame, DataFrame, DataFrame], *, collection: str | None = "collection", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, key, score, rank) of the k best chunks of each query, as ``top_k`` of all scores gives them.

    A pack of chunks meets the blocks of queries of its collection in the task that reads it, which keeps the best of each query; only
    these are shuffled, not the scores of all chunks.
    """
    docs, stats, terms = index
    kind = dict(docs.dtypes)["key"]
    w = weights(queries, terms, collection).join(stats, "collection")
    number = F.floor((F.dense_rank().over(Window.partitionBy("collection").orderBy("query_id")) - 1) / BLOCK)
    x = w.withColumn("block", number).groupBy("collection", "block", "avgdl").agg(F.collect_list(F.struct("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))).alias("x"))
    # written once, as each task reads all of them
    blocks = materialize(x.select(F.col("collection").alias("c"), "block", "avgdl", F.col("x.query_id").alias("qids"), F.col("x.term").alias("asked"), F.col("x.w").alias("w")).coalesce(1), "blocks")
    # no equality, as a join by it would bring all packs of a collection to one task
    pairs = packs_of(docs).join(blocks, (F.col("collection") >= F.col("c")) & (F.col("collection") <= F.col("c")))
    names = ["query_id", "key", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, edges, numbers = [], 0, {}, {}

        def compress() -> pa.Table:
            both = pa.concat_tables(held).sort_by([("at", "ascending"), ("score", "descending"), ("key", "ascending")])
            at = both["at"].to_numpy()
            return both.filter(pa.array(np.arange(len(at)) - np.searchsorted(at, at) < k))

        for batch in batches:
            for r in range(batch.num_rows):
                col = lambda name: batch.column(name)[r].values  # noqa: B023, E731
                vocabulary = pc.dictionary_encode(col("asked"))
                qids, q = np.unique(col("qids").to_numpy().astype(np.int64), return_inverse=True)
                known = pc.index_in(col("terms"), vocabulary.dictionary).fill_null(-1).to_numpy()
                t = known[col("codes").to_numpy()]
                d = np.repeat(np.arange(len(col("keys"))), col("sizes").to_numpy())
                d, t, tf = d[t >= 0], t[t >= 0], col("tfs").to_numpy()[t >= 0].astype(np.float64)
                x = tf * (k1 + 1) / (tf + k1 * (1 - b + b * col("dls").to_numpy()[d] / batch.column("avgdl")[r].as_py()))
                u, w, shape = vocabulary.indices.to_numpy(), col("w").to_numpy(), (len(col("keys")), len(qids), len(vocabulary.dictionary))
                score = sums(d, t, x, u, q, w, *shape)
                # a chunk that shares a term has a row, even with a weight that is not positive
                score = np.where(score > 0 if (w > 0).all() else sums(d, t, np.ones(len(x)), u, q, np.ones(len(w)), *shape) > 0, np.round(score, 9), -np.inf)
                block = (batch.column("c")[r].as_py(), batch.column("block")[r].as_py())
                if block not in edges:
                    edges[block] = np.partition(score, max(len(score) - k, 0), axis=0)[max(len(score) - k, 0)] if len(score) >= k else np.full(len(qids), -np.inf)
                row, q = np.nonzero((score >= edges[block]) & (score > -np.inf))
                at = numbers.setdefault(block, len(numbers)) * BLOCK + q
                held.append(pa.table([pa.array(at), pa.array(qids[q]), col("keys").take(pa.array(row)), pa.array(score[row, q])], names=["at", *names]))
                rows += len(row)
                if rows > 1_000_000:
                    held = [compress()]
                    rows = len(held[0])
        if held:
            yield from compress().select(names).combine_chunks().to_batches()

    return top_k(pairs.mapInArrow(run, f"query_id bigint, key {kind}, score double"), k)


def bm25_of(candidates: DataFrame, queries: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], *, collection: str | None = "collection", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, key, score) of stated pairs (query_id, key) in a query's own collection; 0 without a common term."""
    docs, stats, terms = index
    w = weights(queries, terms, collection).groupBy("query_id", "collection").agg(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("w"))).alias("x")).join(stats, "collection")
    pairs = candidates.select("query_id", "key").join(w, "query_id").join(docs, ["key", "collection"])

    def part(x):  # noqa: ANN001, ANN202
        tf = F.get("tfs", F.array_position("terms", x["term"]).cast("int") - 1)
        return F.coalesce(x["w"] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))), F.lit(0.0))

    return pairs.select("query_id", "key", F.round(F.aggregate("x", F.lit(0.0), lambda s, x: s + part(x)), 9).alias("score"))


def top_k(scores: DataFrame, k: int, *, score: str = "score", key: str = "key") -> DataFrame:
    """The k best rows of each query with their rank from 1; of equal scores the lesser key is first."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
