"""Vector search, exact or by inverted lists.

Vectors and queries are packed where they are: an Arrow batch of vectors becomes one row, and so does a batch of
queries.  Exact search meets every block of queries with every pack of vectors; with an index only those of the same
inverted list meet, in a join by list.  Either way one matrix product serves a block and a pack, similarities are
exact, a task keeps the best of each query, and only those are shuffled.  No query and no vector passes the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.materialize import materialize


class Embedder(Protocol):
    """Turns a batch of texts into an array (texts, dimensions) of unit vectors."""

    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """A deterministic stand-in for a model: signed hashes of a text's tokens, as a unit vector."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        # all words of the batch at once; each distinct word is hashed once
        clean = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(pa.array([t or "" for t in texts], pa.string())), r"[^\p{L}\p{N}_]+", " "))
        lists = pc.split_pattern(clean, " ")
        enc = pc.dictionary_encode(lists.flatten())
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in enc.dictionary.to_pylist()], dtype=np.uint64)
        long = np.array([len(w) > 2 for w in enc.dictionary.to_pylist()], dtype=bool)
        idx = enc.indices.to_numpy()
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[long[idx]]
        h = hashes[idx[long[idx]]]
        sign = np.where(h >> np.uint64(63) == 1, 1.0, -1.0)
        out = np.bincount(row * self.dim + (h % np.uint64(self.dim)).astype(np.int64), weights=sign, minlength=len(texts) * self.dim).reshape(len(texts), self.dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class DigestEmbedder:
    """The digits of a text's digest as a vector: says nothing about meaning, but any SQL engine can compute it."""

    dim = 32

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.array([[int(c, 16) - 7.5 for c in hashlib.md5((t or "").encode("utf-8", "replace")).hexdigest()] for t in texts]).reshape(len(texts), 32)  # noqa: S324


def embed(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """``df`` with the vectors of its texts; the model is built once per task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(embedder(s.fillna("").tolist()).astype(np.float32)))

    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double; 0 where one of them is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def packed(df: DataFrame, ident: list[str], vector: str, filters: list[str], lists: str | None, most: int = 2048) -> DataFrame:
    """One row for each batch, list, value of the first filter and length of vectors, of at most ``most`` vectors: (list, dim, one, v,
    the columns of ``ident`` and f0, f1, ... as arrays); ``one`` is the value of the first filter."""
    kinds = [dict(df.dtypes)[c] for c in ident]
    cols = [(F.col(lists) if lists else F.lit(0)).cast("int"), F.col(vector), *[F.col(c) for c in ident], *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in filters]]
    names = [*ident, *[f"f{n}" for n in range(len(filters))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists_, size = batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            first = np.cumsum(size) - size
            kinds_ = pc.dictionary_encode(batch.column(2 + len(ident))) if filters else None
            code = kinds_.indices.to_numpy() if filters else np.zeros(len(size), np.int32)
            for k, d, n in np.unique(np.stack([lists_, size, code]), axis=1).T.tolist():
                if not d:
                    continue
                whole = np.flatnonzero((lists_ == k) & (size == d) & (code == n))
                for at in np.array_split(whole, -(-len(whole) // most)):
                    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    v = pa.array(flat[first[at][:, None] + np.arange(d)].ravel())
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([d], pa.int32()), pa.array([kinds_.dictionary[n].as_py() if filters else ""], pa.string()), one(v), *[one(c.take(pa.array(at))) for c in batch.columns[2:]]], names=["list", "dim", "one", "v", *names])

    schema = ["list int, dim int, one string, v array<float>", *[f"{c} array<{k}>" for c, k in zip(ident, kinds)], *[f"f{n} array<string>" for n in range(len(filters))]]
    aliased = [c.alias(f"c{n}") for n, c in enumerate(cols)]
    return df.where(F.col(vector).isNotNull()).select(*aliased).mapInArrow(run, ", ".join(schema))


def best_of(sim: np.ndarray, rank: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the k[q] greatest values of each column of ``sim``; of equal ones the least ``rank`` first; -inf is none."""
    most = min(int(k.max()), len(sim))
    edge = np.partition(sim, len(sim) - most, axis=0)[len(sim) - most]
    row, q = np.nonzero((sim >= edge) & (sim > -np.inf))
    order = np.lexsort((rank[row], -sim[row, q], q))
    row, q = row[order], q[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k[q]
    return row[keep], q[keep]


def nearest(pairs: DataFrame, n_filters: int, kind: str, exclude_self: bool) -> DataFrame:
    """(query_id, variant, key, sim) of the best of each query in each task, from packs that meet blocks."""
    schema = f"query_id bigint, variant int, key {kind}, sim double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0

        def compress() -> pd.DataFrame:
            both = pd.concat(held).sort_values(["query_id", "variant", "sim", "key"], ascending=[True, True, False, True], kind="stable")
            return both[both.groupby(["query_id", "variant"]).cumcount() < both["k"]]

        for batch in batches:
            for r in range(batch.num_rows):
                col = lambda name: batch.column(name)[r].values  # noqa: B023, E731
                d = batch.column("dim")[r].as_py()
                x, m = (col(c).to_numpy().reshape(-1, d).astype(np.float64) for c in ("v", "qv"))
                keys, qid = col("key"), col("query_id").to_numpy()
                norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None]
                sim = np.round(np.divide(x @ m.T, norm, out=np.zeros_like(norm), where=norm > 0), 9)
                for n in range(n_filters):
                    want, own = col(f"g{n}"), col(f"f{n}")
                    has = np.flatnonzero(pc.not_equal(want, "").to_numpy(zero_copy_only=False))
                    known = pc.unique(want)
                    sim[:, has] = np.where(pc.index_in(own, known).fill_null(-1).to_numpy()[:, None] == pc.index_in(want, known).to_numpy()[has][None], sim[:, has], -np.inf)
                if exclude_self:
                    sim[np.array(keys.to_pylist(), dtype=object)[:, None] == qid[None]] = -np.inf
                rank = np.empty(len(keys), np.int64)
                rank[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
                k = col("k").to_numpy()
                row, q = best_of(sim, rank, k)
                held.append(pd.DataFrame({"query_id": qid[q], "variant": col("variant").to_numpy()[q], "key": keys.take(pa.array(row)).to_pandas(), "sim": sim[row, q], "k": k[q]}))
                rows += len(row)
                if rows > 1_000_000:
                    held = [compress()]
                    rows = len(held[0])
        if held:
            yield pa.RecordBatch.from_pandas(compress()[["query_id", "variant", "key", "sim"]], schema=pa.schema([("query_id", pa.int64()), ("variant", pa.int32()), ("key", pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()), ("sim", pa.float64())]), preserve_index=False)

    return pairs.mapInArrow(run, schema)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int | str, *, key: str = "vec_id", vector: str = "embedding", filters: list[tuple[str, str]] | None = None, exclude_self: bool = False, index: VectorIndex | None = None) -> DataFrame:
    """(query_id, variant, key, sim, rank from 0) of the k nearest vectors of each query.

    ``queries`` has query_id, vector and optionally variant; with ``filters`` (query column, vector column) only
    vectors with an equal value are compared where the query's value is neither null nor empty.  ``k`` is a
    number or the name of a query column.  The search is exact, unless ``index`` is given; then ``vectors`` are those
    that it has assigned (with their column ``list``), and a query looks at its nearest lists only.

    Null vectors give no row; vectors of another length than the query's are not compared; of equal
    similarities (to nine digits) the lesser key is first; empty tables give an empty result.
    """
    own = filters or []
    kind = dict(vectors.dtypes)[key]
    asked = queries.select("query_id", (F.col("variant") if "variant" in queries.columns else F.lit(0)).cast("int").alias("variant"), F.col(vector).alias("qv"), F.greatest(F.lit(0), (F.col(k) if isinstance(k, str) else F.lit(k)).cast("int")).alias("k"), *[F.col(a).cast("string").alias(f"g{n}") for n, (a, _) in enumerate(own)]).where("k > 0")
    asked = index.nearest_lists(asked, "qv") if index else asked
    blocks = packed(asked, ["query_id", "variant", "k"], "qv", [f"g{n}" for n in range(len(own))], "list" if index else None, 512)
    blocks = blocks.withColumnsRenamed({"v": "qv", "dim": "d", "list": "l", "one": "o", **{f"f{n}": f"g{n}" for n in range(len(own))}})
    data = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"), *[F.col(b).cast("string").alias(f"x{n}") for n, (_, b) in enumerate(own)], *(["list"] if index else []))
    packs = packed(data, ["key"], "v", [f"x{n}" for n in range(len(own))], "list" if index else None)
    meet = (F.col("o") == "") | (F.col("one") == F.col("o"))
    if index:  # list by list
        pairs = packs.join(blocks, (F.col("list") == F.col("l")) & (F.col("dim") == F.col("d")) & meet)
    else:
        # a stated set of queries against all vectors, pack by pack; no equality, as a join by it would bring all packs to one
        # task; the blocks are written once, as each task reads all of them
        pairs = packs.join(materialize(blocks.coalesce(1), "blocks"), (F.col("dim") >= F.col("d")) & (F.col("dim") <= F.col("d")) & meet)
    found = nearest(pairs, len(own), kind, exclude_self)
    w = Window.partitionBy("query_id", "variant").orderBy(F.col("sim").desc(), F.col("key"))
    ranked = found.withColumn("rank", F.row_number().over(w) - 1)
    if isinstance(k, int):
        return ranked.where(F.col("rank") < k).select("query_id", "variant", F.col("key").alias(key), "sim", "rank")
    limits = asked.select("query_id", "variant", F.col("k").alias("_k")).distinct()
    return ranked.join(limits, ["query_id", "variant"]).where("rank < _k").select("query_id", "variant", F.col("key").alias(key), "sim", "rank")


@dataclass(frozen=True)
class VectorIndex:
    """Inverted lists around the centres of a k-means clustering (by cosine)."""

    centres: np.ndarray
    probes: int

    @classmethod
    def fit(cls, vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id", lists: int = 16, probes: int = 12, max_sample: int = 20_000, rounds: int = 10) -> VectorIndex:
        """The centres from at most ``max_sample`` vectors, those first by a hash of their key; every vector is then
        assigned, and a search looks at ``probes`` lists of each query.  An empty table gives one list."""
        own = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key)).limit(max_sample).select(vector).toArrow()[vector].combine_chunks()
        if not len(own):
            return cls(np.zeros((1, 0)), 1)
        x = [np.asarray(v, dtype=np.float64) for v in own.to_pylist()]
        dim = int(np.bincount([len(v) for v in x]).argmax())
        x = np.array([v for v in x if len(v) == dim])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = x[np.random.default_rng(5).permutation(len(x))[:lists]]
        for _ in range(rounds):
            near = (x @ c.T).argmax(1)
            for j in range(len(c)):
                if (near == j).any():
                    m = x[near == j].mean(0)
                    c[j] = m / max(np.linalg.norm(m), 1e-12)
        return cls(c, min(probes, len(c)))

    def lists_of(self, df: DataFrame, vector: str, n: int) -> DataFrame:
        centres = self.centres

        def near(v: pd.Series) -> pd.Series:
            out = []
            for x in v:
                same = x is not None and len(x) == centres.shape[1]
                out.append(np.argsort(-(centres @ np.asarray(x, dtype=np.float64)), kind="stable")[:n].astype(np.int32) if same else np.arange(n, dtype=np.int32))
            return pd.Series(out)

        return df.withColumn("list", F.explode(F.pandas_udf(near, "array<int>")(F.col(vector))))

    def assign(self, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
        """``vectors`` with the number of the list that each belongs to."""
        return self.lists_of(vectors, vector, 1)

    def nearest_lists(self, queries: DataFrame, vector: str) -> DataFrame:
        return self.lists_of(queries, vector, self.probes)
