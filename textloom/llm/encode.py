"""Problem 6: token ids of a corpus by a public byte-level BPE.

Per partition, DuckDB contracts words by a recursive query.  The rows of the working table are token
positions, (word, pos, tok); each step joins neighbouring tokens to the merge table, finds each word's
pair of least rank and contracts it, from left to right, until no pair is left.  An ordered aggregation
then gives the ids of each word.  All occurrences of a word's best pair are contracted in one step: a
merge with the new token always has a higher rank, so the result is that of one contraction at a time.

Words repeat, so only words that a task has not met yet are contracted; the memory of a task keeps at most
``memory_words`` words and starts again beyond that.  A word of more than ``max_recursive_bytes`` bytes is
contracted by an exact heap instead, as the accumulated rows of the recursion grow with the square of its
length.

Splitting needs a look-ahead that DuckDB's regular expressions lack, so the public splitting pattern is
applied before.  Special tokens are never produced; their strings are ordinary text.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.tables import table

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pattern that splits text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CONTRACT = """
WITH RECURSIVE step AS (
    SELECT word, pos, tok, 0 AS it FROM start
    UNION ALL
    (WITH pairs AS (
        SELECT word, pos, tok, it, lead(tok) OVER w AS nxt, row_number() OVER w AS idx
        FROM step WINDOW w AS (PARTITION BY word ORDER BY pos)
     ), ranked AS (
        SELECT p.*, m.rank, m.new, min(m.rank) OVER (PARTITION BY p.word) AS best
        FROM pairs p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.nxt
     ), hits AS (
        SELECT *, coalesce(rank = best, false) AS hit FROM ranked WHERE best IS NOT NULL
     ), islands AS (
        SELECT *, idx - row_number() OVER (PARTITION BY word, hit ORDER BY idx) AS island FROM hits
     ), merged AS (
        SELECT *, CASE WHEN hit AND row_number() OVER (PARTITION BY word, hit, island ORDER BY idx) % 2 = 1 THEN new END AS made FROM islands
     ), kept AS (
        SELECT *, lag(made) OVER (PARTITION BY word ORDER BY idx) AS before FROM merged
     )
     SELECT word, pos, coalesce(made, tok), it + 1 FROM kept WHERE before IS NULL)
), final AS (
    SELECT word, pos, tok FROM step QUALIFY it = max(it) OVER (PARTITION BY word)
)
SELECT word, list(tok ORDER BY pos) AS ids FROM final GROUP BY word ORDER BY word
"""


def byte_chars() -> dict[int, str]:
    """The printable character that the public vocabulary writes for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class RecursiveBpe:
    """Contracts words with DuckDB; one per task."""

    def __init__(self, vocabulary: str, max_recursive_bytes: int = 4096, memory_words: int = 2_000_000, step_bytes: int = 4_000_000) -> None:
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.of_byte = np.array([vocab[c] for _, c in sorted(byte_chars().items())], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a, b = (np.array([vocab[p[k]] for p in pairs], dtype=np.int32) for k in (0, 1))
        new = np.array([vocab[p[0] + p[1]] for p in pairs], dtype=np.int32)
        self.ranks = {(x, y): (r, z) for r, (x, y, z) in enumerate(zip(a.tolist(), b.tolist(), new.tolist()))}
        self.db = duckdb.connect(config={"threads": 1})
        merges = pa.table({"a": a, "b": b, "rank": np.arange(len(a), dtype=np.int32), "new": new})
        self.db.register("merges_arrow", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_arrow")
        self.max_recursive_bytes, self.memory_words, self.step_bytes = max_recursive_bytes, memory_words, step_bytes
        self.known: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN)

    def heap(self, word: bytes) -> list[int]:
        """The ids of a long word: the pair of least rank, leftmost first, from a heap over a linked list."""
        tok = self.of_byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(tok)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*self.ranks[p], i, *p) for i in range(n - 1) if (p := (tok[i], tok[i + 1])) in self.ranks]
        heapq.heapify(queue)
        while queue:
            _, new, i, a, b = heapq.heappop(queue)
            j = nxt[i]
            if tok[i] != a or j >= n or tok[j] != b:
                continue
            tok[i], tok[j] = new, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] < n and (p := (tok[k], tok[nxt[k]])) in self.ranks:
                    heapq.heappush(queue, (*self.ranks[p], k, *p))
        return [t for t in tok if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Contract words that are not known yet, ``step_bytes`` at a time, so that a recursion's rows have a bound."""
        coded = [w.encode("utf-8", "replace") for w in words]
        short = [k for k, c in enumerate(coded) if len(c) <= self.max_recursive_bytes]
        for k in set(range(len(words))) - set(short):
            self.known[words[k]] = self.heap(coded[k])
        total = np.cumsum([len(coded[k]) for k in short]) if short else np.zeros(0, np.int64)
        a = 0
        while a < len(short):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + self.step_bytes, side="right")))
            self.contract([(words[k], coded[k]) for k in short[a:b]])
            a = b

    def contract(self, words: list[tuple[str, bytes]]) -> None:
        size = np.array([len(c) for _, c in words], dtype=np.int64)
        first = np.cumsum(size) - size
        tok = self.of_byte[np.frombuffer(b"".join(c for _, c in words), dtype=np.uint8)]
        start = pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), size), "pos": (np.arange(len(tok)) - np.repeat(first, size)).astype(np.int32), "tok": tok})
        self.db.register("start", start)
        got = self.db.sql(CONTRACT).to_arrow_table()
        self.db.unregister("start")
        for k, ids in zip(got["word"].to_pylist(), got["ids"].to_pylist()):
            self.known[words[k][0]] = ids

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """A list of ids for each text; an empty list for an empty or null one."""
        split = [self.split.findall(t) if t else [] for t in texts]
        if len(self.known) > self.memory_words:
            self.known.clear()
        known = self.known
        fresh = list(dict.fromkeys(w for words in split for w in words if w not in known))
        if fresh:
            self.learn(fresh)
        ids = [[i for w in words for i in known[w]] for words in split]
        return pa.array(ids, pa.list_(pa.int32()))


def encode_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json", max_recursive_bytes: int = 4096, memory_words: int = 2_000_000) -> DataFrame:
    """(id_col, ids): the token ids of every row, in the same partitioning, without a shuffle.

    Null and empty texts give an empty list; blank texts are encoded as they are; repeated rows give
    repeated rows; a null id stays null; an empty table gives an empty result; other columns are not read.
    A lone surrogate, which cannot be written in UTF-8, counts as ``?``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or RecursiveBpe(vocabulary, max_recursive_bytes, memory_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), bpe.encode(batch.column(1).to_pylist())], names=["i", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind}, ids array<int>").select(F.col("i").alias(id_col), "ids")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of each document by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p6_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and longest document by source, from the same encoding."""
    docs = table(spark, sf_dir, "documents")
    size = encode_corpus(docs).select("doc_id", F.size("ids").cast("bigint").alias("n"))
    return docs.select("doc_id", "source").join(size, "doc_id").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))


QUERIES = {"p6_ids": p6_ids, "p6_stats": p6_stats}
SQL: dict[str, str] = {}
