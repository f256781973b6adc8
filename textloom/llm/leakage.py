"""Problem 7: evaluation texts that leak into training text.

One Aho-Corasick automaton holds every run of ``min_words`` words of the normalised evaluation items.  A
text is scanned once; its words are found in the original text, so every match has offsets there.

Normalisation: a word is a longest run of letters and digits, in lower case.  For the automaton each
distinct word of the items is a number, written in characters of a private alphabet, and every other word is
as many separator characters.

The evaluation set is broadcast: it is a fixed table, and ``leaks`` refuses one with more than
``max_item_words`` words (the bound that the broadcast and the automaton rely on).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.tables import table

WORD = re.compile(r"[^\W_]+")
OTHER = "\x01"
FIRST = 0x100
_built: dict = {}


def index_of(name: str, rows: list, min_words: int) -> LeakIndex:
    """The automaton of one search; a worker process builds it once and keeps that of its last search."""
    if name not in _built:
        _built.clear()
        _built[name] = LeakIndex(rows, min_words)
    return _built[name]


def n_words(text: Column) -> Column:
    """The number of words of a text, counted by Spark."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1))


def code_point(k: int) -> str:
    """The k-th character of the private alphabet; surrogates are left out."""
    c = FIRST + k
    return chr(c if c < 0xD800 else c + 0x800)


class LeakIndex:
    """The automaton over the word windows of the items.

    A word of the items is a number of ``width`` digits, each a character of the private alphabet; each place has
    digits of its own, so that no match can start inside a word, and a node has at most ``base`` children, which
    the automaton searches one by one.
    """

    def __init__(self, items: list[tuple[int, str]], min_words: int = 12, base: int = 128) -> None:
        self.min_words = min_words
        texts = [(item_id, [w.lower() for w in WORD.findall(text or "")]) for item_id, text in items]
        known = dict.fromkeys(w for _, words in texts for w in words)
        self.width = 1
        while base**self.width < len(known):
            self.width += 1
        self.codes = {w: "".join(code_point(base * p + k // base**p % base) for p in range(self.width)) for k, w in enumerate(known)}
        self.other = OTHER * self.width
        windows: dict[str, set[int]] = {}
        for item_id, words in texts:
            coded = [self.codes[w] for w in words]
            for i in range(len(coded) - min_words + 1):
                windows.setdefault("".join(coded[i : i + min_words]), set()).add(item_id)
        self.automaton = ahocorasick.Automaton()
        for window, ids in windows.items():
            self.automaton.add_word(window, tuple(sorted(ids)))
        if windows:
            self.automaton.make_automaton()
        self.empty = not windows

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, start, end) of each maximal leaked passage; offsets are those of ``text`` itself."""
        if not text or self.empty:
            return []
        get = self.codes.get
        words = WORD.findall(text)
        if len(words) < self.min_words:
            return []
        coded = "".join([get(w.lower(), self.other) for w in words])
        hits: dict[int, list[list[int]]] = {}
        for last, ids in self.automaton.iter(coded):
            end = last // self.width
            start = end - self.min_words + 1
            for item in ids:
                runs = hits.setdefault(item, [])
                if runs and start <= runs[-1][1] + 1 and end >= runs[-1][1]:
                    runs[-1][1] = end
                else:
                    runs.append([start, end])
        if not hits:
            return []
        at = [m.span() for m in WORD.finditer(text)]
        return [(item, at[a][0], at[b][1]) for item, runs in sorted(hits.items()) for a, b in runs]


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 12, max_item_words: int = 5_000_000) -> DataFrame:
    """Leaked passages: (id_col, item_id, start, end), one row per maximal passage of an item in a text.

    Null and blank texts or items and texts shorter than ``min_words`` words give no row; a repeated
    document row gives its rows again; items of fewer than ``min_words`` words cannot leak (see ``coverage``); further columns of ``docs`` are not read, whatever their names; an
    empty table on either side gives an empty result.
    """
    own = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
    size = own.agg(F.sum(n_words(F.col(item_text))).alias("words"), F.sum(F.length(item_text)).alias("chars")).first()
    words, chars = size["words"] or 0, size["chars"] or 0
    if words > max_item_words or chars > 20 * max_item_words:  # known before a text is fetched
        raise ValueError(f"the evaluation set has {words} words of {chars} characters; at most {max_item_words} words of 20 are held in memory")
    rows = [(int(r[0]), r[1]) for r in own.select(item_id, item_text).collect()]
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(rows)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = index_of(name, shared.value, min_words)
        for pdf in batches:
            out = [(i, *s) for i, t in zip(pdf["i"], pdf["t"]) for s in index.spans(t)]
            yield pd.DataFrame(out, columns=["doc", "item", "start", "end"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return out.mapInPandas(scan, f"doc {kind}, item bigint, start int, `end` int").select(F.col("doc").alias(id_col), F.col("item").alias("item_id"), "start", "end")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of each document that holds at least twelve consecutive words of an item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id").distinct()


def coverage(items: DataFrame, *, item_id: str = "item_id", item_text: str = "text", min_words: int = 12) -> DataFrame:
    """(item_id, n_words, covered) of each item; those of fewer than ``min_words`` words are not covered by the search."""
    own = items.groupBy(F.col(item_id).alias("item_id")).agg(F.max(F.coalesce(n_words(F.col(item_text)), F.lit(0))).alias("n_words"))
    return own.withColumn("covered", F.col("n_words") >= min_words)


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each evaluation item with the number of documents it leaked into and of passages found there, and whether
    it is long enough to be looked for."""
    hits = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_passages"))
    items = coverage(table(spark, sf_dir, "benchmark"))
    return items.join(hits, "item_id", "left").select("item_id", "n_words", "covered", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_passages", F.lit(0)).alias("n_passages"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
SQL: dict[str, str] = {
    "p7_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i : i + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
bg AS (SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i : i + 11], ' '))) AS g FROM b WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)
""",
}
SQL["p7_items"] = SQL["p7_found"].split("dg AS")[0] + r"""dg AS (SELECT doc_id, unnest(generate_series(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 12), bg AS (SELECT item_id, unnest(generate_series(1, len(w) - 11)) AS i, w FROM b WHERE len(w) >= 12),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 11], ' ') AS g FROM dg), y AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM bg),
hit AS (SELECT item_id, doc_id, i, i - lag(i) OVER (PARTITION BY item_id, doc_id ORDER BY i) AS gap FROM x JOIN y USING (g)),
n AS (SELECT item_id, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (WHERE gap IS NULL OR gap > 12) AS n_passages FROM hit GROUP BY item_id)
SELECT item_id, k::INTEGER AS n_words, k >= 12 AS covered, coalesce(n_docs, 0) AS n_docs, coalesce(n_passages, 0) AS n_passages
FROM (SELECT item_id, max(coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}]+')), 0)) AS k FROM benchmark GROUP BY item_id) LEFT JOIN n USING (item_id)
"""
