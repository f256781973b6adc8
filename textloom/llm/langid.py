"""Problem 3: missing or wrong language labels, and texts that mix languages.

Error-correcting output codes: each language has a codeword of ``bits`` signs, and for each bit a binary
n-gram classifier (log odds of hashed character n-grams and whole words between the languages with + and
those with -) predicts the sign.  The margins of a line are the means over its words; loss-weighted decoding
takes the language whose codeword has the least logistic loss, and the distance to the second one says how
sure that is.  Lines that are too close to call take the language of their section.

The classifiers are fitted on the fixed sample sentences and about ``max_rows`` labelled rows (twice as many
at most), chosen by a hash of the id.  As labels may be wrong, the rows count only line by line: first those lines on which the
classifier of the sample sentences agrees with the label, then those that the second classifier is sure of.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.tables import table

#: Identifiers, numbers, paths and addresses say nothing about the language.
NOISE = r"\S*[\d_/\\@]\S*"
NOT_LETTERS = r"[^\p{L}\p{M}']+"
MISSING = ("", "und")


def codewords(n: int, bits: int, seed: int = 7) -> np.ndarray:
    """n rows of ``bits`` signs whose least Hamming distance is the best of many random draws."""
    rng, best, found = np.random.default_rng(seed), -1, None
    for _ in range(4000):
        m = rng.choice([-1, 1], size=(n, bits))
        if n > 1 and (np.abs(m.sum(0)) == n).any():
            continue
        d = ((bits - m @ m.T) // 2 + bits * np.eye(n, dtype=int)).min()
        if d > best:
            best, found = d, m
    return found


def grams(word: str, buckets: int) -> list[int]:
    """Buckets of a word's n-grams of 1 to 4 characters with its ends, and of the word itself (three times)."""
    w = f"<{word}>"
    out = [hash_text("=" + word) % buckets] * 3
    for n in (1, 2, 3, 4):
        out += [hash_text(w[i : i + n]) % buckets for i in range(len(w) - n + 1)]
    return out


def hash_text(s: str) -> int:
    """FNV-1a over code points; the same in every process."""
    h = 2166136261
    for c in s:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h ^ h >> 15


def words_of(lines: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, index of each word of all lines, number of words of each line)."""
    a = pc.utf8_lower(pa.array(lines, pa.string()))
    a = pc.replace_substring_regex(a, NOISE, " ")
    a = pc.utf8_trim_whitespace(pc.replace_substring_regex(a, NOT_LETTERS, " "))
    lists = pc.split_pattern(a, " ")
    flat = lists.flatten()
    enc = pc.dictionary_encode(flat)
    words, idx = enc.dictionary.to_pylist(), enc.indices.to_numpy()
    return words, idx, pc.list_value_length(lists).to_numpy()


class OutputCodes:
    """The codewords and the log odds of the bits; scores are kept by word."""

    def __init__(self, langs: list[str], bits: int = 15, buckets: int = 1 << 16) -> None:
        self.langs, self.buckets = langs, buckets
        self.code = codewords(len(langs), bits)
        self.weights = np.zeros((buckets, bits), dtype=np.float32)
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {"": 0}
        self.scores = np.zeros((1, self.code.shape[1]), dtype=np.float32)
        self.informative = np.zeros(1, dtype=bool)

    def fit(self, lines: list[str], langs: list[str], smooth: float = 0.3) -> None:
        at = {x: k for k, x in enumerate(self.langs)}
        words, idx, size = words_of(lines)
        lang = np.repeat(np.array([at[x] for x in langs]), size)
        n_words = len(words)
        per = np.zeros((len(self.langs), n_words), dtype=np.float64)
        np.add.at(per, (lang, idx), 1)
        per = np.log1p(per)  # a word that fills the sample counts less than its share
        count = np.zeros((len(self.langs), self.buckets))
        for k, w in enumerate(words):
            if w:
                for g in grams(w, self.buckets):
                    count[:, g] += per[:, k]
        p = (count + smooth) / (count.sum(1, keepdims=True) + smooth * self.buckets)
        seen = count.sum(0) > 0
        for b in range(self.code.shape[1]):
            plus = self.code[:, b] > 0
            self.weights[:, b] = np.where(seen, np.log(p[plus].mean(0)) - np.log(p[~plus].mean(0)), 0)
        self.forget()

    def learn(self, words: list[str]) -> np.ndarray:
        """Row of each word in ``scores``; new words get their clipped mean log odds."""
        if len(self.row) > 1_000_000:
            self.forget()
        fresh = [w for w in words if w not in self.row]
        if fresh:
            made = np.empty((len(fresh), self.code.shape[1]), dtype=np.float32)
            for k, w in enumerate(fresh):
                made[k] = self.weights[grams(w, self.buckets)].mean(0)
                self.row[w] = len(self.row)
            self.scores = np.vstack([self.scores, np.clip(made * 2, -2.5, 2.5)])
        return np.array([self.row[w] for w in words], dtype=np.int64)

    def margins(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(mean margins of each line, number of its words)."""
        words, idx, size = words_of(lines)
        rows = self.learn(words)[idx] if len(idx) else np.zeros(0, dtype=np.int64)
        n = len(lines)
        total = np.zeros((n, self.code.shape[1]), dtype=np.float32)
        full = size > 0
        if full.any():
            starts = (np.cumsum(size) - size)[full]
            total[full] = np.add.reduceat(self.scores[rows], starts, axis=0)
        blank = np.array([not w for w in words], dtype=bool)
        real = np.bincount(np.repeat(np.arange(n), size), weights=~blank[idx], minlength=n) if len(idx) else np.zeros(n)
        return total / np.maximum(real, 1)[:, None], real

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the best language, its confidence, gap of the loss to the second) of each row."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).mean(2)
        best = loss.argmin(1)
        part = np.sort(loss, axis=1)
        gap = part[:, 1] - part[:, 0] if loss.shape[1] > 1 else np.ones(len(loss))
        conf = 1 / np.exp((part[:, :1] - part) * 12).sum(1)
        return best, conf, gap


def plain_lines(text: str | None) -> list[tuple[int, str]]:
    """(line_no, line) of the non-blank lines outside fenced code."""
    if not text:
        return []
    lines = text.split("\n")
    if "```" not in text:
        return [(k, x) for k, x in enumerate(lines) if x and not x.isspace()]
    out, inside = [], False
    for k, x in enumerate(lines):
        if x.lstrip().startswith("```"):
            inside = not inside
        elif not inside and x.strip():
            out.append((k, x))
    return out


def clean_label(label: Column) -> Column:
    """A label in lower case without a region; null if it says nothing."""
    short = F.regexp_extract(F.lower(F.trim(label)), r"^([^-_]*)", 1)
    return F.when(short.isin(*MISSING), F.lit(None)).otherwise(short)


def fit(samples: list[tuple[str, str]], rows: list[tuple[str, str]], bits: int = 15, sure: float = 0.04) -> OutputCodes:
    """The classifiers from (language, sentence) samples and (label, text) rows."""
    langs = sorted({x for x, _ in samples})
    codes = OutputCodes(langs, bits)
    own = [(x, t) for x, t in samples if t]
    codes.fit([t for _, t in own], [x for x, _ in own])
    lines = [(x, line) for x, t in rows if x in set(langs) for _, line in plain_lines(t)]
    if lines:
        labels = np.array([langs.index(x) for x, _ in lines])
        texts = [t for _, t in lines]
        for turn in range(3):
            margins, n = codes.margins(texts)
            best, _, gap = codes.decode(margins)
            take = np.flatnonzero(((best == labels) if turn == 0 else (gap > sure)) & (n >= 3))
            codes.fit([texts[k] for k in take] + [t for _, t in own], [langs[best[k]] for k in take] + [x for x, _ in own])
    return codes


def label_languages(sections: DataFrame, samples: DataFrame, *, id_col: str = "section_id", text_col: str = "text", label_col: str = "lang", sample_lang: str = "lang", sample_text: str = "text", max_rows: int = 4000, max_samples: int = 100_000, bits: int = 15, sure: float = 0.05, least_words: int = 3) -> DataFrame:
    """(id_col, label, lang, confidence, n_langs, lines) of each row of ``sections``.

    ``lines`` holds (line_no, lang, confidence, ambiguous) of each non-blank line outside fenced code; lang is
    the language of most words.  A row without such lines (null, empty and blank texts among them) has a null
    lang and no lines.  Null labels, blank ones and ``und`` are null.  Of two languages with equal loss the
    first by name wins.  Only the languages of the samples are known, so text in another one gets that among them that
    is least unlike it, with a low confidence.  The classifiers see at most ``max_samples`` sample sentences and twice
    ``max_rows`` rows, those first by a hash, so that a fit on the same rows is the same.  Repeated rows give repeated rows; very long texts are read whole; an empty table
    gives an empty result; other columns are not read.
    """
    spark = sections.sparkSession
    own = [(r[0].strip().lower(), r[1]) for r in samples.where(F.col(sample_lang).isNotNull() & F.col(sample_text).isNotNull()).select(sample_lang, sample_text).orderBy(F.xxhash64(sample_text), sample_text, sample_lang).limit(max_samples).collect()]
    if not own:
        raise ValueError("there are no sample sentences")
    labelled = sections.select(clean_label(F.col(label_col)).alias("x"), F.col(text_col).alias("t"), F.xxhash64(F.col(id_col)).alias("h")).where("x IS NOT NULL AND t IS NOT NULL")
    share = min(1.0, max_rows / max(sections.count(), 1))
    picked = labelled.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy("h", "x", "t").limit(2 * max_rows)
    model = fit(own, sorted((r[0], r[1]) for r in picked.select("x", "t").collect()), bits)
    shared = spark.sparkContext.broadcast(model)
    kind = dict(sections.dtypes)[id_col]
    schema = f"i {kind}, label string, lang string, confidence float, n_langs int, lines array<struct<line_no:int,lang:string,confidence:float,ambiguous:boolean>>"
    struct = pa.struct([("line_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float32()), ("ambiguous", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: OutputCodes = shared.value
        names = np.array(codes.langs, dtype=object)
        for batch in batches:
            per = [plain_lines(t) for t in batch.column(2).to_pylist()]
            size = np.array([len(p) for p in per], dtype=np.int64)
            total = int(size.sum())
            doc = np.repeat(np.arange(len(per)), size)
            margins, n = codes.margins([x for p in per for _, x in p])
            best, conf, gap = codes.decode(margins) if total else (np.zeros(0, int), np.zeros(0), np.zeros(0))
            weak = (gap < sure) | (n < least_words)
            # the section's language: that of most words, by its sure lines if there are any
            votes = np.zeros((len(per), len(names)))
            weight = np.maximum(n, 0.01) * np.where(weak, 0.01, 1)
            np.add.at(votes, (doc, best), weight)
            main = votes.argmax(1)
            share = votes.max(1) / np.maximum(votes.sum(1), 1e-9)
            final = np.where(weak, main[doc], best)
            seen = np.zeros((len(per), len(names)), dtype=bool)
            seen[doc, final] = True
            empty = size == 0
            line = pa.StructArray.from_arrays([pa.array([k for p in per for k, _ in p], pa.int32()), pa.array(names[final] if total else [], pa.string()), pa.array(conf.astype(np.float32)), pa.array(weak)], fields=list(struct))
            offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
            mean = np.bincount(doc, weights=conf, minlength=len(per)) / np.maximum(size, 1) if total else np.zeros(len(per))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names[main], pa.string(), mask=empty), pa.array((mean * share).astype(np.float32), mask=empty), pa.array(seen.sum(1).astype(np.int32)), pa.ListArray.from_arrays(offsets, line)],
                names=["i", "label", "lang", "confidence", "n_langs", "lines"],
            )

    out = sections.select(F.col(id_col).alias("i"), clean_label(F.col(label_col)).alias("label"), F.col(text_col).alias("t")).mapInArrow(run, schema)
    return out.select(F.col("i").alias(id_col), "label", "lang", "confidence", "n_langs", "lines")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section_id, line_no, lang) of each line of the sections with a missing or wrong label or with mixed languages."""
    found = label_languages(table(spark, sf_dir, "sections"), table(spark, sf_dir, "lang_samples"))
    case = F.col("label").isNull() | (F.col("label") != F.col("lang")) | (F.col("n_langs") > 1)
    return found.where(case).select("section_id", F.explode("lines").alias("x")).select("section_id", "x.line_no", "x.lang")


def p3_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section with its label, language, confidence and number of languages."""
    return label_languages(table(spark, sf_dir, "sections"), table(spark, sf_dir, "lang_samples")).select("section_id", "label", "lang", F.round("confidence", 3).alias("confidence"), "n_langs")


QUERIES = {"p3_found": p3_found, "p3_sections": p3_sections}
SQL: dict[str, str] = {}
