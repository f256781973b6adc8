"""Problem 2: pages whose article is template residue, filler, an error or a demand for scripts.

The block labeller separates the site's frame from the rest.  The text of the rest, whatever the labeller says of
it, has names, numbers and placeholders masked; equal masked texts are one template from here on.  Labels spread
from the trusted templates, those on which the labeller is sure or that hold nothing but known residue: each
round finds every other template that is alike to one reached in the round before, until a round finds none, so
whole components of trusted templates are residue and the others stay out.

A round looks for near-duplicates in partitioned SimHash tables: signatures of 64 bits, cut into ``BLOCKS`` blocks, with
one table for each choice of half of them, so that any two signatures within ``BLOCKS / 2`` bits meet in a table under
a key of 32 bits.  Candidates are verified by their Hamming distance and then by their words (multiset Dice, not
shingles, as most residue is shorter than five words).

One changed word of a short text turns far more than three bits, so the tables miss most short pairs.  They are
found by an exact way: two texts of n and m words with Dice t share at least t (n + m) / 2 of them, a repeated
word counted with its number, so they share one among the first n - ceil(t n / (2 - t)) + 1 and
m - ceil(t m / (2 - t)) + 1 in any common order.  The words that are rare among the templates of the round before
come first, those that these do not have at all before them.  Templates meet at these words; sizes and positions,
both exact bounds, discard most pairs before the words are compared.

Table keys and words go through one join.  Keys that the templates of the round before do not have, by a bitmap of
fixed size, are dropped where they are made, so almost nothing of the articles is shuffled.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import blocks as B
from textloom.llm.lines import by_kind, bytes_of, mapped, squeezed
from textloom.llm.shingles import mix
from textloom.plans.materialize import materialize
from textloom.plans.tables import table

#: Patterns of what varies between copies of a template.
PLACEHOLDER = r"(?i)\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|@@.*?@@|\[\[.*?\]\]|%\([\w.]+\)s|%[\w.]{2,}%|[$#]?\{[\w.]+\}|\[(?:your|insert) [^\]]*\]|<[\w.]+ goes here>|\b__[\w.]+?__"
NAME = r"(\p{L}[ ,])[\p{Lu}\p{Lt}\p{Lo}]\p{L}{3,}"
MARK, NO_WORD = r"([{}%<>@\[\]$#])", r"[^\p{L}\p{N}{}%<>@\[\]$# ]+"
#: Bytes for ``masked_ascii``: marks stay; capital letters are 3, other letters 2, spaces and commas 1.
MARKED = mapped(b"{}%<>@[]$#")
KINDS = bytes(3 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 1 if c in b" ," else 0 for c in range(256))
#: Slots of the counts that order words.
SLOTS = 1 << 16
#: Bits of the bitmap of keys.
MARKS = 1 << 20
#: Blocks of a signature; half of them make the key of a table.
BLOCKS = 6


def masked(cores: pa.Array) -> pa.Array:
    """Core texts without what varies between copies of one template."""
    if cores.null_count:
        valid = pc.is_valid(cores).to_numpy(zero_copy_only=False)
        return masked(cores.drop_null()).take(pa.array(np.cumsum(valid) - 1, mask=~valid))
    return by_kind(cores, masked_ascii, masked_any)


def replaced(a: pa.Array, where: str, pattern: str, by: str) -> pa.Array:
    """The strings with each match of ``pattern`` replaced; ``where`` matches in all strings that have one."""
    hit = pc.match_substring_regex(a, where)
    return pc.replace_with_mask(a, hit, pc.replace_substring_regex(a.filter(hit), pattern, by)) if pc.any(hit).as_py() else a


def masked_ascii(cores: pa.Array) -> pa.Array:
    """``masked`` for texts of ASCII, by their bytes: every word of four letters or more that begins with a capital one after a letter and a
    space or comma is a name, whether a name comes before it or not."""
    a = replaced(cores, r"[{<\[%]|@@|__", PLACEHOLDER, " placeholdermark ")
    off, data = bytes_of(replaced(a, MARK, MARK, r" \1 "))
    kind = np.frombuffer(data.translate(KINDS), np.uint8)
    at = np.flatnonzero(kind == 3)
    text = np.searchsorted(off, at, side="right")
    inside = (at - 2 >= off[text - 1]) & (at + 3 < off[text])
    at, end = at[inside], off[text[inside]]
    name = (kind[at - 2] >= 2) & (kind[at - 1] == 1) & (kind[at + 1] >= 2) & (kind[at + 2] >= 2) & (kind[at + 3] >= 2)
    at, end = at[name], end[name]
    others = np.r_[np.flatnonzero(kind < 2), len(kind)]
    size = np.minimum(others[np.searchsorted(others, at)], end) - at
    x = np.frombuffer(bytearray(data.translate(MARKED)), np.uint8)
    x[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())] = 1
    return pc.replace_substring(squeezed(off, x), "\1", "namemark")


def masked_any(cores: pa.Array) -> pa.Array:
    """``masked`` by regular expressions, for all letters."""
    a = pc.replace_substring_regex(cores, PLACEHOLDER, " placeholdermark ")
    a = pc.replace_substring_regex(a, NAME, r"\1namemark")
    again = pc.fill_null(pc.match_substring_regex(a, "namemark[ ,]" + NAME.split(")")[1]), False)
    if pc.any(again).as_py():  # a name that follows a name
        a = pc.replace_with_mask(a, again, pc.replace_substring_regex(a.filter(again), NAME, r"\1namemark"))
    a = replaced(replaced(pc.utf8_lower(a), r"\d", r"\d+", "0"), MARK, MARK, r" \1 ")
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.replace_substring_regex(a, NO_WORD, " "), " {2,}", " "))


def signatures(doc: np.ndarray, ids: np.ndarray, n_texts: int) -> np.ndarray:
    """64-bit SimHash of the words of each text, from ``word_ids``; 0 for a text without words.

    The bits are counted in bytes, eight to a number, over stretches of at most 255 words of a text.
    """
    n = np.bincount(doc, minlength=n_texts)
    out = np.zeros(n_texts, dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    parts = -(-n[full] // 255)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat((np.cumsum(n) - n)[full], parts) + 255 * number
    first, h = np.cumsum(parts) - parts, mix(ids)
    for k in range(8):  # byte j of ``some`` counts bit 8 j + k
        some = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), start).view(np.uint8).reshape(-1, 8)
        on = np.add.reduceat(some, first, axis=0, dtype=np.int64) * 2 > n[full][:, None]
        out[full] |= np.ascontiguousarray(on).view(np.uint64).ravel() << np.uint64(k)
    return out


def dice(a: str, b: str) -> float:
    x, y = Counter(a.split()), Counter(b.split())
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 1.0


def known_residue(core: str) -> bool:
    """Nothing but lines that the seeds know, or filler."""
    lines = [x for x in core.split("\n") if x.strip()]
    for x in sorted(lines, key=len, reverse=True):  # long lines decide soonest
        words = B.WORD.findall(x.lower())
        if not (len(words) <= 24 and B.RESIDUE_RE.search(B.bare(re.sub(r"`[^`]*`", " ", x))) or words and sum(map(B.LOREM.__contains__, words)) >= 0.7 * len(words)):
            return False
    return bool(lines)


def word_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit identifier) of the words of masked texts; a repeated word is told apart by its number."""
    lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    enc = pc.dictionary_encode(lists.flatten())
    own = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in enc.dictionary.to_pylist()], dtype=np.uint64)
    doc, code = np.repeat(np.arange(len(texts)), size), enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    joint = np.sort(doc * np.int64(max(len(own), 1)) + code)
    doc, code = joint // max(len(own), 1), joint % max(len(own), 1)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])] if len(doc) else np.zeros(0, bool)
    number = np.arange(len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    word = own[code] if len(own) else np.zeros(0, np.uint64)
    full = word != 0
    return doc[full], (word ^ number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[full]


def templates(cores: list[str | None], p_residue: Sequence[float]) -> tuple[list, list, list, list]:
    """(tmpl, n, text, sure) of pages' bodies: the masked text with a hash and the number of words, and whether it is
    trusted to be residue; null for a page without a body."""
    texts = masked(pa.array(cores, pa.string())).to_pylist()
    none = [t is None for t in texts]
    tmpl = [None if x else xxhash.xxh3_64_intdigest(t) - (1 << 63) for x, t in zip(none, texts)]
    sure = [None if x else p >= 0.8 or known_residue(c) for x, c, p in zip(none, cores, p_residue)]
    return tmpl, [None if x else t.count(" ") + 1 if t else 0 for x, t in zip(none, texts)], texts, sure


def counted(df: DataFrame, key: F.Column, size: int) -> np.ndarray:
    """How often each of ``size`` values of ``key`` occurs; at most ``size`` numbers reach the driver."""
    got = df.groupBy(key.alias("k")).agg(F.count("*").alias("c")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[got["k"].to_numpy()] = got["c"].to_numpy()
    return out


def words_table(tmpl: DataFrame) -> DataFrame:
    """(slot) of each word of the templates; slots only order the words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"slot": (word_ids(pdf["text"].tolist())[1] % np.uint64(SLOTS)).astype(np.int32)})

    return tmpl.select("text").mapInPandas(run, "slot int")


def in_order(doc: np.ndarray, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by text, count (below 2 ** 20) and identifier."""
    joint = (doc.astype(np.uint64) << np.uint64(44)) | (count.astype(np.uint64) << np.uint64(24)) | (ids >> np.uint64(40))
    order = np.argsort(joint)
    tied = (doc[-1] >> 20 if len(doc) else 0) or (joint[order][1:] == joint[order][:-1]).any()
    return np.lexsort((ids, count, doc)) if tied else order  # a number of 64 bits nearly always tells them apart


def meeting_keys(tmpl: DataFrame, counts: np.ndarray, t: float, name: str, marks: np.ndarray | None = None) -> DataFrame:
    """(name, w, at, n, sig) of the keys at which a template meets those alike to it.

    A key of a SimHash table comes with the signature and ``at`` -1, a word with its place in the template; keys
    that are not in ``marks`` are left out.
    """
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    masks = np.array([sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in ks) for ks in itertools.combinations(range(BLOCKS), BLOCKS // 2)], dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc, ids = word_ids(pdf["text"].tolist())
            own, size = pdf[name].to_numpy(), np.bincount(doc, minlength=len(pdf))
            sig = signatures(doc, ids, len(pdf))
            order = in_order(doc, np.minimum(counts[(ids % np.uint64(SLOTS)).astype(np.int64)], (1 << 20) - 1), ids)
            doc, ids = doc[order], ids[order]
            at = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
            keep = at < (size - np.ceil(t / (2 - t) * size - 1e-9).astype(np.int64) + 1)[doc]
            tables = mix((sig[:, None] & masks) ^ mix(masks)).ravel()
            who = np.r_[doc[keep], np.repeat(np.arange(len(pdf)), len(masks))]
            w, place = np.r_[ids[keep], tables], np.r_[at[keep], np.full(len(tables), -1)]
            if marks is not None:
                seen = marks[(w % np.uint64(len(marks))).astype(np.int64)]
                who, w, place = who[seen], w[seen], place[seen]
            yield pd.DataFrame({name: own[who], "w": w.view(np.int64), "at": place.astype(np.int32), "n": size[who].astype(np.int32), "sig": sig[who].view(np.int64)})

    return tmpl.select(F.col("tmpl").alias(name), "text").mapInPandas(run, f"{name} bigint, w bigint, at int, n int, sig bigint")


def in_reach(sizes: list[int], t: float) -> F.Column:
    """Whether a template's size n can be alike to a text of one of the sizes."""
    spans: list[list[int]] = []
    for n in sorted(sizes):
        low, high = math.ceil(t / (2 - t) * n - 1e-9), math.floor((2 - t) / t * n + 1e-9)
        if spans and low <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    out = F.lit(False)
    for low, high in spans:
        out = out | F.col("n").between(low, high)
    return out


def candidates(near: DataFrame, rest: DataFrame, least_dice: float) -> DataFrame:
    """(a, b) of the templates that meet and pass the bounds of the way on which they meet."""
    counts = counted(words_table(near), F.col("slot"), SLOTS)
    a = materialize(meeting_keys(near, counts, least_dice, "a").withColumnsRenamed({"at": "at_a", "n": "n_a", "sig": "sig_a"}), "keys")
    marks = counted(a, F.col("w").bitwiseAND(MARKS - 1), MARKS) > 0
    b = meeting_keys(rest, counts, least_dice, "b", marks)
    most = F.least(F.least("n", "n_a"), 1 + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n") - F.col("at") - 1))
    by_word = (F.col("at") >= 0) & (2 * most >= least_dice * (F.col("n") + F.col("n_a")) - 1e-9)
    by_table = (F.col("at") < 0) & (F.bit_count(F.col("sig").bitwiseXOR(F.col("sig_a"))) <= BLOCKS // 2)
    return a.join(b, "w").where((by_word | by_table) & ((F.col("at") < 0) == (F.col("at_a") < 0))).select("a", "b").distinct()


def alike_to(near: DataFrame, rest: DataFrame, least_dice: float) -> DataFrame:
    """(tmpl) of each template of ``rest`` whose words are alike to those of one of ``near``."""
    pairs = materialize(candidates(near, rest, least_dice), "pairs")  # their number decides how the texts are joined
    same = F.pandas_udf(lambda s, t: pd.Series([dice(p, q) for p, q in zip(s, t)]), T.DoubleType())
    texts = pairs.join(near.select(F.col("tmpl").alias("a"), F.col("text").alias("ta")), "a").join(rest.select(F.col("tmpl").alias("b"), F.col("text").alias("tb")), "b")
    return texts.where(same("ta", "tb") >= least_dice).select(F.col("b").alias("tmpl")).distinct()


def residue_of(labelled: DataFrame, *, id_col: str = "page_id", least_dice: float = 0.8) -> DataFrame:
    """(id_col) of the pages, labelled by ``label_pages``, that are residue as a whole."""
    pages = labelled.where("tmpl IS NOT NULL").select(F.col(id_col).alias("i"), "tmpl", "n", "text", "sure")
    tmpl = materialize(pages.groupBy("tmpl").agg(F.min("n").alias("n"), F.first("text").alias("text"), F.avg(F.col("sure").cast("int")).alias("sure")), "distinct")
    near = materialize(tmpl.where("sure >= 0.5 AND n > 0").select("tmpl", "n", "text"), "near")
    rest, bad = tmpl.where("sure < 0.5").select("tmpl", "n", "text"), tmpl.where("sure >= 0.5").select("tmpl")
    while True:  # each round takes at least one template out of the rest, or is the last
        sizes = [r["n"] for r in near.select("n").distinct().collect()]
        if not sizes:
            break
        found = materialize(alike_to(near, rest.where(in_reach(sizes, least_dice)), least_dice), "reached")
        near, rest, bad = materialize(rest.join(found, "tmpl", "left_semi"), "near"), rest.join(found, "tmpl", "left_anti"), bad.unionByName(found)
    return pages.join(bad, "tmpl", "left_semi").select(F.col("i").alias(id_col))


def residue_pages(pages: DataFrame, *, id_col: str = "page_id", **how) -> DataFrame:
    """(id_col) of each page row whose article is replaced as a whole by residue.

    Null and blank contents give no row; pages with a frame but no other text are no case; pages whose
    text is not alike to a trusted template, at the end of a chain or directly, are no case; repeated rows are decided alike; an empty
    table gives an empty result; other columns than those of ``label_pages`` are not read.
    """
    from textloom.llm.boilerplate import label_pages

    labelled = materialize(label_pages(pages, id_col=id_col, **how), "labels")
    return residue_of(labelled, id_col=id_col)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id) of each page whose article is residue."""
    return residue_pages(table(spark, sf_dir, "pages"))


def p2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked residue texts with their number of pages."""
    from textloom.llm.boilerplate import label_pages

    labelled = materialize(label_pages(table(spark, sf_dir, "pages")), "labels")
    return labelled.join(residue_of(labelled), "page_id", "left_semi").groupBy("text").agg(F.count("*").alias("n_pages"))


QUERIES = {"p2_found": p2_found, "p2_templates": p2_templates}
SQL: dict[str, str] = {}
