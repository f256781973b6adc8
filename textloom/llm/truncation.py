"""Problem 8: text cut off by field limits or in transfer.

A trie of the corpus vocabulary says whether the last token of a text is an unknown proper prefix of known
words.  The trie is a table of its nodes, (prefix, passes, ends), of which only those are built that some text
asks for, by a join, whatever their length; it is never held in one place.

The trie's word is scored together with the other evidence, each from all rows: the length, as each source's texts
pile up at its limit, in characters or bytes; a mark of the cut; an open code fence; a last line that is open, that
is, without closing punctuation.  Against it stands a known closing line (a sign-off, a total, a version): one
that ends several texts and that, by a trie of lines over masked words, seldom goes on where it stands elsewhere.
Every row tells which evidence spoke.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.materialize import materialize
from textloom.plans.tables import table

MARK = re.compile(r"\s*(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|…|\.{3}|[\[(<](?:truncated|cut|continued|more|snip)[\])>])$", re.I)
BROKEN = "�"
CLOSERS = "\"'»”“’*_)]>"
STOPS = ".!?。！？"
#: Punctuation after which a line does not end, or which ends a sentence, with closing marks around it.
PAUSE = r"[\"'»”’*_)\]>]*[.!?。！？,;:…][\"'»”’*_)\]>]*$"
#: What each piece of evidence adds to the score; from ``CUT`` on a text counts as cut.
WEIGHTS = {"fence": 4, "broken": 4, "trie": 2, "length": 2, "mark": 2, "open": 2, "closing_line": -3, "remark": -3}
CUT = 2
TAIL = re.compile(r"[^\W_]+$")
SCHEMA = "id {id}, source string, n_chars bigint, n_bytes bigint, kind string, marked boolean, broken boolean, token string, line string, lower_start boolean, n_words int, closed_before boolean, digest bigint"


def mask(line: Column) -> Column:
    """A line without what varies: numbers, addresses, identifiers, tags and names; one space between words."""
    line = F.regexp_replace(line, r"[^\s]+@[^\s]+|[\p{L}\p{N}_]+://[^\s]+", "U")
    line = F.regexp_replace(line, r"#[\p{L}\p{N}_]+", "#T")
    line = F.regexp_replace(line, r"(?<![\p{L}\p{N}_])[\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)+(?![\p{L}\p{N}_])", "I")
    line = F.regexp_replace(line, r"\p{N}+", "0")
    line = F.regexp_replace(line, r"(?<=[\s\[])[\p{L}&&[^a-zа-яіїєґ]]\p{L}+", "N")
    return F.trim(F.regexp_replace(line, r"[\s\p{Z}]+", " "))


def tail(text: str) -> tuple:
    """(kind, marked, broken, token, line, lower_start, n_words, closed_before) of the end of a text.

    kind: ``fence`` an open code fence; ``closed`` ends as a complete text does; ``row``, ``item``, ``heading``,
    ``tags`` an open last line of that sort; ``prose`` an open last line of running text.
    """
    body = text.rstrip()
    broken = body.endswith(BROKEN)
    body = body.rstrip(BROKEN)
    m = MARK.search(body)
    marked = m is not None
    if m:
        body = body[: m.start()].rstrip()
    lines = body.split("\n")
    fences = sum(x.lstrip().startswith("```") for x in lines)
    line = lines[-1].strip()
    before = next((x.strip() for x in reversed(lines[:-1]) if x.strip()), "")
    t = TAIL.search(body)
    token = t[0].lower() if t else ""
    words = line.split()
    bare = line.rstrip(CLOSERS)
    closed_before = not before or before.rstrip(CLOSERS).endswith(tuple(STOPS)) or before.endswith(("|", "`", ")"))
    if fences % 2:
        kind = "fence"
    elif line.startswith("```"):
        kind = "closed"
    elif line.startswith("|"):
        kind = "closed" if line.endswith("|") and len(line) > 1 else "row"
    elif re.fullmatch(r"`+", line):
        kind = "fence"
    elif bare.endswith(tuple(STOPS)):
        kind = "closed"
    elif re.match(r"(?:[-*+•]|\d+[.)])\s", line) or line in ("-", "*"):
        kind = "closed" if line.endswith(")") and "(" in line or re.search(r"\]\(\S+\)$", line) else "item"
    elif re.match(r"#{1,6}\s", line) or re.fullmatch(r"#+", line):
        kind = "heading"
    elif line.startswith("#"):
        kind = "tags"
    elif re.search(r"\]\([^()\s]+\)$", line):
        kind = "closed"
    else:
        kind = "prose"
    return kind, marked, broken, token, line, line[:1].islower(), len(words), closed_before


def tails(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]
        for pdf in batches:
            rows = [(i, s, len(t), len(t.encode("utf-8", "replace")), *tail(t), h) for i, s, t, h in zip(pdf["id"], pdf["source"], pdf["t"], pdf["h"])]
            yield pd.DataFrame(rows, columns=names)

    kept = docs.where(F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\S"))
    return kept.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")).mapInPandas(run, SCHEMA.format(id=dict(docs.dtypes)[id_col]))


def vocabulary_trie(docs: DataFrame, text_col: str, asked: DataFrame, head: int = 8) -> DataFrame:
    """(p, passes, ends) of the trie's nodes that ``asked`` (p, without repeats) names, over all words of all texts.

    passes counts the words of the corpus that go through the node, ends those that stop there.  Words give their
    prefixes up to ``head`` letters, and longer ones only in the lengths of the asked prefixes that start alike,
    so that a long word costs no more than what is asked of it.
    """
    words = docs.where(F.col(text_col).isNotNull()).select(F.explode(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+")).alias("w")).where("w <> ''")
    count = words.groupBy("w").agg(F.count("*").alias("n"))
    near = count.select("w", "n", F.explode(F.sequence(F.lit(1), F.least(F.lit(head), F.length("w")))).alias("k"))
    lengths = asked.where(F.length("p") > head).groupBy(F.substring("p", 1, head).alias("h")).agg(F.collect_set(F.length("p")).alias("ks"))
    far = count.where(F.length("w") > head).withColumn("h", F.substring("w", 1, head)).join(lengths, "h").select("w", "n", F.explode(F.filter("ks", lambda k: k <= F.length("w"))).alias("k"))
    nodes = near.unionByName(far).select("n", F.substring("w", F.lit(1), F.col("k")).alias("p"), (F.length("w") == F.col("k")).alias("whole"))
    return nodes.join(asked, "p", "left_semi").groupBy("p").agg(F.sum("n").alias("passes"), F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).alias("ends"))


def line_trie(docs: DataFrame, text_col: str, asked: DataFrame, depth: int = 8) -> DataFrame:
    """(m, passes, ends) of the trie of masked lines, word by word, at the nodes that ``asked`` (m) names.

    passes counts the lines of all texts that start so, ends those that stop there without closing punctuation.
    """
    head = lambda x: F.regexp_replace(F.regexp_extract(x, r"^([^\s\p{Z}]*)", 1), PAUSE, "")
    lines = docs.where(F.col(text_col).isNotNull()).select(F.explode(F.split(text_col, "\n")).alias("x")).where(F.col("x").rlike(r"\S")).select(F.regexp_replace("x", r"^\s+|\s+$", "").alias("x"))
    # most lines start with a word that starts no asked line
    lines = lines.withColumn("h", head(mask(F.regexp_extract("x", r"^([^\s\p{Z}]*)", 1)))).join(asked.select(head(F.col("m")).alias("h")).distinct(), "h", "left_semi")
    lines = lines.select(F.split(mask(F.col("x")), " ", depth + 1).alias("w"))
    at = lines.select("w", F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size("w")))).alias("k"))
    text = F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")
    bare = F.regexp_replace(text, PAUSE, "")
    nodes = at.select(bare.alias("m"), ((F.size("w") == F.col("k")) & (bare == text)).alias("stops"))
    return nodes.join(asked, "m", "left_semi").groupBy("m").agg(F.count("*").alias("passes"), F.sum(F.col("stops").cast("bigint")).alias("ends"))


def length_limits(ends: DataFrame, *, least_rows: int = 4, least_share: float = 0.008, times: float = 6.0) -> DataFrame:
    """(source, unit, limit): lengths at which a source's texts pile up, in characters or bytes.

    A length counts as a limit if it has ``least_rows`` texts, ``least_share`` of its source's texts and
    ``times`` as many as the mean of the lengths that occur in the source.  Texts of one length or less than
    20 are no evidence.
    """
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("n")))).alias("u")
    count = ends.select("source", unit).select("source", "u.*").where("n >= 20").groupBy("source", "unit", "n").agg(F.count("*").alias("k"))
    total = count.groupBy("source", "unit").agg(F.sum("k").alias("total"), F.avg("k").alias("mean"))
    pair = count.join(total.select(F.col("source").alias("s"), F.col("unit").alias("u"), "total", "mean"), F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") == F.col("u")))
    return pair.where((F.col("k") >= least_rows) & (F.col("k") >= least_share * F.col("total")) & (F.col("k") >= times * F.col("mean"))).select("source", "unit", F.col("n").alias("limit"))


def truncated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", unknown_ratio: float = 50.0, closing_texts: int = 8, closing_words: int = 8) -> DataFrame:
    """Every non-blank text with its evidence and the verdict ``cut``: (id_col, source, kind, evidence, score, cut).

    ``evidence`` lists what speaks for a cut or against it: fence and broken (half a character) by themselves; trie (the last token
    is a proper prefix of words that are ``unknown_ratio`` times as frequent), length (at a limit of the source) and
    mark (an ellipsis or the like) for texts whose last line is not closed; open (its last line is running text or a table row); closing_line
    (the last line ends at least ``closing_texts`` different texts, seldom at a limit, and half of the lines that
    start so end there) and remark (a few words in lower case after closed text).

    Null and blank texts give no row; a null source is a source of its own; repeated rows give repeated rows;
    very long texts are read whole; an empty table gives an empty result.  Only the three named columns are
    read, so other columns may have any names.
    """
    ends = materialize(tails(docs, id_col, text_col, source_col).withColumn("m", mask(F.col("line"))).drop("line"), "tails")
    limits = materialize(length_limits(ends), "limits")
    e = ends
    for u in ("chars", "bytes"):
        at = limits.where(F.col("unit") == u).select(F.col("source").alias(f"s_{u}"), F.col("limit").alias(f"l_{u}"))
        e = e.join(at, e["source"].eqNullSafe(F.col(f"s_{u}")) & (F.col(f"n_{u}") == F.col(f"l_{u}")), "left")
    e = materialize(e.withColumn("at_limit", F.col("l_chars").isNotNull() | F.col("l_bytes").isNotNull()).drop("s_chars", "l_chars", "s_bytes", "l_bytes"), "limited")
    # copies of one text say nothing about its last line, so different texts are counted
    often = e.where(F.col("n_words") <= closing_words).groupBy("m").agg(F.countDistinct("digest").alias("k"), F.avg(F.col("at_limit").cast("int")).alias("share")).where((F.col("k") >= closing_texts) & (F.col("share") < 0.3)).select("m")
    closing = line_trie(docs, text_col, materialize(often, "often"), closing_words).where(2 * F.col("ends") >= F.col("passes")).select("m", F.lit(True).alias("known_line"))
    e = e.join(closing, "m", "left")
    # only tokens of letters are looked up; texts without one take no part in the join
    word = F.col("token").rlike(r"^\p{L}+$") & (F.col("kind") != "closed")
    trie = vocabulary_trie(docs, text_col, e.where(word).select(F.col("token").alias("p")).distinct())
    part = trie.where((F.col("passes") > F.col("ends")) & (F.col("ends") * unknown_ratio < F.col("passes"))).select("p", F.lit(True).alias("partial"))
    e = e.withColumn("asked", F.when(word, F.col("token"))).join(part, F.col("asked") == F.col("p"), "left").withColumn("partial_word", F.coalesce("partial", F.lit(False)))
    not_closed, fence = F.col("kind") != "closed", F.col("kind") == "fence"
    speaks = {
        "fence": fence,
        "broken": F.col("broken"),
        "trie": F.col("partial_word"),
        "length": not_closed & F.col("at_limit"),
        "mark": not_closed & F.col("marked"),
        "open": F.col("kind").isin("prose", "row"),
        "closing_line": ~fence & F.coalesce("known_line", F.lit(False)),
        "remark": ~fence & (F.col("n_words") <= 4) & F.col("lower_start") & F.col("closed_before") & ~F.col("at_limit") & ~F.col("partial_word"),
    }
    evidence = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in speaks.items()]), lambda x: x.isNotNull())
    score = sum(F.when(c, F.lit(WEIGHTS[k])).otherwise(F.lit(0)) for k, c in speaks.items())
    return e.select(F.col("id").alias(id_col), "source", "kind", evidence.alias("evidence"), score.alias("score"), (score >= CUT).alias("cut"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of each cut document."""
    return truncated(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts: its texts, cut ones and their share, and how many of those each evidence speaks for."""
    t = truncated(table(spark, sf_dir, "documents"))
    by = [F.sum((F.col("cut") & F.array_contains("evidence", k)).cast("bigint")).alias(f"n_{k}") for k in ("fence", "trie", "length", "mark", "open")]
    return t.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.col("cut").cast("bigint")).alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share_cut"), *by)


QUERIES = {"p8_found": p8_found, "p8_sources": p8_sources}
SQL: dict[str, str] = {}
