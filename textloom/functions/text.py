"""Column functions over text; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` sees it, in a form that Java and RE2 share.
WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
#: What is not a word character: letters, numbers and the underscore.
NOT_WORD = r"[^\p{L}\p{N}_]+"


def tokens(text: Column, least: int = 3) -> Column:
    """Lower-case runs of word characters of at least ``least`` characters; null gives an empty array."""
    runs = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "), " ")
    return F.filter(runs, lambda w: F.length(w) >= least)


def words(text: Column) -> Column:
    """The words between white space; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def trim(text: Column) -> Column:
    """Without white space at both ends, in Python's sense."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)/*$", 1)


def suffix(path: Column) -> Column:
    """The last suffix of the file name in lower case, with its dot; names that start with their only dot have none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]+$", "")


def chunk_id(path: Column, text: Column, prefix: Column | None = None) -> Column:
    """``{stem}_{6 hex of the path}__{10 hex of the text}`` in letters, digits and underscores."""
    head = stem(path) if prefix is None else prefix
    raw = F.concat(head, F.lit("_"), F.substring(F.md5(path), 1, 6), F.lit("__"), F.substring(F.md5(text), 1, 10))
    return F.regexp_replace(raw, r"[^A-Za-z0-9_]", "_")
