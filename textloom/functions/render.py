"""Column functions that render results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import stem, trim


def breadcrumb(filename: Column, parent: Column, heading: Column) -> Column:
    """filename [> parent, unless it is the stem] [> heading, unless it is the parent]."""
    name, p, h = F.coalesce(filename, F.lit("unknown")), F.coalesce(parent, F.lit("")), F.coalesce(heading, F.lit(""))
    return F.concat_ws(" > ", name, F.when((p != "") & (p != stem(name)), p), F.when((h != "") & (h != p), h))


def snippet(text: Column, limit: int = 1500) -> Column:
    """The text without its overlap mark, cut after a fence, a sentence or at ``limit`` characters."""
    t = trim(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, r"^\[\.\.\.\]\s*", ""), r"\n{3,}", "\n\n")
    fence = F.locate("```", t, limit - 199) - 1
    head = F.substring(t, 1, limit)
    stop = F.length(head) - F.locate(" .", F.reverse(head)) - 1  # place of the last ". ", counted from 0
    has_stop = F.locate(" .", F.reverse(head)) > 0
    cut = (
        F.when((fence > 0) & (fence < limit + 500), F.substring(t, F.lit(1), fence + 3))
        .when(has_stop & (stop > limit // 2), F.substring(t, F.lit(1), stop + 1))
        .otherwise(F.concat(head, F.lit("...")))
    )
    return F.when(F.length(t) > limit, cut).otherwise(t)


def percent(score: Column) -> Column:
    """A share as whole percent, halves to even."""
    return F.concat(F.bround(score * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def result_block(rank: Column, crumb: Column, score: Column, category: Column, body: Column) -> Column:
    return F.concat(F.lit("### ["), rank.cast("string"), F.lit("] "), crumb, F.lit("\n**Relevance:** "), percent(score), F.lit(" | **Category:** "), F.coalesce(category, F.lit("")), F.lit("\n\n"), body, F.lit("\n"))
