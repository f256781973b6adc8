"""Greedy removal of near-duplicate results."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy_dedup(results: DataFrame, *, text: str = "text", score: str = "final_score", place: str = "place", ratio: float = 0.8, chars: int = 200) -> DataFrame:
    """Each query's results in score order (then place) without those whose first ``chars`` characters are more
    than ``ratio`` like those of a kept one.  A query has few results (a shortlist), so a group is small."""

    def like(m: SequenceMatcher, head: str) -> bool:
        m.set_seq1(head)
        # two bounds from above save most comparisons
        return m.real_quick_ratio() > ratio and m.quick_ratio() > ratio and m.ratio() > ratio

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, place], ascending=[False, True], kind="stable")
        kept: list[SequenceMatcher] = []  # one for each kept head, which it has analysed once
        keep = []
        for t in pdf[text]:
            head = (t or "")[:chars]
            fresh = not any(like(m, head) for m in kept)
            keep.append(fresh)
            if fresh:
                kept.append(SequenceMatcher(None, "", head))
        return pdf[keep]

    return results.groupBy("query_id").applyInPandas(run, results.schema)


def ranked(results: DataFrame, *, score: str = "final_score", place: str = "place", n: str = "n") -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), place)
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col(n))
