"""Breadth-first crawl over a source of pages, one level at a time, as joins of frontier, pages and links."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.html import page_to_markdown
from textloom.functions.url import allowed_url, normalize_url
from textloom.plans.materialize import materialize


class PageSource(Protocol):
    """Gives (url, html, content) for the URLs of a frontier; URLs that cannot be fetched are left out."""

    def fetch(self, frontier: DataFrame) -> DataFrame: ...


class TablePages:
    """Pages of a table, joined on the normalised URL; of several fetches of a URL the last one counts (by ``order``,
    columns of which the greatest is last), and its columns stay together.  They are chosen once for all levels."""

    def __init__(self, pages: DataFrame, order: tuple[str, ...] = ("fetched_at", "page_id")) -> None:
        by = [F.col(c) for c in order if c in pages.columns] or [F.coalesce("content", F.lit(""))]
        own = pages.select(normalize_url(F.col("url")).alias("url"), F.struct(*by).alias("o"), F.struct("html", "content").alias("p"))
        self.pages, self.latest = own, None

    def fetch(self, frontier: DataFrame) -> DataFrame:
        if self.latest is None:
            self.latest = materialize(self.pages.groupBy("url").agg(F.max_by("p", "o").alias("p")).select("url", "p.*"), "pages")
        return frontier.select("url").join(self.latest, "url")


class RenderedPages:
    """Pages that need scripts: ``render`` (a browser, for instance) turns a URL into HTML or null, in the tasks."""

    def __init__(self, render: Callable[[str], str | None], extractor: Callable[[str], str] | None = None) -> None:
        self.render, self.extractor = render, extractor

    def fetch(self, frontier: DataFrame) -> DataFrame:
        render, extractor = self.render, self.extractor

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(u, h, page_to_markdown(h, u, extractor)) for u in pdf["url"] if (h := render(u))]
                yield pd.DataFrame(rows, columns=["url", "html", "content"])

        return frontier.select("url").mapInPandas(run, "url string, html string, content string")


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """``urllib.parse.urljoin``; a link that cannot be resolved gives null."""
    def one(b, x):  # noqa: ANN001, ANN202
        try:
            return urljoin(b, x)
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)])


def robots_filter(urls: DataFrame, rules: dict[str, str] | DataFrame, agent: str = "textloom") -> DataFrame:
    """URLs that robots.txt allows; ``rules`` has the text by scheme and host (host, rules), and hosts without one allow all."""
    if isinstance(rules, dict):
        rules = urls.sparkSession.createDataFrame(list(rules.items()), "host string, rules string")

    @F.pandas_udf(T.BooleanType())
    def ok(u: pd.Series, text: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}

        def one(x: str, t: str | None) -> bool:
            if t is None:
                return True
            if t not in parsed:
                parsed[t] = RobotFileParser()
                parsed[t].parse(t.splitlines())
            return parsed[t].can_fetch(agent, x)

        return pd.Series([one(x, t) for x, t in zip(u, text)])

    host = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    both = urls.withColumn("_host", host).join(rules.select(F.col("host").alias("_host"), F.col("rules").alias("_rules")), "_host", "left")
    return both.where(ok("url", "_rules")).select(*urls.columns)


def crawl(source: PageSource, links: DataFrame, seeds: DataFrame, *, max_pages: int = 200, max_depth: int = 10, stay: bool = True, exclude: list[str] | None = None, robots: dict[str, str] | None = None) -> DataFrame:
    """(seed, url, content, depth) of the pages that a crawl of each seed finds.

    ``seeds`` has seed (a URL) and depth (0, or 1 for URLs from a sitemap, in column url); ``links`` has
    (src_url, link, pos).  A level is visited at once; where it would pass ``max_pages`` pages with content, the
    first in the order of discovery are kept.  Visited URLs are never visited again.
    """
    spark = seeds.sparkSession
    front = seeds.select("seed", normalize_url(F.coalesce(F.col("url"), F.col("seed")) if "url" in seeds.columns else F.col("seed")).alias("url"), (F.col("depth") if "depth" in seeds.columns else F.lit(0)).cast("int").alias("depth"), F.lit(0).cast("bigint").alias("pos"))
    # a table for each level; nothing is written twice
    seen = spark.createDataFrame([], "seed string, url string")
    out = spark.createDataFrame([], "seed string, url string, content string, depth int, ord bigint")
    edges = links.select(normalize_url(F.col("src_url")).alias("src"), "link", F.col("pos").cast("bigint").alias("link_pos"))
    domain = F.regexp_extract("seed", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    prefix = F.regexp_replace("seed", r"(?s)[?#].*$", "")
    for _ in range(max_depth + 1):
        first = front.groupBy("seed", "url").agg(F.min("depth").alias("depth"), F.min("pos").alias("pos"))
        first = first.where(allowed_url(F.col("url"), prefix, domain, stay, exclude)).join(seen, ["seed", "url"], "left_anti")
        if robots:
            first = robots_filter(first, robots)
        # places in the order of discovery start again at each level, so they stay small
        first = materialize(first.withColumn("pos", F.row_number().over(Window.partitionBy("seed").orderBy("pos", "url")).cast("bigint")), "frontier")
        got = first.join(source.fetch(first.select("url").distinct()).select("url", "content"), "url")
        counted = out.groupBy("seed").agg(F.count("*").alias("have"))
        with_content = got.where(F.col("content").rlike(r"\S")).join(counted, "seed", "left")
        turn = F.row_number().over(Window.partitionBy("seed").orderBy("pos", "url")) + F.coalesce("have", F.lit(0))
        new = with_content.withColumn("ord", turn.cast("bigint")).where(F.col("ord") <= max_pages).select("seed", "url", "content", "depth", "ord")
        out = out.unionByName(materialize(new, "crawled"))
        seen = seen.unionByName(first.select("seed", "url"))
        full = out.groupBy("seed").agg(F.count("*").alias("have")).where(F.col("have") >= max_pages).select("seed")
        step = got.where(F.col("depth") < max_depth).join(full, "seed", "left_anti").join(edges, F.col("url") == F.col("src"))
        step = step.select("seed", normalize_url(join_url("url", "link")).alias("url"), (F.col("depth") + 1).alias("depth"), (F.col("pos") * 1_000_000 + F.col("link_pos")).alias("pos"))
        front = materialize(step.where("url IS NOT NULL").join(seen, ["seed", "url"], "left_anti"), "next")
        if front.isEmpty():
            break
    return out.select("seed", "url", "content", "depth")
