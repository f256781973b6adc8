"""Problem 5: lines repeated across the documents of one site.

The pages of a site are split by a hash of their canonical URL into blocks of about ``block_urls`` URLs, so
no task holds more than a block, however large the site, and the URL counts of the blocks add up exactly.
In each block a suffix array is built over the concatenated line identifiers of its pages; neighbouring
suffixes with a common first line give each line's number of URLs.  The counts of the blocks are added, lines that
span enough URLs of the site are kept, and their occurrences are deleted by a join back to the pages' identifiers.

Longer repeated blocks consist of such lines only.  A page's other lines become breaks, URLs of a site with the
same runs of lines between breaks become one row with their number, and a suffix array over the runs of the whole
site gives its maximal repeats at their own lengths, each with its number of URLs, in one scan.

Line identifiers (``lines``) are written once, in one pass over the texts; lines without one break a block.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.lines import line_keys, lists_of
from textloom.plans.materialize import materialize
from textloom.plans.tables import table


def canonical_url(url: Column) -> Column:
    """A URL in lower case without fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"(?s)#.*$", ""), r"/+$", "")


def site_of(url: Column) -> Column:
    """The host of a URL in lower case; text without a scheme counts from its start."""
    return F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks, ranks of each doubling round) of a sequence of integers, by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    rounds, k = [rank], 1
    order = np.argsort(rank)
    while n > 1 and k < n:
        second = np.full(n, -1, dtype=np.int64)
        second[:-k] = rank[k:]
        joint = rank * (n + 1) + second + 1
        order = np.argsort(joint)
        ranked = joint[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
        rank, k = new, 2 * k
        rounds.append(rank)
        if rank[order[-1]] == n - 1:
            break
    return order, rank, rounds


def common_prefixes(order: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in the array (0 for the first)."""
    n = len(order)
    lcp = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    total = np.zeros(max(n - 1, 0), dtype=np.int64)
    for level in range(len(rounds) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(a), dtype=bool)
        same[ok] = rounds[level][a[ok]] == rounds[level][b[ok]]
        step = np.where(same, 1 << level, 0)
        total, a, b = total + step, a + step, b + step
    lcp[1:] = total
    return lcp


def block_counts(urls: np.ndarray, keys: list[np.ndarray]) -> pd.DataFrame:
    """(key, length, urls): number of distinct URLs of each line (length 1) that a block of pages holds."""
    size = np.array([len(k) for k in keys], dtype=np.int64)
    if not size.sum():
        return pd.DataFrame({"key": np.array([], dtype=np.int64), "length": np.array([], dtype=np.int32), "urls": np.array([], dtype=np.int64)})
    flat = np.concatenate(keys)
    ids = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    top = ids.max() + 1
    # each page ends with an identifier of its own, so that no common prefix crosses pages
    first = np.cumsum(size) - size + np.arange(len(size))
    text = np.empty(len(flat) + len(size), dtype=np.int64)
    ends = first + size
    text[ends] = top + np.arange(len(size))
    body = np.ones(len(text), dtype=bool)
    body[ends] = False
    text[body] = ids
    url_at = np.repeat(np.unique(urls, return_inverse=True)[1], size + 1)
    order, _, rounds = suffix_array(text)
    lcp = common_prefixes(order, rounds)
    # intervals of suffixes that share their first line; each URL counts once
    group = np.cumsum(np.r_[True, lcp[1:] < 1])[body[order]]
    at = order[body[order]]
    width = np.int64(len(urls) + 1)
    own = np.unique(group * width + url_at[at]) // width
    g, first = np.unique(group, return_index=True)
    count = np.bincount(own, minlength=int(g[-1]) + 1)[g]
    key_at = np.zeros(len(text), dtype=np.int64)
    key_at[body] = flat
    return pd.DataFrame({"key": key_at[at[first]], "length": np.int32(1), "urls": count.astype(np.int64)})


def maximal_blocks(runs: list[np.ndarray], row: np.ndarray, weight: np.ndarray) -> pd.DataFrame:
    """(key, length, urls) of each maximal repeat of at least two lines in the runs.

    ``row`` has the row of each run and ``weight`` the number of URLs of each row.  A repeat is maximal if not all
    of its occurrences have the same line before them, nor the same line after them; ends of runs differ.
    """
    size = np.array([len(r) for r in runs], dtype=np.int64)
    flat = np.concatenate(runs) if len(runs) else np.zeros(0, np.int64)
    ids = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    ends = np.cumsum(size + 1) - 1
    text = np.empty(len(flat) + len(size), dtype=np.int64)
    body = np.ones(len(text), dtype=bool)
    body[ends] = False
    text[ends] = len(flat) + np.arange(len(size))
    text[body] = ids
    own = np.zeros(len(text), dtype=np.int64)
    own[body] = flat
    mask, base, hashes, power = (1 << 64) - 1, 0x9E3779B97F4A7C15, [0], [1]
    for k in own.tolist():
        hashes.append((hashes[-1] * base + k) & mask)
        power.append(power[-1] * base & mask)
    out: dict[str, list] = {"key": [], "length": [], "urls": []}
    if len(text) > 1:
        order, _, rounds = suffix_array(text)
        lcp = common_prefixes(order, rounds).tolist() + [0]
        before = text[order - 1]  # the end of the last run stands before the first
        changes = np.cumsum(np.r_[0, before[1:] != before[:-1]]).tolist()
        rows = np.repeat(row, size + 1)[order]
        total = np.r_[0, np.cumsum(weight[rows])].tolist()
        at, rows, weights = order.tolist(), rows.tolist(), weight.tolist()
        last: dict[int, int] = {}
        lengths, lefts, again = [0], [0], [0]  # open intervals; again has the weight of rows seen before inside
        for i in range(len(at) + 1):
            h, left, carried = lcp[i], i - 1, 0
            while lengths[-1] > h:
                n, left, twice = lengths.pop(), lefts.pop(), again.pop() + carried
                if n > 1 and changes[i - 1] > changes[left]:
                    key = (hashes[at[left] + n] - hashes[at[left]] * power[n]) & mask
                    out["key"].append(key - (1 << 64) if key >> 63 else key)
                    out["length"].append(n)
                    out["urls"].append(total[i] - total[left] - twice)
                carried = twice
            if lengths[-1] < h:
                lengths.append(h)
                lefts.append(left)
                again.append(carried)
            else:
                again[-1] += carried
            if i < len(at):
                if rows[i] in last:  # the least open interval that holds both counts the row once
                    again[bisect_right(lefts, last[rows[i]]) - 1] += weights[rows[i]]
                last[rows[i]] = i
    return pd.DataFrame(out).astype({"key": np.int64, "length": np.int32, "urls": np.int64})


def keyed_pages(pages: DataFrame, id_col: str, url_col: str, content_col: str, carry: DataFrame | None = None) -> DataFrame:
    """(i, site, u, keys, t) of each page with non-blank content and a URL; ``keys`` has one identifier for each
    line, null where the line does not count.

    One pass over the texts without a shuffle.  ``t`` is null, but keeps the text of the pages whose (i, u) is in
    ``carry``, a table of bounded size that is broadcast.
    """
    kept = pages.where(F.col(content_col).isNotNull() & F.col(content_col).rlike(r"\S") & F.col(url_col).isNotNull())
    rows = kept.select(F.col(id_col).alias("i"), site_of(F.col(url_col)).alias("site"), F.xxhash64(canonical_url(F.col(url_col))).alias("u"), F.col(content_col).alias("t"))
    if carry is None:
        rows = rows.withColumn("carried", F.lit(False))
    else:
        rows = rows.join(F.broadcast(carry.select("i", "u", F.lit(True).alias("carried"))), ["i", "u"], "left").select("i", "site", "u", "t", F.coalesce("carried", F.lit(False)).alias("carried"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = line_keys(batch.column(3))
            text = pc.if_else(batch.column(4), batch.column(3), pa.scalar(None, batch.column(3).type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists_of(own.size, own.key, pa.int64(), ~own.counts), text], names=["i", "site", "u", "keys", "t"])

    return rows.mapInArrow(run, f"i {dict(rows.dtypes)['i']}, site string, u bigint, keys array<bigint>, t string")


def blocks_of(keyed: DataFrame, *, min_urls: int = 8, min_share: float = 0.2, block_urls: int = 2000, longer: bool = True) -> DataFrame:
    """(site, key, length, n_urls, n_site_urls) of each line (length 1) or, if ``longer``, maximal block of lines
    that is repeated; ``keyed`` has the pages as (site, u, keys)."""
    sites = keyed.select("site", "u").distinct().groupBy("site").agg(F.count("*").alias("n_site_urls")).where(F.col("n_site_urls") >= min_urls)
    joined = keyed.select("site", "u", "keys").join(sites, "site")
    salt = F.pmod(F.col("u"), F.ceil(F.col("n_site_urls") / block_urls).cast("bigint"))

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = block_counts(pdf["u"].to_numpy(), [np.asarray(ks, dtype=np.int64) for ks in pdf["keys"]])
        if pdf["n_site_urls"][0] <= block_urls:  # the whole site is here
            got = got[got["urls"] >= min_urls]
        got.insert(0, "site", key[0])
        return got

    # lines that do not count leave the array here, as only single lines are counted
    salted = joined.select("site", "u", "n_site_urls", salt.alias("salt"), F.filter("keys", lambda k: k.isNotNull()).alias("keys"))
    counts = salted.groupBy("site", "salt").applyInPandas(count, "site string, key bigint, length int, urls bigint")
    total = counts.groupBy("site", "key", "length").agg(F.sum("urls").alias("n_urls")).where(F.col("n_urls") >= min_urls)
    lines = total.join(sites, "site").where(F.col("n_urls") >= min_share * F.col("n_site_urls"))
    if not longer:
        return lines
    lines = materialize(lines, "lines")

    def maximal(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # two rows stand for any greater number of URLs with the same runs, so that these repeat
        parts = [(rs, w) for rs, n in zip(pdf["runs"], pdf["n"]) for w in ([1, n - 1] if n > 1 else [1])]
        runs = [(k, np.array(r.split(), dtype=np.int64)) for k, (rs, _) in enumerate(parts) for r in rs]
        got = maximal_blocks([r for _, r in runs], np.array([k for k, _ in runs], dtype=np.int64), np.array([w for _, w in parts], dtype=np.int64))
        got.insert(0, "site", key[0])
        return got[got["urls"] >= min_urls].rename(columns={"urls": "n_urls"})

    # the lines of a site that reach the share are at most 1 / min_share times those of a page
    known = lines.groupBy("site").agg(F.collect_set("key").alias("known"))
    marked = joined.join(known, "site").select("site", "u", F.array_join(F.transform("keys", lambda k: F.when(F.array_contains("known", k), k.cast("string")).otherwise("|")), " ").alias("marked"))
    runs = F.filter(F.transform(F.split("marked", r"\|"), lambda r: F.trim(r)), lambda r: F.contains(r, F.lit(" ")))
    urls = marked.select("site", "u", runs.alias("runs")).groupBy("site", "u").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"))
    rows = urls.where(F.size("runs") > 0).groupBy("site", "runs").agg(F.count("*").alias("n"))
    blocks = rows.groupBy("site").applyInPandas(maximal, "site string, key bigint, length int, n_urls bigint").join(sites, "site").where(F.col("n_urls") >= min_share * F.col("n_site_urls"))
    return lines.unionByName(blocks)


def repeated_blocks(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", content_col: str = "content", **how) -> DataFrame:
    """``blocks_of`` a table of pages."""
    return blocks_of(materialize(keyed_pages(pages, id_col, url_col, content_col).drop("t"), "keyed"), **how)


def repeated_numbers(pages: DataFrame, id_col: str, url_col: str, content_col: str, **how) -> DataFrame:
    """(i, gone) of each page that has repeated lines, with their numbers.

    The texts are read once; the repeated lines of a site, at most 1 / ``min_share`` times those of a page, meet its
    pages in a join by site, which AQE splits where a site is large.
    """
    keyed = materialize(keyed_pages(pages, id_col, url_col, content_col).drop("t"), "keyed")
    known = blocks_of(keyed, longer=False, **how).groupBy(F.col("site").alias("s")).agg(F.collect_set("key").alias("known"))
    places = F.filter(F.transform("keys", lambda k, n: F.when(F.array_contains("known", k), n)), lambda n: n.isNotNull())
    return keyed.select("i", "site", "keys").join(known, F.col("site") == F.col("s")).select("i", places.alias("gone")).where(F.size("gone") > 0)


def repeated_lines(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", content_col: str = "content", **how) -> DataFrame:
    """(id_col, line_no) of each occurrence of a repeated line.

    Pages with null or blank content or a null URL give no row and count nowhere; pages fetched again count
    as one URL; repeated rows give their rows again; ties do not arise, as every line that reaches both bounds
    is taken; an empty table gives an empty result; other columns are not read.
    """
    return repeated_numbers(pages, id_col, url_col, content_col, **how).select(F.col("i").alias(id_col), F.explode("gone").alias("line_no"))


def remove_repeated_lines(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", content_col: str = "content", **how) -> DataFrame:
    """Every page as (id_col, content, n_removed), with its repeated lines, and so all blocks of them, taken out.

    Ids must be unique.  Null contents stay null, blank and unaffected ones stay as they are.
    """
    gone = repeated_numbers(pages, id_col, url_col, content_col, **how)
    both = pages.select(id_col, content_col).join(gone, F.col(id_col) == F.col("i"), "left")
    rest = F.filter(F.transform(F.split(content_col, "\n"), lambda x, k: F.when(~F.array_contains("gone", k), x)), lambda x: x.isNotNull())
    return both.select(F.col(id_col), F.when(F.col("gone").isNull(), F.col(content_col)).otherwise(F.array_join(rest, "\n")).alias(content_col), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, line_no) of each occurrence of a line repeated in its site."""
    return repeated_lines(table(spark, sf_dir, "pages"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without the lines repeated in its site."""
    return remove_repeated_lines(table(spark, sf_dir, "pages"))


def p5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site: repeated lines, maximal repeated blocks of more lines, and the length of the longest block."""
    b = repeated_blocks(table(spark, sf_dir, "pages"))
    return b.groupBy("site").agg(F.max("n_site_urls").alias("n_site_urls"), F.sum((F.col("length") == 1).cast("bigint")).alias("n_lines"), F.sum((F.col("length") > 1).cast("bigint")).alias("n_blocks"), F.max("length").alias("longest_block"))


QUERIES = {"p5_found": p5_found, "p5_clean": p5_clean, "p5_blocks": p5_blocks}
SQL: dict[str, str] = {
    "p5_found": r"""
WITH kept AS (
    SELECT page_id, content,
           regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1) AS site,
           regexp_replace(regexp_replace(lower(trim(url)), '#.*$', '', 's'), '/+$', '') AS u
    FROM pages WHERE url IS NOT NULL AND regexp_matches(content, '\S')
), lines AS (
    SELECT page_id, site, u, unnest(string_split(content, chr(10))) AS line,
           generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM kept
), fenced AS (
    SELECT *, sum(CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no) AS f FROM lines
), keyed AS (
    SELECT page_id, site, u, line_no, regexp_replace(lower(line), '\P{L}+', '', 'g') AS k FROM fenced
    WHERE f % 2 = 0 AND NOT starts_with(ltrim(line), '```') AND NOT starts_with(ltrim(line), '#')
), sites AS (SELECT site, count(DISTINCT u) AS n FROM kept GROUP BY site),
counts AS (SELECT site, k, count(DISTINCT u) AS c FROM keyed WHERE k <> '' GROUP BY site, k)
SELECT page_id, line_no::INTEGER AS line_no
FROM keyed JOIN counts USING (site, k) JOIN sites USING (site) WHERE c >= 8 AND c >= 0.2 * n
""",
}
KEYED_SQL = SQL["p5_found"].split("SELECT page_id, line_no::INTEGER")[0]
SQL["p5_clean"] = KEYED_SQL + r""", gone AS (SELECT page_id, list(line_no) AS gone FROM keyed JOIN counts USING (site, k) JOIN sites USING (site) WHERE c >= 8 AND c >= 0.2 * n GROUP BY page_id)
SELECT page_id, CASE WHEN gone IS NULL THEN content ELSE array_to_string(list_filter(string_split(content, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS content,
       coalesce(len(gone), 0)::INTEGER AS n_removed
FROM (SELECT page_id, content FROM pages) LEFT JOIN gone USING (page_id)
"""
# every run of repeated lines, all of its parts of two or more lines, and what stands before and after them
SQL["p5_blocks"] = KEYED_SQL + r""", rep AS (SELECT page_id, site, u, line_no, k FROM keyed JOIN counts USING (site, k) JOIN sites USING (site) WHERE c >= 8 AND c >= 0.2 * n),
isl AS (SELECT *, line_no - row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS g FROM rep),
run AS (SELECT page_id, site, u, g, list(k ORDER BY line_no) AS r FROM isl GROUP BY page_id, site, u, g HAVING count(*) > 1),
firsts AS (SELECT *, unnest(generate_series(1, len(r) - 1)) AS a FROM run), parts AS (SELECT *, unnest(generate_series(a + 1, len(r))) AS b FROM firsts),
occ AS (SELECT site, u, array_to_string(r[a:b], chr(1)) AS s, b - a + 1 AS size, CASE WHEN a > 1 THEN r[a - 1] ELSE page_id || '|' || g END AS l, CASE WHEN b < len(r) THEN r[b + 1] ELSE page_id || '|' || g END AS q FROM parts),
blocks AS (SELECT site, s, any_value(size) AS size, count(DISTINCT u) AS c FROM occ GROUP BY site, s HAVING count(DISTINCT l) > 1 AND count(DISTINCT q) > 1),
long AS (SELECT site, count(*) AS n_blocks, max(size) AS longest FROM blocks JOIN sites USING (site) WHERE c >= 8 AND c >= 0.2 * n GROUP BY site),
short AS (SELECT site, any_value(n) AS n_site_urls, count(*) AS n_lines FROM counts JOIN sites USING (site) WHERE k <> '' AND c >= 8 AND c >= 0.2 * n GROUP BY site)
SELECT site, n_site_urls, n_lines, coalesce(n_blocks, 0) AS n_blocks, coalesce(longest, 1)::INTEGER AS longest_block FROM short LEFT JOIN long USING (site)
"""
