"""Problem 1: page boilerplate mixed with main content.

Every page is labelled line by line by the recurrent block labeller (``blocks``); frame lines are reported
or removed.  The lines that recur in each site are counted before over all pages (``repeated_lines``) and joined
to the pages by site, so the labelling knows each line's share of its site's URLs.  The labeller is fitted on at
most ``max_pages`` pages, taken breadth first over the sites so that small sites count; they are chosen from
the URLs alone.  The texts are read twice: for the identifiers of their lines, and to label them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import blocks as B
from textloom.llm.lines import Lines, bytes_of, line_keys, lists_of
from textloom.llm.repeated_lines import blocks_of, canonical_url, keyed_pages, site_of
from textloom.llm.residue import residue_of, templates
from textloom.plans.materialize import materialize
from textloom.plans.tables import table

#: Least URLs, and least share of a site's URLs, on which a line recurs.
LEAST_URLS, LEAST_SHARE = 3, 0.1
#: Lines that the labeller looks at together.
LINES = 50_000


def recurring(keyed: DataFrame) -> DataFrame:
    """(s, known) of each site with recurring lines, ``known`` as (key, share) in the order of the keys.

    A site's list has at most 1 / ``LEAST_SHARE`` times the lines of a page.
    """
    lines = blocks_of(keyed, min_urls=LEAST_URLS, min_share=LEAST_SHARE, longer=False)
    share = (F.col("n_urls") / F.col("n_site_urls")).cast("float")
    return lines.groupBy(F.col("site").alias("s")).agg(F.array_sort(F.collect_list(F.struct("key", share.alias("share")))).alias("known"))


def shares_of(keys: np.ndarray, counts: np.ndarray, known: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The share of its site's URLs of each line of a site's pages, 0 where it does not recur."""
    if not len(known) or not len(keys):
        return np.zeros(len(keys), np.float32)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(counts & (known[at] == keys), share[at], 0).astype(np.float32)


def keyed_lines(texts: pa.Array, sites: pa.Array, known_keys: pa.ListArray, known_shares: pa.ListArray) -> tuple[Lines, np.ndarray]:
    """The lines of a batch of pages and their shares; neighbouring pages of one site are looked up together."""
    own = line_keys(texts)
    end = np.cumsum(own.size)
    first = end - own.size
    site = pc.dictionary_encode(pc.fill_null(sites, "")).indices.to_numpy()
    edges = np.flatnonzero(np.r_[True, site[1:] != site[:-1], True]) if len(site) else np.zeros(1, np.int64)
    share = np.zeros(len(own.key), np.float32)
    size = pc.fill_null(pc.list_value_length(known_keys), 0).to_numpy(zero_copy_only=False)
    stop = np.cumsum(size)
    ks, ss = (x.flatten().to_numpy(zero_copy_only=False) for x in (known_keys, known_shares))
    for p, q in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if size[p]:
            a, b, u, v = first[p], end[q - 1], stop[p] - size[p], stop[p]
            share[a:b] = shares_of(own.key[a:b], own.counts[a:b], ks[u:v], ss[u:v])
    return own, share


def split_pages(texts: pa.Array, *known: pa.Array) -> list[B.Page]:
    """The pages of a batch, with the shares of their lines."""
    own, share = keyed_lines(texts, *known)
    end = np.cumsum(own.size)
    return [B.split_page(t, share[a:b], own.fenced[a:b]) for t, a, b in zip(texts.to_pylist(), (end - own.size).tolist(), end.tolist())]


def choose_sample(pages: DataFrame, id_col: str, url_col: str, max_pages: int, per_site: int) -> DataFrame:
    """(i, u) of at most ``max_pages`` pages, up to ``per_site`` of each site, first pages of all sites first."""
    keys = pages.where(F.col(id_col).isNotNull() & F.col(url_col).isNotNull()).select(F.col(id_col).alias("i"), site_of(F.col(url_col)).alias("site"), F.xxhash64(canonical_url(F.col(url_col))).alias("u"))
    turn = F.row_number().over(Window.partitionBy("site").orderBy("u", "i"))
    # sites come in groups of eight pages, so that what varies in a site shows
    order = (F.ceil(F.col("turn") / 8), F.xxhash64("site"), "turn")
    return keys.withColumn("turn", turn).where(F.col("turn") <= per_site).orderBy(*order).limit(max_pages).select("i", "u").distinct()


def fit_labeller(keyed: DataFrame, known: DataFrame) -> B.Labeller:
    """The labeller, from the pages whose texts ``keyed`` carries."""
    own = keyed.where("t IS NOT NULL").join(known, F.col("site") == F.col("s"), "left").select("site", "u", "i", "t", F.col("known.key").alias("k"), F.col("known.share").alias("sh"))
    got = own.toArrow().combine_chunks()
    pages = split_pages(*(got[c].combine_chunks() for c in ("t", "site", "k", "sh"))) if got.num_rows else []
    order = sorted(range(got.num_rows), key=lambda r: (got["site"][r].as_py(), got["u"][r].as_py(), str(got["i"][r].as_py())))
    return B.fit([pages[r] for r in order])


def label_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", content_col: str = "content", max_pages: int = 2000, per_site: int = 40) -> DataFrame:
    """(id_col, frame, n_article, n_residue, tmpl, n, text, sure) of each page with non-blank content.

    ``frame`` has the numbers of the frame lines.  The other lines, but for headings, the crawler's lines and fenced
    code, are the body: n_article and n_residue count its words by label, and tmpl, n, text and sure are its template
    (``residue.templates``), null where there is no body.  The body of a page that is nothing but frame to the labeller
    is what of it does not recur in the site, or else its line most like residue.

    Null and blank contents give no row; a null URL belongs to a site without recurring lines; repeated rows give
    repeated rows; very long pages are read whole; of two equal probabilities the class listed first wins; an empty
    table gives an empty result; other columns are not read.
    """
    keyed = materialize(keyed_pages(pages, id_col, url_col, content_col, choose_sample(pages, id_col, url_col, max_pages, per_site)), "keyed")
    known = materialize(recurring(keyed), "recurring")
    model = fit_labeller(keyed, known)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = dict(pages.dtypes)[id_col]
    names = ["i", "frame", "n_article", "n_residue", "tmpl", "n", "text", "sure"]

    def label(make: B.Features, texts: pa.Array, *known: pa.Array) -> tuple[pa.ListArray, np.ndarray, np.ndarray, list[str | None], list[float]]:
        own, share = keyed_lines(texts, *known)
        stripped = [x.strip() for x in own.lines.to_pylist()]
        blank, article = (np.array(x, dtype=bool) for x in ([not x for x in stripped], [B.fixed_article(x) for x in stripped]))
        full = np.flatnonzero(~blank[own.at])
        doc, line, share = np.repeat(np.arange(len(texts)), own.size)[full], own.at[full], share[full]
        at = full - (np.cumsum(own.size) - own.size)[doc]
        feats = make.of(own.lines, own.words, line, at, own.fenced[full], share, np.bincount(doc, minlength=len(texts)), own.size)
        prob = shared.value.probabilities(feats)
        best, pr, words = prob.argmax(1), prob[:, B.RESIDUE], np.maximum(feats[4], 1).astype(np.float64)
        free = ~(own.fenced[full] | article[line])
        body = free & (best != B.FRAME)
        end = np.cumsum(feats[5])
        some = lambda mask: np.bincount(doc[mask], minlength=len(texts))
        for d in np.flatnonzero((some(free) > 0) & (some(body) == 0)).tolist():
            own_free = end[d] - feats[5][d] + np.flatnonzero(free[end[d] - feats[5][d] : end[d]])
            rest = own_free[share[own_free] == 0]
            body[rest if len(rest) else own_free[pr[own_free] == pr[own_free].max()]] = True
        frame = free & (best == B.FRAME)
        in_doc, n = doc[body], some(body)
        n_words, n_art = (np.bincount(doc[m], words[m], len(texts)) for m in (body, body & (best == B.ARTICLE)))
        mean, first = np.zeros(len(texts)), (np.cumsum(n) - n)[n > 0]
        if len(in_doc):
            mean[n > 0] = np.add.reduceat(pr[body] * words[body], first) / n_words[n > 0]
        core, a = [stripped[k] for k in line[body].tolist()], np.cumsum(n) - n
        cores = ["\n".join(core[p : p + q]) if q else None for p, q in zip(a.tolist(), n.tolist())]
        return lists_of(some(frame), at[frame].astype(np.int32), pa.int32()), n_art.astype(np.int32), (n_words - n_art).astype(np.int32), cores, mean.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = B.Features()
        for batch in batches:
            off, data = bytes_of(batch.column(1))
            total = np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), off[1:]) + np.arange(1, batch.num_rows + 1)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + LINES, side="right")))
                part = batch.slice(a, b - a)
                frame, n_art, n_res, core, mean = label(make, *part.columns[1:])
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), frame, *(pa.array(x, k) for x, k in zip((n_art, n_res, *templates(core, mean)), kinds))], names=names)
                a = b

    kept = pages.where(F.col(content_col).isNotNull() & F.col(content_col).rlike(r"\S")).select(F.col(id_col).alias("i"), site_of(F.coalesce(F.col(url_col), F.lit(""))).alias("site"), F.col(content_col).alias("t"))
    rows = kept.join(known, F.col("site") == F.col("s"), "left").select("i", "t", "site", F.col("known.key").alias("k"), F.col("known.share").alias("sh"))
    out = rows.mapInArrow(run, f"i {kind}, frame array<int>, n_article int, n_residue int, tmpl bigint, n int, text string, sure boolean")
    return out.withColumnRenamed("i", id_col)


def frame_lines(pages: DataFrame, *, id_col: str = "page_id", **how) -> DataFrame:
    """(id_col, line_no) of each frame line of the pages that are not residue as a whole."""
    labelled = materialize(label_pages(pages, id_col=id_col, **how), "labels")
    gone = residue_of(labelled, id_col=id_col)
    return labelled.select(id_col, "frame").join(gone, id_col, "left_anti").select(id_col, F.explode("frame").alias("line_no"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, line_no) of each line that is not of the page's own article."""
    return frame_lines(table(spark, sf_dir, "pages"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page that is not residue with the text of its article."""
    pages = table(spark, sf_dir, "pages")
    labelled = materialize(label_pages(pages), "labels")
    kept = labelled.select("page_id", "frame").join(residue_of(labelled), "page_id", "left_anti")
    rest = F.filter(F.transform(F.split("content", "\n"), lambda x, k: F.when(~F.array_contains("frame", k), x)), lambda x: x.isNotNull())
    return pages.select("page_id", "content").join(kept, "page_id").select("page_id", F.array_join(rest, "\n").alias("content"), F.size("frame").alias("n_removed"))


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean}
SQL: dict[str, str] = {}
