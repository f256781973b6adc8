"""Problem 4: near-duplicate records with small edits, by T-occurrence search.

Two texts with n and m distinct shingles have the Jaccard similarity t or more exactly if they share
T = ceil(t / (1 + t) * (n + m)) of them, so the search asks for the documents that occur on at least T of the
query's inverted lists.

1. One pass counts shingles in a sketch of fixed size, and gives each row the id of its set of shingles;
   rows with equal sets are one document from here on.
2. The shingles of a document are ordered by their count (rare ones first).  Documents that share T shingles
   share one among the first n - ceil(t n) + 1, so only those lists are built, spread over the cluster by
   shingle.  A list is sorted by size; each document binary-probes the part whose sizes can reach t, and
   positions and 128-bit parity bitmaps, both exact bounds, discard most of what is left.  A shingle that is
   frequent even so is split into cells, so that no task holds a long list whole.
3. The remaining candidates of a query form inverted lists of their own; DivideSkip (Li, Lu and Lu, 2008)
   heap-merges the short lists, binary-probes the long ones, and keeps documents that reach T.

The result is exact: no list, bucket or partner is capped.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shingles import Shingler, mix
from textloom.operators.components import connected_components
from textloom.plans.materialize import materialize
from textloom.plans.tables import table, table_bytes

SLAB = 1 << 10
EIGHTH = 8  # steps of the count levels in one doubling


def needed(n, m, t: float):
    """The overlap T that sets of n and m elements need for the similarity t."""
    return np.ceil(t / (1 + t) * (n + m) - 1e-9).astype(np.int64)


def set_ids(doc: np.ndarray, s: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(id of each text's set of shingles, its size); the id is independent of the order."""
    size = np.bincount(doc, minlength=n_docs)
    out = np.zeros(n_docs, dtype=np.uint64)
    full = size > 0
    if full.any():
        starts = (np.cumsum(size) - size)[full]
        out[full] = mix(np.add.reduceat(mix(s), starts) ^ (np.bitwise_xor.reduceat(s, starts) * np.uint64(0x9E3779B97F4A7C15)))
    return out.view(np.int64), size


def count_shingles(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """One pass over the texts: rows (slab, counts) of the sketch of each task, and rows (id, set_id, n)."""
    kind = dict(docs.dtypes)["i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketch = Shingler(k), np.zeros(1 << bits, dtype=np.int64)
        names = ["slab", "counts", "id", "set_id", "n"]
        for batch in batches:
            doc, s = shingler.shingles(batch.column(1))
            sketch += np.bincount((s & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
            ids, size = set_ids(doc, s, batch.num_rows)
            full = size > 0
            nothing = int(full.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(nothing, pa.int32()), pa.nulls(nothing, pa.binary()), batch.column(0).filter(pa.array(full)), pa.array(ids[full]), pa.array(size[full].astype(np.int32))], names=names)
        if sketch.any():
            slabs = sketch.reshape(-1, SLAB)
            n = len(slabs)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array([x.tobytes() for x in slabs], pa.binary()), pa.nulls(n, pa_type(kind)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names=names)

    return docs.mapInArrow(run, f"slab int, counts binary, id {kind}, set_id bigint, n int")


def pa_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def add_slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the slabs of a partition, added as they come."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for slab, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(counts.as_buffer(), dtype=np.int64)
            total[slab] = total[slab] + own if slab in total else own
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slab", "counts"])


def sketch_levels(counted: DataFrame, bits: int) -> np.ndarray:
    """The level of each bucket, 8 log2(1 + count); its size is fixed, 2 ** bits bytes.

    The sketches of the tasks are added in two steps, so that no task receives more than a share of them.  From each
    count the mean of all buckets is taken away, which is what other shingles add to it.
    """
    rows = counted.where("slab IS NOT NULL").select("slab", "counts")
    some = rows.repartition("slab", F.pmod(F.xxhash64("counts"), F.lit(64))).mapInArrow(add_slabs, "slab int, counts binary")
    total = np.zeros(1 << bits, dtype=np.int64)
    for r in some.repartition("slab").mapInArrow(add_slabs, "slab int, counts binary").toLocalIterator():
        total[r["slab"] * SLAB : (r["slab"] + 1) * SLAB] = np.frombuffer(r["counts"], dtype=np.int64)
    total = np.maximum(total - int(total.mean()), 0)
    return np.minimum(np.round(EIGHTH * np.log2(1 + total)), 255).astype(np.uint8)


def prefix_lists(docs: DataFrame, levels, k: int, t: float, parts: int, hot: int) -> DataFrame:  # noqa: ANN001
    """Rows (part, set_id, n, b0, b1, tokens, places): the prefix shingles of a document that lie in one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, level = Shingler(k), levels.value
        bits = np.uint64(len(level) - 1)
        for batch in batches:
            doc, s = shingler.shingles(batch.column(1))
            ids, size = set_ids(doc, s, batch.num_rows)
            bit = s >> np.uint64(57)
            one = np.uint64(1) << (bit & np.uint64(63))
            full = np.flatnonzero(size > 0)
            first = np.cumsum(size) - size
            parity = np.zeros((2, batch.num_rows), dtype=np.uint64)
            for half in (0, 1):
                if len(full):
                    parity[half, full] = np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == half, one, np.uint64(0)), first[full])
            lev = level[(s & bits).astype(np.int64)]
            order = np.lexsort((s, lev, doc))
            doc, s, lev = doc[order], s[order], lev[order]
            place = np.arange(len(s)) - first[doc]
            n = size[doc]
            keep = place < n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
            doc, s, lev, place = doc[keep], s[keep], lev[keep], place[keep]
            token = mix(s)
            # a frequent shingle is split: blocks of documents, one cell for each pair of blocks
            blocks = np.ceil(np.exp2(lev / EIGHTH) / hot).astype(np.int64)
            many = np.flatnonzero(blocks > 1)
            if len(many):
                b = blocks[many]
                at = np.repeat(many, b)
                other = np.arange(b.sum()) - np.repeat(np.cumsum(b) - b, b)
                mine = ids[doc[at]].view(np.uint64) % blocks[at].astype(np.uint64)
                lo, hi = np.minimum(mine, other.astype(np.uint64)), np.maximum(mine, other.astype(np.uint64))
                few = blocks <= 1
                token = np.r_[token[few], mix(token[at] + lo * np.uint64(0x9E3779B97F4A7C15) + mix(hi + np.uint64(1)))]
                doc, place = np.r_[doc[few], doc[at]], np.r_[place[few], place[at]]
            part = (token % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((part, doc))
            doc, part, token, place = doc[order], part[order], token[order], place[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
            starts = np.flatnonzero(new)
            offsets = pa.array(np.r_[starts, len(doc)].astype(np.int32))
            d = doc[starts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[starts].astype(np.int32)), pa.array(ids[d]), pa.array(size[d].astype(np.int32)), pa.array(parity[0, d].view(np.int64)), pa.array(parity[1, d].view(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array((token >> np.uint64(32)).astype(np.uint32).view(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(np.minimum(place, 32767).astype(np.int16))),
                ],
                names=["part", "set_id", "n", "b0", "b1", "tokens", "places"],
            )

    return docs.mapInArrow(run, "part int, set_id bigint, n int, b0 bigint, b1 bigint, tokens array<int>, places array<smallint>")


def probe_lists(token: np.ndarray, doc: np.ndarray, place: np.ndarray, n: np.ndarray, ids: np.ndarray, bitmaps: np.ndarray, t: float, chunk: int = 2_000_000) -> Iterator[np.ndarray]:
    """Arrays of candidate pairs (id of the smaller or equal set first) from inverted lists."""
    size = n[doc]
    order = np.lexsort((ids[doc], size, token))
    token, doc, place, size = token[order], doc[order], place[order], size[order]
    # the end of the part of the list whose sizes can reach t with this one, by a binary probe
    run = np.cumsum(np.r_[0, token[1:] != token[:-1]])
    width = np.int64(size.max(initial=0)) + 2
    joint = run * width + size
    most = np.minimum(np.floor(size / t + 1e-9).astype(np.int64), width - 1)
    end = np.searchsorted(joint, run * width + most, side="right")
    # the smaller one of a pair needs a shorter prefix than the larger
    role = place < size - np.ceil(2 * t / (1 + t) * size - 1e-9).astype(np.int64) + 1
    count = np.where(role, end - np.arange(len(token)) - 1, 0)
    # equal sizes: either may come first in the list, so the other must not need the longer prefix; the order
    # of the shingles is the same for both and the first common one lies in the shorter prefix of each
    total = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + chunk, side="right")))
        c = count[a:b]
        left = np.repeat(np.arange(a, b), c)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
        x, y = doc[left], doc[right]
        nx, ny = size[left], size[right]
        must = needed(nx, ny, t)
        ok = 1 + np.minimum(nx - place[left], ny - place[right]) - 1 >= must
        x, y, must, total_n = x[ok], y[ok], must[ok], (nx + ny)[ok]
        apart = np.bitwise_count(bitmaps[0, x] ^ bitmaps[0, y]).astype(np.int64) + np.bitwise_count(bitmaps[1, x] ^ bitmaps[1, y])
        ok = (apart <= total_n - 2 * must) & (ids[x] != ids[y])
        p = np.stack([ids[x[ok]], ids[y[ok]]], axis=1)
        if len(p):
            p.sort(axis=1)
            yield np.unique(p, axis=0)
        a = b


def candidates(lists: DataFrame, t: float, parts: int) -> DataFrame:
    """Distinct pairs (sa, sb), sa < sb, of set ids that pass all bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        whole = whole.combine_chunks()
        col = lambda name: whole[name].combine_chunks() if whole[name].num_chunks != 1 else whole[name].chunk(0)
        ids, n = col("set_id").to_numpy(), col("n").to_numpy().astype(np.int64)
        tokens = col("tokens")
        token, place = tokens.flatten().to_numpy(), col("places").flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(ids)), np.diff(tokens.offsets.to_numpy()))
        # copies of a set count once
        order = np.lexsort((ids[doc], token))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (token[order][1:] == token[order][:-1]) & (ids[doc[order]][1:] == ids[doc[order]][:-1])
        order = order[~same]
        bitmaps = np.stack([col("b0").to_numpy().view(np.uint64), col("b1").to_numpy().view(np.uint64)])
        for p in probe_lists(token[order], doc[order], place[order], n, ids, bitmaps, t):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], names=["sa", "sb"])

    return lists.repartitionById(parts, "part").mapInArrow(run, "sa bigint, sb bigint").distinct()


def divide_skip(query: np.ndarray, sets: list[np.ndarray], t: float, mu: float = 0.01) -> list[tuple[int, int]]:
    """(index, overlap) of the sets that reach the required overlap with ``query``; all arrays are sorted."""
    n = len(query)
    must = [int(x) for x in needed(n, np.array([len(s) for s in sets]), t)] if sets else []
    if not must:
        return []
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    lo, hi = np.searchsorted(flat, query, side="left"), np.searchsorted(flat, query, side="right")
    lists = sorted((owner[a:b] for a, b in zip(lo.tolist(), hi.tolist()) if b > a), key=len)
    if not lists:
        return []
    least = min(must)
    n_long = min(int(least / (mu * math.log2(len(lists[-1]) + 1) + 1)), least - 1, len(lists))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    out, last, seen = [], -1, 0

    def settle(d: int, c: int) -> None:
        for k, x in enumerate(long):
            if c + len(long) - k < must[d]:
                return
            at = int(np.searchsorted(x, d))
            c += at < len(x) and x[at] == d
        if c >= must[d]:
            out.append((d, c))

    merged = heapq.merge(*(x.tolist() for x in short)) if len(sets) > 1 else iter([0] * len(short))
    for d in merged:
        if d != last:
            if last >= 0 and seen >= must[last] - n_long:
                settle(last, seen)
            last, seen = d, 0
        seen += 1
    if last >= 0 and seen >= must[last] - n_long:
        settle(last, seen)
    return out


def verify(pairs: DataFrame, texts: DataFrame, k: int, t: float, group: int) -> DataFrame:
    """The pairs (sa, sb) that reach the overlap.  ``texts`` has one text (set_id, t) for each set.

    A query with more than ``group`` candidates is split into several groups.
    """
    many = pairs.groupBy("sa").agg(F.ceil(F.count("*") / group).cast("int").alias("salts"))
    salted = pairs.join(many, "sa").select("sa", "sb", F.pmod(F.xxhash64("sb"), F.col("salts")).cast("int").alias("salt"))
    own = many.select("sa", F.col("sa").alias("sb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = salted.unionByName(own).join(texts, F.col("sb") == F.col("set_id")).select("sa", "sb", "salt", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rest = Shingler(k), None
        names = ["sa", "sb"]

        def settle(block: pa.Table) -> pa.RecordBatch:
            doc, s = shingler.shingles(block["t"].combine_chunks() if block["t"].num_chunks != 1 else block["t"].chunk(0))
            cut = np.searchsorted(doc, np.arange(block.num_rows + 1))
            sa, sb, salt = (block[c].to_numpy() for c in ("sa", "sb", "salt"))
            edge = np.flatnonzero(np.r_[True, (sa[1:] != sa[:-1]) | (salt[1:] != salt[:-1]), True])
            found: list[tuple[int, int]] = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                query = np.flatnonzero(sb[a:b] == sa[a])
                others = [r for r in range(a, b) if sb[r] != sa[a]]
                if not len(query) or not others:
                    continue
                q = a + int(query[0])
                for d, _ in divide_skip(s[cut[q] : cut[q + 1]], [s[cut[r] : cut[r + 1]] for r in others], t):
                    found.append((int(sa[a]), int(sb[others[d]])))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=names)

        for batch in batches:
            block = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            sa, salt = block["sa"].to_numpy(), block["salt"].to_numpy()
            edge = np.flatnonzero((sa[1:] != sa[:-1]) | (salt[1:] != salt[:-1]))
            if not len(edge):
                rest = block
                continue
            rest = block.slice(int(edge[-1]) + 1)
            yield settle(block.slice(0, int(edge[-1]) + 1))
        if rest is not None and rest.num_rows:
            yield settle(rest)

    return rows.repartition("sa", "salt").sortWithinPartitions("sa", "salt").mapInArrow(run, "sa bigint, sb bigint")


def similar_sets(docs: DataFrame, *, id_col: str = "section_id", text_col: str = "text", k: int = 3, threshold: float = 0.7, sketch_bits: int | None = None, hot: int = 20_000, group: int = 2000, part_entries: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): each row's set (id, set_id, n), and the similar pairs of distinct sets (sa, sb).

    Texts of fewer than ``k`` words have no shingle and take no part; null texts neither.  Ids must be
    unique.  The sketch has 2 ** ``sketch_bits`` counts, by default as the size of the table asks for, from 2 ** 20
    to 2 ** 24; the lists are spread over so many partitions that each holds about ``part_entries`` entries.
    """
    spark = docs.sparkSession
    sketch_bits = sketch_bits or min(24, max(20, int(math.log2(max(table_bytes(docs), 1))) - 6))
    d = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    counted = materialize(count_shingles(d, k, sketch_bits), "shingles")
    members = counted.where("slab IS NULL").select("id", "set_id", "n")
    entries = members.agg(F.sum(F.col("n") - F.ceil(F.col("n") * threshold) + 1).alias("e")).first()["e"] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(entries) // part_entries))
    levels = spark.sparkContext.broadcast(sketch_levels(counted, sketch_bits))
    pairs = materialize(candidates(prefix_lists(d, levels, k, threshold, parts, hot), threshold, parts), "candidates")
    ends = pairs.select(F.col("sa").alias("set_id")).unionByName(pairs.select(F.col("sb").alias("set_id"))).distinct()
    reps = members.join(ends, "set_id", "left_semi").groupBy("set_id").agg(F.min("id").alias("i"))
    texts = d.join(reps, "i").select("set_id", "t")
    return members, verify(pairs, texts, k, threshold, group)


def similar_pairs(docs: DataFrame, *, id_col: str = "section_id", class_rows: int = 1000, **how) -> DataFrame:
    """({id_col}_a, {id_col}_b), a < b: every pair of rows whose texts reach the similarity.

    Rows with equal sets of shingles are pairs too; a row that is repeated with its id counts once.  Null texts and texts of fewer than k words give no pair;
    an empty table gives an empty result; other columns are not read, whatever their names.

    The result has c * c / 2 pairs for c copies of a text, so a class of more than ``class_rows`` rows is cut into
    blocks, and each pair of blocks is joined by itself.
    """
    members, pairs = similar_sets(docs, id_col=id_col, **how)
    members = members.select("id", "set_id").distinct()  # repeated rows of one id are one row
    size = members.groupBy("set_id").agg(F.count("*").alias("c")).select("set_id", "c", F.ceil(F.col("c") / class_rows).cast("int").alias("blocks"))
    members = materialize(members.join(size, "set_id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "members")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cells = pairs.join(size.select(F.col("set_id").alias("sa"), F.col("blocks").alias("na")), "sa").join(size.select(F.col("set_id").alias("sb"), F.col("blocks").alias("nb")), "sb")
    cells = cells.select("sa", "sb", "nb", every(F.col("na")).alias("ka")).select("sa", "sb", "ka", every(F.col("nb")).alias("kb"))
    a, b = (members.select(F.col("set_id").alias(f"s{x}"), F.col("block").alias(f"k{x}"), F.col("id").alias(v)) for x, v in (("a", "x"), ("b", "y")))
    across = cells.join(a, ["sa", "ka"]).join(b, ["sb", "kb"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b")
    copied = members.where("c > 1").select("set_id", "id", "block", every(F.col("blocks")).alias("other"))
    own = copied.select("set_id", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "block")
    both = own.withColumnsRenamed({"id": "a", "block": "ba"}).join(own.withColumnsRenamed({"id": "b", "block": "bb"}), ["set_id", "lo", "hi"])
    within = both.where("a < b AND (lo = hi OR ba <> bb)").select("a", "b")
    return across.unionByName(within).select(F.col("a").alias(f"{id_col}_a"), F.col("b").alias(f"{id_col}_b"))


def similar_groups(docs: DataFrame, *, id_col: str = "section_id", **how) -> DataFrame:
    """(id_col, group_id, n_links) of every row that has shingles: its connected component and its number of
    partners; copies are counted, not expanded."""
    members, pairs = similar_sets(docs, id_col=id_col, **how)
    pairs = materialize(pairs, "pairs")
    size = members.groupBy("set_id").agg(F.count("*").alias("c"), F.min("id").alias("first"))
    comp = connected_components(pairs, "sa", "sb").select(F.col("id").alias("set_id"), "component")
    both = pairs.unionByName(pairs.select(F.col("sb").alias("sa"), F.col("sa").alias("sb")))
    links = both.join(size.select(F.col("set_id").alias("sb"), "c"), "sb").groupBy(F.col("sa").alias("set_id")).agg(F.sum("c").alias("links"))
    info = size.join(comp, "set_id", "left").join(links, "set_id", "left").select("set_id", "first", F.coalesce("component", "set_id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links"))
    head = info.groupBy("component").agg(F.min("first").alias("group_id"))
    return members.join(info.select("set_id", "component", "n_links"), "set_id").join(head, "component").select(F.col("id").alias(id_col), "group_id", "n_links")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section_id_a, section_id_b) of each pair of sections with at least 0.7 of their word triples in common."""
    return similar_pairs(table(spark, sf_dir, "sections"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section with its group of near-duplicates and its number of links."""
    return similar_groups(table(spark, sf_dir, "sections"))


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
SQL: dict[str, str] = {
    "p4_found": r"""
WITH w AS (SELECT section_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM sections WHERE text IS NOT NULL),
s AS (SELECT DISTINCT section_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
n AS (SELECT section_id, count(*) AS n FROM s GROUP BY section_id),
o AS (SELECT a.section_id AS a, b.section_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.section_id < b.section_id GROUP BY ALL)
SELECT a AS section_id_a, b AS section_id_b FROM o JOIN n x ON x.section_id = a JOIN n y ON y.section_id = b WHERE 10 * o >= 7 * (x.n + y.n - o)
""",
}
SQL["p4_groups"] = SQL["p4_found"].replace("WITH w AS", "WITH RECURSIVE w AS").rsplit("SELECT a AS section_id_a", 1)[0] + r""",
p AS (SELECT a, b FROM o JOIN n x ON x.section_id = a JOIN n y ON y.section_id = b WHERE 10 * o >= 7 * (x.n + y.n - o)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT section_id AS a, section_id AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT section_id, group_id, coalesce(n_links, 0) AS n_links
FROM (SELECT a AS section_id, min(b) AS group_id FROM reach GROUP BY a) LEFT JOIN (SELECT a AS section_id, count(*) AS n_links FROM e GROUP BY a) USING (section_id)
"""
