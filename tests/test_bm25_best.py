import os
import random
import shutil

from textloom.operators import bm25
from textloom.operators.store import Store
from textloom.operators.vector import HashEmbedder, embed
from textloom.schema import QUERIES

CHUNK = "collection string, chunk_id string, source string, filename string, heading string, parent_heading string, category string, section_ordinal int, sub_index int, word_count int, text string"


def tables(spark, n=60):
    rng = random.Random(7)
    text = lambda k: " ".join(rng.choice(["common", *(f"word{j}" for j in range(12))]) for _ in range(k))
    rows = [(c, f"{c}{i}", f"s{i % 9}", "f", "h", "p", "k", i, 0, 0, None if i == 3 else "" if i == 4 else "common " + text(i % 7)) for c in "ab" for i in range(n)]
    q = [(i, None if i == 5 else "common" if i == 6 else "nowhere" if i == 7 else text(4), 5, None, None, "ab"[i % 2]) for i in range(20)]
    return spark.createDataFrame(rows, CHUNK), spark.createDataFrame(q, QUERIES)


def test_best_are_those_of_all_scores(spark, tmp_path, monkeypatch):
    chunks, q = tables(spark)
    all_scores = bm25.bm25_scores(q, chunks)
    want = {k: sorted((r.query_id, r.rank, r.key, round(r.score, 6)) for r in bm25.top_k(all_scores, k).collect()) for k in (1, 7)}
    assert any(r[3] < 1 for r in want[7]) and len({r[0] for r in want[1]}) == 18  # the term in all texts has the floor as its weight
    store = Store(spark, str(tmp_path / "db"), buckets=3)
    for c in "ab":
        store.replace_sources(c, embed(chunks, "text", HashEmbedder(8)).where(f"collection = '{c}'"))
    for pack, block, k, index in ((2048, 512, 7, bm25.own_index(chunks)), (5, 3, 1, store.bm25_index()), (5, 3, 7, store.bm25_index())):
        monkeypatch.setattr(bm25, "PACK", pack)
        monkeypatch.setattr(bm25, "BLOCK", block)
        assert sorted((r.query_id, r.rank, r.key, round(r.score, 6)) for r in bm25.bm25_best(q, k, index).collect()) == want[k]
    # the store keeps one row for each chunk, and all scores come from these too
    assert store.bm25_index()[0].count() == chunks.count()
    got = {(r.query_id, r.key): round(r.score, 6) for r in bm25.bm25_scores(q, chunks, index=store.bm25_index()).collect()}
    assert got == {(r.query_id, r.key): round(r.score, 6) for r in all_scores.collect()}


def test_weights_that_are_not_positive_give_rows(spark):
    one = spark.createDataFrame([("a", f"k{i}", f"s{i}", "f", "h", "p", "k", 0, 0, 0, t) for i, t in enumerate(["one two", "one two", "one", "none"])], CHUNK)
    q = spark.createDataFrame([(1, "one two", 5, None, None, "a"), (2, "two", 5, None, None, "a")], QUERIES)
    rows = lambda df: sorted((r.query_id, r.key, round(r.score, 6)) for r in df.collect())
    all_scores = bm25.bm25_scores(q, one)
    assert min(r.score for r in all_scores.collect()) <= 0 and rows(bm25.bm25_best(q, 9, bm25.own_index(one))) == rows(all_scores)


def test_a_store_without_terms_by_chunk_is_read(spark, tmp_path):
    chunks, q = tables(spark, 12)
    store = Store(spark, str(tmp_path / "db"), buckets=3)
    store.replace_sources("a", embed(chunks, "text", HashEmbedder(8)).where("collection = 'a'"))
    rows = lambda: sorted((r.query_id, r.key, r.score) for r in bm25.bm25_best(q, 5, store.bm25_index()).collect())
    before = rows()
    for folder in {os.path.join(p, "words") for p, names, _ in os.walk(tmp_path) if "words" in names}:
        shutil.rmtree(folder)
    assert before and rows() == before
