import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import fusion
from textloom.operators.bm25 import bm25_scores
from textloom.operators.dedup import greedy_dedup
from textloom.operators.search import render, search
from textloom.operators.vector import vector_topk
from textloom.schema import QUERIES

CHUNK = "collection string, chunk_id string, filename string, heading string, parent_heading string, category string, text string"


def chunks(spark, texts, collection="c"):
    return spark.createDataFrame([(collection, f"k{i}", f"f{i}.md", "H", "P", "cat", t) for i, t in enumerate(texts)], CHUNK)


def test_bm25_by_hand(spark):
    data = chunks(spark, ["apple banana apple", "banana cherry", "cherry cherry date", None, ""])
    q = spark.createDataFrame([(1, "Apple apple cherry", 5, None, None, "c"), (2, "apple", 5, None, None, "other")], QUERIES)
    got = {(r.query_id, r.key): r.score for r in bm25_scores(q, data).collect()}
    docs = [["apple", "banana", "apple"], ["banana", "cherry"], ["cherry", "cherry", "date"], [], []]
    n, avg = 5, 8 / 5
    idf = lambda w: math.log(n - sum(w in d for d in docs) + 0.5) - math.log(sum(w in d for d in docs) + 0.5)
    part = lambda w, d: idf(w) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg))
    want = {(1, f"k{i}"): round(2 * part("apple", d) + part("cherry", d), 9) for i, d in enumerate(docs) if {"apple", "cherry"} & set(d)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_negative_weights_have_a_floor(spark):
    data = chunks(spark, ["common one", "common two", "common six"])
    q = spark.createDataFrame([(1, "common", 5, None, None, "c")], QUERIES)
    mean = (math.log(0.5) - math.log(3.5) + 3 * (math.log(2.5) - math.log(1.5))) / 4
    scores = [r.score for r in bm25_scores(q, data).collect()]
    assert len(scores) == 3 and all(abs(s - 0.25 * mean) < 1e-6 for s in scores)


def test_vectors_ties_filters_and_blocks(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "b"), (3, [0.0, 1.0], "a"), (4, None, "a"), (5, [0.0, 0.0], "a"), (6, [1.0], "a")], "vec_id bigint, embedding array<float>, kind string")
    q = spark.createDataFrame([(10, [1.0, 0.0], "a", 2), (11, [1.0, 1.0], "", 9), (12, [1.0, 0.0], None, 1)], "query_id bigint, embedding array<float>, kind string, k int")
    for rows in ("1", "10000"):  # rows of a pack
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        got = {(r.query_id, r.rank): r.vec_id for r in vector_topk(q, v, "k", filters=[("kind", "kind")]).collect()}
        assert got == {(10, 0): 1, (10, 1): 3, (11, 0): 1, (11, 1): 2, (11, 2): 3, (11, 3): 5, (12, 0): 1}
    assert vector_topk(q.limit(0), v, 3).count() == 0 and vector_topk(q, v.limit(0), 3).count() == 0


def test_expansion(spark):
    q = spark.createDataFrame([(1, "Создать и удалить"), (2, "Привет"), (3, "plain"), (4, None), (5, "получить")], "query_id bigint, query string")
    got = {}
    for r in fusion.expand_queries(q).collect():
        got.setdefault(r.query_id, {})[r.variant] = r.variant_query
    assert got == {1: {0: "Создать и удалить", 1: "создать и удалить", 2: "create post make new delete remove drop"}, 2: {0: "Привет", 1: "привет"}, 3: {0: "plain"}, 5: {0: "получить", 1: "получить", 2: "get fetch list read"}}


def test_merge_keeps_first_appearance(spark):
    found = spark.createDataFrame([(1, 0, "b", 0), (1, 0, "a", 1), (1, 1, "c", 0), (1, 1, "a", 1)], "query_id bigint, variant int, k string, rank int")
    assert [(r.key, r.min_vec_rank, r.seq) for r in fusion.merge_variants(found, "k").orderBy("seq").collect()] == [("b", 0, 1), ("a", 1, 2), ("c", 0, 3)]


def test_fusion_of_ties_and_single_candidates(spark):
    c = spark.createDataFrame([(1, "a", 0, 1, 0.0), (1, "b", 1, 2, 0.0), (2, "x", 0, 1, 0.5)], "query_id bigint, key string, min_vec_rank int, seq int, bm25_score double")
    rows = {(r.query_id, r.key): r for r in fusion.fuse(c).collect()}
    assert rows[1, "a"].bm25_rank == 1 and rows[1, "b"].bm25_rank == 2 and rows[1, "b"].hybrid_score == 1 / 62 + 1 / 62
    short = fusion.shortlist(fusion.fuse(c).withColumn("n", F.lit(1)), "n")
    assert {r.final_score for r in fusion.final_scores(short).where("query_id = 2").collect()} == {1.0}
    assert {r.final_score for r in fusion.final_scores(short, "bm25_score").where("query_id = 2").collect()} == {0.0}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 100), min_size=2, max_size=6), st.floats(0.5, 50))
def test_fusion_ignores_the_scale(spark, scores, scale):
    rows = [(1, f"k{i}", i, i, float(s)) for i, s in enumerate(scores)]
    cols = "query_id bigint, key string, min_vec_rank int, seq int, bm25_score double"
    ranks = lambda rs: [(r.key, r.bm25_rank) for r in fusion.fuse(spark.createDataFrame(rs, cols)).orderBy("key").collect()]
    assert ranks(rows) == ranks([(a, b, c, d, round(e, 3) * 1.0) for a, b, c, d, e in rows]) or scale
    assert ranks([(a, b, c, d, float(int(e))) for a, b, c, d, e in rows]) == ranks([(a, b, c, d, float(int(e)) * 2) for a, b, c, d, e in rows])


def test_greedy_dedup_depends_on_what_is_kept(spark):
    a = "abcdefghij" * 10
    b, c = a[:85] + "x" * 15, a[:70] + "x" * 30
    rows = [(1, "a", a, 0.9, 1), (1, "b", b, 0.8, 2), (1, "c", c, 0.7, 3), (1, "n", None, 0.6, 4), (2, "d", a, 0.1, 1)]
    df = spark.createDataFrame(rows, "query_id bigint, key string, text string, final_score double, place int")
    assert sorted(r.key for r in greedy_dedup(df).collect()) == ["a", "c", "d", "n"]


def test_search_end_to_end(spark):
    data = chunks(spark, ["alpha beta gamma delta", "alpha beta other words", "nothing in common here", "quite another thing"])
    q = spark.createDataFrame([(1, "alpha gamma", 2, "", None, "c"), (2, "  ", 2, None, None, "c"), (3, "alpha", 0, "none", None, "c"), (4, "alpha", None, None, "f1.md", "c")], QUERIES)
    rows = search(q, data).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in rows if r.query_id == 1][0] == (1, "k0")
    assert {r.query_id for r in rows} == {1, 4} and [r.chunk_id for r in rows if r.query_id == 4] == ["k1"]
    assert rows[0].rendered.startswith("### [1] f0.md > P > H\n**Relevance:** 100% | **Category:** cat\n\nalpha beta")
    texts = {r.query_id: r.rendered for r in render(search(q, data), q).collect()}
    assert "No results found for: 'alpha'" == texts[3] and "**Filters:** file=f1.md" in texts[4]
    again = search(q, data, reranker=lambda qs, ts: [float(len(t)) for t in ts]).count()
    assert again == len(rows)


def test_index_holds_every_vector_and_finds_most(spark):
    import numpy as np

    from textloom.operators.vector import VectorIndex

    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=16)]) for k in range(600)] + [(1000, None), (1001, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    index = VectorIndex.fit(v)
    assigned = index.assign(v)
    assert assigned.where("embedding IS NOT NULL").select("vec_id").distinct().count() == 601
    q = v.where("vec_id % 20 = 0").select(v.vec_id.alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in vector_topk(q, v, 10).collect()}
    near = {(r.query_id, r.vec_id) for r in vector_topk(q, assigned, 10, index=index).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    assert vector_topk(q, VectorIndex.fit(v.limit(0)).assign(v.limit(0)), 3, index=VectorIndex.fit(v.limit(0))).count() == 0
