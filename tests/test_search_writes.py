from pyspark.sql import functions as F

from textloom.operators import bm25, search
from textloom.operators.vector import vector_topk
from textloom.schema import QUERIES

CHUNK = "collection string, chunk_id string, filename string, heading string, parent_heading string, category string, text string"


def test_a_search_writes_candidates_and_not_all_scores(spark, monkeypatch):
    chunks = spark.createDataFrame([("c", f"k{i}", f"f{i}", "h", "p", "k", f"common word{i % 7} word{i % 5} text{i}") for i in range(200)], CHUNK)
    q = spark.createDataFrame([(i, f"common word{i} text{i}", 1, None, None, "c") for i in range(4)], QUERIES)
    written = []
    real = search.materialize

    def noted(df, label):
        out = real(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(search, "materialize", noted)
    assert search.search(q, chunks).count() == 4
    assert written and max(n for _, n in written) <= 4 * 4  # four candidates for each result; all scores are 800
    pairs = q.select("query_id").crossJoin(chunks.select(F.col("chunk_id").alias("key")))
    want = {(r.query_id, r.key): r.score for r in bm25.bm25_scores(q, chunks).collect()}
    got = {(r.query_id, r.key): r.score for r in bm25.bm25_of(pairs, q, bm25.own_index(chunks)).collect()}
    assert len(got) == 800 and all(abs(s - want.get(k, 0)) < 1e-8 for k, s in got.items())


def test_filters_meet_only_packs_of_their_value(spark):
    v = spark.createDataFrame([(i, [1.0, i / 50], "abc"[i % 3], None if i % 4 == 0 else "xy"[i % 2]) for i in range(50)], "vec_id bigint, embedding array<float>, a string, b string")
    q = spark.createDataFrame([(100, [1.0, 0.0], "a", "x"), (101, [1.0, 0.0], "b", None), (102, [1.0, 0.0], "", "y"), (103, [1.0, 0.0], "none", "")], "query_id bigint, embedding array<float>, a string, b string")
    got = {}
    for r in vector_topk(q, v, 3, filters=[("a", "a"), ("b", "b")]).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {100: [6, 18, 30], 101: [1, 4, 7], 102: [1, 3, 5]}
