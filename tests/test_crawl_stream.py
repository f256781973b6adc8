import datetime as dt

import pytest

from textloom.operators.components import connected_components
from textloom.operators.crawl import RenderedPages, TablePages, crawl
from textloom.streaming.watch import bursts, event_stream, stop, watch

HOST = "https://a.b/docs"


def graph(spark):
    pages = spark.createDataFrame([(f"{HOST}/{n}" if n else HOST, "<html>", f"text {n}") for n in ("", "1", "2", "3", "deep", "far")] + [("https://c.d/x", "<html>", "other"), (f"{HOST}/empty", "<html>", " ")], "url string, html string, content string")
    links = spark.createDataFrame([(HOST, "/docs/1", 0), (HOST, "/docs/2/", 1), (HOST, "/docs/pic.png", 2), (HOST, "https://c.d/x", 3), (f"{HOST}/1", "2#frag", 0), (f"{HOST}/1", "/docs", 1), (f"{HOST}/2", "deep", 0), (f"{HOST}/deep", "far", 0), (f"{HOST}/2", "/out", 1), (f"{HOST}/2", "empty", 2)], "src_url string, link string, pos int")
    return TablePages(pages), links


def found(rows):
    return {(r.url.removeprefix(HOST), r.depth) for r in rows}


def test_crawl(spark):
    source, links = graph(spark)
    seeds = spark.createDataFrame([(HOST + "/",)], "seed string")
    assert found(crawl(source, links, seeds).collect()) == {("", 0), ("/1", 1), ("/2", 1), ("/deep", 2), ("/far", 3)}
    assert found(crawl(source, links, seeds, max_depth=1).collect()) == {("", 0), ("/1", 1), ("/2", 1)}
    assert found(crawl(source, links, seeds, max_pages=2).collect()) == {("", 0), ("/1", 1)}
    assert found(crawl(source, links, seeds, exclude=["/1$"]).collect()) == {("", 0), ("/2", 1), ("/deep", 2), ("/far", 3)}
    assert found(crawl(source, links, seeds, robots={"https://a.b": "User-agent: *\nDisallow: /docs/2"}).collect()) == {("", 0), ("/1", 1)}
    assert crawl(source, links, seeds.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 1)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_bursts(spark):
    rows = [(at(0), "a.md", "modified"), (at(2), "a.md", "created"), (at(3.5), "b.md", "moved"), (at(5.6), "c.md", "deleted"), (at(5.7), "c.exe", "modified"), (at(5.8), "d.md", None), (None, "e.md", "modified")]
    got = sorted((r.n_events, r.n_paths) for r in bursts(spark.createDataFrame(rows, "ts timestamp, path string, kind string")).collect())
    assert got == [(1, 1), (3, 2)]


def test_stream_runs_an_index_for_each_closed_burst(spark, tmp_path):
    folder, calls = str(tmp_path / "events"), []
    schema = "ts timestamp, path string, kind string"
    spark.createDataFrame([(at(0), "a.md", "modified"), (at(1), "b.md", "modified")], schema).coalesce(1).write.parquet(folder)

    def run(n):
        calls.append(n)
        raise RuntimeError("a failing run does not end the stream")

    q = watch(event_stream(spark, folder), run, str(tmp_path / "cp"), late="1 second", trigger={"processingTime": "100 milliseconds"})
    q.processAllAvailable()
    spark.createDataFrame([(at(100), "c.md", "modified")], schema).coalesce(1).write.mode("append").parquet(folder)
    q.processAllAvailable()
    assert calls == [1] and q.isActive
    stop(q)
    assert not q.isActive


def test_the_last_fetch_counts_as_a_whole(spark):
    rows = [(1, f"{HOST}/#a", "<old>", "z old", at(0)), (2, HOST + "/", None, "new", at(5)), (3, HOST + "/", "<late>", "zz no time", None)]
    pages = TablePages(spark.createDataFrame(rows, "page_id bigint, url string, html string, content string, fetched_at timestamp"))
    got = pages.fetch(spark.createDataFrame([(HOST,)], "url string")).collect()
    assert [(r.html, r.content) for r in got] == [(None, "new")]


def test_pages_that_a_browser_renders(spark):
    html = "<title>T</title><main>" + "Some words of content. " * 12 + "</main>"
    source = RenderedPages(lambda u: html if u == HOST else None)
    got = crawl(source, spark.createDataFrame([], "src_url string, link string, pos int"), spark.createDataFrame([(HOST,), (HOST + "/none",)], "seed string")).collect()
    assert [(r.url, r.content.split("\n")[0]) for r in got] == [(HOST, "# T")]


def test_bursts_of_several_roots(spark):
    rows = [(at(0), "a.md", "modified", "r"), (at(1), "b.md", "modified", "s"), (at(3), "a.md", "modified", "r"), (at(3), "c.md", "modified", "s")]
    df = spark.createDataFrame(rows, "ts timestamp, path string, kind string, root string")
    assert sorted((r.root, r.n_events) for r in bursts(df, key="root").collect()) == [("r", 1), ("r", 1), ("s", 2)]
    assert [r.n_events for r in bursts(df).collect()] == [4]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from textloom.plans import materialize as M

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        M.shared_dir(Session())
    df = M.materialize(spark.range(3))
    assert df.count() == 3 and M.release(spark) >= 1 and M.release(spark) == 0
