from pyspark.sql import functions as F

from textloom.functions import render as R
from textloom.functions import text as X
from textloom.functions import url as U
from textloom.functions.html import by_density, clean_markdown, links_of, page_header, page_to_markdown, plain_text, title_of


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(col.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, X.tokens(F.col("t")), t="Ab abc, x_y-Ünï 12 123\u00a0naïve²") == ["abc", "x_y", "ünï", "123", "naïve²"]
    assert one(spark, X.tokens(F.lit(None).cast("string")), t="") == []


def test_paths(spark):
    assert one(spark, X.suffix(F.col("t")), t="a/b.tar.GZ") == ".gz" and one(spark, X.suffix(F.col("t")), t="a/.hidden") == ""
    assert one(spark, X.stem(F.col("t")), t="a/b.tar.gz") == "b.tar"


def test_urls(spark):
    assert one(spark, U.normalize_url(F.col("u")), u="https://a.b/c//#x") == "https://a.b/c"
    assert one(spark, U.normalize_url(F.col("u")), u="https://a.b/") == "https://a.b/"
    ok = lambda u, prefix="https://a.b/docs/", **k: one(spark, U.allowed_url(F.col("u"), F.lit(prefix), F.lit("a.b"), **k), u=u)
    assert ok("https://a.b/docs") and ok("https://a.b/docs/x?y=1") and not ok("https://a.b/other") and not ok("ftp://a.b/docs/x")
    assert not ok("https://c.d/docs/x") and not ok("https://a.b/docs/x.PNG") and not ok("https://a.b/docs/x?p=1", exclude=[r"p=\d"])
    assert ok("https://a.b/other", stay=False) and not ok("not a url")


def test_links_titles_and_sitemaps(spark):
    html = '<title>T</title><h1>Big <b>one</b></h1><a href=" /x ">1</a><a class="k" href="#y">2</a><a href="mailto:z">3</a><a href=\'u?v\'>4</a>'
    assert one(spark, U.page_links(F.col("h")), h=html) == ["/x", "u?v"] == links_of(html)
    assert title_of(html) == "Big one" and title_of("<title> T </title>") == "T" and page_header("<p>x</p>", "u") == "Source: u\n\n"
    assert one(spark, U.sitemap_urls(F.col("x")), x="<loc> a </loc><loc>b</loc><loc>a</loc>") == ["a", "b"]


def test_clean_markdown():
    assert clean_markdown("a  \n\n\n\n\n\nb\n---\n| - |\nc") == "a\n\n\nb\nc"


def test_render(spark):
    assert one(spark, R.breadcrumb(F.lit("a.md"), F.lit("a"), F.lit("H")), x=0) == "a.md > H"
    assert one(spark, R.breadcrumb(F.lit(None).cast("string"), F.lit("P"), F.lit("P")), x=0) == "unknown > P"
    assert [one(spark, R.percent(F.lit(v)), x=0) for v in (0.125, 0.015, 0.135, 1.0)] == ["12%", "2%", "14%", "100%"]


def test_snippets(spark):
    cut = lambda t: one(spark, R.snippet(F.col("t")), t=t)
    assert cut("[...] over\n\n\n\nlap") == "over\n\nlap"
    assert cut("x" * 1400 + "```" + "y" * 500) == "x" * 1400 + "```"
    assert cut("x" * 1200 + "```" + "y" * 900) == ("x" * 1200 + "```" + "y" * 900)[:1500] + "..."
    assert cut("x" * 2100 + "```" + "y" * 10) == "x" * 1500 + "..."
    assert cut("x" * 900 + ". " + "y" * 900) == "x" * 900 + "."
    assert cut("x" * 700 + ". " + "y" * 900) == "x" * 700 + ". " + "y" * 798 + "..."


def test_html_pages():
    body = "<p>" + "Some words of content. " * 12 + "</p>"
    page = f"<html><head><title>T</title></head><body><nav>{body}</nav><main>{body}<h2>Sub</h2><ul><li>one</li><li><a href='/u'>two</a></li></ul></main></body></html>"
    text = page_to_markdown(page, "https://x/")
    assert text.startswith("# T\n\nSource: https://x/\n\n") and text.count("Some words") == 12 and "## Sub" in text and "* [two](/u)" in text
    by_class = page_to_markdown(f"<div class='a content b'>{body}</div><div>other</div>", "u")
    assert by_class.startswith("Source: u") and "other" not in by_class
    assert "Some words" in page_to_markdown(f"<body>{body}</body>", "u") and "Some words" in page_to_markdown(f"<section>{body}</section>", "u")
    assert page_to_markdown("<body><p>short</p></body>", "u") == "" == page_to_markdown(None, "u") and by_density("<p>x</p>") == ""
    assert plain_text("<p>a<b>b</b></p><script>no</script>") == "a\nb"
