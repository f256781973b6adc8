"""The engine's queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import html
from textloom.functions import render as R
from textloom.functions import text as X
from textloom.functions import url as U
from textloom.operators import bm25, chunking, crawl, fusion, manifest, stats
from textloom.operators.search import render as render_results
from textloom.operators.search import search
from textloom.operators.store import Store, collection_counts, from_file
from textloom.operators.vector import DigestEmbedder, VectorIndex, embed, vector_topk
from textloom.plans.materialize import materialize, shared_dir
from textloom.plans.tables import table as t
from textloom.sources import remote, samples
from textloom.sources.files import admitted, convert_files, supported
from textloom.streaming.watch import bursts, watched

QUERIES: dict = {}
SQL: dict[str, str] = {}

WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
TOKENS = r"list_filter(string_split(regexp_replace(lower(replace(coalesce({0}, ''), 'İ', 'i' || chr(775))), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda x: length(x) > 2)"
WORDS = "list_filter(string_split(regexp_replace(coalesce({0}, ''), '" + WS.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g'), ' '), lambda x: x <> '')"
NAME = r"regexp_extract({0}, '([^/\\]*)/*$', 1)"
SUFFIX = r"lower(regexp_extract(" + NAME + r", '[^.](\.[^.]+)$', 1))"
SUPPORTED_SQL = "('.md','.txt','.rst','.text','.log','.py','.js','.ts','.jsx','.tsx','.css','.scss','.java','.go','.rs','.c','.cpp','.h','.hpp','.rb','.php','.swift','.kt','.lua','.sh','.bash','.json','.yaml','.yml','.toml','.xml','.ini','.cfg','.csv','.html','.htm','.pdf','.docx','.xlsx','.pptx','.ipynb')"
ASKED = "query_id % 20 = 0 AND regexp_matches(query, '\\S')"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def by_row(f, kind: str):  # noqa: ANN001, ANN201
    """A function of one text, of those that the engine runs in its tasks, as a column function."""
    import pandas as pd

    return F.pandas_udf(lambda s: pd.Series([f(x) for x in s], dtype=object), kind)


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every request whose id is divisible by 20."""
    return t(spark, d, "queries").where((F.col("query_id") % 20 == 0) & F.col("query").rlike(r"\S"))


# --- text ---------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, len(list_distinct({TOKENS.format('text')})) AS n_distinct FROM documents")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    w = X.tokens(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.size(w).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    p = bm25.postings(t(spark, d, "documents"), key="doc_id", collection=None)
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"SELECT section_id, len({WORDS.format('text')}) AS n_words FROM sections")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "sections").select("section_id", X.word_count(F.col("text")).cast("bigint").alias("n_words"))


@query(rf"""SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (
SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?。]){WS}+', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') AS s FROM documents)""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = by_row(chunking.sentences, "array<string>")(F.coalesce("text", F.lit("")))
    return t(spark, d, "documents").select("doc_id", F.size(s).cast("bigint").alias("n_sentences"), F.md5(F.array_join(s, "|")).alias("digest"))


@query(rf"SELECT doc_id, md5(regexp_replace(text, '(?s)\A---.*?---{WS}*', '')) AS digest FROM documents WHERE text IS NOT NULL")
def frontmatter_strip(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(by_row(chunking.strip_frontmatter, "string")("text")).alias("digest"))


@query(f"""WITH w AS (SELECT doc_id, text, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, CASE WHEN len(w) > 120 THEN list_transform(generate_series(0, len(w) - 1, 100), lambda i: array_to_string(w[i + 1 : i + 100], ' ')) ELSE [text] END AS p FROM w)
SELECT doc_id, (generate_subscripts(p, 1) - 1)::INTEGER AS part, md5(unnest(p)) AS digest FROM p""")
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 100 words for texts of more than 120, as the tables hold few long texts."""
    p = t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(by_row(lambda x: chunking.window(x, 120, 100), "array<string>")("text")).alias("part", "p"))
    return p.select("doc_id", "part", F.md5("p").alias("digest"))


@query(r"""SELECT section_id, regexp_replace(regexp_replace(regexp_extract(source, '([^/\\]*)/*$', 1), '([^.])\.[^.]+$', '\1') || '_' || md5(source)[1:6] || '__' || md5(text)[1:10], '[^A-Za-z0-9_]', '_', 'g') AS cid
FROM sections WHERE source IS NOT NULL AND text IS NOT NULL""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "sections").where("source IS NOT NULL AND text IS NOT NULL").select("section_id", X.chunk_id(F.col("source"), F.col("text")).alias("cid"))


@query(rf"SELECT section_id, length(regexp_replace(coalesce(text, ''), '[|\-#*`>]|{WS}', '', 'g')) >= 30 AS enough FROM sections")
def min_content(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "sections").select("section_id", by_row(chunking.enough_content, "boolean")(F.coalesce("text", F.lit(""))).alias("enough"))


STRIP = "regexp_replace({0}, '^" + WS.replace("{", "{{").replace("}", "}}") + "+|" + WS.replace("{", "{{").replace("}", "}}") + "+$', '', 'g')"
SENTENCES = "list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '([.!?。])" + WS.replace("{", "{{").replace("}", "}}") + r"+', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g'), chr(1)), lambda x: " + STRIP.format("x").replace("{", "{{").replace("}", "}}") + "), lambda x: x <> '')"
# frontmatter, then the first level-1 heading in plain lower case, then the stem
CATEGORY = (
    "CASE WHEN named IS NOT NULL THEN lower(" + STRIP.format("named") + r") WHEN titled <> '' THEN titled ELSE regexp_replace(lower(stem), '[_-]', ' ', 'g') END"
)
CATEGORY_PARTS = (
    rf"list_filter(string_split(regexp_extract(text, '(?s)\A---{WS}*\n(.*?)\n---', 1), chr(10)), lambda x: contains(x, ':') AND lower(" + STRIP.format("split_part(x, ':', 1)") + r") = 'category')[1] AS line, substr(line, position(':' IN line) + 1) AS named, "
    + STRIP.format(rf"regexp_replace(lower(regexp_replace(" + STRIP.format(rf"regexp_extract(text, '(?m)^#{WS}+(.+)$', 1)") + rf", '[*_`]', '', 'g')), '[^\p{{L}}\p{{N}}_\-\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g')") + " AS titled"
)
CHUNKS_SQL = (
    "WITH RECURSIVE d AS (SELECT coalesce(source, 'none') || '/' || doc_id || '.md' AS path, doc_id::VARCHAR AS stem, text, " + CATEGORY_PARTS + r" FROM documents WHERE regexp_matches(text, '\S')), "
    # headings between marks; what stands before a mark belongs to the heading before
    rf"h AS (SELECT path, stem, {CATEGORY} AS category, string_split(regexp_replace(regexp_replace(text, '(?s)\A---.*?---{WS}*', ''), '(?m)^(#{{1,3}}){WS}+(.+)$', chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g'), chr(1)) AS pieces FROM d), "
    "s AS (SELECT path, stem, category, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS ord FROM h), "
    "t AS (SELECT path, stem, category, ord, CASE WHEN ord = 1 THEN 'Introduction' ELSE " + STRIP.format("split_part(split_part(piece, chr(2), 2), chr(3), 1)") + " END AS heading, ord > 1 AND starts_with(piece, '#' || chr(2)) AS top, " + STRIP.format("CASE WHEN ord = 1 THEN piece ELSE substr(piece, position(chr(3) IN piece) + 1) END") + " AS body FROM s), "
    "u AS (SELECT *, coalesce(last_value(CASE WHEN top THEN heading END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ord ROWS UNBOUNDED PRECEDING), stem) AS parent FROM t), "
    rf"v AS (SELECT *, {WORDS.format('body')} AS w FROM u WHERE length(regexp_replace(body, '[|\-#*`>]|{WS}', '', 'g')) >= 30), "
    "x AS (SELECT *, CASE WHEN len(w) > 700 THEN list_transform(generate_series(0, len(w) - 1, 600), lambda i: array_to_string(w[i + 1 : i + 600], ' ')) ELSE [body] END AS ps FROM v), "
    "y AS (SELECT path, stem, category, ord, heading, parent, unnest(ps) AS p, (generate_subscripts(ps, 1) - 1)::INTEGER AS sub FROM x), "
    "z AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord, sub) AS n FROM y), "
    # each chunk begins with the end of what the one before has become
    "f AS (SELECT path, n, p AS t FROM z WHERE n = 1 UNION ALL SELECT z.path, z.n, CASE WHEN len(" + SENTENCES.format("f.t") + ") >= 2 THEN '[...] ' || array_to_string(" + SENTENCES.format("f.t") + "[-2:], ' ') || chr(10) || chr(10) || z.p ELSE z.p END FROM f JOIN z ON z.path = f.path AND z.n = f.n + 1) "
    "SELECT 'docs_v4' AS collection, regexp_replace(stem || '_' || md5(path)[1:6] || '__' || md5(t)[1:10], '[^A-Za-z0-9_]', '_', 'g') AS chunk_id, path AS source, stem || '.md' AS filename, heading, parent AS parent_heading, category, "
    "(z.n - 1)::INTEGER AS section_ordinal, sub AS sub_index, len(" + WORDS.format("t") + ")::INTEGER AS word_count, t AS text FROM f JOIN z USING (path, n)"
)


@query(CHUNKS_SQL)
def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document through the chunker; its source and id make the path."""
    docs = t(spark, d, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return chunking.chunk_documents(docs, collection="docs_v4")


@query(f"SELECT doc_id, {CATEGORY} AS category FROM (SELECT doc_id, text, 'My_file-' || doc_id AS stem, {CATEGORY_PARTS} FROM documents WHERE text IS NOT NULL)")
def categories(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    one = F.pandas_udf(lambda i, x: pd.Series([chunking.category_of(b, f"a/My_file-{a}.txt") for a, b in zip(i, x)]), "string")
    return t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", one("doc_id", "text").alias("category"))


PYTHON = "import os\n\n@deco\ndef f{0}(a):\n    return a\n\nasync def g{0}():\n    pass\n\nclass C{0}:\n    x = 1\n\nprint(1)\n"
SCRIPT = "export class C{0} {{ x = 1; }}\nconst a{0} = async (x) => {{ return x; }};\nasync function f{0}(a) {{ return a; }}\nlet y = 2;\n"
BROKEN = "# Part {0}\n\ndef broken(:\n    a line that is long enough to be kept as text\n"


@query(r"""WITH d AS (SELECT doc_id, doc_id::VARCHAR AS i FROM documents), n AS (SELECT chr(10) AS n)
SELECT 'src/' || i || '.py' AS source, 0 AS section_ordinal, 'Function: f' || i AS heading, '```python' || n || 'def f' || i || '(a):' || n || '    return a' || n || '```' AS text FROM d, n WHERE doc_id % 3 = 0
UNION ALL SELECT 'src/' || i || '.py', 1, 'async Function: g' || i, '```python' || n || 'async def g' || i || '():' || n || '    pass' || n || '```' FROM d, n WHERE doc_id % 3 = 0
UNION ALL SELECT 'src/' || i || '.py', 2, 'Class: C' || i, '```python' || n || 'class C' || i || ':' || n || '    x = 1' || n || '```' FROM d, n WHERE doc_id % 3 = 0
UNION ALL SELECT 'src/' || i || '.ts', 0, 'function: f' || i, '```ts' || n || 'async function f' || i || '(a) { return a; }' || n || '```' FROM d, n WHERE doc_id % 3 = 1
UNION ALL SELECT 'src/' || i || '.ts', 1, 'class: C' || i, '```ts' || n || 'export class C' || i || ' { x = 1; }' || n || '```' FROM d, n WHERE doc_id % 3 = 1
UNION ALL SELECT 'src/' || i || '.ts', 2, 'function: a' || i, '```ts' || n || 'const a' || i || ' = async (x) => { return x; }' || n || '```' FROM d, n WHERE doc_id % 3 = 1
UNION ALL SELECT 'src/' || i || '.py', 0, 'Part ' || i, 'def broken(:' || n || '    a line that is long enough to be kept as text' FROM d, n WHERE doc_id % 3 = 2""")
def code_sections(spark: SparkSession, d: str) -> DataFrame:
    """A source file for each document, of three sorts: one in Python, one in a script language, one that does not parse."""
    sorts = t(spark, d, "documents").select((F.col("doc_id") % 3).alias("k"), F.col("doc_id").cast("string").alias("i"))
    fill = lambda text: F.replace(F.lit(text.format("@1@")), F.lit("@1@"), F.col("i"))
    code = F.when(F.col("k") == 0, fill(PYTHON)).when(F.col("k") == 1, fill(SCRIPT)).otherwise(fill(BROKEN))
    path = F.concat(F.lit("src/"), F.col("i"), F.when(F.col("k") == 1, F.lit(".ts")).otherwise(F.lit(".py")))
    return chunking.chunk_documents(sorts.select(path.alias("path"), code.alias("text"), code.alias("raw")), collection="code", raw="raw").select("source", "section_ordinal", "heading", "text")


# --- files --------------------------------------------------------------------------------------------------

KINDS = (".md", ".csv", ".py", ".html", ".ipynb", ".docx", ".xlsx", ".pptx")


@query(rf"""WITH d AS (SELECT doc_id, doc_id % 8 AS k, text, md5(text) AS m, chr(10) AS n FROM documents WHERE text IS NOT NULL),
x AS (SELECT *, CASE WHEN k < 3 THEN text WHEN k = 3 THEN '<p>' || m || '</p><script>no</script><b>' || doc_id || '</b>' END AS raw FROM d)
SELECT doc_id, CASE WHEN k < 4 THEN md5(raw) END AS md5, md5(CASE WHEN k < 3 AND regexp_replace(raw, '{WS}+', '', 'g') = '' THEN NULL
WHEN k < 2 THEN replace(replace(raw, chr(13) || n, n), chr(13), n)
WHEN k = 2 THEN '# ' || doc_id || '.py' || n || n || '```py' || n || replace(replace(raw, chr(13) || n, n), chr(13), n) || n || '```'
WHEN k = 3 THEN m || n || doc_id
WHEN k = 4 THEN '# ' || m || n || n || '```python' || n || 'x = ' || doc_id || n || '```'
WHEN k = 5 THEN '## ' || m || n || n || 'Paragraph ' || doc_id || n || n || '| a | ' || m || ' |' || n || '|---|---|' || n || '| b | ' || doc_id || ' |'
WHEN k = 6 THEN '## Sheet: S' || doc_id || n || n || '| id | digest |' || n || '|---|---|' || n || '| ' || doc_id || ' | ' || m || ' |'
ELSE '## Slide 1' || n || n || m || n || n || '## Slide 2' || n || n || doc_id END) AS digest FROM x""")
def file_formats(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a file of one of eight formats, read back: the hash of its bytes (for text formats) and of its text."""
    import hashlib

    import pandas as pd

    def content(k: int, i: int, x: str) -> bytes:
        m = hashlib.md5(x.encode()).hexdigest()  # noqa: S324
        if k == 3:
            return f"<p>{m}</p><script>no</script><b>{i}</b>".encode()
        own = {4: lambda: samples.notebook(f"# {m}", f"x = {i}"), 5: lambda: samples.docx(m, f"Paragraph {i}", [["a", m], ["b", str(i)]]), 6: lambda: samples.xlsx(f"S{i}", [["id", "digest"], [str(i), m]]), 7: lambda: samples.pptx([m, str(i)])}
        return own[k]() if k in own else x.encode()

    made = F.pandas_udf(lambda k, i, x: pd.Series([content(*r) for r in zip(k, i, x)]), "binary")
    k = F.col("doc_id") % 8
    names = F.element_at(F.array(*map(F.lit, KINDS)), (k + 1).cast("int"))
    docs = t(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.col("doc_id").cast("string"), names).alias("path"), made(k, "doc_id", "text").alias("content"))
    got = convert_files(docs).withColumn("doc_id", F.regexp_extract("path", r"^(\d+)", 1).cast("bigint"))
    return got.select("doc_id", F.when(F.col("doc_id") % 8 < 4, F.col("md5")).alias("md5"), F.md5("text").alias("digest"))


@query(r"SELECT 'zip://d' || doc_id || '.zip/r/' || doc_id || '.md' AS url, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM documents WHERE text IS NOT NULL AND " + f"regexp_replace(text, '{WS}+', '', 'g') <> ''")
def zip_members(spark: SparkSession, d: str) -> DataFrame:
    """Each document in an archive of its own, beside members that are no documents."""
    import pandas as pd

    made = F.pandas_udf(lambda i, x: pd.Series([samples.zipped({f"r/{a}.md": b, "r/code.py": "left out", "r/blank.txt": " "}) for a, b in zip(i, x)]), "binary")
    files = t(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit("/a/d"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("path"), made("doc_id", "text").alias("content"))
    return remote.zip_members(files).select("url", F.md5("content").alias("digest"))


# --- retrieval ----------------------------------------------------------------------------------------------

BM25_SQL = (
    "t AS (SELECT {coll} AS collection, {key} AS key, " + TOKENS.format("text") + " AS w FROM {chunks}), s AS (SELECT collection, count(*) AS n, avg(len(w)) AS avgdl FROM t GROUP BY collection), "
    "p AS (SELECT collection, key, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT collection, key, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY collection, key, term), "
    "f AS (SELECT collection, term, count(*) AS df FROM p GROUP BY collection, term), r AS (SELECT f.*, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM f JOIN s USING (collection)), "
    "m AS (SELECT collection, avg(raw) AS mean FROM r GROUP BY collection), i AS (SELECT r.collection, term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM r JOIN m USING (collection)), "
    "qt AS (SELECT query_id, collection, term, count(*) AS qtf FROM (SELECT query_id, {qcoll} AS collection, unnest(" + TOKENS.format("query") + ") AS term FROM queries WHERE " + ASKED + ") GROUP BY ALL), "
    "b AS (SELECT query_id, key, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN i USING (collection, term) JOIN p USING (collection, term) JOIN s USING (collection) GROUP BY query_id, key)"
)


def bm25_sql(coll: str, key: str, chunks: str) -> str:
    return BM25_SQL.replace("{coll}", coll).replace("{key}", key).replace("{chunks}", chunks).replace("{qcoll}", coll)


SECTIONS_BM25 = bm25_sql("collection", "section_id", "sections")


@query(f"""WITH {SECTIONS_BM25} SELECT query_id, key AS section_id, rank::INTEGER AS rank, round(score, 6) AS score FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM b) WHERE rank <= 10""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scores = bm25.bm25_scores(asked(spark, d), t(spark, d, "sections"), key="section_id")
    return bm25.top_k(scores, 10).select("query_id", F.col("key").alias("section_id"), "rank", F.round("score", 6).alias("score"))


@query(f"WITH {SECTIONS_BM25} SELECT collection, any_value(n) AS n, round(any_value(avgdl), 6) AS avgdl, count(*) AS n_terms, round(avg(idf), 6) AS mean_idf FROM i JOIN s USING (collection) GROUP BY collection")
def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    sections = t(spark, d, "sections")
    s = bm25.doc_stats(sections)
    terms = bm25.term_stats(bm25.postings(sections, key="section_id"), s).groupBy("collection").agg(F.count("*").alias("n_terms"), F.round(F.avg("idf"), 6).alias("mean_idf"))
    return terms.join(s, "collection").select("collection", "n", F.round("avgdl", 6).alias("avgdl"), "n_terms", "mean_idf")


VECTOR_SQL = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 9) AS sim FROM v q JOIN v ON {0} WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) - 1)::INTEGER AS rank FROM s) WHERE rank < 10"""


@query(VECTOR_SQL.format("true"))
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_topk(q, e, 10).select("query_id", "vec_id", "rank")


@query(VECTOR_SQL.format("q.label = v.label"))
def vector_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return vector_topk(q, e, 10, filters=[("label", "label")]).select("query_id", "vec_id", "rank")


EXPAND_SQL = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(query), '{ru}') THEN '{en}' END" for ru, en in fusion.SYNONYMS) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH q AS (SELECT query_id, query, regexp_matches(query, '[Ѐ-ӿ]') AS c, array_to_string({EXPAND_SQL}, ' ') AS en FROM queries WHERE query IS NOT NULL),
v AS (SELECT query_id, CASE WHEN NOT c THEN [query] WHEN en = '' THEN [query, lower(query)] ELSE [query, lower(query), en] END AS v FROM q)
SELECT query_id, (generate_subscripts(v, 1) - 1)::INTEGER AS variant, unnest(v) AS variant_query FROM v""")
def query_expand(spark: SparkSession, d: str) -> DataFrame:
    return fusion.expand_queries(t(spark, d, "queries")).select("query_id", "variant", "variant_query")


# from candidates c (query_id, n, key, vr, seq) and BM25 scores b to the shortlist sh
SHORTLIST = (
    "mx AS (SELECT query_id, max(score) AS best FROM b GROUP BY query_id), "
    "h AS (SELECT c.*, coalesce(score / CASE WHEN best > 0 THEN best ELSE 1 END, 0) AS bm25_score FROM c LEFT JOIN b USING (query_id, key) LEFT JOIN mx USING (query_id)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vr, seq) AS vec_rank, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, seq) AS bm25_rank FROM h), "
    "hy AS (SELECT *, 1.0::DOUBLE / (60 + vec_rank) + 1.0::DOUBLE / (60 + bm25_rank) AS hybrid FROM k), "
    "sh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, seq) AS place FROM hy) WHERE place <= 2 * n) "
)
FUSED_SQL = (
    "WITH dv AS (SELECT d.doc_id, d.text, e.embedding::DOUBLE[] AS e FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id), "
    + bm25_sql("'all'", "doc_id", "dv")
    + ", qv AS (SELECT q.query_id, query, greatest(1, coalesce(n_results, 5)) AS n, e.embedding::DOUBLE[] AS e FROM queries q JOIN embeddings e ON q.query_id = e.vec_id WHERE " + ASKED + "), "
    "c0 AS (SELECT query_id, n, doc_id AS key, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(qv.e, dv.e) / sqrt(list_dot_product(qv.e, qv.e) * list_dot_product(dv.e, dv.e)), 9) DESC, doc_id) - 1 AS vr FROM qv, dv), "
    "c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vr) AS seq FROM c0 WHERE vr < 4 * n), "
    + SHORTLIST
)


def fused(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    docs = t(spark, d, "documents").join(e, F.col("doc_id") == F.col("vec_id")).select("doc_id", "text", "embedding")
    q = asked(spark, d).join(e, F.col("query_id") == F.col("vec_id")).select("query_id", "query", F.greatest(F.lit(1), F.coalesce("n_results", F.lit(5))).alias("n"), "embedding")
    found = vector_topk(q.withColumn("fetch", 4 * F.col("n")), docs, "fetch", key="doc_id")
    scores = bm25.bm25_scores(asked(spark, d), docs, key="doc_id", collection=None)
    f = fusion.fuse(fusion.with_bm25(fusion.merge_variants(found, "doc_id"), scores))
    return fusion.shortlist(f.join(q.select("query_id", "n"), "query_id"), "n")


@query(FUSED_SQL + "SELECT query_id, key AS doc_id, vec_rank::INTEGER AS vec_rank, bm25_rank::INTEGER AS bm25_rank, round(bm25_score, 6) AS bm25_score, round(hybrid, 9) AS hybrid_score, place::INTEGER AS place FROM sh")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d).select("query_id", F.col("key").alias("doc_id"), "vec_rank", "bm25_rank", F.round("bm25_score", 6).alias("bm25_score"), F.round("hybrid_score", 9).alias("hybrid_score"), "place")


@query(FUSED_SQL + "SELECT query_id, key AS doc_id, round(CASE WHEN max(hybrid) OVER w > 0 THEN hybrid / max(hybrid) OVER w ELSE 0 END, 6) AS final_score FROM sh WINDOW w AS (PARTITION BY query_id)")
def final_score_fallback(spark: SparkSession, d: str) -> DataFrame:
    return fusion.final_scores(fused(spark, d)).select("query_id", F.col("key").alias("doc_id"), F.round("final_score", 6).alias("final_score"))


@query(FUSED_SQL + """SELECT query_id, key AS doc_id, round(0.4 * (hybrid - min(hybrid) OVER w) / CASE WHEN max(hybrid) OVER w <> min(hybrid) OVER w THEN max(hybrid) OVER w - min(hybrid) OVER w ELSE 1 END
+ 0.6 * (bm25_score - min(bm25_score) OVER w) / CASE WHEN max(bm25_score) OVER w <> min(bm25_score) OVER w THEN max(bm25_score) OVER w - min(bm25_score) OVER w ELSE 1 END, 6) AS final_score FROM sh WINDOW w AS (PARTITION BY query_id)""")
def final_score_blend(spark: SparkSession, d: str) -> DataFrame:
    """The blend with a reranker's score; the BM25 score stands in for the reranker."""
    return fusion.final_scores(fused(spark, d), "bm25_score").select("query_id", F.col("key").alias("doc_id"), F.round("final_score", 6).alias("final_score"))


#: The vector of a text for ``DigestEmbedder``: the digits of its digest.
DIGEST = "list_transform(range(1, 33), lambda i: position(md5(coalesce({0}, ''))[i] IN '0123456789abcdef') - 8.5)::DOUBLE[]"
SAME = "(coalesce(v.{0}, '') = '' OR v.{0} = e.{0})"
VARIANTS_SQL = (
    f"q0 AS (SELECT query_id, query, greatest(1, coalesce(n_results, 5)) AS n, collection, category, filename, regexp_matches(query, '[Ѐ-ӿ]') AS c, array_to_string({EXPAND_SQL}, ' ') AS en FROM queries WHERE {ASKED}), "
    "q1 AS (SELECT *, CASE WHEN NOT c THEN [query] WHEN en = '' THEN [query, lower(query)] ELSE [query, lower(query), en] END AS vs FROM q0), "
    "q2 AS (SELECT * EXCLUDE (vs), unnest(vs) AS vq, generate_subscripts(vs, 1) - 1 AS variant FROM q1), "
    f"v AS (SELECT *, {DIGEST.format('vq')} AS ve FROM q2), e AS (SELECT section_id, collection, category, filename, {DIGEST.format('text')} AS e FROM sections), "
    "si AS (SELECT v.query_id, variant, n, section_id AS key, round(list_dot_product(ve, e) / sqrt(list_dot_product(ve, ve) * list_dot_product(e, e)), 9) AS sim FROM v JOIN e ON " + " AND ".join(SAME.format(x) for x in ("collection", "category", "filename")) + "), "
    "vr AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY sim DESC, key) - 1 AS r FROM si), "
    "c1 AS (SELECT query_id, n, key, min(r) AS vr, min(variant * 1000000000 + r) AS first FROM vr WHERE r < 4 * n GROUP BY query_id, n, key), "
    "c AS (SELECT query_id, n, key, vr, row_number() OVER (PARTITION BY query_id ORDER BY first) AS seq FROM c1), "
)
SEARCH_SQL = (
    f"WITH {SECTIONS_BM25}, {VARIANTS_SQL} {SHORTLIST}, "
    "fs AS (SELECT *, CASE WHEN max(hybrid) OVER w > 0 THEN hybrid / max(hybrid) OVER w ELSE 0 END AS final FROM sh WINDOW w AS (PARTITION BY query_id)), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, place) AS rank FROM fs) "
)


def search_results(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline over the sections, with vectors that SQL can compute and without the greedy removal of like
    results, which it cannot (tests compare that with brute force)."""
    return search(asked(spark, d), t(spark, d, "sections"), key="section_id", embedder=DigestEmbedder(), duplicate_ratio=1.0)


@query(f"WITH {VARIANTS_SQL[:-2]} SELECT query_id, key AS section_id, vr::INTEGER AS min_vec_rank, seq::INTEGER AS seq FROM c")
def variant_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates over all variants of each request: their best rank, and their place of first appearance."""
    q = asked(spark, d).withColumn("fetch", 4 * F.greatest(F.lit(1), F.coalesce("n_results", F.lit(5))))
    variants = embed(fusion.expand_queries(q), "variant_query", DigestEmbedder())
    found = vector_topk(variants, embed(t(spark, d, "sections"), "text", DigestEmbedder()), "fetch", key="section_id", filters=[(c, c) for c in ("collection", "category", "filename")])
    return fusion.merge_variants(found, "section_id").withColumnRenamed("key", "section_id")


@query(SEARCH_SQL + "SELECT query_id, rank::INTEGER AS rank, key AS section_id, filename, heading, category, round(final, 6) AS final_score FROM rk JOIN sections ON section_id = key WHERE rank <= n")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return search_results(spark, d).select("query_id", "rank", "section_id", "filename", "heading", "category", F.round("final_score", 6).alias("final_score"))


@query()
def hybrid_search_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline as the engine runs it, with the hashed vectors and without results that are like better ones."""
    return search(asked(spark, d), t(spark, d, "sections"), key="section_id").select("query_id", "rank", "section_id", "filename", "heading", "category", "final_score")


def snippet_sql(limit: int) -> tuple[str, str]:
    """(the cleaned text, its cut as an expression of the cleaned text t) of a snippet of ``limit`` characters."""
    clean = rf"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^{WS}+|{WS}+$', '', 'g'), '^\[\.\.\.\]\s*', ''), '\n{{3,}}', chr(10) || chr(10), 'g')"
    fence, stop, head = f"position('```' IN t[{limit - 199}:])", f"position(' .' IN reverse(t[1:{limit}]))", f"t[1:{limit}]"
    cut = f"CASE WHEN length(t) <= {limit} THEN t WHEN {fence} > 0 AND {fence} + {limit - 201} < {limit + 500} THEN t[1:{fence} + {limit - 198}] WHEN {stop} > 0 AND length({head}) - {stop} - 1 > {limit // 2} THEN t[1:length({head}) - {stop}] ELSE {head} || '...' END"
    return clean, cut


CRUMB = r"coalesce(filename, 'unknown') || CASE WHEN coalesce(parent_heading, '') NOT IN ('', regexp_replace(coalesce(filename, 'unknown'), '([^.])\.[^.]+$', '\1')) THEN ' > ' || parent_heading ELSE '' END || CASE WHEN coalesce(heading, '') NOT IN ('', coalesce(parent_heading, '')) THEN ' > ' || heading ELSE '' END"


@query(
    SEARCH_SQL + f""", x AS (SELECT query_id, rank, final, category, {CRUMB} AS crumb, {snippet_sql(1500)[0]} AS t FROM rk JOIN sections ON section_id = key WHERE rank <= n),
bl AS (SELECT query_id, rank, '### [' || rank || '] ' || crumb || chr(10) || '**Relevance:** ' || round_even(round(final, 9) * 100, 0)::BIGINT || '% | **Category:** ' || coalesce(category, '') || chr(10) || chr(10) || {snippet_sql(1500)[1]} || chr(10) AS b FROM x),
al AS (SELECT query_id, string_agg(b, chr(10) ORDER BY rank) AS b FROM bl GROUP BY query_id)
SELECT q.query_id, CASE WHEN b IS NULL THEN 'No results found for: ''' || query || '''' ELSE '## Results for: "' || query || '"' || chr(10) || chr(10)
|| CASE WHEN coalesce(category, '') <> '' OR coalesce(filename, '') <> '' THEN '**Filters:** ' || concat_ws(', ', CASE WHEN coalesce(category, '') <> '' THEN 'category=' || category END, CASE WHEN coalesce(filename, '') <> '' THEN 'file=' || filename END) || chr(10) || chr(10) ELSE '' END
|| '**Method:** Hybrid (Vector + BM25)' || chr(10) || chr(10) || b END AS rendered FROM queries q LEFT JOIN al USING (query_id) WHERE {ASKED}"""
)
def rendered_search(spark: SparkSession, d: str) -> DataFrame:
    return render_results(search_results(spark, d), asked(spark, d))

@query(
    f"WITH {SECTIONS_BM25}, {VARIANTS_SQL} {SHORTLIST}, "
    "ln AS (SELECT sh.*, length(coalesce(text, ''))::DOUBLE AS rr FROM sh JOIN sections ON section_id = key), "
    "bs AS (SELECT *, 0.4 * (hybrid - min(hybrid) OVER w) / CASE WHEN max(hybrid) OVER w <> min(hybrid) OVER w THEN max(hybrid) OVER w - min(hybrid) OVER w ELSE 1 END + 0.6 * (rr - min(rr) OVER w) / CASE WHEN max(rr) OVER w <> min(rr) OVER w THEN max(rr) OVER w - min(rr) OVER w ELSE 1 END AS final FROM ln WINDOW w AS (PARTITION BY query_id)) "
    "SELECT query_id, rank::INTEGER AS rank, key AS section_id, round(final, 6) AS final_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, place) AS rank FROM bs) WHERE rank <= n"
)
def reranked_search(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline with a reranker: one that prefers long texts, as SQL can compute that."""
    found = search(asked(spark, d), t(spark, d, "sections"), key="section_id", embedder=DigestEmbedder(), reranker=lambda q, x: [len(s) for s in x], duplicate_ratio=1.0)
    return found.select("query_id", "rank", "section_id", F.round("final_score", 6).alias("final_score"))


ADDED = "\n\n## Added\n\nThis part was written into the file after the first run."
FOLDER_SQL = CHUNKS_SQL.replace("WITH RECURSIVE d AS", f"WITH RECURSIVE files AS (SELECT doc_id, source, replace(replace(text || CASE WHEN doc_id % 10 = 1 THEN replace('{ADDED}', '\n', chr(10)) ELSE '' END, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents WHERE doc_id % 10 <> 0), d AS", 1).replace("FROM documents WHERE regexp_matches", "FROM files WHERE regexp_matches", 1)


@query(f"SELECT source, section_ordinal, heading, parent_heading, category, md5(text) AS digest FROM ({FOLDER_SQL})")
def index_folder(spark: SparkSession, d: str) -> DataFrame:
    """The chunks in the engine's store after two runs over a folder: each document a file, of which some are changed and
    some deleted between the runs."""
    import os

    from textloom.api import Engine

    base = f"{shared_dir(spark).removeprefix('file://')}/textloom-folder-{uuid.uuid4().hex}"
    docs = t(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text", "doc_id")

    def write(rows) -> None:  # noqa: ANN001
        for r in rows:
            path = f"{base}/docs/{r['path']}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(r["text"].encode("utf-8"))

    def remove(rows) -> None:  # noqa: ANN001
        for r in rows:
            os.remove(f"{base}/docs/{r['path']}")

    docs.foreachPartition(write)
    engine = Engine(spark, f"{base}/index", embedder=DigestEmbedder())
    engine.index_documents(f"{base}/docs", "folder")
    docs.where("doc_id % 10 = 0").foreachPartition(remove)
    docs.where("doc_id % 10 = 1").withColumn("text", F.concat("text", F.lit(ADDED))).foreachPartition(write)
    engine.index_documents(f"{base}/docs", "folder")
    return engine.store.chunks("folder").select(F.replace("source", F.lit(f"{base}/docs/"), F.lit("")).alias("source"), "section_ordinal", "heading", "parent_heading", "category", F.md5("text").alias("digest"))


@query("SELECT count(*) AS n_queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL")
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the inverted lists, which hold every vector, give at least 0.9 of the ten nearest of the stated queries."""
    e = t(spark, d, "embeddings")
    index = VectorIndex.fit(e)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = vector_topk(q, index.assign(e), 10, index=index).select("query_id", "vec_id", F.lit(1).alias("hit"))
    both = vector_topk(q, e, 10).join(near, ["query_id", "vec_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


@query(r"""WITH p AS (SELECT section_id, word_count, coalesce(filename, 'unknown') AS f, coalesce(parent_heading, '') AS p, coalesce(heading, '') AS h, regexp_replace(coalesce(filename, 'unknown'), '([^.])\.[^.]+$', '\1') AS stem FROM sections)
SELECT section_id, f || CASE WHEN p <> '' AND p <> stem THEN ' > ' || p ELSE '' END || CASE WHEN h <> '' AND h <> p THEN ' > ' || h ELSE '' END AS crumb, round_even(coalesce(word_count, 0) / 8.0, 0)::BIGINT::VARCHAR || '%' AS share FROM p""")
def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "sections").select("section_id", R.breadcrumb(F.col("filename"), F.col("parent_heading"), F.col("heading")).alias("crumb"), R.percent(F.coalesce("word_count", F.lit(0)) / 800).alias("share"))


@query(rf"""WITH a AS (SELECT section_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '^{WS}+|{WS}+$', '', 'g'), '^\[\.\.\.\]\s*', ''), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM sections),
b AS (SELECT section_id, t, t[1:400] AS head, position('```' IN t[201:]) AS f FROM a), c AS (SELECT *, CASE WHEN f > 0 THEN f + 199 ELSE -1 END AS fence, position(' .' IN reverse(head)) AS r FROM b)
SELECT section_id, md5(CASE WHEN length(t) <= 400 THEN t WHEN fence > 0 AND fence < 900 THEN t[1:fence + 3] WHEN r > 0 AND length(head) - r - 1 > 200 THEN t[1:length(head) - r] ELSE head || '...' END) AS digest FROM c""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of 400 characters, as sections are short."""
    return t(spark, d, "sections").select("section_id", F.md5(R.snippet(F.col("text"), 400)).alias("digest"))


# --- stored collections -------------------------------------------------------------------------------------

DIFF_SQL = """WITH o AS (SELECT collection, root, path, min(md5) AS old, true AS there FROM manifest WHERE generation = 1 GROUP BY ALL), n AS (SELECT collection, root, path, min(md5) AS new, true AS here FROM manifest WHERE generation = 2 GROUP BY ALL),
d AS (SELECT collection, root, path, CASE WHEN here IS NULL THEN 'deleted' WHEN new IS NULL THEN 'unreadable' WHEN there IS NULL THEN 'added' WHEN old = new THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL JOIN n USING (collection, root, path)) """
FILLED = "SELECT section_id, collection, coalesce(filename, 'unknown') AS filename, coalesce(category, 'other') AS category, coalesce(word_count, 0) AS word_count FROM sections"


@query(f"SELECT collection, count(*) AS chunks, count(DISTINCT filename) AS files, count(DISTINCT category) AS categories, sum(word_count)::BIGINT AS words FROM ({FILLED}) GROUP BY collection")
def status_report(spark: SparkSession, d: str) -> DataFrame:
    return stats.status(t(spark, d, "sections"))


@query(f"SELECT collection, category, count(*) AS chunks FROM ({FILLED}) GROUP BY ALL")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.counts_by(t(spark, d, "sections"), "category")


@query("SELECT collection, coalesce(filename, 'unknown') AS filename, arg_min(coalesce(source, ''), section_id) AS source, arg_min(coalesce(category, ''), section_id) AS category, count(*) AS chunks, sum(coalesce(word_count, 0))::BIGINT AS words FROM sections GROUP BY 1, 2")
def indexed_files(spark: SparkSession, d: str) -> DataFrame:
    return stats.files(t(spark, d, "sections"))


@query(f"SELECT collection, rank::INTEGER AS rank, filename, chunks FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY chunks DESC, first) AS rank FROM (SELECT collection, filename, count(*) AS chunks, min(section_id) AS first FROM ({FILLED}) GROUP BY ALL)) WHERE rank <= 10")
def top_files(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_files(t(spark, d, "sections"))


@query("SELECT collection, count(*) AS chunks FROM sections GROUP BY collection")
def list_collections(spark: SparkSession, d: str) -> DataFrame:
    return collection_counts(t(spark, d, "sections"))


def stored(spark: SparkSession, d: str) -> Store:
    """A new store with the sections as chunks, each under its own id."""
    store = Store(spark, f"{shared_dir(spark)}/textloom-store-{uuid.uuid4().hex}", buckets=4)
    sections = t(spark, d, "sections").where("collection IS NOT NULL")
    chunks = sections.select("collection", F.col("section_id").cast("string").alias("chunk_id"), "source", "filename", "heading", "parent_heading", "category", "section_ordinal", "sub_index", "word_count", "text", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    for c in [r[0] for r in sections.select("collection").distinct().orderBy("collection").collect()]:
        store.replace_sources(c, chunks.where(F.col("collection") == c))
    return store


@query(DIFF_SQL.rstrip() + """, s AS (SELECT * FROM sections WHERE collection IS NOT NULL), f AS (SELECT collection, path FROM d WHERE state IN ('added', 'changed', 'deleted') AND root = 'docs')
SELECT collection, section_id::VARCHAR AS chunk_id, coalesce(source, '') AS source FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.collection = s.collection AND f.path = s.source)
UNION ALL SELECT collection, 'new ' || md5(path), path FROM d WHERE state IN ('added', 'changed') AND root = 'docs'""")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The store after the second generation of one root: one chunk for each added and changed file, no other ones of
    added, changed and deleted files."""
    store, m = stored(spark, d), t(spark, d, "manifest").where("root = 'docs'")
    old, new = (manifest.latest(m.where(F.col("generation") == k)) for k in (1, 2))
    for c in [r[0] for r in m.select("collection").distinct().orderBy("collection").collect()]:
        # the first generation is in the manifest, but brings no chunks
        first = old.where(F.col("collection") == c).select(F.lit("docs").alias("root"), "path", "md5")
        store.replace_sources(c, store.chunks(c).limit(0), first.select("path").limit(0).withColumnRenamed("path", "source"), first)
        now = new.where(F.col("collection") == c).select("path", "md5")
        states = materialize(store.changes(c, "docs", now), "states")
        text = F.md5("path")
        fresh = states.where("state IN ('added', 'changed')").select("collection", F.concat(F.lit("new "), text).alias("chunk_id"), F.col("path").alias("source"), X.file_name(F.col("path")).alias("filename"), *[F.lit("").alias(x) for x in ("heading", "parent_heading", "category")], *[F.lit(0).alias(x) for x in ("section_ordinal", "sub_index", "word_count")], text.alias("text"))
        store.apply(c, "docs", now, states, fresh)
    return store.chunks().select("collection", "chunk_id", F.coalesce("source", F.lit("")).alias("source"))


@query("""WITH s AS (SELECT * FROM sections WHERE collection IS NOT NULL), gone AS (SELECT collection, max(filename) AS filename FROM s GROUP BY collection)
SELECT collection, count(*) AS chunks FROM s JOIN gone g USING (collection) WHERE collection <> (SELECT min(collection) FROM s) AND NOT coalesce(s.filename = g.filename, false) GROUP BY collection""")
def store_remove(spark: SparkSession, d: str) -> DataFrame:
    """The collections of the store after each has lost its last file by name, and the first one has been dropped."""
    store = stored(spark, d)
    last = store.chunks().groupBy("collection").agg(F.max("filename").alias("f")).orderBy("collection").collect()
    for r in last:
        if r["f"] is not None:
            store.remove_source(r["collection"], r["f"])
    if last:
        store.drop(last[0]["collection"], confirm=True)
    store.vacuum(1)
    return store.collections()


@query(f"""WITH {SECTIONS_BM25} SELECT query_id, key::VARCHAR AS chunk_id, rank::INTEGER AS rank, round(score, 6) AS score FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key::VARCHAR) AS rank FROM b) WHERE rank <= 10""")
def bm25_stored(spark: SparkSession, d: str) -> DataFrame:
    """BM25 from the terms and statistics that the store keeps."""
    best = bm25.bm25_best(asked(spark, d), 10, stored(spark, d).bm25_index())
    return best.select("query_id", F.col("key").alias("chunk_id"), "rank", F.round("score", 6).alias("score"))


def generations(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "manifest")
    return manifest.diff(m.where("generation = 1"), m.where("generation = 2"))


@query(DIFF_SQL + "SELECT * FROM d")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return generations(spark, d)


@query(DIFF_SQL + "SELECT collection, root, path FROM d WHERE state = 'deleted'")
def deleted_files(spark: SparkSession, d: str) -> DataFrame:
    return generations(spark, d).where("state = 'deleted'").drop("state")


@query(DIFF_SQL + f"SELECT {SUFFIX.format('path')} AS suffix, count(*) AS n_files FROM d WHERE state IN ('added', 'changed') GROUP BY 1")
def changed_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    return generations(spark, d).where("state IN ('added', 'changed')").groupBy(X.suffix(F.col("path")).alias("suffix")).agg(F.count("*").alias("n_files"))


@query(DIFF_SQL + """, g AS (SELECT DISTINCT collection, path FROM d WHERE state IN ('changed', 'deleted')), f AS (SELECT DISTINCT collection, path FROM d WHERE state = 'changed')
SELECT collection, chunk_id, category FROM sections s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.collection = s.collection AND g.path = s.source)
UNION ALL SELECT DISTINCT s.collection, chunk_id, 'fresh' FROM sections s JOIN f ON f.collection = s.collection AND f.path = s.source""")
def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The next snapshot when the changed files' chunks come back under another category."""
    chunks, states = t(spark, d, "sections").select("collection", "chunk_id", "source", "category"), generations(spark, d)
    changed = states.where("state = 'changed'").select(F.col("collection").alias("c"), "path").distinct()
    fresh = chunks.join(changed, (F.col("collection") == F.col("c")) & (F.col("source") == F.col("path")), "left_semi").withColumn("category", F.lit("fresh"))
    return manifest.upsert(chunks, states.where("state IN ('changed', 'deleted')"), fresh).select("collection", "chunk_id", "category")


@query("SELECT collection, count(*) AS chunks FROM sections WHERE NOT coalesce(collection = 'docs_v4' AND filename = 'complete-handbook.md', false) GROUP BY collection")
def remove_source(spark: SparkSession, d: str) -> DataFrame:
    """The collections without one file of one of them, by the predicate with which the store removes it."""
    return collection_counts(t(spark, d, "sections").where(~from_file(F.col("collection"), F.col("filename"), "docs_v4", "complete-handbook.md")))


@query(f"SELECT {SUFFIX.format('path')} AS suffix, count(DISTINCT path) AS n_files FROM manifest WHERE {SUFFIX.format('path')} IN {SUPPORTED_SQL} AND NOT regexp_matches(path, '(^|/)(\\.|(__pycache__|node_modules|venv|env|chroma_db|build|dist)(/|$))') GROUP BY 1")
def file_admission(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "manifest").where(supported(F.col("path")) & admitted(F.col("path"))).groupBy(X.suffix(F.col("path")).alias("suffix")).agg(F.countDistinct("path").alias("n_files"))


# --- pages --------------------------------------------------------------------------------------------------

NORM = "(CASE WHEN length({0}) - length(replace({0}, '/', '')) > 3 AND ends_with({0}, '/') THEN regexp_replace({0}, '/+$', '') ELSE {0} END)"
BARE = "regexp_replace(url, '(?s)#.*$', '')"


@query(f"SELECT page_id, {NORM.format(BARE)} AS norm FROM pages")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", U.normalize_url(F.col("url")).alias("norm"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages WHERE url IS NOT NULL)
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https') AND host = lower(host) AND starts_with(regexp_replace(url, '(?s)[?#].*$', ''), 'https://' || lower(host) || '/docs') AND NOT regexp_matches(url, 'page=\d')
AND NOT regexp_matches(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)), '\.(?:jpg|jpeg|png|gif|svg|ico|webp|bmp|css|js|mjs|woff|woff2|ttf|eot|otf|zip|tar|gz|bz2|7z|rar|exe|dmg|pkg|deb|rpm|msi|mp3|mp4|avi|mov|mkv|wav|ogg|pdf)$') AS ok FROM p""")
def url_admit(spark: SparkSession, d: str) -> DataFrame:
    """Whether a crawl of the site's /docs in lower case, without numbered pages, would visit the URL."""
    p = t(spark, d, "pages").where("url IS NOT NULL")
    host = F.lower(U.url_part(F.col("url"), "netloc"))
    return p.select("page_id", U.allowed_url(F.col("url"), F.concat(F.lit("https://"), host, F.lit("/docs/")), host, True, [r"page=\d"]).alias("ok"))


@query(r"""WITH l AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*?\shref\s*=\s*["'']([^"'']*)["'']', 1), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^(javascript:|mailto:|tel:|#)')) AS l FROM pages WHERE html IS NOT NULL)
SELECT page_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS link FROM l""")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").where("html IS NOT NULL").select("page_id", F.posexplode(U.page_links(F.col("html"))).alias("pos", "link"))


@query(r"""WITH h AS (SELECT page_id, url, trim(regexp_replace(CASE WHEN regexp_matches(html, '(?is)<h1\b[^>]*>.*?</h1>') THEN regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1) ELSE regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1) END, '(?s)<[^>]*>', '', 'g')) AS title FROM pages WHERE html IS NOT NULL)
SELECT page_id, CASE WHEN title <> '' THEN '# ' || replace(replace(title, '&lt;', '<'), '&gt;', '>') || chr(10) || chr(10) ELSE '' END || 'Source: ' || url || chr(10) || chr(10) AS header FROM h""")
def page_headers(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    header = F.pandas_udf(lambda h, u: pd.Series([html.page_header(x, y) for x, y in zip(h, u)]), "string")
    return t(spark, d, "pages").where("html IS NOT NULL").select("page_id", header("html", "url").alias("header"))


CLEAN = r"array_to_string(list_filter(string_split(regexp_replace(regexp_replace({0}, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '[|\\—\-#*`>]|" + WS.replace("{", "{{").replace("}", "}}") + r"', '', 'g') <> '' OR regexp_replace(x, '" + WS.replace("{", "{{").replace("}", "}}") + r"', '', 'g') = ''), chr(10))"


@query(f"SELECT page_id, md5({CLEAN.format('content')}) AS digest FROM pages WHERE content IS NOT NULL")
def clean_markdown(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").where("content IS NOT NULL").select("page_id", F.md5(by_row(html.clean_markdown, "string")("content")).alias("digest"))


@query("SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS site, count(DISTINCT trim(url)) AS n_urls, min(trim(url)) AS first FROM pages WHERE url IS NOT NULL GROUP BY 1")
def sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """A sitemap of each site, written from its pages and read back."""
    site = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("site")
    xml = t(spark, d, "pages").where("url IS NOT NULL").groupBy(site).agg(F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("<loc>"), F.trim("url"), F.lit("</loc>")))), "\n").alias("xml"))
    urls = U.sitemap_urls(F.col("xml"))
    return xml.select("site", F.size(urls).cast("bigint").alias("n_urls"), F.element_at(urls, 1).alias("first"))


UNESCAPED = "replace(replace({0}, '&lt;', '<'), '&gt;', '>')"
TRIMMED = "regexp_replace({0}, '^" + WS.replace("{", "{{").replace("}", "}}") + "+|" + WS.replace("{", "{{").replace("}", "}}") + "+$', '', 'g')"
SPACED = "regexp_replace({0}, '" + WS.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g')"
# the raw pages are flat: a title, blocks without tags inside, and links at the end of the body
MAIN_SQL = (
    r"WITH p AS (SELECT page_id, url, " + TRIMMED.format(UNESCAPED.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")) + r" AS title, list_transform(regexp_extract_all(html, '(?s)<div>(.*?)</div>', 1), lambda x: " + UNESCAPED.format("x") + r") AS blocks, "
    r"regexp_extract_all(html, '(?s)<a href=\"([^\"]*)\">(.*?)</a>', 1) AS hrefs, list_transform(regexp_extract_all(html, '(?s)<a href=\"([^\"]*)\">(.*?)</a>', 2), lambda x: " + UNESCAPED.format("x") + r") AS names FROM pages WHERE html IS NOT NULL), "
    r"q AS (SELECT *, coalesce(list_sum(list_transform(list_concat(blocks, names), lambda x: length(" + TRIMMED.format("x") + r"))), 0) AS size, "
    r"list_filter(list_concat(list_transform(blocks, lambda x: " + TRIMMED.format(SPACED.format("x")) + r"), [array_to_string(list_transform(hrefs, lambda h, i: '[' || " + TRIMMED.format(SPACED.format("names[i]")) + r" || '](' || h || ')'), '')]), lambda x: x <> '') AS parts FROM p) "
    r"SELECT page_id, CASE WHEN size >= 200 THEN CASE WHEN title <> '' THEN '# ' || title || chr(10) || chr(10) ELSE '' END || 'Source: ' || coalesce(url, '') || chr(10) || chr(10) || " + CLEAN.format("(array_to_string(parts, chr(10) || chr(10)) || chr(10))") + r" ELSE '' END AS content FROM q"
)


@query(MAIN_SQL)
def html_main_content(spark: SparkSession, d: str) -> DataFrame:
    """Markdown of each raw page."""
    import pandas as pd

    main = F.pandas_udf(lambda h, u: pd.Series([html.page_to_markdown(x, y) for x, y in zip(h, u)]), "string")
    return t(spark, d, "pages").where("html IS NOT NULL").select("page_id", main("html", F.coalesce("url", F.lit(""))).alias("content"))


NETLOC = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
LINKED_SQL = (
    f"u AS (SELECT page_id, content, fetched_at, {NORM.format(BARE)} AS url FROM pages WHERE url IS NOT NULL), "
    f"own AS (SELECT DISTINCT url, {NETLOC.format('url')} AS site FROM u WHERE regexp_matches(url, '^https?://') AND {NETLOC.format('url')} = lower({NETLOC.format('url')}) AND NOT regexp_matches(lower(url), '\\.[a-z0-9]+$')), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY url) AS r FROM own)"
)


def linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, seeds and links: the pages of a site by URL as a tree, in which page k links to pages 2k and 2k + 1."""
    pages = t(spark, d, "pages").where("url IS NOT NULL")
    url = U.normalize_url(F.col("url"))
    host = U.url_part(F.col("url"), "netloc")
    own = pages.select(url.alias("url")).distinct().where(F.col("url").rlike("^https?://") & (host == F.lower(host)) & ~F.lower("url").rlike(r"\.[a-z0-9]+$")).withColumn("site", host)
    ranked = materialize(own.withColumn("r", F.row_number().over(Window.partitionBy("site").orderBy("url"))), "tree")
    up = ranked.select("site", F.col("r").alias("up"), F.col("url").alias("src_url"))
    links = ranked.where("r > 1").withColumn("up", F.floor(F.col("r") / 2).cast("int")).join(up, ["site", "up"]).select("src_url", F.concat("url", F.lit("#part")).alias("link"), (F.col("r") % 2).alias("pos"))
    back = ranked.where("r > 1").select(F.col("url").alias("src_url"), F.lit("/").alias("link"), F.lit(9).alias("pos"))  # leads out of the tree
    return pages, ranked.where("r = 1").select(F.col("url").alias("seed")), links.unionByName(back)


@query(f"""WITH {LINKED_SQL}, seeds AS (SELECT site, url AS seed FROM r WHERE r = 1), last AS (SELECT url, arg_max({{'c': content}}, row(coalesce(fetched_at, TIMESTAMP '0001-01-01'), page_id)).c AS content FROM u GROUP BY url),
t AS (SELECT seed, r.url, r, floor(log2(r))::INTEGER AS depth FROM r JOIN seeds USING (site) JOIN last ON last.url = r.url WHERE r < 16 AND regexp_matches(content, '\\S'))
SELECT seed, url, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY r) AS k FROM t) WHERE k <= 9""")
def bfs_crawl(spark: SparkSession, d: str) -> DataFrame:
    """A crawl of each site from its first page, three levels deep, of at most nine pages with content."""
    pages, seeds, links = linked(spark, d)
    return crawl.crawl(crawl.TablePages(pages), links, seeds, stay=False, max_depth=3, max_pages=9).select("seed", "url", "depth")


@query(rf"""SELECT page_id FROM pages WHERE url IS NOT NULL AND NOT (length(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) % 2 = 0 AND regexp_matches(url, '^[^:]*://[^/?#]*/docs/'))""")
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    """The pages that a crawl may fetch, where hosts whose address has an even length keep /docs/ to themselves."""
    pages = t(spark, d, "pages").where("url IS NOT NULL").select("page_id", "url")
    host = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1).alias("host")
    rules = pages.select(host).distinct().where(F.length("host") % 2 == 0).withColumn("rules", F.lit("User-agent: *\nDisallow: /docs/\n"))
    return crawl.robots_filter(pages, rules).select("page_id")


PLAIN_URL = "'^https?://[^/?#]+/[^/?#]+/[^?#]*$'"


@query(rf"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/]+/(?:[^/]*/)*)', 1) AS dir, regexp_extract(url, '^(https?://[^/]+)', 1) AS host FROM pages WHERE regexp_matches(url, {PLAIN_URL}))
SELECT page_id, host || '/top/x' AS a, dir || 'next' AS b, regexp_replace(dir, '[^/]+/$', '') || 'up' AS c, 'https://other.test/y?z=1' AS d, url || '?page=2' AS e FROM p""")
def url_join(spark: SparkSession, d: str) -> DataFrame:
    """Links of five kinds, joined to the pages' URLs."""
    p = t(spark, d, "pages").where(F.col("url").rlike(PLAIN_URL.strip("'")))
    links = {"a": "/top/x", "b": "next", "c": "../up", "d": "https://other.test/y?z=1", "e": "?page=2"}
    return p.select("page_id", *[crawl.join_url("url", F.lit(x)).alias(k) for k, x in links.items()])


def answer(url: str) -> tuple[int, str, bytes]:
    """A network of its own: a repository of 800 files, two registries, a sitemap below the first folder, and pages."""
    import json
    import re

    if url.startswith("https://api.github.com/repos/o/r/git/trees/v2"):
        return 200, "application/json", json.dumps({"tree": [{"type": "blob", "path": f"{('docs/a', 'docs/b', 'docs/c', 'other/d')[k % 4]}{k}{('.md', '.RST', '.py', '.md')[k % 4]}"} for k in range(800)] + [{"type": "tree", "path": "docs"}]}).encode()
    if url.startswith("https://raw.githubusercontent.com/"):
        return 200, "text/plain", b" " if url.endswith("docs/a8.md") else f"text of\r\n{url}".encode()
    if url.startswith("https://registry.npmjs.org/"):
        return 200, "application/json", json.dumps({"readme": f"npm {url[27:]}"}).encode()
    if url.startswith("https://pypi.org/"):
        return 200, "application/json", json.dumps({"info": {"description": f"pypi {url[17:]}"}}).encode()
    if url == "https://site.test/docs/sitemap.xml":
        return 200, "application/xml", "".join(f"<loc> https://site.test/{('docs', 'blog')[k % 2]}/{k // 4} </loc>" for k in range(40)).encode()
    if m := re.fullmatch(r"https://site\.test/p(\d+)", url):
        k = int(m[1])
        return (404, "text/html", b"") if k % 5 == 0 else (200, "text/plain" if k % 5 == 1 else "text/html; charset=utf-8", f"<title> T{k} </title><nav>menu</nav><main><p>{'Some words of content. ' * 12}</p></main>".encode())
    return 404, "", b""


@query(r"""WITH f AS (SELECT i, CASE i % 4 WHEN 0 THEN 'docs/a' || i || '.md' WHEN 1 THEN 'docs/b' || i || '.RST' ELSE 'other/d' || i || '.md' END AS path FROM range(800) t(i) WHERE i % 4 <> 2 ORDER BY i LIMIT 300),
g AS (SELECT 'github' AS kind, 'https://raw.githubusercontent.com/o/r/v2/' || path AS url FROM f WHERE i <> 8)
SELECT kind, url, 'text of' || chr(10) || url AS content FROM g
UNION ALL VALUES ('npm', 'https://www.npmjs.com/package/axios', 'npm axios/1.6'), ('npm', 'https://www.npmjs.com/package/left', 'npm left/latest'), ('pypi', 'https://pypi.org/project/x/', 'pypi pypi/x/json'), ('pypi', 'https://pypi.org/project/y/', 'pypi pypi/y/1.0/json')
UNION ALL SELECT DISTINCT 'web', 'https://site.test/docs/' || (i // 4), '' FROM range(40) t(i) WHERE i % 2 = 0""")
def remote_sources(spark: SparkSession, d: str) -> DataFrame:
    """What URIs of four schemes name, from ``answer``: at most 300 documents of a repository, registry pages, a sitemap's URLs."""
    uris = ["github://o/r@v2", "npm://axios@1.6", "npm://left", "pypi://x", "pypi://y@1.0", "https://site.test/docs/"]
    out = spark.createDataFrame([], "kind string, url string, content string")
    for uri in uris:
        kind = remote.scheme_of(uri)
        if kind == "github":
            found = remote.github_files(spark, uri, answer)
        elif kind in ("npm", "pypi"):
            found = remote.registry_page(spark, uri, answer)
        else:
            found = remote.sitemap_seeds(spark, uri, answer).withColumn("content", F.lit(""))
        out = out.unionByName(found.select(F.lit(kind).alias("kind"), "url", "content"))
    return out


@query("SELECT doc_id, 'https://site.test/p' || doc_id AS url, '# T' || doc_id || chr(10) || chr(10) || 'Source: https://site.test/p' || doc_id || chr(10) || chr(10) || rtrim(repeat('Some words of content. ', 12)) || chr(10) AS content FROM documents WHERE doc_id % 5 > 1")
def fetched_pages(spark: SparkSession, d: str) -> DataFrame:
    """One page for each document, fetched in the tasks from ``answer``; what is missing or no HTML is left out."""
    asked_for = t(spark, d, "documents").select("doc_id", F.concat(F.lit("https://site.test/p"), F.col("doc_id").cast("string")).alias("url"))
    return asked_for.join(remote.FetchedPages(answer).fetch(asked_for), "url").select("doc_id", "url", "content")


# --- changes ------------------------------------------------------------------------------------------------

WATCHED = f"ts IS NOT NULL AND kind IN ('modified', 'created', 'deleted', 'moved') AND {SUFFIX.format('path')} IN {SUPPORTED_SQL}"


@query(f"SELECT event_id, path, kind FROM change_events WHERE {WATCHED}")
def watched_events(spark: SparkSession, d: str) -> DataFrame:
    return watched(t(spark, d, "change_events")).select("event_id", "path", "kind")


@query(f"""WITH e AS (SELECT ts, path, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= INTERVAL 2 SECOND THEN 0 ELSE 1 END AS new FROM change_events WHERE {WATCHED}),
s AS (SELECT *, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT min(ts) AS start, max(ts) AS last, count(*) AS n_events, count(DISTINCT path)::INTEGER AS n_paths FROM s GROUP BY s""")
def debounce(spark: SparkSession, d: str) -> DataFrame:
    return bursts(t(spark, d, "change_events"))


@query(SQL["debounce"])
def debounce_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same bursts from a stream over the files of the table, run until all are read."""
    out, source = f"{shared_dir(spark)}/textloom-stream-{uuid.uuid4().hex}", t(spark, d, "change_events")
    source.write.parquet(f"{out}/events")
    stream = bursts(spark.readStream.schema(source.schema).parquet(f"{out}/events"))
    # all sessions, open ones too, are written with each batch; the last batch has them all
    q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{out}/bursts")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/bursts")
