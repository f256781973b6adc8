"""Small cases and brute force for each operator of the subpackage."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import blocks as B
from textloom.llm.encode import TOKENIZERS, RecursiveBpe, encode_corpus
from textloom.llm.langid import codewords, label_languages, plain_lines
from textloom.llm.leakage import LeakIndex, leaks
from textloom.llm.neardup import divide_skip, needed, similar_groups, similar_pairs
from textloom.llm.repeated_lines import common_prefixes, repeated_lines, remove_repeated_lines, suffix_array
from textloom.llm.residue import dice, known_residue, masked, residue_of, signatures, word_ids
from textloom.llm.shingles import Shingler
from textloom.llm.truncation import tail, truncated

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"


# --- 4 ---


def sets_of(text, k=3):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near_texts(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 40))] for _ in range(12)]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return [*out, None, "", "   ", "two words", out[0].upper(), out[0] + "!!", "x " * 3000, "x " * 2000]


@pytest.mark.parametrize("hot", [20_000, 4])
def test_pairs_equal_brute_force(spark, hot):
    texts = near_texts(3)
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "section_id bigint, text string, set_id string")
    sets = [sets_of(t) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    got = [tuple(r) for r in similar_pairs(df, hot=hot, sketch_bits=14, group=7, class_rows=hot // 2, part_entries=200).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_groups_count_links(spark):
    texts = near_texts(5, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "section_id bigint, text string")
    pairs = [tuple(r) for r in similar_pairs(df, sketch_bits=14).collect()]
    links = Counter(x for p in pairs for x in p)
    parent = {k: k for k, t in enumerate(texts) if sets_of(t)}
    for _ in range(len(texts)):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.section_id: (r.group_id, r.n_links) for r in similar_groups(df, sketch_bits=14).collect()}
    assert got == {k: (v, links[k]) for k, v in parent.items()}
    assert similar_pairs(df.limit(0)).count() == 0


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(1)
    for _ in range(60):
        query = np.unique(rng.integers(0, 80, 40).astype(np.uint64))
        sets = [np.unique(np.r_[query[rng.random(len(query)) < 0.9], rng.integers(0, 80, 6).astype(np.uint64)]) for _ in range(rng.integers(1, 9))]
        want = [(d, len(np.intersect1d(query, s))) for d, s in enumerate(sets) if len(np.intersect1d(query, s)) >= needed(len(query), len(s), 0.7)]
        assert divide_skip(query, sets, 0.7) == want


def test_shingles_of_odd_texts():
    doc, s = Shingler(3).shingles(pa.array(["", None, "a b", "A-b c", "a b c a b c", "İ x_y 1²"]))
    assert Counter(doc.tolist()) == {3: 1, 4: 3, 5: 2} or Counter(doc.tolist())[3] == 1
    assert len(s) == len(doc)


# --- 5 ---


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 60):
        s = rng.integers(0, 3, n)
        order, _, rounds = suffix_array(s)
        assert order.tolist() == sorted(range(n), key=lambda k: s[k:].tolist())
        lcp = common_prefixes(order, rounds)
        for i in range(1, n):
            a, b = s[order[i - 1] :].tolist(), s[order[i] :].tolist()
            assert lcp[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def pages_of(rows):
    return [(k, u, c) for k, (u, c) in enumerate(rows)]


@pytest.mark.parametrize("block_urls", [2000, 3])
def test_repeated_lines(spark, block_urls):
    rows = [(f"https://A.b/{k % 12}{'#f' if k % 2 else '/'}", f"Legal * Notice {k}\n# Heading\nown {chr(97 + k % 20)}{chr(97 + k // 20)}\n```\nLegal notice\n```\n\n123\r\nsometimes" + ("\nhalf" if k % 12 < 7 else "")) for k in range(24)]
    rows += [("https://c.d/1", "Legal Notice"), (None, "Legal Notice"), ("https://a.b/x", None), ("https://a.b/y", "  \n")]
    df = spark.createDataFrame(pages_of(rows), "page_id bigint, url string, content string").withColumnRenamed("page_id", "page_id")
    got = {(r.page_id, r.line_no) for r in repeated_lines(df, block_urls=block_urls).collect()}
    assert got == {(k, n) for k in range(24) for n in (0, 8)}
    clean = {r.page_id: (r.content, r.n_removed) for r in remove_repeated_lines(df, block_urls=block_urls).collect()}
    assert clean[0] == ("# Heading\nown aa\n```\nLegal notice\n```\n\n123\r\nhalf", 2) and clean[26] == (None, 0) and clean[24] == ("Legal Notice", 0)
    assert repeated_lines(df.limit(0)).count() == 0


# --- 6 ---


def test_encoding_is_that_of_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCABULARY)
    tok.encode_special_tokens = True
    texts = ["", None, " ", "Hello world", "aaaaaaa aaaa\n\n\n  x", "<|endoftext|> café naïve 日本語 🙂🙂", "x" * 5000, "1234567890" * 30, "\t\tif x:\r\n", "don't we'll I'M"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts * 2)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    want = tok.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(got[k] == want[k % len(texts)].ids for k in got) and len(got) == 20
    assert all(tok.decode(got[k], skip_special_tokens=False) == texts[k] for k in range(3, len(texts)))
    assert encode_corpus(df.limit(0)).count() == 0
    assert {tuple(r.ids) for r in encode_corpus(df, max_recursive_bytes=0).where("doc_id < 10").collect()} == {tuple(got[k]) for k in range(10)}


def test_contraction_of_runs():
    bpe = RecursiveBpe(VOCABULARY)
    rng = random.Random(2)
    words = ["".join(rng.choice("ab =") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    bpe.learn(list(dict.fromkeys(words)))
    assert all(bpe.known[w] == bpe.heap(w.encode()) for w in words)


# --- 7 ---


def test_leaks(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    other = "zero " + item
    twelve = "one, TWO\n| three | four-five_six;  seven eight nine ten eleven\ttwelve"
    docs = [(1, f"Before {twelve} after"), (2, item.rsplit(" ", 3)[0]), (3, None), (4, ""), (5, f"{twelve} x {twelve}"), (5, f"{twelve} x {twelve}"), (6, item.replace("six", "6"))]
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame([(10, item), (11, other), (12, None), (13, "short item")], "item_id bigint, text string")
    got = Counter((r.doc_id, r.item_id) for r in leaks(d, b).collect())
    assert got == {(1, 10): 1, (1, 11): 1, (5, 10): 4, (5, 11): 4}
    spans = {d[1][r.start : r.end] for d in docs[:1] for r in leaks(spark.createDataFrame(docs[:1], "doc_id bigint, text string"), b).collect()}
    assert spans == {twelve}
    assert leaks(d, b.limit(0)).count() == 0 == leaks(d.limit(0), b).count()
    with pytest.raises(ValueError):
        leaks(d, b, max_item_words=3)


def test_spans_are_maximal():
    words = [f"w{k}" for k in range(30)]
    index = LeakIndex([(1, " ".join(words))], 5)
    text = " ".join(["x", *words[3:20], "x", *words[:4], *words[9:15]])
    assert [text[a:b].split()[0::100] for _, a, b in index.spans(text)] == [["w3"], ["w9"]]
    assert [len(text[a:b].split()) for _, a, b in index.spans(text)] == [17, 6]


def test_many_distinct_words():
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(["x", *words[3:20], "x", *words[:4], *words[9:15]]), " ".join(reversed(words)), " ".join(words)]
    one, two = (LeakIndex([(1, " ".join(words)), (2, " ".join(words[5:]))], 5, base=n) for n in (1000, 8))
    assert (one.width, two.width) == (1, 2) and [one.spans(t) for t in texts] == [two.spans(t) for t in texts]
    many = LeakIndex([(k, " ".join(f"v{k * 12 + j}" for j in range(12))) for k in range(100_000)])
    assert many.width == 3 and [x for x, _, _ in many.spans("a " + " ".join(f"v{k}" for k in range(24)) + " b")] == [0, 1]


def test_short_items_are_not_covered(spark):
    from textloom.llm.leakage import coverage

    b = spark.createDataFrame([(10, "one " * 12), (13, "short item"), (14, None)], "item_id bigint, text string")
    assert {r.item_id: (r.n_words, r.covered) for r in coverage(b).collect()} == {10: (12, True), 13: (2, False), 14: (0, False)}


# --- 8 ---


@pytest.mark.parametrize(
    ("text", "kind"),
    [("A full sentence.", "closed"), ("It stops in the mid", "prose"), ("```\ncode", "fence"), ("```\ncode\n```", "closed"), ("| a | b |", "closed"), ("| a | b", "row"), ("- the item (x_y)", "closed"), ("- the it", "item"), ("## Head", "heading"), ("#tag #other", "tags"), ("See [x](https://y/z)", "closed"), ('He said "yes."', "closed"), ("It stops [...]", "prose"), ("Done. …", "closed"), ("(123).", "closed")],
)
def test_tails(text, kind):
    assert tail(text)[0] == kind


def test_truncated(spark):
    whole = [f"The quick brown fox jumps over the lazy dog number {k} {'again ' * k}until evening comes." for k in range(40)]
    cut = [w[:60] for w in whole[:20]]
    rows = [(k, t, "s", "x") for k, t in enumerate(whole + cut + [None, " ", "The quick br", "works now, thanks", "a text that ends �"])] + [(99, "Total of all: all is well.\n- the lis", None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, cut string")
    got = {r.doc_id: r for r in truncated(df).collect()}
    assert {k for k, r in got.items() if r.cut} == set(range(40, 60)) | {62, 64} and 60 not in got and 61 not in got
    assert "trie" in got[62].evidence and "length" in got[45].evidence and "length" not in got[62].evidence and not got[63].cut
    assert truncated(df.limit(0)).count() == 0


def test_trie_of_long_words_and_of_lines(spark):
    from textloom.llm.truncation import line_trie, vocabulary_trie

    long = "abcdefgh" + "x" * 60
    docs = spark.createDataFrame([(f"{long}end {long} abcdefgh abc",), ("All is well\nBest wishes, Ann\nAll is well today.\nAll is well.",), (None,)], "text string")
    ask = spark.createDataFrame([(x,) for x in ("abc", long, long + "e", "zz", "abcdefghi")], "p string")
    assert {r.p: (r.passes, r.ends) for r in vocabulary_trie(docs, "text", ask).collect()} == {"abc": (4, 1), long: (2, 1), long + "e": (1, 0)}
    ask = spark.createDataFrame([("All is well",), ("Best wishes",), ("Best wishes, N",)], "m string")
    assert {r.m: (r.passes, r.ends) for r in line_trie(docs, "text", ask).collect()} == {"All is well": (3, 1), "Best wishes": (1, 0), "Best wishes, N": (1, 1)}


# --- 3 ---


def test_codewords_are_apart():
    m = codewords(8, 15)
    assert min((m[a] != m[b]).sum() for a in range(8) for b in range(a)) >= 5


def test_plain_lines_skip_fences():
    assert plain_lines("a\n\n```\nb\n```\n c\n```\nopen") == [(0, "a"), (5, " c")] and plain_lines(None) == [] == plain_lines("")


SAMPLES = {
    "en": ["the house stands on the green hill and the people walk there", "we were reading these books when the rain began to fall", "nobody knows where they should have been with their things"],
    "de": ["das haus steht auf dem grünen hügel und die leute gehen dorthin", "wir lasen diese bücher als der regen zu fallen begann", "niemand weiß wo sie mit ihren sachen hätten sein sollen"],
    "fr": ["la maison se trouve sur la colline verte et les gens y marchent", "nous lisions ces livres quand la pluie a commencé à tomber", "personne ne sait où ils auraient dû être avec leurs affaires"],
}


def test_languages(spark):
    samples = spark.createDataFrame([(x, t) for x, ts in SAMPLES.items() for t in ts], "lang string, text string")
    en, de, fr = (ts[0] for ts in SAMPLES.values())
    rows = [(1, en, "en"), (2, de, "en"), (3, f"{en}\n{fr}\n{en}", "EN-us"), (4, en, None), (5, f"{de}\n```\n{en}\n```", "de_DE"), (6, None, "en"), (7, " ", ""), (8, en, " und "), (8, en, " und ")]
    df = spark.createDataFrame([(a, b, c, 0) for a, b, c in rows], "section_id bigint, text string, lang string, confidence int")
    got = {r.section_id: r for r in label_languages(df, samples).collect()}
    assert {k: (r.label, r.lang, r.n_langs) for k, r in got.items()} == {1: ("en", "en", 1), 2: ("en", "de", 1), 3: ("en", "en", 2), 4: (None, "en", 1), 5: ("de", "de", 1), 6: ("en", None, 0), 7: (None, None, 0), 8: (None, "en", 1)}
    assert [x.lang for x in got[3].lines] == ["en", "fr", "en"] and all(0 < x.confidence <= 1 for x in got[3].lines)
    assert label_languages(df.limit(0), samples).count() == 0


# --- 1 and 2 ---


def site(k, body):
    return f"# Title {k}\n\nSource: https://s{k % 3}.x/{k}\n\nHome | Blog | About us\n\n{body}\n\nWas this page helpful? Yes No\nCopyright 2024 Example Works. All rights reserved."


def bodies(k):
    return f"The service number {k} reads the list of files before it writes the table. Another sentence about topic {chr(97 + k % 26)} follows here.\n\n## Part\n\nOne more paragraph of the article explains the {'very ' * k}long option in detail."


def test_gradient_of_the_labeller():
    pages = [B.split_page(site(k, bodies(k))) for k in range(3)]
    feats = B.Features()(pages)
    labels = np.array([x for p in pages for x in (np.array(B.weak_labels(p.lines, set()))[p.at]).tolist()])
    model, weight = B.Labeller(), np.ones(3, np.float32)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}

    def loss():
        p = model.probabilities(feats)
        known = labels >= 0
        return -np.log(np.maximum(p[known, labels[known]].astype(np.float64), 1e-12)).sum() / known.sum()

    grad = model.gradient(feats, labels, weight)
    rng = np.random.default_rng(0)
    for name in ("xf", "hr", "out", "br", "hf"):
        at = tuple(rng.integers(0, n) for n in model.w[name].shape)
        keep = model.w[name][at]
        model.w[name][at] = keep + 1e-2
        up = loss()
        model.w[name][at] = keep - 1e-2
        down = loss()
        model.w[name][at] = keep
        assert abs((up - down) / 2e-2 - grad[name][at]) < 2e-3


def test_frame_and_residue(spark):
    from textloom.llm.boilerplate import frame_lines, label_pages
    from textloom.llm.residue import residue_pages

    rows = [(k, f"https://s{k % 3}.x/{k}", site(k, bodies(k))) for k in range(60)]
    bad = {100: "{{ page.title }}\nWelcome to {{ author }}, the best way to {{ summary }}.", 101: "404 Not Found\nThe page you asked for could not be found.", 102: "Please enable JavaScript to run this app."}
    rows += [(k + 10 * j, f"https://s{k % 3}.x/{k}-{j}", site(k, t)) for k, t in bad.items() for j in range(4)]
    rows += [(200, "https://s0.x/n", None), (201, None, " \n"), (202, None, site(5, bodies(5)))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, content string, frame string")
    cases = {r.page_id for r in residue_pages(df).collect()}
    assert cases == {k + 10 * j for k in bad for j in range(4)}
    lines: dict = {}
    for r in frame_lines(df).collect():
        lines.setdefault(r.page_id, set()).add(r.line_no)
    want = {k: {i for i, x in enumerate(c.split("\n")) if x.startswith(("Home |", "Was this", "Copyright"))} for k, _, c in rows if c and c.strip() and k not in cases}
    assert sum(lines.get(k) == w for k, w in want.items()) >= 0.95 * len(want) and not set(lines) & cases
    assert label_pages(df.limit(0)).count() == 0 and residue_of(label_pages(df.limit(0))).count() == 0


def test_templates_meet():
    a, b, c, none = masked(pa.array(["The Kelvo server could not be processed (code 404).\n* [x]", "The Brimar server could not be processed (code 17).\n* [x]", "the Brimar Kelvo, Brimar server", None])).to_pylist()
    assert a == b and c == "the namemark namemark brimar server" and none is None
    assert known_residue("TBD\nxxx xxx") and not known_residue("A real sentence here.\nTBD")
    x, y, z = "page not found it may have been moved or deleted try the search", "page not found it may have been moved or deleted try a search", "an entirely different sentence of many other words that has nothing"
    p, q, r, none = signatures(*word_ids([x, y, z, ""]), 4).tolist()
    assert (p ^ q).bit_count() < (p ^ r).bit_count() and dice(x, y) > 0.8 > dice(x, z) and none == 0
