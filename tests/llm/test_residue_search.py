"""The search for alike residue templates against brute force."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.llm.residue import dice, masked, residue_of, templates

LABELLED = "page_id bigint, tmpl bigint, n int, text string, sure boolean"


def edited(seed):
    """Texts of 3 to 45 words, each with copies in which words are changed, left out or added, and copies of those."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("an", "el", "ir", "ot", "um")]
    out = []
    for n in (3, 5, 6, 10, 15, 20, 30, 45):
        for _ in range(6):
            t = [rng.choice(words) for _ in range(n)]
            out.append(" ".join(t))
            for _ in range(5):
                t = list(t)
                for _ in range(max(1, n // 9)):
                    k = rng.randrange(len(t))
                    t[k : k + 1] = rng.choice([[rng.choice(words)], [rng.choice(words)], [t[k], rng.choice(words)], []]) or ([] if len(t) > 2 else t[k : k + 1])
                out.append(" ".join(t))
    return out


def test_every_alike_template_is_reached(spark):
    texts = edited(4)
    sure = {k for k in range(0, len(texts), 6)}
    df = spark.createDataFrame(list(zip(range(len(texts)), *templates(texts, [0.9 if k in sure else 0.3 for k in range(len(texts))]))), LABELLED)
    form = masked(pa.array(texts)).to_pylist()
    want, new = set(sure), set(sure)
    while new:
        new = {k for k in range(len(texts)) if k not in want and any(dice(form[k], form[x]) >= 0.8 for x in new)}
        want |= new
    assert len(sure) + 100 < len(want) < len(texts)
    assert {r.page_id for r in residue_of(df).collect()} == want


def test_long_texts_that_look_like_articles_are_reached(spark):
    from textloom.llm.boilerplate import label_pages

    def page(k, body):
        return f"# Title {k}\n\nSource: https://s{k % 3}.x/{k}\n\nHome | Blog | About us\n\n{body}\n\nCopyright 2024 Example Works. All rights reserved."

    rows = [(k, f"https://s{k % 3}.x/{k}", page(k, f"The service number {k} reads the list of files before it writes the table. Another sentence about topic {chr(97 + k % 26)} follows here.\n\nOne more paragraph of the article explains the {'very ' * k}long option in detail.")) for k in range(60)]
    labelled = label_pages(spark.createDataFrame(rows, "page_id bigint, url string, content string")).select("page_id", "n_article", "tmpl", "n", "text", F.lit(False).alias("sure"))
    long = {r.page_id: r.text for r in labelled.where("n_article > 60 AND text IS NOT NULL").collect()}
    assert len(long) > 10
    first = min(long)
    trusted = labelled.where(F.col("page_id") == first).select(F.lit(999).cast("bigint").alias("page_id"), "tmpl", "n", "text", F.lit(True).alias("sure"))
    want = {k for k, t in long.items() if dice(t, long[first]) >= 0.8}
    assert len(want) > 5
    cases = residue_of(labelled.where("page_id <> %d" % first).drop("n_article").unionByName(trusted)).collect()
    assert want - {first} | {999} <= {r.page_id for r in cases}


def test_tables_find_long_copies(spark):
    """With the tables alone, copies of long texts with one change meet."""
    from textloom.llm.residue import candidates

    rng = random.Random(2)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("an", "el", "ir", "ot", "um")]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(20)]
    rows = lambda ts: spark.createDataFrame([(k, len(t), " ".join(t)) for k, t in enumerate(ts)], "tmpl bigint, n int, text string")
    got = {(r.a, r.b) for r in candidates(rows(base), rows([[*t[:150], "new", *t[151:]] for t in base]), 1.0).collect()}
    assert sum((k, k) in got for k in range(20)) >= 15
