"""Maximal repeated blocks against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from textloom.llm.repeated_lines import maximal_blocks, repeated_blocks


def brute(pages):
    """length -> sorted numbers of URLs of the maximal repeats of two or more lines; pages are (url, runs)."""
    seen = defaultdict(list)
    for u, runs in pages:
        for r in runs:
            for a in range(len(r)):
                for b in range(a + 2, len(r) + 1):
                    seen[tuple(r[a:b])].append((u, r[a - 1] if a else object(), r[b] if b < len(r) else object()))
    out = defaultdict(list)
    for block, at in seen.items():
        if len(at) > 1 and len({x[1] for x in at}) > 1 and len({x[2] for x in at}) > 1:
            out[len(block)].append(len({x[0] for x in at}))
    return {k: sorted(v) for k, v in out.items()}


def test_maximal_blocks_equal_brute_force():
    rng = random.Random(1)
    for _ in range(80):
        pages = [(u, [[rng.randrange(3) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 3))]) for u in range(rng.randint(1, 7))]
        flat = [(u, np.array(r)) for u, rs in pages for r in rs]
        got = maximal_blocks([r for _, r in flat], np.array([u for u, _ in flat]), np.ones(len(pages), dtype=np.int64))
        assert {k: sorted(g["urls"].tolist()) for k, g in got.groupby("length")} == brute(pages)
        assert not got.duplicated(["key", "length"]).any()


@pytest.mark.parametrize("block_urls", [2000, 4])
def test_blocks_have_their_own_lengths(spark, block_urls):
    word = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    menu, foot, side = [f"menu {word(k)}" for k in range(40)], [f"foot {word(k)}" for k in range(5)], [f"side {word(k)}" for k in range(3)]
    rows = [(k, f"https://a.b/{k}", "\n".join([*menu, f"own {word(k)}", *foot, "# Heading", *side, f"end {word(k)}"])) for k in range(20)]
    rows.append((20, "https://A.b/3#again", rows[3][2]))
    df = spark.createDataFrame(rows, "page_id bigint, url string, content string")
    got = sorted((r.length, r.n_urls, r.n_site_urls) for r in repeated_blocks(df, block_urls=block_urls).collect() if r.length > 1)
    assert got == [(3, 20, 20), (5, 20, 20), (40, 20, 20)]
    assert repeated_blocks(df.limit(0)).count() == 0
