"""Words, masks, tags and signatures by bytes equal those by regular expressions and by single bits."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textloom.llm import blocks as B
from textloom.llm import lines as L
from textloom.llm import residue as R

PARTS = "aB|Alpha|Beta,|x |{{a}}|{|}|@@x@@|12|3-4|%abc%|Gamma Delta|namemark|[your name]|\n|__x__|#|A,Bcde|<p goes here>|ß|Éclair|–|Ꟛ|  |\x01|00|\t|c.|* |Дом Волга|²".split("|")


def odd(seed, n=4000):
    rng = random.Random(seed)
    return pa.array([rng.choice(["", " "]).join(rng.choice(PARTS) for _ in range(rng.randrange(10))) for _ in range(n)] + ["", " ", "0"], pa.string())


def test_ascii_meets_no_regular_expression(monkeypatch):
    a = odd(1)
    a = a.filter(pc.and_(pc.string_is_ascii(a), pc.invert(pc.match_substring_regex(a, r"[{}<>%@\[\]$#]|__"))))
    words, masks = L.plain_of_any(a), R.masked_any(a)

    def never(*_, **__):
        raise AssertionError("a regular expression over ASCII")

    monkeypatch.setattr(pc, "replace_substring_regex", never)
    assert len(a) > 50 and L.plain(a).equals(words) and R.masked(a).equals(masks)


def test_bytes_equal_regular_expressions():
    every = pa.array([f"aB {chr(c)}Abcde x{chr(c)}Bcdef" for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000])
    for a in (odd(2), odd(3).slice(7, 900), every, odd(4).slice(0, 0)):
        assert L.plain(a).equals(L.plain_of_any(a))
        assert R.masked(a).equals(R.masked_any(a))
        assert (B.line_tags(a) == np.array([pc.match_substring_regex(a, r).to_numpy(zero_copy_only=False) for r in B.TAGS]).T).all()
    assert R.masked(pa.array([None, "x Alpha"])).to_pylist() == [None, "x namemark"]


def test_signatures_take_few_bytes_a_word():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in (1, 2, 254, 255, 256, 511, 1000, 60_000)] + [""]
    doc, ids = R.word_ids(texts)
    tracemalloc.start()
    got = R.signatures(doc, ids, len(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    bits = (R.mix(ids)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    want = [sum(1 << k for k in range(64) if 2 * bits[doc == d, k].sum() > (doc == d).sum()) for d in range(len(texts))]
    assert got.tolist() == want
    assert peak < 64 * len(ids)
