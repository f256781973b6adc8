"""A recurrent block labeller: which lines of a page belong to its article, to the site's frame, or to residue.

A numpy bidirectional LSTM reads the lines of a page in order.  Each line is a vector of its tag path (the
markup that a crawler's text keeps: heading, list, link, bar, emphasis, fence, neighbouring blank lines,
place in the page) and the mean of the learned vectors of its hashed words, so every line is classified with
the whole page as context.

The labeller is trained here, on a bounded sample of whole sites.  No labels are given, so the sample is
labelled weakly: lines that come back on several URLs of a site (counted over all of its pages), known phrases of site frames and link lists
are frame; running sentences, headings and code are article; and where nothing of a page is left but
placeholders, filler, errors or demands for scripts, those lines are residue.  Unclear lines have no label.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from textloom.llm.lines import bytes_of, plain

ARTICLE, FRAME, RESIDUE, UNKNOWN = 0, 1, 2, -1
BUCKETS, EMB, HIDDEN, CLASSES = 1 << 13, 20, 20, 3
#: Words whose vectors are added up together.
CACHED = 1 << 12

#: General phrases of site frames, in lower case, digits as 0; seeds of the weak labels beside recurrence.
FRAME_SEEDS = (
    "skip to (?:main )?content|back to top|all rights reserved|^copyright|^©|cookie|privacy|subscribe|newsletter|share this|was this page helpful|reading time|last updated|posted by|written by|"
    "^table of contents$|^on this page$|^related articles$|^previous\\b|^← |"
    "zum inhalt|nach oben|alle rechte|lesezeit|datenschutz|geschrieben von|auf dieser seite|^zurück\\b|"
    "haut de page|tous droits|temps de lecture|rédigé par|partager|sur cette page|^précédent|"
    "перейти к содержанию|наверх|все права|время чтения|поделиться|на этой странице"
)
#: Residue of templates, filler, error pages and demands for scripts; seeds of the weak labels.
RESIDUE_SEEDS = (
    r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|@@[\w.]+@@|\[\[[\w.]+\]\]|%\([\w.]+\)s|%[a-z_.]{3,}%|[$#]\{[\w.]+\}|\[your [\w.]+\]|\[insert [\w.]+ here\]|<[\w.]+ goes here>|\b__[\w.]+?__|(?<![\w{])\{[\w.]+\}(?![\w}])|"
    r"lorem ipsum|placeholder|^tbd\W*$|^xxx\b|\basdf\b|^enter heading|text coming soon|sample text|add your description|here goes the|click here to edit|blindtext|texte provisoire|"
    r"not found|nicht gefunden|introuvable|не найдена|n'existe pas|gibt es nicht|^0\W*$|^0 (?:bad|service|internal|forbidden|gateway|not)|bad gateway|no valid answer|internal server|server error|temporarily unavailable|"
    r"could not be|cannot be (?:shown|displayed|found|processed)|was refused|not available|did not respond|has been removed|something went wrong|request id|slow down and retry|too many requests|out of order|do not have permission|ne répond pas|access denied|permission to (?:view|access)|session expired|log in again|account has been suspended|hosting desk|"
    r"planned maintenance|be right back|database connection|traceback \(most|fatal error|^warning: include|^\w+error:|^file \"/|interner fehler|später noch einmal|код ошибки|checking your browser|takes up to 0 seconds|link goes nowhere|moved or deleted|"
    r"javascript (?:is|in your|to run|aktivieren|pour afficher)|aktivieren sie javascript|включить javascript|^noscript|requires scripts|scripts are (?:switched|disabled|required|needed|off)|scripting has been|^loading\W*$|allow it for|switch it on|scripts are allowed|client code is|active content is|(?:script|code|browser)\w* .{0,20}(?:switched off|disabled|blocked)|go to the start page|(?:please )?(?:try again|come back) later|^oops\b|the (?:page|document|address|file|article)\b.{0,40}\b(?:found|shown|exist)"
)
LOREM = set("lorem ipsum dolor sit amet consectetur consec adipiscing elit sed do eiusmod tempor incididunt labore labor et dolore magna aliqua ut enim ad minim veniam quis nostrud nostra exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
FRAME_RE, RESIDUE_RE = re.compile(FRAME_SEEDS), re.compile(RESIDUE_SEEDS, re.I)
LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
WORD = re.compile(r"[^\W\d_]+")


def bare(line: str) -> str:
    """A line without markup, in lower case, with 0 for each number."""
    line = LINK.sub(r"\1", line).replace("*", " ").replace("`", " ")
    return re.sub(r"\d+", "0", re.sub(r"\s+", " ", line).strip().lower())


def letters(line: str) -> str:
    return "".join(WORD.findall(line.lower()))


def fences(lines: list[str]) -> list[bool]:
    out, inside = [], False
    for x in lines:
        if x.lstrip().startswith("```"):
            out.append(True)
            inside = not inside
        else:
            out.append(inside)
    return out


def fixed_article(line: str) -> bool:
    """Headings and the line ``Source:`` belong to the article whatever they say."""
    return line.startswith("#") or line.startswith("Source: ")


def weak_labels(lines: list[str], recurrent: set[str]) -> list[int]:
    """A label for each line of a page; ``recurrent`` has the letters of the site's recurring lines."""
    fenced, out = fences(lines), []
    for x, f in zip(lines, fenced):
        s = x.strip()
        if not s:
            out.append(UNKNOWN)
            continue
        if f or fixed_article(s):
            out.append(ARTICLE)
            continue
        b = bare(s)
        n = len(WORD.findall(b))
        closed = b.endswith((".", "!", "?"))
        links = LINK.findall(s)
        key = letters(s)
        lorem = n and sum(w in LOREM for w in WORD.findall(b)) >= 0.7 * n and n >= 3
        rest = re.sub(r"`[^`]*`", " ", s)
        residue = lorem or (n <= 40 and RESIDUE_RE.search(bare(rest)))
        if n <= 22 and FRAME_RE.search(b):
            out.append(FRAME)
        elif not closed and len(parts := re.split(r" [>»/] ", s)) > 2 and len(parts[0]) <= 24:
            out.append(FRAME)  # a breadcrumb, whatever the title at its end
        elif residue and not (closed and n >= 24 and not lorem):
            out.append(RESIDUE)
        elif key and key in recurrent:
            out.append(FRAME)
        elif closed and n >= 5 and not (links and len(LINK.sub("", s).strip()) < 8):
            out.append(ARTICLE)
        elif links and not closed and n <= 14:
            out.append(FRAME)
        elif not closed and re.search(r" [>»|·/] ", s):
            out.append(FRAME)
        elif not closed and 0 < n <= 8:
            out.append(FRAME)
        else:
            out.append(UNKNOWN)
    core = [k for k, v in enumerate(out) if v in (ARTICLE, RESIDUE) and not fenced[k] and not fixed_article(lines[k].strip())]
    has_article = any(out[k] == ARTICLE for k in core)
    if has_article:  # a sentence about such things in a real article
        out = [(ARTICLE if bare(lines[k]).endswith((".", "!", "?")) and len(WORD.findall(lines[k])) >= 8 else UNKNOWN) if v == RESIDUE else v for k, v in enumerate(out)]
    return out


#: Tag path of a line: regular expressions over the line as it stands.
TAGS = (
    r"^#+\s", r"^Source: ", r"^\s*\*\s", r"^\s*-\s", r"^\s\s", r"^\W*\[[^\]]*\]\([^)]*\)\W*$", r"\]\(", r" \| | · |   ", r" [>»/] ", r"[.!?][*\s\"”»)]*$", r"^\s*\*\*", r"^\s*\|", r"©|\(c\)", r"\d{4}[-/.]\d|\d[-/.]\d{4}",
    r"^\W*(←|Previous|Zur|Pr[ée]c|Назад)", r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$", r"`", r"\{\{|\}\}|<%|%>|@@|\[\[|\]\]|\{%|%\(|\$\{|%\w+%", r":\s*$|: \d", r"\.\s+\p{L}", r",", r"\d",
)
N_TAGS = len(TAGS) + 11
#: Bytes of which a line has one at least if the tag of that number matches; for ``EXACT`` only then.
NEEDS = {0: b"#", 2: b"*", 3: b"-", 5: b"[", 6: b"]", 8: ">/»".encode(), 10: b"*", 11: b"|", 12: "(©".encode(), 13: b"0123456789", 16: b"`", 17: b"{}<>%@[]$", 18: b":", 20: b",", 21: b"0123456789"}
EXACT = (16, 20, 21)


def line_tags(a: pa.Array) -> np.ndarray:
    """Which of ``TAGS`` match each line; only lines that have a needed byte meet the expression."""
    off, data = bytes_of(a)
    full, out = off[1:] > off[:-1], np.zeros((len(a), len(TAGS)), dtype=np.float32)
    needs = sorted(set(NEEDS.values()))
    has = {}
    for part in (needs[:8], needs[8:]):
        table = bytes(sum(1 << k for k, need in enumerate(part) if c in need) for c in range(256))
        seen = np.zeros(len(a), np.uint8)
        if full.any():
            seen[full] = np.bitwise_or.reduceat(np.frombuffer(data.translate(table), np.uint8), off[:-1][full])
        has |= {need: (seen >> k & 1).astype(bool) for k, need in enumerate(part)}
    for k, r in enumerate(TAGS):
        if k not in NEEDS:
            out[:, k] = pc.match_substring_regex(a, r).to_numpy(zero_copy_only=False)
        elif k in EXACT:
            out[:, k] = has[NEEDS[k]]
        elif (where := has[NEEDS[k]]).any():
            out[where, k] = pc.match_substring_regex(a.filter(pa.array(where)), r).to_numpy(zero_copy_only=False)
    return out


@dataclass
class Page:
    lines: list[str]
    at: np.ndarray  # line numbers of the non-blank lines
    share: np.ndarray  # of the site's URLs that have the line, for each of ``at``; 0 where the line does not recur
    fenced: np.ndarray  # whether the line is fenced code, for each of ``at``


def split_page(content: str, shares: np.ndarray | None = None, fenced: np.ndarray | None = None) -> Page:
    """A page with the shares and states of all its lines."""
    lines = content.split("\n")
    at = np.array([k for k, x in enumerate(lines) if x and not x.isspace()], dtype=np.int64)
    inside = np.array(fences(lines), dtype=bool) if fenced is None else fenced
    return Page(lines, at, np.zeros(len(at), np.float32) if shares is None else shares[at], inside[at])


class Features:
    """Tag paths and word buckets of the non-blank lines of pages; buckets of words are kept."""

    def __init__(self) -> None:
        self.bucket: dict[str, int] = {}

    def __call__(self, pages: list[Page]) -> tuple[np.ndarray, ...]:
        """``of`` the non-blank lines of pages."""
        enc = pc.dictionary_encode(pa.array([p.lines[k] for p in pages for k in p.at.tolist()], pa.string()))
        at, fenced, share = (np.concatenate([np.zeros(0, t), *(getattr(p, c) for p in pages)]) for c, t in (("at", np.int64), ("fenced", bool), ("share", np.float32)))
        size, total = np.array([len(p.at) for p in pages], dtype=np.int64), np.array([len(p.lines) for p in pages], dtype=np.int64)
        return self.of(enc.dictionary, plain(enc.dictionary), enc.indices.to_numpy(), at, fenced, share, size, total)

    def of(self, lines: pa.Array, words: pa.Array, line: np.ndarray, at: np.ndarray, fenced: np.ndarray, share: np.ndarray, size: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tags of each line, buckets of the words of the distinct lines, their numbers, the distinct line of each line, number of words of each line,
        number of lines of each page).

        ``lines`` and ``words`` (``lines.plain``) are distinct; each non-blank line has its place among them, its number in the page, whether it
        is fenced code and its share; each page has the number of its non-blank lines and of all lines.
        """
        # lines that differ at their ends only are looked at once
        enc = pc.dictionary_encode(pc.utf8_rtrim_whitespace(lines))
        a, own_line = enc.dictionary, enc.indices.to_numpy()
        first = np.zeros(len(a), dtype=np.int64)
        first[own_line[::-1]] = np.arange(len(own_line))[::-1]
        line = own_line[line]
        own = line_tags(a)
        tags = np.zeros((len(line), N_TAGS), dtype=np.float32)
        k = len(TAGS)
        tags[:, :k] = own[line]
        length = pc.utf8_length(a).to_numpy().astype(np.float32)[line]
        doc = np.repeat(np.arange(len(size)), size)
        total = np.repeat(np.maximum(total, 1), size)
        order = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        each = np.repeat(size, size)
        tags[:, k] = np.log1p(length) / 4
        tags[:, k + 1] = order / np.maximum(each, 1)
        tags[:, k + 2] = np.minimum(order, 10) / 10
        tags[:, k + 3] = np.minimum(each - order - 1, 10) / 10
        begin = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
        last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
        gap = np.r_[0, at[1:] - at[:-1]] if len(at) else at
        tags[:, k + 4] = begin | (gap > 1)
        tags[:, k + 5] = last | np.r_[gap[1:] > 1, True] if len(at) else 0
        tags[:, k + 6] = fenced
        tags[:, k + 7] = total < 12
        lists = pc.split_pattern(words.take(pa.array(first)), " ")
        enc = pc.dictionary_encode(lists.flatten())
        if len(self.bucket) > 1_000_000:
            self.bucket.clear()
        buckets = []
        for w in enc.dictionary.to_pylist():
            h = self.bucket.get(w)
            if h is None:
                h = self.bucket[w] = xxhash.xxh3_64_intdigest(w) % BUCKETS
            buckets.append(h)
        each = pc.list_value_length(lists).to_numpy().astype(np.int64)
        n = each[line]
        own_words = np.array(buckets, dtype=np.int64)[enc.indices.to_numpy()] if buckets else np.zeros(0, np.int64)
        tags[:, k + 8] = np.minimum(n, 12) / 12
        tags[:, k + 9] = np.minimum(n, 40) / 40
        tags[:, k + 10] = share
        return tags, own_words, each, line, n, size


def spread(words: np.ndarray, each: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The words of all lines, from those of the distinct lines."""
    n = each[line]
    return words[np.repeat((np.cumsum(each) - each)[line] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """The weights; ``wx``, ``wh`` and ``b`` hold the four gates of both directions."""

    seed: int = 11
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.w:
            return
        rng, d = np.random.default_rng(self.seed), EMB + N_TAGS
        self.w = {"emb": rng.normal(0, 0.3, (BUCKETS, EMB)), "out": rng.normal(0, 0.1, (2 * HIDDEN + d, CLASSES)), "bo": np.zeros(CLASSES)}
        for s in "fr":
            self.w |= {f"x{s}": rng.normal(0, 0.15, (d, 4 * HIDDEN)), f"h{s}": rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)), f"b{s}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def inputs(self, tags: np.ndarray, words: np.ndarray, n: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The vector of each line; words are those of the distinct lines, n their numbers."""
        mean = np.zeros((len(n), EMB), dtype=np.float32)
        full = n > 0
        first, own, a = (np.cumsum(n) - n)[full], np.zeros((int(full.sum()), EMB), np.float32), 0
        ends = first + n[full]
        while a < len(own):  # some lines at a time, so that their words' vectors stay in the cache
            b = max(a + 1, int(np.searchsorted(ends, first[a] + CACHED, side="right")))
            own[a:b] = np.add.reduceat(self.w["emb"].take(words[first[a] : ends[b - 1]], axis=0), first[a:b] - first[a], axis=0)
            a = b
        mean[full] = own / np.sqrt(n[full])[:, None]
        return np.concatenate([mean[line], tags], axis=1)

    def run(self, x: np.ndarray, side: str, keep: bool = False):  # noqa: ANN201
        """Hidden states of one direction over x (time, batch, features)."""
        t, b, d = x.shape
        pre = (x.reshape(-1, d) @ self.w["x" + side] + self.w["b" + side]).reshape(t, b, 4 * HIDDEN)
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        hs, gates, cells, wh = np.empty((t, b, HIDDEN), np.float32), [], [], self.w["h" + side]
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = pre[k] + h @ wh
            g = sigmoid(z[:, : 3 * HIDDEN])
            u = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            before, c = c, f * c + i * u
            tc = np.tanh(c)
            if keep:
                gates.append((k, i, f, o, u, tc, before, h))
            h = o * tc
            hs[k] = h
        return (hs, gates) if keep else hs

    def pad(self, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(time, batch, features) and the mask; short pages end in zeros."""
        t = int(size.max(initial=1)) or 1
        out = np.zeros((t, len(size), x.shape[1]), np.float32)
        at = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
        doc = np.repeat(np.arange(len(size)), size)
        out[at, doc] = x
        mask = np.zeros((t, len(size)), bool)
        mask[at, doc] = True
        return out, mask

    def backward_ready(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The same pages aligned at their ends, so that the reverse direction starts at the last line."""
        t = x.shape[0]
        out = np.zeros_like(x)
        for b, s in enumerate(size.tolist()):
            out[t - s :, b] = x[:s, b]
        return out

    def sweep(self, x: np.ndarray, first: np.ndarray, size: np.ndarray, side: str, steps: int) -> np.ndarray:
        """Hidden states (rows of x, HIDDEN) of one direction over pages given as spans of rows, ``steps`` lines at a
        time with the state carried over, so that the padded part does not grow with the longest page."""
        out = np.zeros((len(x), HIDDEN), np.float32)
        h, c = np.zeros((len(size), HIDDEN), np.float32), np.zeros((len(size), HIDDEN), np.float32)
        for a in range(0, int(size.max(initial=0)), steps):
            n = np.clip(size - a, 0, steps)  # lines of each page in this stretch, counted from its start or its end
            live = np.flatnonzero(n)
            k = n[live]
            t = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            at = np.repeat(first[live], k) + a + t if side == "f" else np.repeat(first[live] + size[live] - 1, k) - a - t
            doc = np.repeat(np.arange(len(live)), k)
            pre = np.zeros((int(k.max()), len(live), 4 * HIDDEN), np.float32)
            pre[t, doc] = x[at] @ self.w["x" + side] + self.w["b" + side]
            hs, h[live], c[live] = self.steps(pre, self.w["h" + side], h[live], c[live])
            out[at] = hs[t, doc]
        return out

    def steps(self, pre: np.ndarray, wh: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hs = np.empty((*pre.shape[:2], HIDDEN), np.float32)
        z = np.empty(pre.shape[1:], np.float32)
        g = np.empty((pre.shape[1], 3 * HIDDEN), np.float32)
        for k in range(len(pre)):
            np.matmul(h, wh, out=z)
            z += pre[k]
            np.clip(z[:, : 3 * HIDDEN], -30, 30, out=g)  # the sigmoid in place
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.divide(1, g, out=g)
            c = g[:, HIDDEN : 2 * HIDDEN] * c
            c += g[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
            h = np.multiply(g[:, 2 * HIDDEN :], np.tanh(c), out=hs[k])
        return hs, h, c

    def probabilities(self, feats: tuple, cells: int = 1 << 15, steps: int = 256) -> np.ndarray:
        """Class probabilities of each line.  Pages of like length run together, so many that their padded lines stay
        within ``cells``."""
        tags, words, each, line, _, size = feats
        x = self.inputs(tags, words, each, line)
        out = np.zeros((len(x), CLASSES), np.float32)
        first = np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        a = 0
        while a < len(order):
            width = np.minimum(size[order[a:]], steps) * np.arange(1, len(order) - a + 1)
            b = a + max(1, int(np.searchsorted(width, cells, side="right")))
            docs, a = order[a:b], b
            s = size[docs]
            rows = np.repeat(first[docs], s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            own, at = x[rows], np.cumsum(s) - s
            both = np.concatenate([self.sweep(own, at, s, "f", steps), self.sweep(own, at, s, "r", steps), own], axis=1)
            z = both @ self.w["out"] + self.w["bo"]
            e = np.exp(z - z.max(1, keepdims=True))
            out[rows] = e / e.sum(1, keepdims=True)
        return out

    def gradient(self, feats: tuple, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        tags, words, each, line, n, size = feats
        x = self.inputs(tags, words, each, line)
        words = spread(words, each, line)
        p, _ = self.pad(x, size)
        back = self.backward_ready(p, size)
        hf, gf = self.run(p, "f", True)
        hr, gr = self.run(back, "r", True)
        at, doc = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(len(size)), size)
        at_r = at + (p.shape[0] - size)[doc]
        both = np.concatenate([hf[at, doc], hr[at_r, doc], x], axis=1)
        z = both @ self.w["out"] + self.w["bo"]
        e = np.exp(z - z.max(1, keepdims=True))
        dz = e / e.sum(1, keepdims=True)
        known = labels >= 0
        dz[known, labels[known]] -= 1
        w = np.where(known, weight[labels], 0).astype(np.float32)
        dz *= (w / max(w.sum(), 1))[:, None]
        g = {"out": both.T @ dz, "bo": dz.sum(0)}
        db = dz @ self.w["out"].T
        dx = db[:, 2 * HIDDEN :].copy()
        for side, states, source, where, part in (("f", gf, p, at, db[:, :HIDDEN]), ("r", gr, back, at_r, db[:, HIDDEN : 2 * HIDDEN])):
            dh_out = np.zeros(p.shape[:2] + (HIDDEN,), np.float32)
            dh_out[where, doc] = part
            dpre = np.zeros(p.shape[:2] + (4 * HIDDEN,), np.float32)
            dh, dc = np.zeros((p.shape[1], HIDDEN), np.float32), np.zeros((p.shape[1], HIDDEN), np.float32)
            dwh = np.zeros_like(self.w["h" + side])
            for k, i, f, o, u, tc, c0, h0 in reversed(states):
                dh = dh + dh_out[k]
                dc = dc + dh * o * (1 - tc * tc)
                d = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                dpre[k] = d
                dwh += h0.T @ d
                dh, dc = d @ self.w["h" + side].T, dc * f
            flat = dpre.reshape(-1, 4 * HIDDEN)
            g |= {f"x{side}": source.reshape(-1, source.shape[2]).T @ flat, f"b{side}": flat.sum(0), f"h{side}": dwh}
            dx += (dpre[where, doc]) @ self.w["x" + side].T
        full = n > 0
        demb = np.zeros((BUCKETS, EMB), np.float32)
        per = np.repeat(dx[:, :EMB] / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0)
        if full.any():
            for k in range(EMB):
                demb[:, k] = np.bincount(words, weights=per[:, k], minlength=BUCKETS)
        g["emb"] = demb
        return g

    def train(self, pages: list[Page], labels: list[list[int]], epochs: int = 8, batch: int = 64, rate: float = 0.015, least_steps: int = 240) -> None:
        """Adam over the cross entropy of the labelled lines; classes are weighted against their frequency."""
        make, rng = Features(), np.random.default_rng(self.seed)
        keep = [k for k in range(len(pages)) if len(pages[k].at)]
        order = np.array(sorted(keep, key=lambda k: len(pages[k].at)))
        groups = [order[a : a + batch] for a in range(0, len(order), batch)]
        data = []
        for g in groups:
            feats = make([pages[k] for k in g])
            data.append((feats, np.array([labels[k][x] for k in g for x in pages[k].at.tolist()], dtype=np.int64)))
        if not data:
            return
        epochs = max(epochs, -(-least_steps // len(data)))
        count = np.bincount(np.concatenate([y[y >= 0] for _, y in data]), minlength=CLASSES)
        weight = np.clip(np.sqrt(count.max() / np.maximum(count, 1)), 1, 8).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step = 0
        for epoch in range(epochs):
            for at in rng.permutation(len(data)):
                step += 1
                lr = rate * (1 - 0.8 * epoch / max(epochs - 1, 1))
                for k, g in self.gradient(*data[at], weight).items():
                    g = np.clip(g, -1, 1)
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)


def fit(pages: list[Page], seed: int = 11) -> Labeller:
    """A labeller from the weak labels of pages."""
    labels = [weak_labels(p.lines, {letters(p.lines[k]) for k in p.at[p.share > 0].tolist()}) for p in pages]
    out = Labeller(seed)
    out.train(pages, labels)
    return out
