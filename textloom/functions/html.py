"""HTML pages to Markdown: a small document tree, selectors, and three ways to find the main content."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from textloom.config import SETTINGS

#: Elements that hold no content, and where content is looked for, in this order.
NOISE = (
    "nav", "footer", "header", "aside", ".sidebar", ".navigation", ".breadcrumb", ".toc",
    ".cookie-banner", ".cookie-consent", ".announcement-bar", "[role=navigation]", "[role=banner]", "[role=complementary]", "script", "style",
    "noscript", "iframe", "svg",
)
CONTENT = (
    "main", "article", "#content", "#main-content", "#main", "#app-content", "#docs-content", "#page-content",
    "#primary", ".content", ".main-content", ".page-content", ".documentation", ".docs-content", ".doc-content", ".markdown-body",
    ".article-content", ".post-content", ".entry-content", ".rich-text", ".prose", "#root", "#app", "#__next",
    "#__nuxt", "[role=main]", ".gitbook-root", ".theme-doc-markdown", ".md-content", ".rst-content",
)
DENSE = {"div", "section", "article", "main", "td", "li", "p", "span"}
BONUS = {"p", "h1", "h2", "h3", "h4", "li"}
SILENT = {"script", "style", "noscript", "svg", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "table", "blockquote", "header", "footer", "nav", "aside", "form", "figure"}


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)

    def walk(self):  # noqa: ANN201
        """All elements below this one, in document order."""
        stack = list(reversed([c for c in self.children if isinstance(c, Node)]))
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed([c for c in n.children if isinstance(c, Node)]))

    def text(self) -> str:
        """Trimmed pieces of text, joined without space."""
        return "".join(s.strip() for s in self.strings())

    def strings(self) -> list[str]:
        out: list[str] = []
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return out


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "li", "td", "tr", "option") and self.open[-1].tag == tag:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def matches(node: Node, selector: str) -> bool:
    if selector[0] == ".":
        return selector[1:] in node.attrs.get("class", "").split()
    if selector[0] == "#":
        return node.attrs.get("id") == selector[1:]
    if selector[0] == "[":
        name, _, value = selector[1:-1].partition("=")
        return node.attrs.get(name) == value
    return node.tag == selector


def prune(node: Node, drop) -> None:  # noqa: ANN001
    stack = [node]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or not drop(c)]
        stack.extend(c for c in n.children if isinstance(c, Node))


def to_markdown(node: Node) -> str:
    """Headings, lists, links, emphasis, code and tables of a subtree as Markdown; images are left out."""
    out: list[str] = []

    def inline(n) -> str:  # noqa: ANN001
        if isinstance(n, str):
            return re.sub(r"\s+", " ", n)
        body = "".join(inline(c) for c in n.children)
        if n.tag == "a" and n.attrs.get("href") and body.strip():
            return f"[{body.strip()}]({n.attrs['href']})"
        if n.tag in ("strong", "b") and body.strip():
            return f"**{body.strip()}**"
        if n.tag in ("em", "i") and body.strip():
            return f"_{body.strip()}_"
        if n.tag == "code" and body:
            return f"`{body}`"
        return "\n" if n.tag == "br" else "" if n.tag in SILENT | {"img"} else body

    def block(n: Node, depth: int) -> None:
        run: list[str] = []

        def flush(prefix: str = "") -> None:
            if (s := "".join(run).strip()):
                out.append(prefix + s + "\n\n")
            run.clear()

        for c in n.children:
            if isinstance(c, str):
                run.append(inline(c))
            elif re.fullmatch(r"h[1-6]", c.tag):
                flush()
                if (s := inline(c).strip()):
                    out.append(f"{'#' * int(c.tag[1])} {s}\n\n")
            elif c.tag == "pre":
                flush()
                out.append("```\n" + "".join(c.strings()).strip("\n") + "\n```\n\n")
            elif c.tag in ("ul", "ol"):
                flush()
                for k, li in enumerate([x for x in c.children if isinstance(x, Node) and x.tag == "li"], 1):
                    nested = [x for x in li.children if isinstance(x, Node) and x.tag in ("ul", "ol")]
                    s = "".join(inline(x) for x in li.children if x not in nested).strip()
                    out.append("  " * depth + (f"{k}. " if c.tag == "ol" else "* ") + s + "\n")
                    for x in nested:
                        block(Node("#list", {}, [x]), depth + 1)
                out.append("\n")
            elif c.tag == "table":
                flush()
                for k, tr in enumerate([x for x in c.walk() if x.tag == "tr"]):
                    cells = [inline(x).strip() for x in tr.children if isinstance(x, Node) and x.tag in ("td", "th")]
                    out.append("| " + " | ".join(cells) + " |\n" + ("|" + "---|" * len(cells) + "\n" if k == 0 else ""))
                out.append("\n")
            elif c.tag in BLOCK or any(x.tag in BLOCK | {"pre", "h1", "h2", "h3"} for x in c.walk()):
                flush()
                block(c, depth)
            else:
                run.append(inline(c))
        flush()

    block(Node("#top", {}, [node]) if node.tag not in BLOCK else node, 0)
    return "".join(out).strip() + "\n"


def clean_markdown(text: str) -> str:
    """At most three newlines in a row, no blanks before a newline, no lines of marks alone."""
    text = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{4,}", "\n\n\n", text))
    return "\n".join(x for x in text.split("\n") if re.sub(r"[|\\—\-\s#*`>]", "", x) or not x.strip())


def by_selectors(html: str) -> str:
    root = parse(html)
    prune(root, lambda n: any(matches(n, s) for s in NOISE))
    for selector in [*CONTENT, "body"]:
        node = next((n for n in root.walk() if matches(n, selector)), None)
        if node and len(node.text()) >= SETTINGS.least_content:
            return to_markdown(node)
    return ""


def by_density(html: str) -> str:
    """The element with the most characters for each tag in it, more for paragraphs, headings and items."""
    root = parse(html)
    prune(root, lambda n: n.tag in SILENT)
    best, score = None, 0.0
    for n in root.walk():
        if n.tag not in DENSE or (size := len(n.text())) < SETTINGS.least_content:
            continue
        below = list(n.walk())
        own = size / (len(below) + 1) * (1 + 0.5 * sum(x.tag in BONUS for x in below))
        if own > score:
            best, score = n, own
    return to_markdown(best) if best else ""


def title_of(html: str) -> str:
    root = parse(html)
    node = next((n for n in root.walk() if n.tag == "h1"), None) or next((n for n in root.walk() if n.tag == "title"), None)
    return "".join(node.strings()).strip() if node else ""


def page_header(html: str, url: str) -> str:
    """The page's title, if it has one, and its URL."""
    title = title_of(html)
    return (f"# {title}\n\n" if title else "") + f"Source: {url}\n\n"


def links_of(html: str) -> list[str]:
    hrefs = (n.attrs["href"].strip() for n in parse(html).walk() if n.tag == "a" and "href" in n.attrs)
    return [h for h in hrefs if h and not h.startswith(("javascript:", "mailto:", "tel:", "#"))]


def page_to_markdown(html: str | None, url: str, extractor=None) -> str:  # noqa: ANN001
    """The page's header and main content, by an optional extractor, selectors or density; empty without any.

    Null and empty pages give an empty text.
    """
    if not html:
        return ""
    head = page_header(html, url)
    for way, clean in ((extractor, False), (by_selectors, True), (by_density, True)):
        if way and len((body := way(html) or "").strip()) >= SETTINGS.least_content:
            return head + (clean_markdown(body) if clean else body)
    return ""


def plain_text(html: str) -> str:
    """All text outside scripts and styles, one piece a line (for HTML files)."""
    root = parse(html)
    prune(root, lambda n: n.tag in ("script", "style"))
    return "\n".join(root.strings())
