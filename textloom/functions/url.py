"""Column functions over URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of files that a crawl skips.
SKIPPED = (
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".webp", ".bmp",
    ".css", ".js", ".mjs", ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".exe", ".dmg",
    ".pkg", ".deb", ".rpm", ".msi", ".mp3", ".mp4", ".avi", ".mov",
    ".mkv", ".wav", ".ogg", ".pdf",
)
#: Hrefs that lead to no page.
NO_PAGE = ("javascript:", "mailto:", "tel:", "#")


def normalize_url(url: Column) -> Column:
    """Without fragment; without trailing slashes if the URL has more than three slashes."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    slashes = F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit("")))
    return F.when((slashes > 3) & bare.endswith("/"), F.regexp_replace(bare, "/+$", "")).otherwise(bare)


def url_part(url: Column, part: str) -> Column:
    """scheme, netloc or path of a URL, empty where it has none; never fails on odd text."""
    pattern = {"scheme": r"^([A-Za-z][A-Za-z0-9+.-]*):", "netloc": r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", "path": r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"}[part]
    got = F.regexp_extract(url, pattern, 1)
    return F.lower(got) if part == "scheme" else got


def allowed_url(url: Column, prefix: Column, domain: Column, stay: bool = True, exclude: list[str] | None = None) -> Column:
    """Whether a crawl may visit a URL: its scheme, domain, prefix, own exclusions and suffix."""
    clean = F.regexp_replace(url, r"(?s)[?#].*$", "")
    ok = url_part(url, "scheme").isin("http", "https") & (url_part(url, "netloc") == domain)
    if stay:
        ok &= F.startswith(clean, normalize_url(prefix))
    for pattern in exclude or []:
        ok &= ~url.rlike(pattern)
    return ok & ~F.lower(url_part(url, "path")).rlike(r"\.(?:" + "|".join(x[1:] for x in SKIPPED) + ")$")


def page_links(html: Column) -> Column:
    """The hrefs of a page's ``a`` tags, trimmed, without those that lead to no page."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\b[^>]*?\shref\s*=\s*[\"']([^\"']*)[\"']"), 1)
    trimmed = F.transform(found, lambda h: F.trim(h))
    return F.filter(trimmed, lambda h: (h != "") & ~h.rlike("^(?:" + "|".join(NO_PAGE) + ")"))


def sitemap_urls(xml: Column) -> Column:
    """The distinct locations of a sitemap in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"<loc>(.*?)</loc>"), 1), lambda u: F.trim(u)))
