"""Web pages: text, main content, and which addresses may be used."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: character references, tags without content of their own, parts of suspicious addresses
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&rsquo;": "'", "&lsquo;": "'", "&rdquo;": '"', "&ldquo;": '"'}
SKIPPED = ("script", "style", "nav", "header", "footer", "aside", "iframe")
SUSPICIOUS = r"javascript:|data:|file:|localhost|127\.0\.0\.1|0\.0\.0\.0|@"


def html_to_text(html: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>", ""), "(?is)<style[^>]*>.*?</style>", "")
    out = F.regexp_replace(out, "<[^>]+>", "")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


class _Text(HTMLParser):
    """Visible text, and that inside main or article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.every, self.main, self.skip, self.inside = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in SKIPPED
        self.inside += tag in ("main", "article")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in SKIPPED))
        self.inside = max(0, self.inside - (tag in ("main", "article")))

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.every.append(data.strip())
            if self.inside:
                self.main.append(data.strip())


def main_content(pages: DataFrame) -> DataFrame:
    """page_id, text, has_main: text of main or article where there is one, else of the page."""

    def read(batches):
        for pdf in batches:
            rows = []
            for page_id, html in zip(pdf["page_id"], pdf["html"], strict=True):
                p = _Text()
                p.feed(html or "")
                rows.append((page_id, " ".join(" ".join(p.main or p.every).split()), bool(p.main)))
            yield pd.DataFrame(rows, columns=["page_id", "text", "has_main"])

    return pages.select("page_id", "html").mapInPandas(read, "page_id long, text string, has_main boolean")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))


def allowed(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (host(url) == d) | host(url).endswith(f".{d}")
    return out


def safe(url: Column) -> Column:
    return url.isNotNull() & url.rlike("^https?://") & ~F.lower(url).rlike(SUSPICIOUS)
