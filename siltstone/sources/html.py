"""Main content of web pages: text blocks outside navigation and the like, and the page's title, author and date."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SKIPPED = frozenset("script style noscript template nav footer header aside form button select svg iframe head".split())
BLOCKS = frozenset("p div section article main li ul ol table tr td th h1 h2 h3 h4 h5 h6 pre blockquote br hr dl dt dd figure figcaption body".split())
VOID = frozenset("br hr img input meta link wbr col area base embed source track".split())
META = {
    "title": ("og:title", "twitter:title", "dc.title"), "author": ("author", "article:author", "dc.creator"), "url": ("og:url",),
    "created": ("article:published_time", "date", "dc.date", "pubdate", "datepublished"),
}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.blocks: list[list] = []  # depth of article or main, link characters, text
        self.meta: dict[str, str] = {}
        self.title = ""
        self.open_block()

    def open_block(self) -> None:
        if not self.blocks or self.blocks[-1][2]:
            self.blocks.append([0, 0, ""])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("content"):
            self.meta.setdefault((a.get("name") or a.get("property") or a.get("itemprop") or "").lower(), a["content"].strip())
        if tag == "link" and a.get("rel") == "canonical":
            self.meta.setdefault("og:url", a.get("href", ""))
        if tag in BLOCKS:
            self.open_block()
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass
        if tag in BLOCKS:
            self.open_block()

    def handle_data(self, data: str) -> None:
        if "title" in self.stack:
            self.title += data
            return
        if any(t in SKIPPED for t in self.stack):
            return
        text = data if "pre" in self.stack else " ".join(data.split())
        if not text.strip():
            return
        b = self.blocks[-1]
        b[0] = any(t in ("article", "main") for t in self.stack)
        b[1] += len(text) * ("a" in self.stack)
        glue = " " if b[2] and (data[:1].isspace() or b[2][-1:] not in "(“„«/" and data[:1] not in ".,;:!?)”»") else ""
        b[2] += glue + text


def main_content(page: str | None) -> dict[str, str | None]:
    """body (blocks joined by blank lines), title, author, url, created; what is missing is null, body is never.

    Blocks that are mostly links are left out.  Where an article or main element holds half of the text, only it
    counts.
    """
    p = _Page()
    try:
        p.feed(page or "")
        p.close()
    except Exception:  # the parser's own failures on broken pages
        pass
    blocks = [b for b in p.blocks if b[2].strip() and b[1] <= 0.6 * len(b[2])]
    inside = [b for b in blocks if b[0]]
    if sum(len(b[2]) for b in inside) * 2 >= sum(len(b[2]) for b in blocks):
        blocks = inside or blocks
    first = {k: next((p.meta[n] for n in names if p.meta.get(n)), None) for k, names in META.items()}
    return first | {"title": " ".join(p.title.split()) or first["title"], "body": "\n\n".join(b[2].strip() for b in blocks)}


def extract(c: Column | str) -> Column:
    def run(page: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([main_content(x if isinstance(x, str) else None) for x in page], columns=["body", "title", "author", "url", "created"])

    return F.pandas_udf(run, "struct<body:string,title:string,author:string,url:string,created:string>")(c)
