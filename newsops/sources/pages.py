"""Readable text of web pages, extracted page by page."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What is dropped, what ends a text unit, and the length limits.
DROPPED = frozenset("script style noscript svg nav footer aside".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MIN_PARAGRAPH, MAX_BODY = 20, 24000


class _Paragraphs(HTMLParser):
    """Collects the text of every <p>, remembering which container it sits in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.paragraphs: list[tuple[list[str], dict[str, int | None]]] = []
        self.writing: list[list[str]] = []
        self.first: dict[str, int] = {}
        self.count = dict.fromkeys(("article", "main", "body"), 0)
        self.inside: dict[str, list[int]] = {k: [] for k in self.count}

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.open.append(tag)
        if tag in self.count:
            self.count[tag] += 1
            self.inside[tag].append(self.count[tag])
        if tag == "p" and not DROPPED.intersection(self.open):
            text: list[str] = []
            self.paragraphs.append((text, {k: tuple(v) for k, v in self.inside.items()}))
            self.writing.append(text)
        elif tag == "p":
            self.writing.append([])

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            if last == "p" and self.writing:
                self.writing.pop()
            if last in self.inside and self.inside[last]:
                self.inside[last].pop()
            if last == tag:
                break

    def handle_data(self, data):
        if self.writing and not DROPPED.intersection(self.open):
            for text in self.writing:
                text.append(data)


def paragraphs_of(page: str | None) -> list[str]:
    """Paragraph texts of the first article, else main, else body element."""
    if not page:
        return []
    parser = _Paragraphs()
    parser.feed(page)
    parser.close()
    root = next((k for k in ("article", "main", "body") if parser.count[k]), None)
    if root is None:
        return []
    return [
        " ".join(" ".join(piece.strip() for piece in text if piece.strip()).split())
        for text, where in parser.paragraphs if 1 in where[root]
    ]


# page by page: a batch of columns would hold ten thousand whole pages and their paragraphs at once in each worker
page_paragraphs = F.udf(paragraphs_of, T.ArrayType(T.StringType()), useArrow=False)


def body_text(paragraphs, limit: int = MAX_BODY) -> Column:
    """Paragraphs of some length, joined by blank lines and cut at the size limit."""
    kept = F.filter(paragraphs, lambda p: F.length(p) >= MIN_PARAGRAPH)
    return F.substring(F.array_join(kept, "\n\n"), 1, limit)


def page_bodies(pages, url="canonical_url", html="html"):
    """One body per canonical URL; repeats of a URL are read once."""
    once = pages.groupBy(url).agg(F.max(html).alias(html))
    return once.withColumn("_paragraphs", page_paragraphs(html)).select(url, body_text(F.col("_paragraphs")).alias("body"))
