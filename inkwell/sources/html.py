"""Pages to text: regions, titles, links. Regular expressions on the JVM; the exact tree is a pandas UDF."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions.text import strip

# Entities that are decoded.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def without(html: Column, *tags: str) -> Column:
    return F.regexp_replace(html, rf"(?is)<({'|'.join(tags)})\b.*?</\1\s*>", "")


def decode(text: Column) -> Column:
    for name, sign in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def region(html: Column) -> Column:
    """main, else article, else the whole page."""
    inner = lambda tag: F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.when(inner("main") != "", inner("main")).when(inner("article") != "", inner("article")).otherwise(html)


def text(html: Column) -> Column:
    body = F.regexp_replace(without(html, "nav", "header", "footer", "script", "style"), r"(?s)<!--.*?-->", "")
    return strip(F.regexp_replace(decode(F.regexp_replace(region(body), r"<[^>]*>", "\n")), r"\n\s*\n+", "\n"))


def title(html: Column) -> Column:
    return strip(decode(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1), r"<[^>]*>", "")))


def date(html: Column) -> Column:
    """The datetime of the first time, else its text."""
    stamp = F.regexp_extract(html, r'(?is)<time\b[^>]*\bdatetime="([^"]*)"', 1)
    return F.when(stamp != "", stamp).otherwise(strip(F.regexp_extract(html, r"(?is)<time\b[^>]*>(.*?)</time", 1)))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))


def topic(html: Column, host: str) -> Column:
    """The number of the topic that the first link to the host with one has; host is a regular expression."""
    return F.nullif(F.regexp_extract(html, rf'(?i)<a\b[^>]*\bhref="[^"]*{host}[^"]*topic=(\d+)', 1), F.lit("")).cast("long")


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "nav", "header", "footer")

    def handle_endtag(self, tag):
        self.skip -= self.skip > 0 and tag in ("script", "style", "nav", "header", "footer")

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.out.append(data.strip())


@F.pandas_udf(StringType())
def tree_text(html: pd.Series) -> pd.Series:
    """Text nodes of the parsed page, one a line."""

    def one(x):
        tree = _Tree()
        tree.feed(x or "")
        return "\n".join(tree.out)

    return html.map(one)


#: A line before a post that is no date has this many characters or more.
DATE = 50


class _Posts(HTMLParser):
    """author, text and date of each div.post, its inner divs included; the author is the first link of the nearest
    td.poster_info before it, the date the nearest div.smalltext before it, if that is short."""

    def __init__(self):
        super().__init__()
        self.depth, self.open, self.found = 0, [], []
        self.cells, self.cell, self.author, self.link = 0, 0, None, None
        self.small, self.date = None, None

    def handle_starttag(self, tag, attrs):
        kinds = (dict(attrs).get("class") or "").split()
        if tag == "div":
            self.depth += 1
            if "post" in kinds:
                date = "".join(self.date).strip() if self.date else ""
                post = {"at": self.depth, "author": self.author, "text": [], "date": date if 0 < len(date) < DATE else None}
                self.open.append(post)
                self.found.append(post)
            elif "smalltext" in kinds:
                self.small, self.date = self.depth, []
        elif tag == "td":
            self.cells += 1
            if "poster_info" in kinds:
                self.cell, self.author, self.link = self.cells, None, None
        elif tag == "a" and self.cell and self.author is None:
            self.link = []

    def handle_endtag(self, tag):
        if tag == "div" and self.depth:
            self.open = [p for p in self.open if p["at"] < self.depth]
            self.small = None if self.small == self.depth else self.small
            self.depth -= 1
        elif tag == "td" and self.cells:
            if self.cell == self.cells:
                self.cell = 0
            self.cells -= 1
        elif tag == "a" and self.link is not None:
            self.author, self.link = "".join(self.link).strip(), None

    def handle_data(self, data):
        if self.cdata_elem:
            return  # script or style
        for post in self.open:
            post["text"].append(data)
        if self.small is not None:
            self.date.append(data)
        if self.link is not None:
            self.link.append(data)


@F.pandas_udf(ArrayType(StructType().add("author", "string").add("text", "string").add("date", "string")))
def _posts(html: pd.Series) -> pd.Series:
    def one(x):
        page = _Posts()
        page.feed(x or "")
        page.close()
        return [{"author": p["author"] or "unknown", "text": "\n".join(p["text"]).strip(), "date": p["date"]} for p in page.found]

    return html.map(one)


def posts(html: Column, least: int = 30) -> Column:
    """author, text and date of each div.post, of texts of `least` characters or more; inner divs belong to the text."""
    return F.filter(_posts(html), lambda x: F.length(x["text"]) >= least)
