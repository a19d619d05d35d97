"""Scans of forum, mail and article pages that are already in a table: which pages count, and what of a page does."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from html.parser import HTMLParser
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import text as T

# Lines of an article that are formulas.
FORMULA = r"^[pqz\s=\-\+\*\(\)\{\}\<\>\.]+\z"
FORMULA_HEADS = ("q =", "p =", "P =")


def newest(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that exists."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def until_empty(pages: DataFrame, thread: str, page: str, kept: Column) -> DataFrame:
    """The pages of each thread before its first one of which nothing is kept."""
    ends = pages.groupBy(F.col(thread).alias("__thread")).agg(F.min(F.when(~kept, F.col(page))).alias("__end"))
    joined = pages.join(ends, F.col(thread).eqNullSafe(F.col("__thread")))
    return joined.where(F.col("__end").isNull() | (F.col(page) < F.col("__end"))).select(*pages.columns)


def about(pages: DataFrame, title: Column, words: Sequence[str]) -> DataFrame:
    """The pages whose title has one of the words, in any case."""
    return pages.where(F.lower(title).rlike("|".join(re.escape(w.lower()) for w in words)))


def by_writer(texts: DataFrame, writer: str, order: str, least: int, chars: int, first: int) -> DataFrame:
    """Of each writer the first texts of `least` words or more, each cut at `chars` characters: the scan's own bounds."""
    rank = F.row_number().over(Window.partitionBy(writer).orderBy(order))
    long = texts.where(T.word_count(F.col("text")) >= least).withColumn("__rank", rank).where(F.col("__rank") <= first)
    return long.drop("__rank").withColumn("text", F.left("text", F.lit(chars)))


def without_author(rows: DataFrame, author: str, name: str, within: bool = False) -> DataFrame:
    """Rows by others: not of this author's name in any case or, within, of a name that contains it. Unnamed rows stay."""
    own = F.lower(F.coalesce(author, F.lit("")))
    return rows.where(~own.contains(name.lower()) if within else own != name.lower())


def prose(text: Column) -> Column:
    """An article without its lines of formulas."""
    return T.strip(F.array_join(F.filter(T.lines(text), lambda x: ~T.let(T.strip(x), _formula)), "\n"))


def _formula(s: Column) -> Column:
    out = s.rlike(FORMULA)
    for head in FORMULA_HEADS:
        out = out | s.startswith(head)
    return out


def _inner(html: Column) -> Column:
    return T.strip(F.regexp_replace(html, r"<[^>]*>", ""))


def mail_author(html: Column) -> Column:
    """The text of the first link to an info/ page, of two characters or more and without an @."""
    links = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*\bhref="[^"]*info/[^"]*"[^>]*>(.*?)</a\s*>'), F.lit(1))
    return F.get(F.filter(F.transform(links, _inner), lambda x: (F.length(x) > 1) & ~x.contains("@")), 0)


def mail_body(html: Column, least: int = 50) -> Column:
    """The text of div.msgBody, null under `least` characters."""
    body = F.regexp_extract(html, r'(?is)<div\b[^>]*\bclass="[^"]*\bmsgBody\b[^"]*"[^>]*>(.*?)</div\s*>', 1)
    return T.let(_inner(body), lambda x: F.when(F.length(x) >= least, x))


class _Messages(HTMLParser):
    """div.message: its classes, and the text of its header, its body, its pre elements, and all of it."""

    def __init__(self):
        super().__init__()
        self.depth, self.found, self.open = 0, [], []

    def handle_starttag(self, tag, attrs):
        kinds = (dict(attrs).get("class") or "").split()
        if tag in ("div", "pre"):
            self.depth += 1
            inside = any(part == "all" for _, part, _ in self.open)
            if tag == "div" and "message" in kinds and not inside:
                self.found.append({"kinds": kinds, "all": [], "header": [], "body": [], "pre": []})
                self.open.append((self.depth, "all", self.found[-1]))
            elif inside:
                part = "pre" if tag == "pre" else "header" if "header" in kinds else "body" if "body" in kinds else None
                if part:
                    self.open.append((self.depth, part, self.found[-1]))

    def handle_endtag(self, tag):
        if tag in ("div", "pre") and self.depth:
            self.open = [o for o in self.open if o[0] < self.depth]
            self.depth -= 1

    def handle_data(self, data):
        for _, part, message in self.open:
            message[part].append(data)


_MESSAGE = StructType().add("date", "string").add("subject", "string").add("text", "string")


def messages(html: Column, kind: str, least: int = 5) -> Column:
    """date, subject and text of each div.message of a class, without quoted lines, of `least` words or more."""

    @F.pandas_udf(ArrayType(_MESSAGE))
    def found(pages: pd.Series) -> pd.Series:
        def one(x):
            page, out = _Messages(), []
            page.feed(x or "")
            page.close()
            for m in page.found:
                if kind not in m["kinds"]:
                    continue
                head = "\n".join(m["header"])
                given = [(g := re.search(rf"{name}:\s*(.*)", head)) and g[1].strip() for name in ("Date", "Subject")]
                body = "\n".join(m["body"] or m["pre"] or m["all"])
                kept = [x for x in body.split("\n") if not x.strip().startswith(">") and not re.match(r"On .+ wrote:", x.strip())]
                out.append({"date": given[0], "subject": given[1], "text": "\n".join(kept).strip()})
            return out

        return pages.map(one)

    return F.filter(found(html), lambda m: T.word_count(m["text"]) >= least)
