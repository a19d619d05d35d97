"""Tokens, trims, sentences and paragraphs. The rules on white space and regex flags live here alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() and strip() have it, sign by sign: Java finds these much faster than (?U) and \\s.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same signs one by one: what trimming takes.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Those beyond Latin-1. Java looks up a class of single Latin-1 signs in a table of bits, others sign by sign, 25 times slower.
FAR = "".join(c for c in SPACES if c > "\xff")
#: A token of a text without far spaces.
TOKEN = r"[^\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0]+"
WORD_CHAR = r"\w"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body reads it."""
    return F.transform(F.array(value), body)[0]


def plain(text: Column) -> Column:
    """text with blanks for far spaces: its tokens, sentences and paragraphs have the same words."""
    return F.translate(text, FAR, " " * len(FAR))


def words(text: Column) -> Column:
    return F.regexp_extract_all(plain(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column, far: bool = True) -> Column:
    """far: the text may have far spaces."""
    return F.regexp_count(plain(text) if far else text, F.lit(TOKEN))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keep_lines(text: Column, keep: Callable[[Column], Column]) -> Column:
    """The lines whose stripped form passes."""
    return F.array_join(F.filter(lines(text), lambda x: let(strip(x), keep)), "\n")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+", -1), lambda s: strip(s)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n\n", -1), lambda p: strip(p) != "")


def occurrences(text: Column, part: str) -> Column:
    """How often part occurs without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")
