"""Cleaning: steps from text to text, and profiles that are ordered lists of them. Nulls stay null.

Names of sites and authors are parameters, as they depend on where texts come from.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

Step = Callable[[Column], Column]

# What marks lines that aren't an author's own.
CHROME = ("View original", "View in thread", "Previous", "Next", "Back to emails", "Back to posts")
MONTH = r"^(January|February|March|April|May|June|July|August|September|October|November|December)\s+"
MAIL = r"^(From|To|Cc|Subject|Date|Message-ID|References|In-Reply-To|Content-|MIME-|X-|Return-Path|Received|Delivered):"
HEADERS = ("From:", "To:", "Cc:", "Subject:", "Date:", "Message-ID:", "References:", "In-Reply-To:", "Content-Type:", "Content-Transfer", "MIME-Version:", "X-", "Return-Path:", "Received:", "Delivered-To:")
POST_FIELDS = r"^(From|Subject|Date|Posted|Source|To|Cc|In-Reply-To|References|Message-ID|Content-Type|MIME-Version):"
SHORT_HEADERS = ("From:", "To:", "Cc:", "Subject:", "Date:", "Message-ID:", "References:", "In-Reply-To:", "Content-", "MIME-", "X-")

#: A leading (?d) lets only \n end a line, as elsewhere.
D = "(?d)"


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def encoding(t: Column) -> Column:
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.translate(t, "\u00a0\u200b\u200c\ufeff", " ")


def _first(flags: Column) -> Column:
    """Number (from 0) of the first true, -1 if none."""
    return (F.array_position(flags, True) - 1).cast("int")


def archive_wrapper(t: Column) -> Column:
    """Head up to the line of the time, or two lines from Date:, and trailing navigation go."""

    def cut(lines: Column, s: Column) -> Column:
        utc = _first(F.transform(s, lambda x: x.contains("UTC") & (F.length(x) < 60)))
        date = _first(F.transform(s, lambda x: x.startswith("Date:")))
        start = F.when(utc >= 0, utc + 1).when(date >= 0, date + 2).otherwise(0)
        tail = _first(F.transform(F.reverse(s), lambda x: ~x.isin(*CHROME, "")))
        n = F.size(s)
        end = F.when(tail < 0, F.lit(0)).otherwise(n - tail)
        end = F.least(n, F.greatest(end, start + 1))
        return F.array_join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), "\n")

    return T.let(T.lines(t), lambda lines: T.let(F.transform(lines, T.strip), lambda s: cut(lines, s)))


#: White space other than a line end.
_BLANK = rf"[{T.SPACE}&&[^\n]]*+"
_QUOTE = rf"(?U)\n{_BLANK}Quote from:[^\n]*+(?:\n(?!{_BLANK}(?:\n|\z))[^\n]*+)*+(?:\n{_BLANK}(?=\n|\z))?"


def quote_blocks(t: Column) -> Column:
    """From a line that starts a quote up to and with the next blank line; possessive, so a long block is one pass."""
    return F.substring(F.regexp_replace(F.concat(F.lit("\n"), t), _QUOTE, ""), 2, 2**31 - 1)


def quoted_lines(on: str = ".{10,80}", who: str = ".{1,30}", quote: bool = True, quote_from: bool = False) -> Step:
    def step(t: Column) -> Column:
        def keep(s: Column) -> Column:
            tests = [s.startswith(">"), s.rlike(rf"{D}^On {on} wrote:\s*\z")]
            tests += [s.rlike(rf"{D}^{who} wrote:\s*\z")] if who else []
            tests += [s == "Quote"] if quote else []
            return ~_any(tests + ([s.startswith("Quote from:")] if quote_from else []))

        return T.keep_lines(t, keep)

    return step


def signature(t: Column) -> Column:
    return F.split(t, "\n-- ?\n", 2)[0]


def late_rule(t: Column) -> Column:
    """From the first line of dashes on, if it begins past 70 % of the text."""

    def cut(t: Column) -> Column:
        return T.let(F.regexp_instr(t, F.lit(r"\n---+\s*\n")), lambda at: F.when((at > 0) & (at - 1 > F.length(t) * 0.7), F.substring(t, F.lit(1), at - 1)).otherwise(t))

    return T.let(t, cut)


def urls(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)https?://[^\s\x1c-\x1f]+", "")


def code_blocks(t: Column) -> Column:
    return F.regexp_replace(t, r"(?s)Code:\s*\n.*?(?=\n\n|\z)", "")


def indented_code(t: Column) -> Column:
    return F.regexp_replace(t, r"(?d)(?:\n {4,}\S.*){2,}", "")


def annotations(t: Column) -> Column:
    return F.regexp_replace(t, r"(?d)\[.{1,38}\]", "")


def metadata_lines(sites: Sequence[str] = (), authors: Sequence[str] = ()) -> Step:
    def keep(s: Column) -> Column:
        return ~_any([
            s.isin(*CHROME[:2], *sites), F.lower(s).isin(*authors) if authors else F.lit(False), s.rlike(r"^\d{1,4}\z"), s.rlike(r"^(From|Subject|Date):\s*\z"),
            s.rlike(rf"{MONTH}\d{{1,2}},\s+\d{{4}}"), s.contains("UTC") & (F.length(s) < 50) & s.rlike(r"\d{2}:\d{2}"), s.rlike(MAIL), s.rlike(rf"{D}^\[.{{1,38}}\]\z"),
        ])

    return lambda t: T.keep_lines(t, keep)


def white_space(t: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), " {2,}", " ")
    t = F.array_join(F.transform(T.lines(t), lambda x: T.strip(x)), "\n")
    return T.strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def loose_white_space(t: Column) -> Column:
    """Like white_space, but blank lines that stripping makes stay."""
    t = F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), " {2,}", " ")
    return T.strip(F.array_join(F.transform(T.lines(t), lambda x: T.strip(x)), "\n"))


def short_white_space(t: Column) -> Column:
    return T.strip(F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), " {2,}", " "))


def punctuation(t: Column) -> Column:
    return F.replace(F.translate(t, "\u2018\u2019\u201c\u201d\u2013\u2014", "''\"\"--"), F.lit("\u2026"), F.lit("..."))


def header_prefix(sites: Sequence[str] = (), authors: Sequence[str] = ()) -> Step:
    """Leading lines that look like a header go, up to the first that doesn't."""

    def head(s: Column) -> Column:
        tests = [s == "", *(s.startswith(h) for h in HEADERS), s.isin(*CHROME[:2], *sites), F.lower(s).isin(*authors) if authors else F.lit(False), s.rlike(r"^\d{1,4}\z"), s.rlike(MONTH + r"\d"), s.rlike(r"^\d{4}-\d{2}-\d{2}")]
        return _any([*tests, s.contains("UTC") & (F.length(s) < 50), s.rlike(r"^Re:\s") & (F.length(s) < 120), (F.length(s) < 80) & ~s.rlike("[.?!,;:]")])

    def rest(lines: Column) -> Column:
        first = _first(F.transform(lines, lambda x: ~head(T.strip(x))))
        return T.let(first, lambda n: F.when(n >= 0, F.array_join(F.slice(lines, n + 1, F.size(lines)), "\n")).otherwise(""))

    def step(t: Column) -> Column:
        return T.let(T.lines(t), rest)

    return step


def chrome(names: Sequence[str] = ()) -> Step:
    """Navigation goes wherever it stands, in prose too."""

    def step(t: Column) -> Column:
        t = T.keep_lines(t, lambda s: ~s.isin(*CHROME, *names))
        for x in (*CHROME, *names):
            t = F.replace(t, F.lit(x), F.lit(""))
        return t

    return step


def surviving_metadata(authors: Sequence[str] = ()) -> Step:
    def step(t: Column) -> Column:
        for a in authors:
            t = F.regexp_replace(t, rf"(?i)From:\s*\n\s*{a}\s*\n", "")
        t = F.regexp_replace(F.regexp_replace(t, r"Subject:\s*\n", ""), r"Date:\s*\n", "")
        t = F.regexp_replace(t, r"(?md)^\d{1,4}\s*$", "")
        t = F.regexp_replace(t, rf"(?md){MONTH}\d{{1,2}},\s+\d{{4}}.*$", "")
        return F.regexp_replace(t, r"(?mdU)^\w+ \d{1,2}, \d{4} at \d{1,2}:\d{2}:\d{2} UTC\s*$", "")

    return step


def quote_regex(t: Column) -> Column:
    t = F.regexp_replace(t, r"(?s)Quote from:.*?(?=\n\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?md)^Quote\s*$", ""), r"(?md)^\s*Quote\s*$", "")


def post_lines(sites: Sequence[str] = (), authors: Sequence[str] = ()) -> Step:
    def keep(s: Column) -> Column:
        return ~_any([
            s.startswith(">"), s.rlike(rf"{D}^On .+ wrote:\z"), s.rlike(rf"{D}^.{{1,40}} wrote:\z"), s.rlike(POST_FIELDS), s.isin(*sites) if sites else F.lit(False), s.rlike(r"^\d+\z"), s.rlike(MONTH + r"\d"), s.rlike(r"^\d{4}-\d{2}-\d{2}"),
            s.contains("UTC") & (F.length(s) < 40), F.lower(s).isin(*authors) if authors else F.lit(False), s.startswith("Re: ") & (F.length(s) < 100), s.startswith("[Moderator"), s.startswith("[EMAIL"), s.startswith("-----"),
        ])

    return lambda t: T.keep_lines(t, keep)


def positive_head(sites: Sequence[str] = (), authors: Sequence[str] = ()) -> Step:
    """The first generation's cleaner of the positive class: a header prefix, then quote blocks that end in a blank line."""
    fixed = "|".join([*sites, *authors, "From:", "Subject:", "Date:", r"\d+", "Source"])

    def head(s: Column) -> Column:
        return _any([s == "", s.rlike(rf"(?iu)^(?:{fixed})\z"), s.rlike(r"(?i)^(?:Re:|Posted)"), s.rlike(r"(?iU)^\w+ \d+, \d{4}"), s.rlike(MONTH.removesuffix(r"\s+")), s.rlike(r"^\d{4}-\d{2}-\d{2}"), s.contains("UTC") & (F.length(s) < 40)])

    def rest(lines: Column) -> Column:
        first = _first(F.transform(lines, lambda x: ~head(T.strip(x))))
        plain = lambda n: F.transform(F.slice(lines, n + 1, F.size(lines)), lambda x: F.when(T.strip(x) == "", "").otherwise(x))
        return T.let(first, lambda n: F.when(n >= 0, F.array_join(plain(n), "\n")).otherwise(""))

    def step(t: Column) -> Column:
        t = T.strip(T.let(T.lines(t), rest))
        t = F.regexp_replace(t, r"(?s)Quote from:.*?(?=\n\n)", "")
        return T.strip(F.regexp_replace(t, r"(?md)^Quote\s*$", ""))

    return step


def negative_head(t: Column) -> Column:
    """The first generation's cleaner of the negative class: header lines up to a blank or a rule, signature, quotes."""
    head = lambda x: _any([x.startswith(h) for h in SHORT_HEADERS])

    def body(lines: Column) -> Column:
        cut = _first(F.transform(lines, lambda x: T.let(T.strip(x), lambda s: ~head(s) & ((s == "") | s.startswith("-----")))))

        def at(cut: Column) -> Column:
            before = F.filter(F.slice(lines, 1, F.when(cut >= 0, cut).otherwise(F.size(lines))), lambda x: ~head(T.strip(x)))
            after = F.when(cut >= 0, F.slice(lines, cut + 2, F.size(lines))).otherwise(F.array().cast("array<string>"))
            return F.array_join(F.concat(before, after), "\n")

        return T.let(cut, at)

    return T.strip(quoted_lines(on=".+", who="", quote=False)(signature(T.strip(T.let(T.lines(t), body)))))


def profile(name: str, sites: Sequence[str] = (), authors: Sequence[str] = ()) -> list[Step]:
    """v5 (for archives v5a), v4, v2, and the first generation's v1_pos and v1_neg."""
    if name in ("v5", "v5a"):
        return [encoding, *([archive_wrapper] if name == "v5a" else []), quote_blocks, quoted_lines(), signature, urls, code_blocks, metadata_lines(sites, authors), white_space, punctuation]
    if name == "v4":
        return [encoding, header_prefix(sites, authors), quoted_lines(".+", ".{1,40}", quote_from=True), signature, late_rule, chrome(), surviving_metadata(authors), urls, code_blocks, indented_code, annotations, white_space, punctuation]
    if name == "v2":
        return [quote_regex, post_lines(sites, authors), code_blocks, loose_white_space]
    return {"v1_pos": [positive_head(sites, authors)], "v1_neg": [negative_head]}[name]


def kept(t: Column, least: int = 15, name: str = "v5", **known: Sequence[str]) -> Column:
    """cleaned and word_count, as an array of one, or of none under `least` words. To be exploded, so that nothing is cleaned
    twice: a filter on the cleaned column would be pushed below the cleaning and bring a second one with it."""
    counted = F.transform(F.array(clean(t, name, **known)), lambda x: F.struct(x.alias("cleaned"), T.word_count(x).alias("word_count")))
    return F.filter(counted, lambda x: x["word_count"] >= least)


def clean(t: Column, name: str = "v5", **known: Sequence[str]) -> Column:
    for step in profile(name, **known):
        t = step(t)
    return t
