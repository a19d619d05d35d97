"""SQL of the cleaning profiles, step by step: each takes a table of doc_id and text and gives one of the same form."""

from __future__ import annotations

from ..operators import clean

LF = "chr(10)"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


S = trim("x")


def drop_lines(*tests: str) -> str:
    test = " or ".join(tests)
    return f"coalesce(array_to_string([x for x in string_split(text, {LF}) if not coalesce({test}, false)], {LF}), '')"


def starts(prefixes, x: str = S) -> str:
    return "(" + " or ".join(f"starts_with({x}, '{p}')" for p in prefixes) + ")"


def isin(values, x: str = S) -> str:
    return f"{x} in (" + ", ".join(f"'{v}'" for v in values) + ")"


def step(expression: str):
    return lambda rows: f"(select doc_id, {expression} as text from {rows})"


def replaced(pattern: str, by: str = "", x: str = "text") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _like(pattern: str, x: str = S) -> str:
    return f"regexp_matches({x}, '{pattern}')"


ISO = r"^\d{4}-\d{2}-\d{2}"
MONTH = clean.MONTH


def archive_wrapper(rows: str) -> str:
    return f"""(select doc_id, coalesce(array_to_string(l[st + 1:least(len(l), greatest(e, st + 1))], {LF}), '') as text from (
  select doc_id, l, case when u > 0 then u when d > 0 then d + 1 else 0 end as st,
  coalesce(list_max([i for i in range(1, len(s) + 1) if not ({isin([*clean.CHROME, ''], 's[i]')})]), 0) as e from (
    select doc_id, l, s, coalesce(list_min([i for i in range(1, len(s) + 1) if contains(s[i], 'UTC') and len(s[i]) < 60]), 0) as u,
    coalesce(list_min([i for i in range(1, len(s) + 1) if starts_with(s[i], 'Date:')]), 0) as d from (
      select doc_id, string_split(text, {LF}) as l, [{S} for x in string_split(text, {LF})] as s from {rows}))))"""


def from_first(rows: str, head: str, line: str = "x") -> str:
    """From the first line on that isn't part of the head."""
    return f"""(select doc_id, case when f > 0 then coalesce(array_to_string([{line} for x in l[f:]], {LF}), '') else '' end as text from (
  select doc_id, l, coalesce(list_min([i for i in range(1, len(l) + 1) if not h[i]]), 0) as f from (
    select doc_id, string_split(text, {LF}) as l, [coalesce({head}, false) for x in string_split(text, {LF})] as h from {rows})))"""


HEAD = " or ".join([
    f"{S} = ''", starts(clean.HEADERS), isin(clean.CHROME[:2]), _like(r"^\d{1,4}$"), _like(MONTH + r"\d"), _like(ISO), f"(contains({S}, 'UTC') and len({S}) < 50)",
    rf"({_like(r'^Re:\s')} and len({S}) < 120)", f"(len({S}) < 80 and not {_like('[.?!,;:]')})",
])
POSITIVE = " or ".join([
    f"{S} = ''", _like(r"(?i)^(?:From:|Subject:|Date:|\d+|Source)$"), _like("(?i)^(?:Re:|Posted)"), _like(r"(?i)^\w+ \d+, \d{4}"), _like(MONTH.removesuffix(r"\s+")), _like(ISO),
    f"(contains({S}, 'UTC') and len({S}) < 40)",
])


def negative_head(rows: str) -> str:
    head = starts(clean.SHORT_HEADERS)
    cut = f"list_min([i for i in range(1, len(s) + 1) if not {starts(clean.SHORT_HEADERS, 's[i]')} and (s[i] = '' or starts_with(s[i], '-----'))])"
    return f"""(select doc_id, {trim(f"coalesce(array_to_string(list_concat([x for x in l[1:c - 1] if not {head}], l[c + 1:]), {LF}), '')")} as text from (
  select doc_id, l, coalesce({cut}, len(l) + 1) as c from (
    select doc_id, string_split(text, {LF}) as l, [{S} for x in string_split(text, {LF})] as s from {rows})))"""


def late_rule(rows: str) -> str:
    found = r"regexp_extract(text, '\n---+\s*\n')"
    return f"""(select doc_id, case when a > 0 and a - 1 > len(text) * 0.7 then substr(text, 1, a - 1) else text end as text from (
  select doc_id, text, case when {found} = '' then 0 else strpos(text, {found}) end as a from {rows}))"""


def chrome(x: str = "text") -> str:
    x = drop_lines(isin(clean.CHROME))
    for name in clean.CHROME:
        x = f"replace({x}, '{name}', '')"
    return x


def surviving_metadata() -> str:
    x = "text"
    for pattern in (r"Subject:\s*\n", r"Date:\s*\n", r"(?m)^\d{1,4}\s*$", rf"(?m){MONTH}\d{{1,2}},\s+\d{{4}}.*$", r"(?m)^\w+ \d{1,2}, \d{4} at \d{1,2}:\d{2}:\d{2} UTC\s*$"):
        x = replaced(pattern, "", x)
    return x


CODE = r"Code:\s*\n(?s:.*?)(\n\n|\z)"
SPACES = replaced(" {2,}", " ", r"regexp_replace(text, '\n{3,}', concat(chr(10), chr(10)), 'g')")
LOOSE = trim(f"coalesce(array_to_string([{S} for x in string_split({SPACES}, {LF})], {LF}), '')")
POSTS = drop_lines(
    f"starts_with({S}, '>')", _like("^On .+ wrote:$"), _like("^.{1,40} wrote:$"), _like(clean.POST_FIELDS), _like(r"^\d+$"), _like(MONTH + r"\d"), _like(ISO),
    f"(contains({S}, 'UTC') and len({S}) < 40)", f"(starts_with({S}, 'Re: ') and len({S}) < 100)", starts(["[Moderator", "[EMAIL", "-----"]),
)


def profile(name: str, rows: str, steps: dict[str, str], quotes: str) -> str:
    """The SQL of a profile over rows. steps: expressions of the newest profile's steps; quotes: its step of quote blocks."""
    tail = [step(steps[k]) for k in ("c4", "c5", "c6", "c7", "c8", "c9", "c10")]
    blocks = lambda r: f"(select doc_id, coalesce(c.text, '') as text from {rows} d left join ({quotes.format(r)}) c using (doc_id))"
    quoted = drop_lines(f"starts_with({S}, '>')", _like(r"^On .+ wrote:\s*$"), _like(r"^.{1,40} wrote:\s*$"), f"{S} = 'Quote'", f"starts_with({S}, 'Quote from:')")
    double = {k: steps[k] for k in ("c5", "c6", "c7", "c9", "c10")}
    chain = {
        "v5a": [step(steps["c1"]), archive_wrapper, blocks, *tail],
        "v4": [
            step(steps["c1"]), lambda r: from_first(r, HEAD), step(quoted), step(double["c5"]), late_rule, step(chrome()), step(surviving_metadata()), step(double["c6"]), step(double["c7"]),
            step(replaced(r"(?:\n {4,}\S.*){2,}")), step(replaced(r"\[.{1,38}\]")), step(double["c9"]), step(double["c10"]),
        ],
        "v2": [
            step(replaced(r"Quote from:(?s:.*?)(\n\n|\z)", r"\1")), step(replaced(r"(?m)^Quote\s*$")), step(replaced(r"(?m)^\s*Quote\s*$")), step(POSTS), step(replaced(CODE, r"\1")), step(LOOSE),
        ],
        "v1_pos": [
            lambda r: from_first(r, POSITIVE, f"case when {S} = '' then '' else x end"), step(trim("text")), step(replaced(r"Quote from:(?s:.*?)(\n\n)", r"\1")),
            step(trim(replaced(r"(?m)^Quote\s*$"))),
        ],
        "v1_neg": [negative_head, step(steps["c5"]), step(trim(drop_lines(f"starts_with({S}, '>')", _like(r"^On .+ wrote:\s*$"))))],
    }
    for f in chain[name]:
        rows = f(rows)
    return rows
