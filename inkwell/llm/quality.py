"""Quality rules with thresholds that follow each language's and source's own documents.

Counts of every whole text are made once and written to the shared folder. Quantile sketches (Greenwald-Khanna, merged
over partitions) of four shares give each (language, source) its quartiles, and a document is dropped where a share lies
further beyond the quartiles than `reach` interquartile ranges and a slack. Quartiles of a group are drawn to those of
its language as if `prior` documents more had these, and those of a language to all documents' in the same way.

Defined cases: a null text has no words; a null language or source is a group of its own; fixed base rules drop texts
of under 50 words, and those of which over half of the words lie in repeated three-word windows; documents that fail
these don't count for the quartiles; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import WORD, slices, staged, texts_of

MIN_WORDS, MAX_REPEAT = 50, 50
REACH, PRIOR, ACCURACY = 3.0, 100.0, 1000
#: Parts that the documents of a hot (language, source) are dealt to.
PARTS = 16
#: Shares, and what a document may lie beyond its group's reach.
SLACK = {"symbols": 0.05, "dup_lines": 0.25, "repeats": 0.2, "length": 2.0}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WINDOW = 3


def counts(text: bytes) -> tuple[int, ...]:
    """The COUNTS of a text."""
    raw = np.frombuffer(text, np.uint8)
    seen: dict[bytes, int] = {}
    words = np.array([seen.setdefault(w, len(seen)) for w in text.split()], np.int64)  # numbers, not hashes: equal words alone are equal
    n = len(words)
    chars = int((((raw & 0xC0) != 0x80) & ~spans._GAP[raw]).sum())
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    repeated = 0
    if n > _WINDOW:
        grams = words
        for k in range(1, _WINDOW):
            grams = np.unique(grams[: n - k] * len(seen) + words[k:], return_inverse=True)[1]
        twice = np.zeros(n, bool)
        twice[: len(grams)] = np.bincount(grams)[grams] > 1
        inside = twice.copy()
        for k in range(1, _WINDOW):
            inside[k:] |= twice[: n - k]
        repeated = int(inside.sum())
    return n, chars, int(_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the COUNTS."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = zip(*map(counts, texts_of(batch)), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(x, pa.int64()) for x in rows)], ["doc_id", "lang", "source", *COUNTS])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def _quartiles(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Number of documents (<prefix>_n) and quartiles of each share (<prefix>_<share>) by keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias(f"{prefix}_n"), *(F.percentile_approx(s, [0.25, 0.75], ACCURACY).alias(f"{prefix}_{s}") for s in SLACK))


def _shrunk(n: Column, own: Column, wider: Column, prior: float) -> Column:
    """A quartile of n documents, drawn to the wider group's as if `prior` documents more had that one."""
    return (n * own + prior * wider) / (n + prior)


def limits(good: DataFrame, reach: float, prior: float) -> DataFrame:
    """g_lang, g_source and, for each share, low_ and high_: what a document of the group may have."""
    small, mid, all_ = (_quartiles(good, keys, p) for keys, p in ((["lang", "source"], "s"), (["lang"], "m"), ([], "a")))
    joined = small.join(mid.withColumnRenamed("lang", "m_lang"), F.col("lang").eqNullSafe(F.col("m_lang"))).join(F.broadcast(all_))  # all_ is one row
    edge = []
    for s, slack in SLACK.items():
        q = [_shrunk(F.col("s_n"), F.col(f"s_{s}")[i], _shrunk(F.col("m_n"), F.col(f"m_{s}")[i], F.col(f"a_{s}")[i], prior), prior) for i in (0, 1)]
        edge += [(q[0] - reach * (q[1] - q[0]) - slack).alias(f"low_{s}"), (q[1] + reach * (q[1] - q[0]) + slack).alias(f"high_{s}")]
    return joined.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *edge)


def judge(docs: DataFrame, reach: float = REACH, prior: float = PRIOR) -> DataFrame:
    """doc_id, the COUNTS, base_failed, kept and failed (the shares out of reach)."""
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    shares = {"symbols": ratio("n_symbols", "word_chars"), "dup_lines": ratio("n_dup_lines", "n_lines"), "repeats": ratio("n_repeat_words", "n_words"), "length": ratio("word_chars", "n_words")}
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    rows = staged(measured(docs), "counts").withColumns(shares).withColumn("base_failed", failed)
    dealt = limits(rows.where("not base_failed"), reach, prior).withColumn("g_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    part = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(PARTS)).cast("int")
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")) & (F.col("part") == F.col("g_part"))
    beyond = lambda s: (F.col(s) < F.col(f"low_{s}")) | (F.col(s) > F.col(f"high_{s}"))
    out = F.filter(F.array(*(F.when(beyond(s), s) for s in SLACK)), lambda x: x.isNotNull())
    judged = rows.withColumn("part", part).join(dealt, same, "left").withColumn("failed", out)
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")


_SHARES_SQL = {"symbols": "n_symbols / nullif(word_chars, 0)", "dup_lines": "n_dup_lines / nullif(n_lines, 0)", "repeats": "n_repeat_words / nullif(n_words, 0)", "length": "word_chars / nullif(n_words, 0)"}


def oracle(reach: float = REACH, prior: float = PRIOR) -> str:
    """The op9 query as SQL, with exact quartiles: the sketch's are exact on tables of some thousand documents."""
    quartiles = lambda p: ", ".join(f"quantile_disc({s}, {q}) as {p}_{s}_{q * 100:.0f}" for s in SLACK for q in (0.25, 0.75))
    shrunk = lambda s, q: f"(s_n * s_{s}_{q} + {prior} * (m_n * m_{s}_{q} + {prior} * a_{s}_{q}) / (m_n + {prior})) / (s_n + {prior})"
    edges = ", ".join(f"{shrunk(s, 25)} as {s}_25, {shrunk(s, 75)} as {s}_75" for s in SLACK)
    beyond = lambda s, slack: f"case when {s} < {s}_25 - {reach} * ({s}_75 - {s}_25) - {slack} or {s} > {s}_75 + {reach} * ({s}_75 - {s}_25) + {slack} then '{s}' end"
    failed = ", ".join(beyond(s, slack) for s, slack in SLACK.items())
    return f"""with t as (
  select doc_id, lang, source, coalesce(text, '') as text, coalesce(regexp_extract_all(text, '{WORD}'), []) as w,
  [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '{WORD}')] as l from documents),
windows as (
  select doc_id, i, array_to_string(w[i:i + {_WINDOW - 1}], ' ') as k from (
    select doc_id, w, unnest(range(1, len(w) - {_WINDOW - 2})) as i from t where len(w) >= {_WINDOW})),
twice as (
  select doc_id, k from windows group by doc_id, k having count(*) > 1),
repeated as (
  select doc_id, count(distinct j) as n from (
    select doc_id, unnest(range(i, i + {_WINDOW})) as j from windows join twice using (doc_id, k)) group by doc_id),
c as (
  select doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum([len(x) for x in w]), 0)::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  coalesce(n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines from t left join repeated using (doc_id)),
r as (
  select *, {", ".join(f"{x} as {s}" for s, x in _SHARES_SQL.items())}, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words as base_failed from c),
a as (select count(*) as a_n, {quartiles("a")} from r where not base_failed),
m as (select lang, count(*) as m_n, {quartiles("m")} from r where not base_failed group by lang),
s as (select lang, source, count(*) as s_n, {quartiles("s")} from r where not base_failed group by lang, source),
limits as (
  select s.lang, s.source, {edges} from s join m on s.lang is not distinct from m.lang, a),
judged as (
  select r.*, [x for x in [{failed}] if x is not null] as failed
  from r left join limits g on r.lang is not distinct from g.lang and r.source is not distinct from g.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and len(failed) = 0 as kept, failed from judged"""
