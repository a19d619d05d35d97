"""Substring dedup by relative Lempel-Ziv parsing: what a document has of earlier documents is removed.

Reference blocks are the surroundings of locally least word runs, cut by content, so that equal passages make equal
blocks. They are indexed by their run and named by all their words; of equal blocks the least document's is the
reference. Only blocks that can hold a factor of a document are looked at, found by the index; parsing every document against every
block grows with the square of the corpus. Where a passage ends within a block, the windows over this boundary are
looked up one by one. From these references a document is parsed greedily, from left to right, each factor the longest
run that one reference has; factors of `length` words or more are the duplicate spans. See spans.py.

Defined cases: words are runs without ASCII white space, unchanged; a null or empty text has no words; rows without a
doc_id are kept whole and are no reference; rows that share a doc_id don't count as earlier than each other; of equal
references (ties) the least document's is taken; an empty table gives an empty result; other columns pass through, whatever their
names, but for those that the result has itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import spans
from .common import WORD

LENGTH, GRAM = 50, 20


def _kept_words(text: bytes, runs: np.ndarray) -> bytes:
    words = text.split()
    if not len(runs):
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for s, e in runs.tolist():
        keep[s:e] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _apply(docs: DataFrame, length: int, digest) -> DataFrame:
    gram = max(1, length * GRAM // LENGTH)
    found = spans.repeats(docs, spans.word_tokens, length, gram)
    return spans.apply(docs, found, lambda text: len(text.split()), spans.cut_words, digest, length, gram)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with n_tokens (words), n_removed, n_spans, n_factors, spans (byte offsets of what goes), factors and kept_text."""
    return _apply(docs, length, None)


def dedup_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with n_tokens, n_removed, n_spans, n_factors and kept_sha256, of the kept words joined by one space."""
    return _apply(docs, length, _kept_words)


def oracle(length: int = LENGTH) -> str:
    """The op2 query as SQL: every window of every text, by its words."""
    return f"""with t as (
  select doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) as w from documents),
windows as (
  select doc_id, i, md5(array_to_string(w[i:i + {length - 1}], ' ')) as k from (
    select doc_id, w, unnest(range(1, len(w) - {length - 2})) as i from t where len(w) >= {length})),
late as (
  select doc_id, i from windows join (select k, min(doc_id) as first from windows group by k) using (k) where doc_id > first),
gone as (
  select distinct doc_id, unnest(range(i, i + {length})) as i from late),
runs as (
  select doc_id, count(*) as n_removed, count(*) filter (before is null or before < i - 1) as n_spans from (
    select doc_id, i, lag(i) over (partition by doc_id order by i) as before from gone) group by doc_id),
words as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from t where len(w) > 0),
kept as (
  select doc_id, string_agg(word, ' ' order by i) as text from words anti join gone using (doc_id, i) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(coalesce(kept.text, '')) as kept_sha256
from t left join runs using (doc_id) left join kept using (doc_id)"""
