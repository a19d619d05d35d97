"""Removal of bytes that are covered by a long string that also starts in an earlier document.

By anchor windows (`spans.py`), not by suffix sorting: locally least 16-byte runs are joined by name, then their
surroundings, then single windows of 50 bytes. `doubling.py` has the distributed prefix doubling that this stands for;
README has the figures for which it is not the query's path.

Defined cases: a text is its UTF-8 bytes, a null text is empty; matches never cross documents; rows without a doc_id are
kept whole and match nothing; rows that share a doc_id don't count as earlier than each other; an empty table gives an
empty result; other columns pass through, whatever their names, but for those that the result has itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import doubling, spans

LENGTH, GRAM = 50, 16


def _kept_bytes(text: bytes, runs: np.ndarray) -> bytes:
    return spans.cut_bytes(text, runs)[1]


def _apply(docs: DataFrame, length: int, digest, doubled: bool = False) -> DataFrame:
    gram = max(1, length * GRAM // LENGTH)
    found = doubling.repeats(docs, length) if doubled else spans.repeats(docs, spans.byte_tokens, length, gram, sources=False)
    return spans.apply(docs, found, len, spans.cut_bytes, digest, length, gram)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with n_tokens (bytes), n_removed, n_spans, n_factors, spans, factors and kept_text (bytes that are no UTF-8 become U+FFFD)."""
    return _apply(docs, length, None)


def dedup_digest(docs: DataFrame, length: int = LENGTH, doubled: bool = False) -> DataFrame:
    """docs with n_tokens, n_removed, n_spans, n_factors and kept_sha256, of the kept bytes; doubled: by prefix doubling."""
    return _apply(docs, length, _kept_bytes, doubled)
