"""Language identification by interpolated Kneser-Ney character models.

One model a language, of orders 1 to ORDER over lower-cased letters with every other run of characters as one space.
The n-grams of all models are one sorted array of hashes an order, with the discounted share of each language beside
it, and so are the contexts with their interpolation weights. A text gets the language of the lowest cross-entropy per
character; it is rejected where that entropy is above what held-back training texts of the language have.

The models are fitted on a sample of SAMPLE_DOCS texts of each language, chosen by a hash of the text, of which a longer
one gives SAMPLE_CHARS characters from its middle; this bounds the driver's work and the size of the models. Every text
is scored whole.

Defined cases: a null text, or one without a letter, is `und` with score 0 and rejected; rows without a language are
not learned from; where no language is learned every text is `und`; equal texts of a language are learned once, but fill the
sample as often as they are there; of languages with one cross-entropy (ties) the first by code point is taken;
other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, least, mix, slices

ORDER, DISCOUNT = 5, 0.75
SAMPLE_DOCS, SAMPLE_CHARS = 400, 5_000
#: A held-back text of a language has at most the largest entropy seen, times this.
MARGIN = 1.35
UND = "und"
#: Inverse temperature, in characters, of the score.
SHARPNESS = 8.0
_OTHER = re.compile(r"[\W\d_]+")


def normal(text: str) -> str:
    return " " * (ORDER - 1) + _OTHER.sub(" ", text.lower()).strip() + " "


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _hash(columns: Iterable[np.ndarray], n: int) -> np.ndarray:
    h = np.zeros(n, np.uint64)
    for c in columns:
        h *= np.uint64(0x100000001B3)
        h += c
        h += np.uint64(1)
    return mix(h)


def _columns(codes: np.ndarray) -> list[np.ndarray]:
    """The characters of each ORDER-gram, by place."""
    n = len(codes) - ORDER + 1
    return [codes[j : j + n] for j in range(ORDER)]


def _grams(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the 0- to ORDER-grams that end where these do."""
    return [_hash(columns[ORDER - k :], len(columns[0])) for k in range(ORDER + 1)]


def _contexts(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of what precedes the last character of each of these n-grams, by n from 1 on."""
    return [np.empty(0, np.uint64), *(_hash(columns[ORDER - k : -1], len(columns[0])) for k in range(1, ORDER + 1))]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value is found, and of each value its number among these."""
    order = np.argsort(h)
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    at = np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at


class Models:
    """The models of several languages."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        parts = [self._fit(texts[x]) for x in self.languages]
        self.floor = 1.0 / max(1, max((p[0] for p in parts), default=1))
        self.grams, self.shares, self.contexts, self.weights = [], [], [], []
        for k in range(ORDER):
            for keys, values, which, rest in ((self.grams, self.shares, 1, 0.0), (self.contexts, self.weights, 2, 1.0)):
                every = np.unique(np.concatenate([p[which][k][0] for p in parts] or [np.empty(0, np.uint64)]))
                table = np.full((len(every), len(parts)), rest, np.float32)
                for i, p in enumerate(parts):
                    table[np.searchsorted(every, p[which][k][0]), i] = p[which][k][1]
                keys.append(every)
                values.append(table)
        self.most = np.full(len(parts), np.inf)

    @staticmethod
    def _fit(texts: list[str]) -> tuple[int, list, list]:
        """Number of characters; by order the n-grams' discounted shares and the contexts' weights."""
        columns = [np.concatenate(x) for x in zip(*(_columns(_codes(normal(t))) for t in texts), strict=True)]
        grams, contexts = _grams(columns), _contexts(columns)
        shares, weights, whole = [None] * ORDER, [None] * ORDER, None
        for k in range(ORDER, 0, -1):
            keys, first, counts = np.unique(grams[k], return_index=True, return_counts=True)
            if whole is not None:  # below the highest order it counts in how many longer n-grams this one ends
                counts = np.bincount(np.searchsorted(keys, grams[k][whole]), minlength=len(keys))
            own, at = np.unique(contexts[k][first], return_inverse=True)
            total, kinds = np.bincount(at, counts), np.bincount(at)
            shares[k - 1] = (keys, np.maximum(counts - DISCOUNT, 0) / total[at])
            weights[k - 1] = (own, np.minimum(1.0, DISCOUNT * kinds / total))
            whole = first
        return len(shares[0][0]), shares, weights

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Nats a character of each normalised text (rows) by each language (columns)."""
        codes = _codes("".join(texts))
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        columns = _columns(codes)
        first, at = _distinct(_hash(columns, len(columns[0])))
        columns = [c[first] for c in columns]
        grams, contexts = _grams(columns), _contexts(columns)
        p = np.full((len(first), len(self.languages)), self.floor, np.float32)
        for k in range(1, ORDER + 1):
            for keys, values, wanted, add in ((self.contexts[k - 1], self.weights[k - 1], contexts[k], False), (self.grams[k - 1], self.shares[k - 1], grams[k], True)):
                i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[i] == wanted
                if add:
                    p[hit] += values[i[hit]]
                else:
                    p[hit] *= values[i[hit]]
        logs = np.log(p)
        sums = np.zeros((len(texts), len(self.languages)))
        for i, (s, e) in enumerate(zip(starts.tolist(), (ends - ORDER + 1).tolist(), strict=True)):
            sums[i] = logs[at[s:e]].sum(0, dtype=np.float64)
        return -sums / (ends - starts - ORDER + 1)[:, None]

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        """Set what each language's own texts have at most."""
        for i, x in enumerate(self.languages):
            if texts.get(x):
                self.most[i] = MARGIN * self.entropies([normal(t) for t in texts[x]])[:, i].max()

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is accepted."""
        names, score, taken = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        normed = [normal(t) if t else "" for t in texts]
        some = [i for i, t in enumerate(normed) if any(map(str.isalpha, t))]
        if some and self.languages:
            h = self.entropies([normed[i] for i in some])
            best = h.argmin(1)
            low = h[np.arange(len(some)), best]
            score[some] = 1 / np.exp(SHARPNESS * (low[:, None] - h)).sum(1)
            taken[some] = low <= self.most[best]
            for i, b in zip(some, best.tolist(), strict=True):
                names[i] = self.languages[b]
        return names, score, taken


def fit(labelled: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Models:
    """text, lang of rows to learn from -> models. A fifth of the sample is held back for calibration.

    The driver gets `docs` texts of each language at most, and of each `chars` characters, from its middle if it has more.
    """
    rows = labelled.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("t"))
    few = least(rows.select("lang", "t"), "lang", [F.xxhash64("t", F.lit(1)), F.col("t")], docs)
    few = few.select(F.col("lang").alias("l"), F.col("t").alias("f")).distinct()
    chosen = rows.join(F.broadcast(few), (F.col("lang") == F.col("l")) & (F.col("t") == F.col("f")))
    middle = F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - chars) / 2) + 1).cast("int"), F.lit(chars))
    texts: dict[str, list[str]] = {}
    for r in chosen.groupBy("lang", "t").agg(F.min(middle).alias("text")).orderBy("lang", "t").collect():
        if any(map(str.isalpha, r.text)):
            texts.setdefault(r.lang, []).append(r.text)
    learn = {x: [t for i, t in enumerate(ts) if i % 5 or len(ts) < 5] for x, ts in texts.items()}
    models = Models(learn)
    models.calibrate({x: ts[::5] if len(ts) >= 5 else [] for x, ts in texts.items()})
    return models


def identify(docs: DataFrame, models: Models, keep: list[str] | None = None) -> DataFrame:
    """All columns of docs (or those of keep) and lang_pred, score, accepted; columns of these names are replaced."""
    plain = docs.drop("lang_pred", "score", "accepted")
    given, shared = plain.columns if keep is None else keep, docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE_BYTES // 4):  # n-grams of all orders take a hundred times the text
            names, score, taken = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), pa.array(names), pa.array(score), pa.array(taken)], [*given, "lang_pred", "score", "accepted"])

    fields = T.StructType([plain.schema[c] for c in given]).add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return plain.mapInArrow(run, fields)


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(False))
