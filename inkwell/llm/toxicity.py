"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word comes in twice: as an embedding of its hash, and as the mean of embeddings of its character n-grams of three and
four bytes, with the highest log-odds of label 1 that one of them has among the training texts. Windows of
WINDOW words overlap by half and cover the whole text; a text's score is that of its worst window, calibrated on the
training texts. The network is fitted on SAMPLE texts of label 1 and CLEAN of label 0, of CHARS characters at most, chosen by a hash of
the id, by turns finding each text's worst window and descending on it; word embeddings start with the smoothed
log-odds of the classes, as one of their coordinates.

Defined cases: a null text, or one without a word, has the score of an empty window; null labels are not learned from;
an id with both labels is learned with both; with one class or none the scores are the share of label 1 (one half without
labels); rows that share a doc_id are scored each by its own text, and the least of their texts is learned; equal texts have equal scores, and windows
that tie count alike; other columns may have any name but score, which is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans
from .common import least, mix, slices, texts_of

WINDOW, STRIDE, HIDDEN, DIM, ATTEND = 32, 16, 8, 8, 8
WORDS, GRAMS = 1 << 16, 1 << 16
INPUT = 2 * DIM + 1
SAMPLE, CLEAN, CHARS = 1000, 2000, 20_000
ROUNDS, BATCH, RATE, SEED = 6, 128, 0.01, 7
#: Texts that are added to either class for the log-odds.
SMOOTH = 5
#: Windows that are scored at once.
CHUNK = 4096
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters (all that isn't ASCII counts as one)."""
    return text.translate(_LETTERS).lower().split()


class Batch:
    """The words of some texts, and windows over them: rows of word numbers, -1 beyond the text."""

    def __init__(self, texts: list[bytes]):
        seen: dict[bytes, int] = {}
        ids = [np.array([seen.setdefault(w, len(seen)) for w in words_of(t)], np.int64) for t in texts]
        rows, self.doc = [], []
        for i, x in enumerate(ids):
            n = len(x)
            if n < WINDOW:
                x = np.r_[x, np.full(WINDOW - n, -1)]
            starts = np.unique(np.minimum(np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE), max(0, n - WINDOW)))
            rows.append(np.lib.stride_tricks.sliding_window_view(x, WINDOW)[starts])
            self.doc.append(np.full(len(starts), i))
        self.windows, self.doc = np.concatenate(rows), np.concatenate(self.doc)
        joined = b" " + b" ".join(seen) + b" "
        self.words = (spans.word_tokens(joined) >> np.uint64(20)) % np.uint64(WORDS) if seen else np.empty(0, np.uint64)
        self.words = self.words.astype(np.int64)
        raw = np.frombuffer(joined + b" ", np.uint8).astype(np.uint64)
        inside = np.flatnonzero(raw[1:-2] != 32) + 1
        three = (raw[inside - 1] << np.uint64(16)) + (raw[inside] << np.uint64(8)) + raw[inside + 1]
        four = (three << np.uint64(8)) + raw[inside + 2] + np.uint64(1 << 40)
        self.grams = (mix(np.stack([three, four], 1).ravel()) % np.uint64(GRAMS)).astype(np.int64)
        length = 2 * np.array([len(w) for w in seen], np.int64)
        self.first, self.length = np.cumsum(length) - length, length


    def part(self, rows: np.ndarray) -> "Batch":
        """Some windows and their words alone."""
        out = Batch.__new__(Batch)
        used, at = np.unique(self.windows[rows], return_inverse=True)
        out.windows = at.reshape(len(rows), WINDOW) - int(used[0] < 0)
        used = used[used >= 0]
        out.doc, out.words, out.length = self.doc[rows], self.words[used], self.length[used]
        out.first = np.cumsum(out.length) - out.length
        out.grams = self.grams[np.arange(out.length.sum()) + np.repeat(self.first[used] - out.first, out.length)]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        make = lambda *shape, scale=0.3: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": make(WORDS, DIM, scale=0.02), "gram": make(GRAMS, DIM, scale=0.05), "att": make(2 * HIDDEN, ATTEND), "pick": make(ATTEND), "out": make(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        self.odds = np.zeros(GRAMS, np.float32)
        for d in "fb":
            self.p |= {f"x{d}": make(INPUT, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": make(HIDDEN, 2 * HIDDEN), f"n{d}": make(HIDDEN, HIDDEN)}
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, b: Batch) -> np.ndarray:
        if not len(b.words):
            return np.zeros((1, INPUT), np.float32)
        chars = np.add.reduceat(self.p["gram"][b.grams], b.first, axis=0) / b.length[:, None]
        worst = np.maximum.reduceat(self.odds[b.grams], b.first)[:, None]
        return np.concatenate([self.p["word"][b.words], chars, worst], axis=1).astype(np.float32)

    def forward(self, x: np.ndarray, w: np.ndarray, keep: bool = False):
        """x: inputs of words, w: windows -> logits; keep: and what backward() needs."""
        p, h, there = self.p, HIDDEN, (w >= 0)
        out = np.zeros((len(w), WINDOW, 2 * h), np.float32)
        saved = {}
        for d, steps in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            given = x @ p[f"x{d}"] + p[f"c{d}"]
            s = np.zeros((len(w), h), np.float32)
            u, n = p[f"u{d}"], p[f"n{d}"]
            for t in steps:
                g, on = given[np.maximum(w[:, t], 0)], there[:, t, None]
                zr = _sigmoid(g[:, : 2 * h] + s @ u)
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h :] + (r * s) @ n)
                new = np.where(on, c + z * (s - c), s)
                if keep:
                    saved[d, t] = (s, z, r, c)
                s = new
                out[:, t, h * (d == "b") : h * (1 + (d == "b"))] = s
        a = np.tanh(out @ p["att"])
        e = np.where(there, a @ p["pick"], -1e9)
        e[:, 0] = np.where(there.any(1), e[:, 0], 0)
        e = np.exp(e - e.max(1, keepdims=True))
        e /= e.sum(1, keepdims=True)
        pooled = (e[..., None] * out).sum(1)
        logit = pooled @ p["out"] + p["bias"]
        return (logit, (out, a, e, pooled, saved)) if keep else logit

    def backward(self, b: Batch, x: np.ndarray, w: np.ndarray, kept, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        p, h, there = self.p, HIDDEN, w >= 0
        out, a, e, pooled, saved = kept
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        g["out"], g["bias"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dpool = dlogit[:, None] * p["out"]
        de = (out * dpool[:, None]).sum(2)
        ds = e * (de - (e * de).sum(1, keepdims=True)) * there
        g["pick"] = np.einsum("btk,bt->k", a, ds)
        da = ds[..., None] * p["pick"] * (1 - a * a)
        g["att"] = np.einsum("bti,btk->ik", out, da)
        dout = e[..., None] * dpool[:, None] + da @ p["att"].T
        dx = np.zeros_like(x)
        for d, steps in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            u, n, dgiven = p[f"u{d}"], p[f"n{d}"], np.zeros((len(x), 3 * h), np.float32)
            dh = np.zeros((len(w), h), np.float32)
            for t in steps:
                s, z, r, c = saved[d, t]
                dh = dh + dout[:, t, h * (d == "b") : h * (1 + (d == "b"))]
                on = there[:, t, None]
                dn = dh * on
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (s - c) * z * (1 - z)
                drs = dc @ n.T
                dr = drs * s * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                g[f"n{d}"] += (r * s).T @ dc
                g[f"u{d}"] += s.T @ dzr
                np.add.at(dgiven, np.maximum(w[:, t], 0), np.concatenate([dzr, dc], 1))
                dh = np.where(on, dn * z + drs * r + dzr @ u.T, dh)
            g[f"x{d}"], g[f"c{d}"] = x.T @ dgiven, dgiven.sum(0)
            dx += dgiven @ p[f"x{d}"].T
        if len(b.words):
            touched = np.unique(w[w >= 0])
            g["word"] = (b.words[touched], dx[touched, :DIM])
            owner = np.repeat(np.arange(len(b.words)), b.length)
            some = np.isin(owner, touched)
            g["gram"] = (b.grams[some], (dx[:, DIM : 2 * DIM] / b.length[:, None])[owner[some]])
        return g

    def step(self, g: dict, state: dict, rate: float) -> None:
        """Adam for what is dense, and scaled descent (Adagrad) for the embeddings that were met."""
        state["n"] = state.get("n", 0) + 1
        for k, d in g.items():
            if isinstance(d, tuple):
                rows, at = np.unique(d[0], return_inverse=True)
                sums = np.zeros((len(rows), DIM), np.float32)
                np.add.at(sums, at, d[1])
                v = state.setdefault(k, np.full(self.p[k].shape, 1e-4, np.float32))
                v[rows] += sums * sums
                self.p[k][rows] -= rate * sums / np.sqrt(v[rows])
            else:
                m, v = state.setdefault(k, [np.zeros_like(d), np.zeros_like(d)])
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                self.p[k] -= rate * (m / (1 - 0.9 ** state["n"])) / (np.sqrt(v / (1 - 0.999 ** state["n"])) + 1e-8)

    def worst(self, b: Batch, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each of n texts the highest logit, and the window that has it."""
        x = self.inputs(b)
        logits = np.concatenate([self.forward(x, b.windows[i : i + CHUNK]) for i in range(0, len(b.windows), CHUNK)])
        order = np.lexsort((logits, b.doc))
        last = np.flatnonzero(np.r_[b.doc[order][1:] != b.doc[order][:-1], True])
        return logits[order][last], order[last]

    def train(self, texts: list[bytes], labels: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> None:
        """labels: 0 or 1 of each text."""
        share = float(labels.mean()) if len(labels) else 0.5
        if not 0 < labels.sum() < len(labels):
            self.slope, self.shift = 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))
            return
        b, r, state = Batch(texts), np.random.default_rng(seed), {}
        seen, grams = np.zeros((2, WORDS)), np.zeros((2, GRAMS))
        pairs = np.unique((b.doc[:, None] << 32 | b.windows)[b.windows >= 0])
        pairs = np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1)
        for y in (0, 1):
            own = pairs[labels[pairs[:, 0]] == y]
            seen[y] = np.bincount(b.words[own[:, 1]], minlength=WORDS)
            size = b.length[own[:, 1]]
            at = np.arange(size.sum()) + np.repeat(b.first[own[:, 1]] - np.cumsum(size) + size, size)
            grams[y] = np.bincount(np.unique(np.repeat(own[:, 0], size) * GRAMS + b.grams[at]) % GRAMS, minlength=GRAMS)
        odds = lambda x: np.log((x[1] + SMOOTH) / (x[0] * labels.sum() / (len(labels) - labels.sum()) + SMOOTH))
        self.p["word"][:, 0], self.odds = odds(seen), odds(grams).astype(np.float32)
        weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
        for k in range(rounds):
            _, at = self.worst(b, len(texts))
            extra = np.flatnonzero(labels[b.doc] == 0)
            extra = r.choice(extra, min(len(extra), len(texts) // 2), replace=False)
            rows = np.concatenate([at, extra])
            rows = rows[r.permutation(len(rows))]
            for i in range(0, len(rows), BATCH):
                some = b.part(rows[i : i + BATCH])
                x = self.inputs(some)
                logit, kept = self.forward(x, some.windows, keep=True)
                d = (_sigmoid(logit) - labels[some.doc]) * weight[some.doc] / len(some.doc)
                self.step(self.backward(some, x, some.windows, kept, d.astype(np.float32)), state, RATE * (1 - k / rounds / 1.2))
        logit, _ = self.worst(b, len(texts))
        self._calibrate(logit.astype(np.float64), labels)

    def _calibrate(self, logit: np.ndarray, labels: np.ndarray) -> None:
        """A logistic fit of the labels on the texts' logits, by Newton's method with a slight pull to a slope of 1."""
        q = np.array([1.0, 0.0])
        f = np.stack([logit, np.ones_like(logit)], 1)
        for _ in range(30):
            y = _sigmoid(f @ q)
            grad = f.T @ (y - labels) + 1e-1 * (q - [1.0, 0.0])
            q = q - np.linalg.solve((f * (y * (1 - y))[:, None]).T @ f + 1e-1 * np.eye(2), grad).clip(-2, 2)
        self.slope, self.shift = max(float(q[0]), 0.05), float(q[1])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logit, _ = self.worst(Batch(texts), len(texts))
        return _sigmoid(self.slope * logit.astype(np.float64) + self.shift)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, clean: int = CLEAN, chars: int = CHARS) -> Network:
    """docs (doc_id, text), labels (doc_id, toxic) of rows to learn from.

    The driver gets `sample` texts of label 1 and `clean` of label 0 at most: one for each labelled id, the least of those
    that share it, and `chars` characters of each, from its middle if it has more.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic").distinct()
    few = [least(known.where(F.col("toxic") == y), "toxic", [F.xxhash64("doc_id"), F.col("doc_id")], n).select("doc_id", "toxic") for y, n in ((0, clean), (1, sample))]
    met = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(few[0].unionByName(few[1])), "doc_id")
    middle = F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - chars) / 2) + 1).cast("int"), F.lit(chars))
    rows = met.groupBy("doc_id", "toxic").agg(F.min(middle).alias("text")).orderBy("doc_id", "toxic").collect()
    net = Network()
    net.train([r.text.encode("utf-8", "replace") for r in rows], np.array([r.toxic for r in rows], np.int64))
    return net


def score(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """All columns of docs (or those of keep) and score; a column of this name is replaced."""
    plain = docs.drop("score")
    given, shared = plain.columns if keep is None else keep, docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), pa.array(shared.value.scores(texts_of(batch)))], [*given, "score"])

    return plain.mapInArrow(run, T.StructType([plain.schema[c] for c in given]).add("score", "double"))
