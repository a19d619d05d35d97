"""Runs of tokens that an earlier document has too: the search behind substring and suffix-array dedup.

A window is `length` tokens of one document, and a token is removed if a window over it also starts in a document with
a smaller doc_id. Tokens have 64-bit names, and names of runs come from them by doubling (`Names`). Rounds, each a sort
of names by Spark:

1. Anchors: of the `gram`-token runs of every window the one with the least name. Equal windows have equal anchors, so
   runs that no other document names the same are dropped, and with them all that is unique.
2. Reference blocks: an anchor with its surroundings (all windows over it) is a block, and the block of the least
   document that has it is its reference. A later document has the whole block from there.
   A window that another document has reaches half of its rest beyond the anchor at one side at least; anchors whose
   names up to there are unique at both sides are dropped.
3. What stays (the ends of repeats) is judged window by window, by the pair of the names of its halves; each window
   is looked up by its own anchor only, and its reference is the least document's window.

Then every document is parsed: from left to right into the longest factors that one reference has (`parse`).

A slice of documents resolves what it can by itself before each round, and an anchor that many of its documents have in
different surroundings goes straight to the third round, so that a hot passage weighs no more than the slices that
have it. A wrong match needs equal names of 104 bits (blocks) or 96 bits (windows), or two words of one 64-bit name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, mix, slices, staged, texts_of

#: Position in the low bits; above it a hash of the text, as rows may share a doc_id; then whether the
#: anchor is open, or stands for others that are.
AT_BITS, OPEN, CROWDED = 40, 1 << 62, 1 << 61
#: Documents of a slice that may have an anchor in different surroundings and still bring it to the second round.
HOT = 32
#: Key of the words' hashes.
SEED = 0x1F3A5C79
#: Bits of a side's name; those of the surroundings' are above.
SIDE = 12
_LEFT, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of two runs, one behind the other -> the name of both. Shifts keep sums of names from cancelling out."""
    x = a * _LEFT
    x += b
    x ^= x >> np.uint64(29)
    x *= _SPREAD
    x ^= x >> np.uint64(32)
    return x


class Names:
    """Names of all runs of a token sequence, by doubling: the name of 2**k tokens joins the names of its halves.

    Tokens of one byte are put side by side while they fit into a name.
    """

    def __init__(self, tokens: np.ndarray, most: int):
        self.n, self.levels = len(tokens), [tokens.astype(np.uint64)]
        while 2 << (len(self.levels) - 1) <= min(most, self.n):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            if tokens.dtype == np.uint8 and half < 8:
                self.levels.append(last[:-half] << np.uint64(8 * half) | last[half:])
            else:
                self.levels.append(_join(last[:-half], last[half:]))

    def of(self, start: np.ndarray, size: int) -> np.ndarray:
        """Names of the runs of `size` tokens that begin at start: two overlapping runs of a power of two, joined."""
        k = size.bit_length() - 1
        level = self.levels[k]
        return _join(level[start] + np.uint64(size), level[start + (size - (1 << k))])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of the runs [start, end), of any sizes."""
        out, size = np.empty(len(start), np.uint64), end - start
        for m in np.unique(size).tolist():
            own = size == m
            out[own] = self.of(start[own], m)
        return out

    def every(self, size: int) -> np.ndarray:
        """Names of the runs of `size` tokens at every place."""
        k = size.bit_length() - 1
        level, last = self.levels[k], self.n - size + 1
        return _join(level[:last] + np.uint64(size), level[size - (1 << k) :][:last])


def _sliding(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(names: Names, length: int, gram: int) -> np.ndarray:
    """Starts of the runs that have the least name in some window, ascending."""
    if names.n < length:
        return np.empty(0, np.int64)
    g, width = names.every(gram), length - gram + 1
    least = _sliding(np.minimum, g, width)
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_sliding(np.maximum, np.concatenate([pad, least, pad]), width) == g)


def windows_of(names: Names, given: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Starts of the windows that have one of these anchors as theirs and hold no side that is unique.

    given: four times the anchor, and 1 if its left side is shared, 2 if its right side is.
    """
    at, left, right = given >> 2, (given & 1 > 0)[:, None], (given & 2 > 0)[:, None]
    around = length - gram
    side, back = (around + 1) // 2, np.arange(around + 1)
    g, width = names.every(gram), length - gram + 1
    least = _sliding(np.minimum, g, width)
    start = at[:, None] - back
    fits = (start >= 0) & (start < len(least)) & (left | (back < side)) & (right | (around - back < side))
    start, own = start[fits], np.broadcast_to(at[:, None], fits.shape)[fits]
    return np.unique(start[least[start] == g[own]])


def byte_tokens(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = ~_GAP[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_tokens(text: bytes) -> np.ndarray:
    """A keyed 64-bit hash of each word's bytes."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(SEED)), np.uint64, len(words))


Tokens = Callable[[bytes], np.ndarray]


def keys(docs: DataFrame) -> DataFrame:
    """doc_id, salt, text of the rows that can have a repeat; the salt tells rows that share a doc_id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id is not null and text is not null").withColumn("salt", _salt())


def _salt():
    return F.shiftrightunsigned(F.xxhash64(F.col("text").cast("string")), AT_BITS + 3)


def _owners(doc: np.ndarray, at: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Of each row the row of the least document that has the same names."""
    order = np.lexsort((at, doc, *same))
    first = np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in same], axis=0)]
    owner = np.empty(len(doc), np.int64)
    owner[order] = order[first][np.cumsum(first) - 1]
    return owner


def _crowded(key: np.ndarray, doc: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of these rows those whose key more than HOT have, without and with the key's first and last document."""
    order = rows[np.lexsort((doc[rows], key[rows]))]
    edge = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True])
    large = np.flatnonzero(np.diff(edge) > HOT) if len(rows) else []
    groups = [order[edge[i] : edge[i + 1]] for i in large]
    inner = [g[(doc[g] != doc[g[0]]) & (doc[g] != doc[g[-1]])] for g in groups]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *inner]), np.concatenate([none, *groups])


def _lone(at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Names that no other row has, for rows that need no other."""
    return mix(at.astype(np.uint64) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _table(names: list[str], columns: list[np.ndarray], late: np.ndarray, sources: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of a round; sources: src and src_at of the late ones, or nothing."""
    columns = columns + [np.where(late, x, 0) for x in sources]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), [*names, "doc_id", "at", *("src", "src_at")[: len(sources)]])


def _rows(names: str, sources: bool) -> str:
    return f"{names}, doc_id long, at long" + (", src long, src_at long" if sources else "")


def _sourced(rows: DataFrame, sources: bool, *same: str) -> DataFrame:
    """rows with first (the least document of those with the same names) and src and src_at (0 without sources)."""
    own, names = F.col("at") < 0, Window.partitionBy(*same)
    if not sources:
        return rows.withColumn("first", F.min("doc_id").over(names)).withColumns({"src": F.lit(0).cast("long"), "src_at": F.lit(0).cast("long")})
    least = rows.withColumn("least", F.min(F.struct("doc_id", "at")).over(names)).withColumn("first", F.col("least.doc_id"))
    given = lambda mine, other: F.when(own, F.col(mine)).otherwise(F.col(f"least.{other}"))
    return least.withColumns({"src": given("src", "doc_id"), "src_at": given("src_at", "at")}).drop("least")


def _round_one(keyed: DataFrame, tokens: Tokens, length: int, gram: int, sources: bool) -> DataFrame:
    """key, ctx, doc_id, at, src, src_at: the anchors. What an earlier document of the same slice has with its
    surroundings is a repeat already, of the anchor src_at of the document src, and has a negative at; what is crowded
    is open already."""
    around = length - gram
    side, below = (around + 1) // 2, np.uint64((1 << SIDE) - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 * SLICE_BYTES):
            parts = []
            for text, doc, salt in zip(texts_of(batch), batch.column("doc_id").to_numpy(), batch.column("salt").to_numpy(), strict=True):
                if len(text) < length:
                    continue
                names = Names(tokens(text), gram + 2 * around)
                at = anchors(names, length, gram)
                if len(at):
                    low, high = np.maximum(at - around, 0), np.minimum(at + gram + around, names.n)
                    ctx = (names.between(low, high) ^ (at - low).astype(np.uint64)) << np.uint64(2 * SIDE)
                    ctx |= (names.between(np.maximum(at - side, 0), at + gram) & below) << np.uint64(SIDE)
                    ctx |= names.between(at, np.minimum(at + gram + side, names.n)) & below
                    parts.append((names.of(at, gram), ctx, np.full(len(at), doc), at | (int(salt) << AT_BITS)))
            if not parts:
                continue
            key, ctx, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            owner = _owners(doc, at, ctx, key)
            late, src, src_at = doc > doc[owner], doc[owner], at[owner]
            crowd, whole = _crowded(key, doc, np.flatnonzero(~late))
            at[whole] |= CROWDED
            own = late.copy()
            own[crowd] = True
            key = np.where(own, _lone(at, doc), key)
            at[crowd] |= OPEN
            yield _table(["key", "ctx"], [key.view(np.int64), ctx.view(np.int64), doc, np.where(late, -1 - at, at)], late, [src, src_at] if sources else [])

    return keyed.mapInArrow(run, _rows("key long, ctx long", sources))


def _place() -> Column:
    return F.struct("at", "src", "src_at")


def _round_two(found: DataFrame, sources: bool) -> DataFrame:
    """doc_id, salt, done (anchors whose surroundings are repeats, and of what), open (anchors to be judged window by window)."""
    all_ = Window.partitionBy("key")
    judged = _sourced(found, sources, "key", "ctx")
    judged = judged.withColumns({"low": F.min("doc_id").over(all_), "high": F.max("doc_id").over(all_), "one": F.min("ctx").over(all_) == F.max("ctx").over(all_)})
    sure = (F.col("at") < 0) | (F.col("at") >= OPEN)
    judged = judged.where(sure | (F.col("low") < F.col("high"))).withColumn("late", (F.col("at") < 0) | (F.col("doc_id") > F.col("first")))
    mask = F.lit((1 << SIDE) - 1)
    sides = {"l": F.shiftright("ctx", SIDE).bitwiseAND(mask), "r": F.col("ctx").bitwiseAND(mask)}
    judged = judged.where(sure | F.col("late") | ~F.col("one")).withColumns(sides)
    shared = [F.min("doc_id").over(w) < F.max("doc_id").over(w) for w in (Window.partitionBy("key", "l"), Window.partitionBy("key", "r"))]
    crowded = F.max((F.col("at") > 0) & (F.col("at").bitwiseAND(F.lit(CROWDED)) != 0)).over(all_)
    judged = judged.withColumn("near_c", crowded).withColumn("near_l", shared[0]).withColumn("near_r", shared[1])
    judged = judged.where(sure | F.col("late") | F.col("near_c") | F.col("near_l") | F.col("near_r"))
    bare = F.lit(CROWDED - 1)
    plain = F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).bitwiseAND(bare)
    both = (F.col("at") >= OPEN) | F.col("near_c")
    near = F.when(both, 3).otherwise(F.col("near_l").cast("int") + 2 * F.col("near_r").cast("int"))
    low = F.lit((1 << AT_BITS) - 1)
    judged = judged.select("doc_id", plain.alias("whole"), "late", near.alias("near"), "src", F.col("src_at").bitwiseAND(low).alias("src_at"))
    judged = judged.withColumn("at", F.col("whole").bitwiseAND(low))
    judged = judged if sources else judged.withColumn("src_at", F.col("at"))
    return judged.groupBy("doc_id", F.shiftright("whole", AT_BITS).alias("salt")).agg(
        F.collect_list(F.when(F.col("late"), _place())).alias("done"), F.collect_list(F.when(~F.col("late"), 4 * F.col("at") + F.col("near"))).alias("open")
    )


def _round_three(keyed: DataFrame, two: DataFrame, tokens: Tokens, length: int, gram: int, sources: bool) -> DataFrame:
    """doc_id, salt, starts: the windows over open anchors that an earlier document has too, and where it has them."""
    half = length // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = []
            open_ = batch.column("open")
            for i, (text, doc, salt) in enumerate(zip(texts_of(batch), batch.column("doc_id").to_numpy(), batch.column("salt").to_numpy(), strict=True)):
                names = Names(tokens(text), length)
                start = windows_of(names, open_[i].values.to_numpy(), length, gram)
                parts.append((names.of(start, half), names.of(start + half, length - half), np.full(len(start), doc), start | (int(salt) << AT_BITS)))
            a, b, doc, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(start):
                continue
            owner = _owners(doc, start, b, a)
            late, src, src_at = doc > doc[owner], doc[owner], start[owner]
            a = np.where(late, _lone(start, doc), a)
            b &= np.uint64(0xFFFFFFFF)  # 96 bits name a window; what is left out would not compress
            yield _table(["a", "b"], [a.view(np.int64), b.view(np.int64), doc, np.where(late, -1 - start, start)], late, [src, src_at] if sources else [])

    open_ = two.where(F.size("open") > 0).select("doc_id", "salt", "open")
    windows = keyed.join(open_, ["doc_id", "salt"]).mapInArrow(run, _rows("a long, b long", sources))
    own, low = F.col("at") < 0, F.lit((1 << AT_BITS) - 1)
    judged = _sourced(windows, sources, "a", "b").where(own | (F.col("doc_id") > F.col("first")))
    judged = judged.select("doc_id", F.when(own, -1 - F.col("at")).otherwise(F.col("at")).alias("whole"), "src", F.col("src_at").bitwiseAND(low).alias("src_at"))
    judged = judged.withColumn("at", F.col("whole").bitwiseAND(low))
    judged = judged if sources else judged.withColumn("src_at", F.col("at"))
    return judged.groupBy("doc_id", F.shiftright("whole", AT_BITS).alias("salt")).agg(F.collect_list(_place()).alias("starts"))


def _places(found: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """at, src, src_at of a list of places, empty for null."""
    if not found.is_valid:
        return (np.empty(0, np.int64),) * 3
    return tuple(found.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))


#: start, end, source document, place in it
Factors = list[tuple[int, int, int, int]]


def parse(n: int, done: pa.Scalar, starts: pa.Scalar, length: int, gram: int) -> Factors:
    """The greedy parse of a document of n tokens relative to its references.

    From left to right, a factor is the longest run, from where the last one ended, that one reference document has;
    what no reference has is between factors. Every factor reaches over a window of `length` tokens.
    """
    around = length - gram
    a, a_src, a_from = _places(done)
    w, w_src, w_from = _places(starts)
    low = np.concatenate([np.maximum(a - around, 0), w])
    if not len(low):
        return []
    high = np.concatenate([np.minimum(a + gram + around, n), w + length])
    src, shift = np.concatenate([a_src, w_src]), np.concatenate([a_from - a, w_from - w])
    order = np.lexsort((low, shift, src))
    low, high, src, shift = low[order], high[order], src[order], shift[order]
    apart = np.cumsum(np.r_[False, (src[1:] != src[:-1]) | (shift[1:] != shift[:-1])]) * (n + 1)  # runs of one reference lie together
    high = np.maximum.accumulate(high + apart) - apart
    new = np.r_[True, low[1:] + apart[1:] > high[:-1] + apart[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(high) - 1]
    runs = sorted(zip(low[new].tolist(), high[last].tolist(), src[new].tolist(), shift[new].tolist(), strict=True))
    out, at, i, best = [], 0, 0, None
    while True:
        while i < len(runs) and runs[i][0] <= at:
            if best is None or runs[i][1] > best[1]:
                best = runs[i]
            i += 1
        if best is not None and best[1] > at:
            out.append((at, best[1], best[2], at + best[3]))
            at = best[1]
        elif i < len(runs):
            at = runs[i][0]
        else:
            return out


def removed_runs(factors: Factors) -> np.ndarray:
    """Factors -> maximal removed runs."""
    if not factors:
        return np.empty((0, 2), np.int64)
    edge = np.array(factors, np.int64)[:, :2]
    new = np.r_[True, edge[1:, 0] > edge[:-1, 1]]
    return np.stack([edge[new, 0], edge[np.r_[np.flatnonzero(new)[1:] - 1, len(edge) - 1], 1]], 1)


def repeats(docs: DataFrame, tokens: Tokens, length: int, gram: int, sources: bool = True) -> DataFrame:
    """doc_id, salt, done, starts for the documents that repeat something. Without sources all references count as one."""
    keyed = keys(docs)
    two = staged(_round_two(_round_one(keyed, tokens, length, gram, sources), sources), "anchors")
    three = staged(_round_three(keyed, two, tokens, length, gram, sources), "windows")
    return two.select("doc_id", "salt", "done").join(three, ["doc_id", "salt"], "full").where("size(done) > 0 or size(starts) > 0")


#: (text, runs) -> (spans of bytes, bytes that are kept)
Cut = Callable[[bytes, np.ndarray], tuple[np.ndarray, bytes]]


def cut_bytes(text: bytes, runs: np.ndarray) -> tuple[np.ndarray, bytes]:
    return runs, b"".join(text[s:e] for s, e in zip(np.r_[0, runs[:, 1]].tolist(), [*runs[:, 0].tolist(), len(text)], strict=True))


def cut_words(text: bytes, runs: np.ndarray) -> tuple[np.ndarray, bytes]:
    """From the first removed word to the word after the last."""
    start, _ = word_bounds(text)
    edge = np.r_[start, len(text)]
    spans = edge[runs]
    return spans, cut_bytes(text, spans)[1]


_COUNTS = ("n_tokens", "n_removed", "n_spans", "n_factors")
_FACTORS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "source", "source_start")]))


def apply(docs: DataFrame, found: DataFrame, count: Callable[[bytes], int], cut: Cut, digest: Callable[[bytes, np.ndarray], bytes] | None, length: int, gram: int) -> DataFrame:
    """All columns of docs and n_tokens, n_removed, n_spans, n_factors, and either kept_sha256 of what digest makes or spans
    (byte offsets), factors (in tokens) and kept_text. Columns of these names are replaced; others may have any name."""
    added = [(n, T.LongType()) for n in _COUNTS]
    added += [("kept_sha256", T.StringType())] if digest else [("spans", T.ArrayType(T.ArrayType(T.LongType()))), ("factors", _FACTORS), ("kept_text", T.StringType())]
    plain = docs.drop(*(n for n, _ in added))
    others = [c for c in plain.columns if c != "text"]
    packed = plain.select(F.struct(*(plain[f"`{c}`"] for c in others)).alias("row"), F.col("text"), F.col("doc_id").cast("long").alias("doc"), _salt().alias("salted"))
    joined = packed.join(found, (F.col("doc") == F.col("doc_id")) & (F.col("salted") == F.col("salt")), "left").select("row", "text", "done", "starts")
    schema = T.StructType([*joined.schema.fields[:2], *(T.StructField(n, t) for n, t in added)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            done, starts = batch.column("done"), batch.column("starts")
            for i, text in enumerate(texts_of(batch)):
                n = count(text)
                factors = parse(n, done[i], starts[i], length, gram)
                runs = removed_runs(factors)
                sums = (n, int((runs[:, 1] - runs[:, 0]).sum()), len(runs), len(factors))
                if digest:
                    rows.append((*sums, hashlib.sha256(digest(text, runs)).hexdigest()))
                else:
                    spans, kept = cut(text, runs)
                    rows.append((*sums, spans.tolist(), [dict(zip(("start", "end", "source", "source_start"), f, strict=True)) for f in factors], kept.decode("utf-8", "replace")))
            types = [pa.int64()] * len(_COUNTS)
            factor = pa.struct([(n, pa.int64()) for n in ("start", "end", "source", "source_start")])
            types += [pa.string()] if digest else [pa.list_(pa.list_(pa.int64())), pa.list_(factor), pa.string()]
            new = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *new], schema.names)

    out = joined.mapInArrow(run, schema)
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in plain.columns), *(n for n, _ in added))
