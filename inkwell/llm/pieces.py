"""SentencePiece encoding and decoding, by suffix-array matching.

A text's spaces become the mark of a word's start, and since no piece has this mark behind another character, text is
encoded in units that begin with it. The units that a batch has for the first time are joined to texts; a text's suffixes
are sorted, every piece is binary-searched for the range of suffixes that begin with it, and the occurrences are edges
of a graph over the places of the text. Edges are sorted by where they end in their unit and relaxed in this order: of
the edges that end at a place the longest is kept whose pair with the last piece before it is one that byte-pair
merging leaves apart. A sequence of pieces of which all neighbours are such pairs is the one that merging by score
makes, so the result equals merging pair by pair. A character without a piece falls back to its bytes.

Decoding joins the pieces and the bytes, turns marks to spaces and drops the first, so that any text without the mark
itself comes back as it was.

Defined cases: a null text has null ids; an empty text has none; runs of spaces, line ends and characters without a
piece are kept; ids that aren't in the vocabulary raise an error; other columns pass through; an empty table gives an
empty result. The vocabulary's file is read on the driver and sent to the executors.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

#: The mark of a word's start in pieces; texts have a space in its place.
MARK = "▁".encode()
_UNIT = re.compile(rb" +[^ ]*")
#: Units that a worker remembers before it starts anew.
REMEMBERED = 300_000
#: Bytes of new units whose suffixes are sorted at once; edges take some hundred times that.
AT_ONCE = 1 << 17
#: Pairs of pieces that are looked up without a dictionary: a slot for each value of these bits of a hash.
SLOT_BITS = 21
_NONE, _START, _CHAR = -3, -2, -1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """The pieces of a model file (byte-pair merging with byte fallback and no normalisation)."""

    def __init__(self, path: str | None = None):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path or default_model(), "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models of byte-pair merging with byte fallback, a dummy prefix and no normalisation are known")
        self.pieces = [b""] * len(model.pieces)
        self.ids: dict[bytes, int] = {}
        self.score = np.zeros(len(model.pieces))
        self.byte = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            self.score[i] = p.score
            if p.type == 6:
                self.byte[int(p.piece[3:-1], 16)] = i
                self.pieces[i] = bytes([int(p.piece[3:-1], 16)])
            elif p.type == 1:
                self.pieces[i] = p.piece.encode().replace(MARK, b" ")
                self.ids[self.pieces[i]] = i
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        if any(b" " in p.lstrip(b" ") for p in self.ids):
            raise ValueError("a piece has the mark of a word's start behind another character")

    def merge(self, text: bytes) -> list[int]:
        """Merging pair by pair, highest score first and leftmost among equals; _CHAR - code point where no piece is."""
        parts = [c.encode() for c in text.decode("utf-8", "surrogateescape")]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.score[j] > best):
                    best, at = self.score[j], i
            if at < 0:
                return [self.ids.get(p, _CHAR) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def decode(self, ids: list[int]) -> str:
        if ids and min(ids) < 0:
            raise IndexError("no such piece")
        return b"".join([self.pieces[i] for i in ids])[1:].decode("utf-8", "replace")


class Suffixes:
    """The suffixes of a text, sorted by their first eight bytes; what is longer is compared beyond them."""

    def __init__(self, text: bytes):
        raw = np.frombuffer(text + b"\xff" * 64, np.uint8).astype(np.uint64)
        key = np.zeros(len(text) + 56, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | raw[k : k + len(key)]
        self.key = key
        self.order = np.argsort(key[: len(text)])
        self.sorted = key[self.order]

    def find(self, low: list[np.ndarray], high: list[np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the patterns; low[j], high[j]: least and greatest value of a pattern's j-th eight bytes."""
        first, last = np.searchsorted(self.sorted, low[0], "left"), np.searchsorted(self.sorted, high[0], "right")
        count = last - first
        which = np.repeat(np.arange(len(count)), count)
        at = self.order[np.arange(len(which)) + np.repeat(first - np.cumsum(count) + count, count)]
        for j in range(1, len(low)):
            long = length[which] > 8 * j
            ok = np.ones(len(which), bool)
            here = self.key[at[long] + 8 * j]
            ok[long] = (here >= low[j][which[long]]) & (here <= high[j][which[long]])
            at, which = at[ok], which[ok]
        return at, which


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        patterns = list(v.ids)
        self.pattern_id = np.array([v.ids[p] for p in patterns], np.int64)
        self.length = np.array([len(p) for p in patterns], np.int64)
        blocks = -(-int(self.length.max(initial=1)) // 8)
        self.low, self.high = ([np.array([int.from_bytes((p[8 * j : 8 * j + 8] + fill * 8)[:8], "big") for p in patterns], np.uint64) for j in range(blocks)] for fill in (b"\0", b"\xff"))
        self.alone = {p for p in patterns if len(p.decode()) == 1}
        self.pairs: dict[int, bool] = {}
        self.slots, self.apart = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)
        self.runs: dict[int, np.ndarray] = {}
        spaces = sorted(len(p) for p in patterns if not p.strip(b" "))
        self.widest = spaces[-1] if spaces else 0
        # whether a run longer than the widest piece of spaces is that piece, repeated, and the rest: tried on all rests
        self.plain = self.widest > 0 and all(self.v.merge(b" " * n) == self._blocks(n) for n in range(self.widest + 1, 3 * self.widest + 1))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _apart(self, pairs: np.ndarray) -> np.ndarray:
        """Whether merging leaves the two pieces of each pair apart; pair: (last + 3) * 2**32 + next.

        What was found for a pair stays in its slot until another pair needs that.
        """
        slot = (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)
        out, missed = self.apart[slot], np.flatnonzero(self.slots[slot] != pairs)
        if len(missed):
            new, at = np.unique(pairs[missed], return_inverse=True)
            found = np.array([self._leaves(k) for k in new.tolist()], bool)[at]
            out[missed] = found
            self.slots[slot[missed]], self.apart[slot[missed]] = pairs[missed], found
        return out

    def _leaves(self, pair: int) -> bool:
        got = self.pairs.get(pair)
        if got is None:
            last, piece = (pair >> 32) - 3, pair & 0xFFFFFFFF
            both = [*([last] if last >= 0 else []), piece]
            got = self.v.merge(b"".join(self.v.pieces[i] for i in both)) == both
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            self.pairs[pair] = got
        return got

    def _relax(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after another, and how many each has."""
        text = b"\xff".join(units) + b"\xff"
        size = np.array([len(u) for u in units], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        unit = np.repeat(np.arange(len(units)), size + 1)
        at, which = Suffixes(text).find(self.low, self.high, self.length)
        piece, length = self.pattern_id[which], self.length[which]
        raw = np.frombuffer(text, np.uint8)
        head = np.flatnonzero(((raw & 0xC0) != 0x80) & (raw != 0xFF))  # characters, and those that are no piece
        wide = np.diff(np.r_[head, len(text)])
        wide -= raw[np.minimum(head + wide - 1, len(text) - 1)] == 0xFF
        has = np.zeros(len(text), bool)
        single = np.zeros(len(text), np.int64)
        single[head] = wide
        has[at[length == single[at]]] = True
        odd = ~has[head]
        at, piece, length = np.r_[at, head[odd]], np.r_[piece, np.full(odd.sum(), _CHAR)], np.r_[length, wide[odd]]
        end = at + length - begin[unit[at]]
        order = np.lexsort((length, end))
        at, piece, length, end = at[order], piece[order], length[order], end[order]
        last = np.full(len(text) + 1, _NONE, np.int64)  # of the place behind the last byte
        last[begin] = _START
        back = np.zeros(len(text) + 1, np.int64)
        cuts = np.flatnonzero(np.r_[True, end[1:] != end[:-1], True]).tolist()
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            a, p = at[s:e], piece[s:e]
            before = last[a]
            ok = before != _NONE
            a, p, before, n = a[ok], p[ok], before[ok], length[s:e][ok]
            real = p >= 0
            good = np.ones(len(p), bool)
            good[real] = self._apart((np.maximum(before[real], _START) + 3) << 32 | p[real])
            to = (a + n)[good]
            last[to] = p[good]  # ascending lengths: the longest is written last
            back[to] = n[good]
        place, number, found = begin + size, np.arange(len(units)), []
        while len(place):
            on = place > begin[number]
            place, number = place[on], number[on]
            found.append((number, last[place], place - back[place], back[place]))
            place = place - back[place]
        number, ids, start, n = (np.concatenate(x) for x in zip(*found, strict=True))
        bare = ids == _CHAR
        repeat = np.where(bare, n, 1)
        order = np.lexsort((start, number))
        number, ids, start, repeat = number[order], ids[order], start[order], repeat[order]
        inner = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        flat = np.repeat(ids, repeat)
        flat = np.where(flat == _CHAR, self.v.byte[raw[np.repeat(start, repeat) + inner]], flat)
        return flat.astype(np.int32), np.bincount(number, repeat, len(units)).astype(np.int64)

    def _learn(self, units: list[bytes]) -> None:
        plain = [u for u in units if not u.startswith(b"  ")]
        spaced = [u for u in units if u.startswith(b"  ")]  # pieces of spaces alone share one score: merged pair by pair
        for some in (plain, spaced):
            if not some:
                continue
            if some is plain:
                ids, counts = (np.concatenate(x) for x in zip(*map(self._relax, self._parts(some)), strict=True))
            else:
                parts = [self._spaced(u) for u in some]
                ids, counts = np.concatenate(parts).astype(np.int32), np.array([len(p) for p in parts], np.int64)
            starts = np.cumsum(counts) - counts + len(self.ids)
            self.known.update(zip(some, range(len(self.starts), len(self.starts) + len(some)), strict=True))
            self.ids, self.starts, self.counts = np.r_[self.ids, ids], np.r_[self.starts, starts], np.r_[self.counts, counts]

    @staticmethod
    def _parts(units: list[bytes]) -> Iterator[list[bytes]]:
        """The units in order of length, cut at about AT_ONCE bytes; a longer unit is a part of its own. Reorders the list."""
        units.sort(key=len)
        ends = np.cumsum([len(u) + 1 for u in units])
        at = 0
        while at < len(units):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
            yield units[at:upto]
            at = upto

    def _spaced(self, unit: bytes) -> np.ndarray:
        """Extra spaces, then the rest as a unit: pieces of spaces score below all others, so they merge last."""
        extra = len(unit) - len(unit.lstrip(b" ")) - (unit.strip(b" ") != b"")
        rest = unit[extra:]
        ids, _ = self._relax([rest]) if rest else (np.empty(0, np.int32), None)
        lone = len(ids) and ids[0] == self.v.ids.get(b" ")
        return np.r_[self._spaces(extra + bool(lone)), ids[bool(lone) :]]

    def _spaces(self, n: int) -> np.ndarray:
        """Ids of n spaces. Leftmost merges among equals double all pieces at once, level by level, until the widest piece."""
        if n not in self.runs:
            if len(self.runs) > 10_000:
                self.runs.clear()
            self.runs[n] = np.array(self.v.merge(b" " * n) if n <= self.widest or not self.plain else self._blocks(n), np.int32)
        return self.runs[n]

    def _blocks(self, n: int) -> list[int]:
        """As merge() does, where pieces of 1, 2, 4 and so on spaces to the widest exist and no others that halves do not make."""
        whole, left = divmod(n, self.widest)
        return [self.v.ids[b" " * self.widest]] * whole + self.v.merge(b" " * left)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each has."""
        if len(self.known) > REMEMBERED:
            self._forget()
        units = [_UNIT.findall(b" " + t.replace(MARK, b" ")) if t else [] for t in texts]
        every = list(chain.from_iterable(units))
        new = list(set(every).difference(self.known))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        counts = self.counts[at]
        ids = self.ids[np.arange(counts.sum()) + np.repeat(self.starts[at] - np.cumsum(counts) + counts, counts)]
        sums = np.r_[0, np.cumsum(counts)][np.cumsum([0, *map(len, units)])]
        return ids, np.diff(sums)


_encoders: dict[str, Encoder] = {}


def encode(docs: DataFrame, vocabulary: Vocabulary, check: bool = False, keep: list[str] | None = None) -> DataFrame:
    """All columns of docs (or those of keep) and ids; check: and n_pieces and round_trip, whether decoding gives the text. Columns of these names are replaced."""
    plain = docs.drop("ids", "n_pieces", "round_trip")
    given, shared = plain.columns if keep is None else keep, docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:  # what a worker has learned serves its later tasks
            _encoders.clear()
            _encoders[key] = Encoder(shared.value)
        e = _encoders[key]
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids, counts = e.encode([t or b"" for t in texts])
            ends = np.cumsum(counts)
            null = np.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[null, False]), pa.array(ids))
            out, names = [*(batch.column(c) for c in given), lists], [*given, "ids"]
            if check:
                whole = b"".join(map(e.v.pieces.__getitem__, ids.tolist()))
                upto = np.r_[0, np.cumsum(e.v.size[ids])][np.r_[0, ends]].tolist()
                back = [whole[a + 1 : b] for a, b in zip(upto[:-1], upto[1:], strict=True)]
                out += [pa.array(counts), pa.array([None if t is None else b == t for b, t in zip(back, texts, strict=True)], pa.bool_())]
                names += ["n_pieces", "round_trip"]
            yield pa.RecordBatch.from_arrays(out, names)

    fields = T.StructType([plain.schema[c] for c in given]).add("ids", T.ArrayType(T.IntegerType()))
    if check:
        fields = fields.add("n_pieces", "long").add("round_trip", "boolean")
    return plain.mapInArrow(run, fields)


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All columns of rows and text, from ids; a column text is replaced."""
    plain = rows.drop("text")
    given, shared = plain.columns, rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else shared.value.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), pa.array(texts, pa.string())], [*given, "text"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("text", T.StringType())]))
