"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree over blocks of documents.

Documents of a source are dealt to blocks by a hash of their id and text. A source's target is some passes over all its
blocks and a rest, which takes blocks in a random order and of the last one documents in a hashed order. The draws of
blocks are split among output shards by halving the shards: what the left half gets of each source is drawn from the
multivariate hypergeometric distribution, down to single shards, which take the next blocks of each source's random
order. Shards thus have disjoint draws, exact totals and the proportions of a full shuffle, and within a shard rows
are ordered by a hash.

The driver holds one row a source and one a block: MAX_BLOCKS and MIN_BLOCKS a source at most, whatever the input. More
than MOST_SOURCES sources are an error.

Defined cases: a null text has size 0; null is a source, the last one; a source without words has target 0; rows that
share doc_id and text go together, others are dealt apart, without an id too; other columns may have any name (shard is
replaced); an empty table gives an empty result; a run with the same seed gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
MAX_BLOCKS, MIN_BLOCKS, SHARDS, SEED = 8192, 16, 16, 42
MOST_SOURCES = 20_000
#: Words of a part of a shard that is shuffled in one task.
PART_WORDS = 4_000_000
#: The last block of a source is ranked in ranges of its order, by these high bits.
RANGE_BITS = 12


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """share of the sum of all sizes, dealt by weight; what is above most times a size is dealt anew to the others."""
    out, left, free = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Draws of each source -> draws of each source (columns) in each shard (rows), by halving."""
    if shards == 1:
        return counts[None]
    left = shards // 2
    part = rng.multivariate_hypergeometric(counts, int(counts.sum()) * left // shards, method="marginals")
    return np.concatenate([split(part, left, rng), split(counts - part, shards - left, rng)])


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _keys() -> list[Column]:
    """source, doc and t of docs: what the plan needs to know of a document."""
    return [F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("t")]


class Plan:
    """What to take: sources (source, words, target) and draws (source, block, copy, shard, up to which order)."""

    def __init__(self, docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS, seed: int = SEED):
        self.spark, self.seed, self.shards = docs.sparkSession, seed, shards
        self.sizes = staged(docs.select(*_keys(), _size().alias("size")), "sizes")
        rows = self.sizes.groupBy("source").agg(F.sum("size")).limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
        self.sources = [r[0] for r in rows]
        self.words = [r[1] for r in rows]
        self.targets = targets(self.words, [weights[i % len(weights)] for i in range(len(rows))], share, most)
        total = max(1, sum(self.words))
        self.blocks = [MIN_BLOCKS + MAX_BLOCKS * w // total for w in self.words]
        self.draws = self._draws()

    def _frame(self, rows: list, schema: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(rows, schema))

    def placed(self, rows: DataFrame) -> DataFrame:
        """source, doc, t and others -> with block and order."""
        counts = self._frame(list(zip(self.sources, self.blocks, strict=True)), "n_source string, blocks long")
        block = F.pmod(F.xxhash64("doc", "t", F.lit(self.seed)), F.col("blocks"))
        joined = rows.join(counts, F.col("source").eqNullSafe(F.col("n_source")))
        return joined.withColumns({"block": block, "order": F.xxhash64(F.lit(self.seed + 1), "doc", "t")}).drop("n_source", "blocks")

    def _draws(self) -> list[tuple]:
        sizes = {(r[0], r[1]): r[2] for r in self.placed(self.sizes).groupBy("source", "block").agg(F.sum("size")).collect()}
        rng, orders, last, full = np.random.default_rng(self.seed), [], [], []
        for s, n, words, target in zip(self.sources, self.blocks, self.words, self.targets, strict=True):
            passes, own = (int(target // words), []) if words else (0, [])
            for copy in range(passes):
                own += [(int(b), copy) for b in rng.permutation(n)]
            left = target - passes * words
            for b in rng.permutation(n).tolist() if words else []:
                size = sizes.get((s, b), 0)
                if left < 1:
                    break
                own.append((b, passes))
                if size > left:
                    last.append((s, b, float(left)))
                left -= size
            orders.append(own)
            full.append(passes)
        upto = self._upto(last)
        quota = split(np.array([len(o) for o in orders], np.int64), self.shards, rng) if orders else []
        at, out, ends = [0] * len(orders), [], {(s, b) for s, b, _ in last}
        for shard, counts in enumerate(quota):
            for i, n in enumerate(counts.tolist()):
                for b, copy in orders[i][at[i] : at[i] + n]:
                    part = copy == full[i] and (self.sources[i], b) in ends
                    out.append((self.sources[i], b, copy, shard, upto[self.sources[i]] if part else (1 << 63) - 1))
                at[i] += n
        return out

    def _upto(self, last: list[tuple]) -> dict:
        """Of each source's last block, the order up to which documents come nearest to what is left.

        Sums of ranges of the order find the range in which it is; this range alone is ranked.
        """
        if not last:
            return {}
        ends = self._frame(last, "e_source string, e_block long, left_over double")
        shift = 64 - RANGE_BITS
        rows = self.placed(self.sizes).join(ends, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("block") == F.col("e_block")))
        rows = rows.groupBy("source", "order").agg(F.sum("size").alias("size"), F.first("left_over").alias("left_over")).withColumn("range", F.shiftright("order", shift))
        run = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("size"), F.first("left_over").alias("left_over"))
        ranges = ranges.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0))).where("before <= left_over")
        found = ranges.groupBy("source").agg(F.max(F.struct("range", "before")).alias("r")).select(F.col("source").alias("r_source"), F.col("r.range").alias("r_range"), F.col("r.before").alias("before"))
        inner = rows.join(F.broadcast(found), F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
        sum_ = F.sum("size").over(Window.partitionBy("source").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
        middle = F.col("before") + sum_ - F.col("size") / 2
        taken = inner.withColumn("middle", middle).groupBy("source", "range").agg(F.max(F.when(F.col("middle") <= F.col("left_over"), F.col("order"))))
        return {s: max((r << shift) - 1, -(1 << 63)) if upto is None else upto for s, r, upto in map(tuple, taken.collect())}

    def taken(self) -> DataFrame:
        """doc, size, source_size, target and by_shard: each shard that takes the document, once for every time, and its words."""
        whole: dict[tuple, list] = {}
        for s, b, _, shard, upto in self.draws:
            whole.setdefault((s, b), []).append((shard, upto))
        wanted = [(s, b, u) for (s, b), u in whole.items()]
        draws = self._frame(wanted, "d_source string, d_block long, draws array<struct<shard: int, upto: bigint>>")
        facts = self._frame(list(zip(self.sources, self.words, self.targets, strict=True)), "f_source string, source_size long, target double")
        rows = self.placed(self.sizes).join(draws, F.col("source").eqNullSafe(F.col("d_source")) & (F.col("block") == F.col("d_block")), "left")
        rows = rows.join(facts, F.col("source").eqNullSafe(F.col("f_source")))
        drawn = F.filter(F.coalesce("draws", F.array().cast("array<struct<shard: int, upto: bigint>>")), lambda d: F.col("order") <= d["upto"])
        by_shard = F.transform(drawn, lambda d: F.struct(d["shard"].alias("shard"), F.col("size").alias("words")))
        return rows.select("doc", "size", "source_size", "target", by_shard.alias("by_shard"))

    def mixed(self, docs: DataFrame) -> DataFrame:
        """The mix: docs' columns and shard, rows repeated as drawn, in each shard's own random order."""
        draws = self._frame(self.draws, "d_source string, d_block long, copy int, shard int, upto long")
        plain = docs.drop("shard")
        packed = plain.select(F.struct(*(plain[f"`{c}`"] for c in plain.columns)).alias("row"), *_keys())
        rows = self.placed(packed).join(draws, F.col("source").eqNullSafe(F.col("d_source")) & (F.col("block") == F.col("d_block"))).where("order <= upto")
        parts = 1 + sum(map(int, self.targets)) // (self.shards * PART_WORDS)
        rows = rows.withColumn("place", F.xxhash64(F.lit(self.seed + 2), "shard", "copy", "order"))
        dealt = rows.repartition("shard", F.pmod("place", F.lit(max(parts, 4)))).sortWithinPartitions("shard", "place")
        return dealt.select(*(F.col("row").getField(c).alias(c) for c in plain.columns), "shard")


def mix(docs: DataFrame, **options) -> DataFrame:
    """All columns of docs (doc_id, text, source and any others) and shard."""
    return Plan(docs, **options).mixed(docs)


def shares(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (the words the mix takes of each document) and by_shard: which shards take them."""
    taken = F.aggregate("by_shard", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return Plan(docs, **options).taken().select(F.col("doc").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), "by_shard")
