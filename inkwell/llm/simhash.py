"""SimHash near-duplicates: fingerprints of word shingles, linked by tiled exact comparison.

Defined cases: a null text and a text without words have fingerprint zero, which links like any other; fewer words than
a shingle make one shingle of the whole sequence; equal texts have equal fingerprints; an empty table gives an empty
result; other columns are never read. Rows that share a doc_id are judged each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, texts_of
from .graph import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Most fingerprints that are compared with each other at once.
TILE = 4096
#: Parts that the fingerprints of one component are dealt to.
PARTS = 32


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x, shingle, seed) for x in texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between values -> each value that isn't the least of its local component, and that least value."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _tile_links(fps: np.ndarray, pops: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one bucket, tile against tile; fps ascend by their number of ones."""
    left, right, size = [], [], 512
    for i in range(0, len(fps), size):
        for j in range(i, len(fps), size):
            if pops[j] - pops[min(i + size, len(fps)) - 1] > radius:
                break  # this tile and all that follow differ by more ones than the radius
            near = np.bitwise_count(fps[i : i + size, None] ^ fps[None, j : j + size]) <= radius
            p, q = np.nonzero(near)
            p, q = p + i, q + j
            if len(p) > 4 * size:  # nearly everything is near: what joins the tiles suffices
                m, r = _roots(p[p < q], q[p < q])
                p, q = r, m
            left.append(fps[p[p < q]])
            right.append(fps[q[p < q]])
    return np.concatenate(left), np.concatenate(right)


def _bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each of several whole buckets."""
    pops = np.bitwise_count(fps).astype(np.int64)
    order = np.lexsort((fps, pops, keys))
    keys, fps, pops = keys[order], fps[order], pops[order]
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(edge)
    left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    large = sizes > 64
    for s, n in zip(edge[:-1][large], sizes[large], strict=True):
        a, b = _tile_links(fps[s : s + n], pops[s : s + n], radius)
        left.append(a)
        right.append(b)
    small = np.repeat(~large, sizes)
    keys, fps, pops = keys[small], fps[small], pops[small]
    for step in range(1, int(sizes[~large].max(initial=1))):  # small buckets side by side: a row against the step-th after it
        i = np.flatnonzero((keys[step:] == keys[:-step]) & (pops[step:] - pops[:-step] <= radius))
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= radius]
        left.append(fps[i])
        right.append(fps[i + step])
    return np.concatenate(left), np.concatenate(right)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """Distinct fp -> links (u, v) that connect what lies within the radius, at most one a fingerprint and batch.

    Two fingerprints within the radius agree wholly in at least blocks - radius of their blocks, so each choice of that
    many blocks makes a bucket, and every near pair meets in one. A bucket of more than `tile` fingerprints is dealt
    to pairs of its parts, so that no task gets it whole. In a bucket, tiles ordered by their number of ones are
    compared bit by bit, and pairs of tiles whose numbers differ by more than the radius are skipped.
    """
    blocks = blocks or radius + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    kept = list(combinations(range(blocks), blocks - radius))
    masks = [sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen) for chosen in kept]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)))).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    part = F.pmod(F.hash("fp"), F.col("parts"))
    dealt = keyed.join(large, "key", "left").withColumn("other", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")))
    dealt = dealt.select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least(part, "other"), F.greatest(part, "other"))).alias("key"), "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = _bucket_links(k, f, radius)
            if len(a):
                u, v = _roots(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            k = np.concatenate([rest_k, batch.column("key").to_numpy()])
            f = np.concatenate([rest_f, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(k):
                continue
            whole = int(np.searchsorted(k, k[-1]))  # the last bucket may go on in the next batch
            if whole:
                yield from found(k[:whole], f[:whole])
            rest_k, rest_f = k[whole:], f[whole:]
        if len(rest_k):
            yield from found(rest_k, rest_f)

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id that links lead to."""
    own = staged(fingerprints(docs, shingle, seed), "fingerprints")
    least = staged(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(least.select("fp"), radius))
    linked = least.join(roots.withColumnRenamed("node", "fp"), "fp").withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int"))
    lowest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    spread = lowest.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))  # a component of many fingerprints is more than one task
    classes = linked.join(spread, ["root", "part"]).select("fp", "component_id")
    first = least.join(classes, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return own.join(first, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
