"""Connected components of an edge table, by alternating large-star and small-star contractions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

#: Most links that one task joins at once (1.6 MB); rounds of queries for fewer ones cost the driver more than the links are worth.
FEW = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> each of their ids, ascending, and the least id of its component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    above = list(range(len(nodes)))
    for a, b in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist(), strict=True):
        while above[a] != a:
            above[a] = a = above[above[a]]
        while above[b] != b:
            above[b] = b = above[above[b]]
        above[max(a, b)] = min(a, b)
    for i, a in enumerate(above):  # a is i or less, and has its root by now
        above[i] = above[a]
    return nodes, nodes[above]


def _at_once(edges: DataFrame) -> DataFrame:
    """components() of few links, in one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy() for c in ("u", "v")] for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _joined(*map(np.concatenate, zip(*parts, strict=True)))], ["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of long ids -> (node, root) for each id that has a link; root is the least id of its component.

    Links from an id to itself and repeated links are allowed; no links give no rows. Up to FEW links are joined by one
    task. Of more, each round is written to the shared folder; the number of rounds grows with the logarithm of the longest chain.
    """
    now, seen = staged(_small_star(edges.where("u <> v")), "links"), None
    if now.count() <= FEW:
        return _at_once(now)
    while True:
        after = staged(_small_star(_large_star(now)), "links")
        unstage(now)
        now = after
        mark = now.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)")).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
