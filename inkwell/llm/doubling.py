"""Prefix doubling over all positions of all documents, by sorts of rank pairs in Spark.

The rank of a position is that of the bytes from there on: eight bytes are their own rank. Each round pairs a position's
rank with the rank as far behind it as the ranks reach, sorts the pairs, and numbers them anew; positions whose pair
one document alone has leave, and with them all that would be paired with them. Rounds end when ranks reach `length`
bytes. Exact for all texts without hashing, but each round shuffles every position that is left twice: see README for
what that takes. `suffix.py` finds the same windows by anchors.

Defined cases: as in `suffix.py`; a group of equal pairs is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .common import slices, staged, texts_of

WIDTH = 8
_SCHEMA = "doc_id long, salt long, at int, rank long"


def _positions(keyed: DataFrame, length: int) -> DataFrame:
    """Every position that has `width` bytes before it, and these as a number."""
    width = min(WIDTH, length)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text, doc, salt in zip(texts_of(batch), batch.column("doc_id").to_pylist(), batch.column("salt").to_pylist(), strict=True):
                n = len(text) - width + 1
                if len(text) >= length:
                    raw, rank = np.frombuffer(text, np.uint8).astype(np.uint64), np.zeros(n, np.uint64)
                    for k in range(width):
                        rank = rank << np.uint64(8) | raw[k : k + n]
                    columns = [np.full(n, doc), np.full(n, salt), np.arange(n, dtype=np.int32), rank.view(np.int64)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["doc_id", "salt", "at", "rank"])

    return keyed.mapInArrow(run, _SCHEMA)


def _reranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (rank, second) -> the number of each pair; what one document alone has leaves."""
    names, rest, seen = ["doc_id", "salt", "at", "rank", "second"], None, TaskContext.get().partitionId() << 40

    def numbered(x: list[np.ndarray]) -> pa.RecordBatch:
        nonlocal seen
        doc, salt, at, a, b = x
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        edge, group = np.flatnonzero(new), np.cumsum(new) - 1
        shared = (np.minimum.reduceat(doc, edge) < np.maximum.reduceat(doc, edge))[group]
        rank = group + seen
        seen += len(edge)
        return pa.RecordBatch.from_arrays([pa.array(c[shared]) for c in (doc, salt, at, rank)], names[:4])

    for batch in batches:
        x = [batch.column(c).to_numpy() for c in names]
        if not len(x[0]):
            continue
        if rest is not None:
            x = [np.concatenate(p) for p in zip(rest, x, strict=True)]
        last = np.flatnonzero((x[3] != x[3][-1]) | (x[4] != x[4][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last pair may go on in the next batch
        if cut:
            yield numbered([c[:cut] for c in x])
        rest = [c[cut:] for c in x]
    if rest is not None:
        yield numbered(rest)


def repeats(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, salt, starts: the windows that an earlier document has too, in the form that `spans.apply` takes."""
    rows, have = _positions(spans.keys(docs), length), min(WIDTH, length)
    while have < length:
        step = min(have, length - have)
        behind = Window.partitionBy("doc_id", "salt").orderBy("at").rangeBetween(step, step)
        pairs = rows.withColumn("second", F.first("rank").over(behind)).where("second is not null")
        ordered = pairs.repartitionByRange("rank", "second").sortWithinPartitions("rank", "second")
        rows, have = staged(ordered.mapInArrow(_reranked, _SCHEMA), "ranks"), have + step
    late = rows.withColumn("first", F.min("doc_id").over(Window.partitionBy("rank"))).where("doc_id > first")
    at = F.col("at").cast("long")
    place = F.struct(at.alias("at"), F.lit(0).cast("long").alias("src"), at.alias("src_at"))
    found = late.groupBy("doc_id", "salt").agg(F.collect_list(place).alias("starts"))
    return found.select("doc_id", "salt", F.lit(None).cast("array<struct<at: bigint, src: bigint, src_at: bigint>>").alias("done"), "starts")
