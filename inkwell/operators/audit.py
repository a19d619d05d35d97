"""Audits of two classes for parity: each gives check, metric, threshold and passed. Input: text, label (0 or 1)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grams
from ..functions import text as T
from ..functions.batches import bounded

# Words that don't count as vocabulary, and artifacts.
STOP_WORDS = "the a an and or but in on at to for of is it that this with from by as be are was were have has had do does did not no can will would could should may might shall".split()
#: Values of a range that is summed up in one task.
RANGE = 1024
ARTIFACTS = ("[", "-----", "wrote:", "Quote from:", ">", "http", "Re:", "@")


def _share(p: Column, label: int) -> Column:
    own = F.col("label") == label
    return F.try_divide(F.count_if(p & own) * 100, F.count_if(own))


def artifact(name: str, t: Column) -> Column:
    if name == "[":
        return F.contains(F.left(t, F.lit(50)), F.lit("["))
    if name == "Re:":
        return F.contains(F.left(t, F.lit(30)), F.lit("Re:"))
    if name == ">":
        return F.exists(T.lines(t), lambda x: T.strip(x).startswith(">"))
    return t.contains(name)


def rates(docs: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """check, pos, neg: percent of each class that passes each test, in one pass."""
    row = docs.agg(*(F.struct(F.lit(k).alias("check"), _share(p, 1).alias("pos"), _share(p, 0).alias("neg")).alias(f"r{i}") for i, (k, p) in enumerate(tests.items())))
    return row.select(F.inline(F.array(*(F.col(f"r{i}") for i in range(len(tests))))))


def artifacts(docs: DataFrame) -> DataFrame:
    return rates(docs, {k: artifact(k, F.col("text")) for k in ARTIFACTS})


def source_parity(docs: DataFrame) -> DataFrame:
    """source, pos, neg: percent of each class that the source has."""
    counts = docs.groupBy("source").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    all_ = counts.agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"))
    return counts.crossJoin(F.broadcast(all_)).select("source", F.try_divide(F.col("p") * 100, "ps").alias("pos"), F.try_divide(F.col("n") * 100, "ns").alias("neg"))


def ks(docs: DataFrame, value: Column) -> DataFrame:
    """d: the two samples' largest distance; p: Kolmogorov's asymptotic series. Counts go by value first, then by ranges of values."""
    by = docs.select(value.alias("x"), "label").groupBy("x").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    by = by.withColumn("range", F.floor(F.col("x") / RANGE))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    ranges = by.groupBy("range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    before, all_ = upto(Window.orderBy("range")), Window.partitionBy()
    ranges = ranges.select("range", *((F.sum(c).over(before) - F.col(c)).alias(f"b{c}") for c in ("rp", "rn")), F.sum("rp").over(all_).alias("ps"), F.sum("rn").over(all_).alias("ns"))
    own = upto(Window.partitionBy("range").orderBy("x"))
    steps = by.join(F.broadcast(ranges), "range")
    steps = steps.withColumns({"p": F.col("brp") + F.sum("p").over(own), "n": F.col("brn") + F.sum("n").over(own)})
    row = steps.agg(F.max("ps").alias("ps"), F.max("ns").alias("ns"), F.max(F.abs(F.col("p") / F.col("ps") - F.col("n") / F.col("ns"))).alias("d"))
    root = F.sqrt(F.col("ps") * F.col("ns") / (F.col("ps") + F.col("ns")))
    lam = (root + 0.12 + 0.11 / root) * F.col("d")
    series = reduce(lambda a, j: a + (2 if j % 2 else -2) * F.exp(-2 * j * j * lam * lam), range(1, 101), F.lit(0.0))
    return row.select(F.round("d", 9).alias("d"), F.when(F.col("d") < 1e-9, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))).alias("p"))


def vocabulary(docs: DataFrame, n: int = 200) -> DataFrame:
    """label, word, count: the n most common words of each class; ties by word. Words are counted as they stand, then cut to letters."""
    raw = docs.select("label", F.explode(T.words(F.lower("text"))).alias("word")).groupBy("label", "word").agg(F.count("*").alias("own"))
    rows = raw.withColumn("word", F.regexp_replace("word", "[^a-z]", ""))
    counts = rows.where((F.length("word") > 2) & ~F.col("word").isin(STOP_WORDS)).groupBy("label", "word").agg(F.sum("own").alias("count"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("count"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def trigrams(docs: DataFrame) -> DataFrame:
    """tri, pos, neg: counts of each class's overlapping character trigrams, summed up in each task before they are shuffled."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            pos, neg = zip(*held.values(), strict=True) if held else ((), ())
            return pa.record_batch({"tri": pa.array(held, pa.string()), "pos": pa.array(pos, pa.int64()), "neg": pa.array(neg, pa.int64())})

        for part in grams.slices(batches):
            cp, row = grams.points(part.column("text").to_pylist())
            codes = grams.Codes(cp, 3)
            label = pc.fill_null(part.column("label").cast(pa.int64()), -1).to_numpy(zero_copy_only=False)[row[: len(codes.code)]]
            inside = row[: len(codes.code)] == row[2:]
            for place, own in enumerate((label == 1, label == 0, (label != 1) & (label != 0))):
                found, n = grams.counted(codes.code[inside & own])
                for tri, k in zip(codes.named(found), n.tolist(), strict=True):
                    counts = held.setdefault(tri, [0, 0])
                    if place < 2:
                        counts[place] += k
            if len(held) > grams.HELD:
                yield out()
                held.clear()
        yield out()

    rows = docs.where(F.length("text") > 2).select(F.col("label").cast("long").alias("label"), "text", F.length("text").alias("size"))
    return rows.mapInArrow(run, "tri string, pos long, neg long").groupBy("tri").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def trigram_problems(docs: DataFrame) -> DataFrame:
    """tri, pos, neg in percent, of those above 1 in one class and under 0.1 in the other."""
    tri = trigrams(docs)
    all_ = tri.agg(F.sum("pos").alias("ps"), F.sum("neg").alias("ns"))
    p, n = F.try_divide(F.col("pos") * 100, "ps"), F.try_divide(F.col("neg") * 100, "ns")
    rows = tri.crossJoin(F.broadcast(all_)).select("tri", p.alias("pos"), n.alias("neg"))
    return rows.where("(pos > 1 and neg < 0.1) or (neg > 1 and pos < 0.1)")


def newline_density(docs: DataFrame) -> DataFrame:
    n = T.occurrences(F.col("text"), "\n")
    own = lambda y: F.try_divide(F.sum(F.when(F.col("label") == y, n)), F.count_if(F.col("label") == y))
    row = docs.agg(own(1).alias("pos"), own(0).alias("neg"))
    return row.withColumn("ratio", F.greatest("pos", "neg") / F.greatest(F.least("pos", "neg"), F.lit(0.01)))


def topic_rate(docs: DataFrame, topic: str) -> DataFrame:
    return rates(docs, {topic: F.lower("text").contains(topic)})


def summary(docs: DataFrame, topic: str) -> DataFrame:
    """check, metric, threshold, passed of all but the classifier's check."""
    gap = lambda d, c, name: d.agg(F.max(F.abs(F.col("pos") - F.col("neg"))).alias("metric")).select(F.lit(name).alias("check"), F.round("metric", 6).alias("metric"), F.lit(float(c)).alias("threshold"), (F.col("metric") <= c).alias("passed"))
    line = lambda d, name, c, ok: d.select(F.lit(name).alias("check"), F.round("metric", 6).alias("metric"), F.lit(float(c)).alias("threshold"), ok.alias("passed"))
    common = vocabulary(docs).groupBy("word").count().where("count = 2").agg((F.count("*") * 100 / 200).alias("metric"))
    m = F.col("metric")
    parts = [
        gap(source_parity(docs), 10, "source parity"), line(ks(docs, T.word_count(F.col("text"))).withColumnRenamed("p", "metric"), "length", 0.05, m > 0.05),
        line(newline_density(docs).withColumnRenamed("ratio", "metric"), "newlines", 1.25, m.between(0.8, 1.25)), gap(artifacts(docs), 5, "artifacts"),
        line(common, "vocabulary", 50, m >= 50), line(trigram_problems(docs).agg(F.count("*").alias("metric")), "trigrams", 0, m == 0), gap(topic_rate(docs, topic), 20, "topic"),
    ]
    return reduce(DataFrame.unionByName, parts)


def leaks(docs: DataFrame) -> DataFrame:
    """One row: texts with what cleaning should have removed, and mean newlines and characters (0 without texts)."""
    t = F.col("text")
    tests = {"wrote": t.contains("wrote:"), "quote_from": t.contains("Quote from:"), "starts_quote": t.startswith("Quote"), "link": t.contains("http")}
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return docs.agg(*(F.count_if(p).alias(k) for k, p in tests.items()), mean(T.occurrences(t, "\n")).alias("newlines"), mean(F.length(t)).alias("chars"))


def classifier_check(folds: DataFrame, limit: float = 0.9) -> DataFrame:
    """The naive classifier's folds -> one more check: its mean accuracy is `limit` at most."""
    row = folds.agg(F.avg("accuracy").alias("metric"))
    return row.select(F.lit("classifier").alias("check"), F.round("metric", 6).alias("metric"), F.lit(limit).alias("threshold"), (F.col("metric") <= limit).alias("passed"))


def verdict(checks: DataFrame) -> DataFrame:
    """One row: how many checks, and whether all passed."""
    return checks.agg(F.count("*").alias("checks"), F.bool_and("passed").alias("passed"))
