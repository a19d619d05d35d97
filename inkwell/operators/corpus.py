"""Building a corpus: chunks, keep-first dedup, decontamination, cohorts, splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def chunks(text: Column, least: int = 50, most: int = 400) -> Column:
    """Paragraphs folded to chunks of about least to most words; a tail under least words is dropped.

    The fold finds where each chunk ends, as pairs of numbers; paragraphs are joined once, from these.
    """
    ends = "array<struct<upto: int, n: int>>"

    def merge(acc: Column, p: Column) -> Column:
        flush = (acc["n"] + p["n"] > most) & (acc["n"] >= least)
        out = F.when(flush, F.concat(acc["out"], F.array(F.struct(acc["i"].alias("upto"), acc["n"].alias("n"))))).otherwise(acc["out"])
        return F.struct(out.alias("out"), (acc["i"] + 1).alias("i"), F.when(flush, p["n"]).otherwise(acc["n"] + p["n"]).alias("n"))

    def joined(ps: Column) -> Column:
        start = F.struct(F.array().cast(ends).alias("out"), F.lit(0).alias("i"), F.lit(0).alias("n"))
        last = lambda a: F.when(a["n"] >= least, F.concat(a["out"], F.array(F.struct(a["i"].alias("upto"), a["n"].alias("n"))))).otherwise(a["out"])
        cuts = F.aggregate(ps, start, merge, last)
        first = lambda x, i: F.when(i > 0, F.get(x, i - 1)["upto"]).otherwise(0)
        part = lambda x, c, i: F.array_join(F.transform(F.slice(ps, first(x, i) + 1, c["upto"] - first(x, i)), lambda p: p["text"]), "\n\n")
        return T.let(cuts, lambda x: F.transform(x, lambda c, i: part(x, c, i)))

    counted = F.transform(F.split(text, "\n\n+", -1), lambda p: F.struct(p.alias("text"), T.word_count(p).alias("n")))
    folded = T.let(F.filter(counted, lambda p: p["n"] > 0), joined)
    wc = T.word_count(text)
    return F.when(wc > most, folded).when(wc >= least, F.array(text)).otherwise(F.array().cast("array<string>"))


def chunked(docs: DataFrame, least: int = 50, most: int = 400) -> DataFrame:
    keep = [c for c in docs.columns if c != "text"]
    rows = docs.select(*keep, F.posexplode(chunks(F.col("text"), least, most)).alias("chunk_index", "text"))
    return rows.withColumn("word_count", T.word_count(F.col("text")))


def keep_first(docs: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row by order of each key. Columns of order tell all rows apart; they alone are aggregated, in part before the shuffle."""
    first = docs.groupBy(*(k.alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min(F.struct(*order)).alias("__first")).select("__first.*")
    return docs.join(first, order, "left_semi")


def decontaminate(docs: DataFrame, label: str = "label", prefix: int = 200) -> DataFrame:
    """Negatives whose prefix a positive has go. Spark chooses the join by the keys' size."""
    key = F.left(F.col("text"), F.lit(prefix))
    positive = docs.where(F.col(label) == 1).select(key.alias("__key")).distinct()
    kept = docs.where(F.col(label) == 0).withColumn("__key", key).join(positive, "__key", "left_anti").drop("__key")
    return docs.where(F.col(label) == 1).unionByName(kept)


def hash_order(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")).cast("binary"))


#: Leading digits of the hash by which the rows of a label are dealt to ranges.
DIGITS = 3


def ranked(rows: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """rows with __i, the place (from 1) in a hashed order within each label, and __n, the label's rows.

    A range of the hash is ranked in one task, after the counts of the ranges before it; labels are few.
    """
    hashed = rows.withColumn("__h", hash_order(key, seed)).withColumn("__range", F.left("__h", F.lit(DIGITS)))
    counts = hashed.groupBy(F.col(label).alias("__label"), F.col("__range").alias("__of")).agg(F.count("*").alias("__c"))
    all_ = Window.partitionBy("__label")
    before = F.sum("__c").over(all_.orderBy("__of").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")
    counts = counts.withColumns({"__before": before, "__n": F.sum("__c").over(all_)}).drop("__c")
    own = Window.partitionBy(label, "__range").orderBy("__h", key)
    placed = hashed.withColumn("__at", F.row_number().over(own))
    joined = placed.join(F.broadcast(counts), F.col(label).eqNullSafe(F.col("__label")) & (F.col("__range") == F.col("__of")))
    return joined.withColumn("__i", F.col("__before") + F.col("__at")).select(*rows.columns, "__i", "__n")


def splits(rows: DataFrame, label: str, key: str, floors: tuple[int, int, int] = (20, 15, 15), shares: tuple[float, float, float] = (0.2, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """split: golden, test, val, train by position in a hashed order within each label; floors are least sizes."""
    n, i = F.col("__n"), F.col("__i")
    g, t, v = (F.greatest(F.lit(f), F.floor(n * s)) for f, s in zip(floors, shares, strict=True))
    split = F.when(i <= g, "golden").when(i <= g + t, "test").when(i <= g + t + v, "val").otherwise("train")
    return ranked(rows, label, key, seed).withColumn("split", split).drop("__i", "__n")


def folds(rows: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    return ranked(rows, label, key, seed).withColumn("fold", ((F.col("__i") - 1) % k).cast("int")).drop("__i", "__n")


def holdout(rows: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    return ranked(rows, label, key, seed).withColumn("held_out", F.col("__i") <= F.ceil(F.col("__n") * share)).drop("__i", "__n")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """label, n, weight: n / (2 n_c)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__all")))).select(label, "n", (F.col("__all") / (2 * F.col("n"))).alias("weight"))
