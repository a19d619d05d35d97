"""JSON arrays in and out, writers' files, and mail archives cut into messages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, word_count

ITEM = "source string, url string, title string, date string, number int, msg_num int, thread_id bigint, author string, same_thread boolean, text string"


def items(spark: SparkSession, *paths: str) -> DataFrame:
    """Objects of JSON arrays; fields that a file lacks are null."""
    return spark.read.schema(ITEM).option("multiLine", True).json(list(paths))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """writer, text: arrays of strings, one file a writer, named by it."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_name").alias("file"))
    name = F.initcap(F.replace(F.regexp_replace("file", r"\.json$", ""), F.lit("_"), F.lit(" ")))
    return rows.select(name.alias("writer"), F.explode(F.from_json("value", "array<string>")).alias("text"))


def grid(spark: SparkSession, first: int, last: int, form: str) -> DataFrame:
    """id, url: a range of numbers as addresses."""
    return spark.range(first, last + 1).select("id", F.format_string(form, "id").alias("url"))


def blocks(text: Column, author: str, least: int = 10, any_case: bool = False) -> Column:
    """Messages of one author in an archive page, of `least` words or more: cut before each From: line, body behind the last header line."""
    mark = rf"(?={'(?i)' if any_case else ''}From:\s*{re.escape(author)})"
    parts = F.filter(F.split(text, mark, -1), lambda p: F.lower(F.left(p, F.lit(200))).contains(author.lower()))

    def body(p: Column) -> Column:
        lines = F.split(p, "\n", -1)
        last = F.array_position(F.transform(F.reverse(lines), lambda x: x.rlike(r"^\s*[A-Z][A-Za-z-]*:")), True)
        kept = F.slice(lines, F.when(last > 0, F.size(lines) - last + 2).otherwise(1).cast("int"), F.size(lines))
        return strip(F.array_join(F.filter(kept, lambda x: ~F.ltrim(x).startswith(">")), "\n"))

    return F.filter(F.transform(parts, body), lambda b: word_count(b) >= least)


def write_splits(rows: DataFrame, folder: str) -> None:
    """One folder a split, JSON lines."""
    rows.write.mode("overwrite").partitionBy("split").json(folder)


def write_set(values: DataFrame, column: str, path: str) -> None:
    """The distinct values of a column, ascending, one a line; an earlier set there is replaced."""
    values.select(F.col(column).cast("string").alias(column), F.col(column).alias("by")).where(F.col("by").isNotNull()).distinct().orderBy("by").select(column).write.mode("overwrite").text(path)


def replace(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Each table written as JSON lines to its own folder, in place of what was there; the names of those that were empty."""
    empty = [name for name, rows in tables.items() if rows.isEmpty()]
    for name, rows in tables.items():
        if name not in empty:
            rows.write.mode("overwrite").json(f"{folder}/{name}")
    return empty
