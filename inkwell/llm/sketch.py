"""Document fingerprints: threshold-scaled sketches of word shingles.

A shingle is five consecutive words (fewer words: the whole sequence), hashed by XXH64; a sketch is the set of all
hashes below a fixed fraction of the range. Sketches of parts merge to the sketch of the whole by union, and the shares
of common hashes estimate resemblance and containment however unequal the documents are. A text with words of which
no hash is below the fraction keeps its least hash, so that short texts can be told apart too; merging applies the
same rule, so a merged sketch is the sketch of the whole.

Defined cases: a null text is empty; a text without words has an empty sketch and an empty fingerprint; two empty
sketches are alike (1), an empty one and another aren't (0); equal texts have equal fingerprints; an empty table gives
an empty result; rows that share a doc_id follow each other by a hash of the text; rows without a doc_id come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

SHINGLE, FRACTION = 5, 0.25
#: Documents that are ordered in one task at once, about; parts of the order of all documents, at most.
CELL, QUANTILES = 1024, 256


def _threshold(fraction: float) -> int:
    return min(int(fraction * 2**64), 2**64 - 1) - (1 << 63)


def sketch(text: Column, shingle: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """Ascending distinct hashes (longs) of a text's shingles below the fraction."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))

    def of(hashes: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(hashes) - shingle), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(shingle))))
        whole = F.array(F.aggregate(hashes, F.lit(42).cast("long"), lambda a, h: F.xxhash64(a, h)))
        return F.when(F.size(hashes) >= shingle, grams).when(F.size(hashes) > 0, whole).otherwise(F.array().cast("array<long>"))

    return _let(_let(words, of), lambda hashes: _below(hashes, fraction))


def _below(hashes: Column, fraction: float) -> Column:
    """The hashes below the fraction, else the least."""
    kept = F.filter(hashes, lambda h: h < _threshold(fraction))
    return F.when(F.size(kept) > 0, F.sort_array(F.array_distinct(kept))).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(kept)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def merged(sketches: Column, fraction: float = FRACTION) -> Column:
    """An array of sketches of one fraction -> the sketch of their texts' shingles together.

    A least hash that a part has kept for want of others goes where another part has hashes below the fraction.
    """
    return _let(F.flatten(sketches), lambda hashes: _below(hashes, fraction))


def resemblance(a: Column, b: Column) -> Column:
    """Share of the common hashes in all hashes of both."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(_let(common, lambda c: c / (F.size(a) + F.size(b) - c)))


def containment(a: Column, b: Column) -> Column:
    """Share of a's hashes that b has."""
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def text_of(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _bounds(docs: DataFrame, own: int) -> tuple[list[int], int]:
    """Ascending bounds of doc_id, QUANTILES at most, that cut the documents to about equal parts, and how many cells of `own` documents a part has."""
    shares = [i / QUANTILES for i in range(1, QUANTILES)]
    n, low, found = docs.agg(F.count("*"), F.min("doc_id"), F.percentile_approx("doc_id", shares, 10_000)).first()
    return sorted({low, *(found or [])} - {None}), 1 + n // (QUANTILES * own)


def _cells(docs: DataFrame, own: int) -> DataFrame:
    """docs with part and cell, ascending with doc_id and, among equal ids, with tie; rows without an id have the last part.

    Parts are quantiles of doc_id; a part is cut evenly between its bounds, and documents that share the id at its
    lower bound, or have none, are cut evenly by a hash of the text, so that no cell grows with the table.
    """
    bounds, cells = _bounds(docs, own)
    ends = F.array(*(F.lit(x).cast("long") for x in bounds)) if bounds else F.array().cast("array<long>")
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(ends, lambda x: x <= F.col("doc_id"))))
    rows = docs.withColumns({"tie": F.xxhash64("text"), "part": part})
    low, high = F.get(ends, F.col("part") - 1), F.get(ends, F.col("part"))
    even = (F.col("tie").cast("double") + 2.0**63) / 2.0**64
    wide = F.coalesce((F.col("doc_id").cast("double") - low) / F.greatest(high.cast("double") - low, F.lit(1.0)), F.lit(0.0))
    last = F.floor((F.col("doc_id") - low) / F.lit(own)).cast("long")  # beyond the last bound there is no other
    some = F.lit(cells * QUANTILES)
    tied = F.col("doc_id").isNull() | (F.col("doc_id") == low)
    cell = F.when(tied, F.floor(even * some)).when(high.isNull(), some + last).otherwise(some + F.floor(wide * cells))
    return rows.withColumn("cell", cell.cast("long"))


def _following(cells: DataFrame) -> DataFrame:
    """Distinct part, cell -> p_part, p_cell, part, cell: each and the one before it; before the first is the last.

    The window over parts, which are QUANTILES and one at most, is the one that runs in a single task.
    """
    own = Window.partitionBy("part").orderBy("cell")
    led = cells.withColumns({"next": F.lead("cell").over(own), "rank": F.row_number().over(own)})
    firsts = led.where("rank = 1").select("part", F.col("cell").alias("first"))
    after = firsts.agg(F.sort_array(F.collect_list(F.struct("part", "first"))).alias("all"))
    after = after.select(F.posexplode("all").alias("i", "x"), "all").select(F.col("x.part").alias("a_part"), F.get("all", (F.col("i") + 1) % F.size("all")).alias("after"))
    joined = led.join(F.broadcast(after), F.col("part") == F.col("a_part"))
    inner = F.col("next").isNotNull()
    return joined.select(F.col("part").alias("p_part"), F.col("cell").alias("p_cell"), F.when(inner, F.col("part")).otherwise(F.col("after.part")).alias("part"), F.coalesce("next", "after.first").alias("cell"))


def with_next(docs: DataFrame, columns: list[str], own: int = CELL) -> DataFrame:
    """doc_id, text and others -> with next_<column>: the values of the next document by doc_id; after the last comes the first."""
    cells = _cells(docs, own)
    order = Window.partitionBy("part", "cell").orderBy(F.col("doc_id"), F.col("tie"), F.col("text"))
    led = cells.withColumns({f"next_{c}": F.lead(F.struct(c)).over(order) for c in columns})
    firsts = cells.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    firsts = firsts.join(_following(cells.select("part", "cell").distinct()), ["part", "cell"])
    firsts = firsts.select(F.col("p_part").alias("part"), F.col("p_cell").alias("cell"), *(F.col(c).alias(f"first_{c}") for c in columns))
    joined = led.join(firsts, ["part", "cell"])
    return joined.select(*docs.columns, *(F.when(F.col(f"next_{c}").isNull(), F.col(f"first_{c}")).otherwise(F.col(f"next_{c}.{c}")).alias(f"next_{c}") for c in columns))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """doc_id, text -> doc_id, n_chars, edited (half of the text replaced by the next document's), sketches and likenesses."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), sketch(text, shingle, fraction).alias("sketch"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    both = with_next(own, ["text", "sketch"]).select("doc_id", F.length("text").cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    both = both.withColumn("edited_sketch", sketch(F.col("edited"), shingle, fraction))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return both.withColumns({"near_edited": resemblance(a, b), "near_next": resemblance(a, c), "in_edited": containment(a, b), "in_next": containment(a, c)})
