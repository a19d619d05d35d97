"""Style features of a document: profile S of 126 and profile L of 146, as doubles in columns.

Every feature is a ratio of integers or of sums of them. A text without words has null features. Types, hapaxes and all
listed words are counted text by text in Arrow batches, so nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .batches import bounded

# The lists that the features are defined by.
FUNCTION_WORDS = [
    "the", "a", "an", "and", "or", "but", "if", "then", "that", "which",
    "who", "whom", "this", "these", "those", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "shall", "can",
    "not", "no", "nor", "so", "yet", "also", "just", "only", "very",
    "still", "already", "even", "now", "here", "there", "where",
    "when", "how", "what", "why", "all", "each", "every", "both",
    "few", "more", "most", "other", "some", "such", "than", "too",
    "of", "in", "for", "on", "with", "at", "by", "from", "to",
    "into", "through", "about", "after", "before", "between", "under",
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her",
    "us", "them", "my", "your", "his", "its", "our", "their",
]
MORE_FUNCTION_WORDS = [
    "above", "up", "down", "out", "off", "over", "again", "further",
    "myself", "yourself", "himself", "itself", "ourselves", "themselves",
]
FIRST, FIRST_PLURAL, SECOND = ["i", "me", "my", "mine", "myself"], ["we", "us", "our", "ours"], ["you", "your", "yours"]
HEDGE = ["think", "believe", "probably", "maybe", "perhaps", "seems", "likely", "might", "could", "would", "guess", "suppose"]
CERTAIN = ["definitely", "certainly", "always", "never", "must", "obviously", "clearly"]
HEDGE_L = [*HEDGE, "unlikely", "should", "assume", "possible", "possibly"]
CERTAIN_L = [*CERTAIN, "exactly", "absolutely"]
PUNCTUATION = {"comma": ",", "semicolon": ";", "colon": ":", "excl": "!", "quest": "?", "dash": "-", "paren": "()", "quote": "\"'", "ellipsis": "..."}
LONG_NAMES = {"excl": "exclamation", "quest": "question"}
CONTRACTION = r"(?U)\w+n't|\w+'[a-z]{1,2}"

PROFILES = {
    "s": {"words": FUNCTION_WORDS, "first_person": FIRST, "first_person_pl": FIRST_PLURAL, "second_person": SECOND, "hedge_rate": HEDGE, "certainty_rate": CERTAIN},
    "l": {"words": [*FUNCTION_WORDS, *MORE_FUNCTION_WORDS], "first_person_rate": FIRST, "first_person_plural_rate": [*FIRST_PLURAL, "ourselves"], "second_person_rate": [*SECOND, "yourself"], "hedge_rate": HEDGE_L, "certainty_rate": CERTAIN_L},
}


def _counts(listed: Sequence[str]):
    """Text -> types, once (words that occur once) and n, how often each listed word occurs, in lower case."""

    @F.pandas_udf("types int, once int, n array<int>")
    def counts(text: pd.Series) -> pd.DataFrame:
        found = [Counter((x or "").lower().split()) for x in text]
        once = [sum(n == 1 for n in c.values()) for c in found]
        return pd.DataFrame({"types": list(map(len, found)), "once": once, "n": [np.array([c[w] for w in listed], np.int32) for c in found]})

    return counts


def _rate(n: Column) -> Column:
    return F.try_divide(n, F.col("wc"))


def _deviation(n: Column, s: Column, q: Column) -> Column:
    return F.sqrt(F.try_divide(n * q - s * s, n * n))


def _measures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, the lists of words and sentence, word and paragraph lengths, and counts that need the text itself."""
    t = F.col(text)
    size = lambda c: F.filter(F.transform(c, lambda x: T.word_count(x, far=False).cast("long")), lambda n: n > 0)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    squares = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x * x)
    marks = {f"n_{k}": T.occurrences(t, v) if k == "ellipsis" else sum((T.occurrences(t, c) for c in v[1:]), T.occurrences(t, v[0])) for k, v in PUNCTUATION.items()}
    rows = docs.select(F.col(key), t.alias("t"), T.words(t).alias("w"), size(F.split(T.plain(t), "[.!?]+", -1)).alias("sl"), size(F.split(T.plain(t), "\n\n", -1)).alias("pl"), F.regexp_count(F.lower(t), F.lit(CONTRACTION)).alias("n_contraction"), *(v.alias(k) for k, v in marks.items()))
    rows = rows.withColumns({"wl": F.transform("w", lambda x: F.length(x).cast("long")), "wc": F.size("w").cast("long")})
    upper = lambda x: (x == F.upper(x)) & (x != F.lower(x))
    first = lambda x: F.substring(x, 1, 1)
    count = lambda c, f: F.size(F.filter(c, f)).cast("long")
    return rows.select(
        key, "t", "wc", "n_contraction", *marks,
        F.size("sl").cast("long").alias("sn"), total("sl").alias("ss"), squares("sl").alias("sq"), F.array_max("sl").alias("s_max"), F.array_min("sl").alias("s_min"),
        total("wl").alias("ws"), squares("wl").alias("wq"), count("wl", lambda x: x > 6).alias("w_long"), count("wl", lambda x: x <= 3).alias("w_short"),
        F.size("pl").cast("long").alias("pn"), total("pl").alias("ps"),
        count("w", lambda x: upper(x) & (F.length(x) > 1)).alias("w_caps"), count("w", lambda x: upper(first(x)) & ~upper(x)).alias("w_initial"),
    )


def features(docs: DataFrame, profile: str = "s", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the profile's features, sorted by name. Keys are unique."""
    bounded(docs.sparkSession)
    lists = PROFILES[profile]
    wanted = sorted({w for ws in lists.values() for w in ws})
    base = _measures(docs, key, text).withColumn("c", _counts(wanted)("t"))
    rows = base.select(*(c for c in base.columns if c not in ("t", "c")), "c.types", "c.once", F.col("c.n").alias("freq"))
    at = {w: i for i, w in enumerate(wanted)}
    n = lambda w: F.get("freq", F.lit(at[w]))
    some = lambda ws: _rate(sum((n(w) for w in ws[1:]), n(ws[0])))
    out = {f"fw_{w}": _rate(n(w)) for w in lists["words"]} | {k: some(ws) for k, ws in lists.items() if k != "words"}
    long = profile == "l"
    out |= {(f"punct_{LONG_NAMES.get(k, k)}_rate" if long else f"punct_{k}"): _rate(F.col(f"n_{k}")) for k in PUNCTUATION}
    some_sent = F.col("sn") > 0
    zero = lambda c: F.when(F.col("wc") > 0, F.when(some_sent, c).otherwise(F.lit(0.0)))
    deviation = _deviation(F.col("sn"), F.col("ss"), F.col("sq"))
    out |= {"contraction_rate": _rate(F.col("n_contraction")), "word_long_rate": _rate(F.col("w_long")), "word_short_rate": _rate(F.col("w_short"))}
    plain = lambda c: F.when(F.col("wc") > 0, F.col(c).cast("double"))
    if long:
        out |= {"sent_mean_length": zero(F.try_divide("ss", "sn")), "sent_std_length": zero(deviation), "sent_max_length": zero(F.col("s_max").cast("double")), "sent_min_length": zero(F.col("s_min").cast("double")), "sent_count": plain("sn")}
        out |= {"word_mean_length": _rate(F.col("ws")), "word_std_length": _deviation(F.col("wc"), F.col("ws"), F.col("wq")), "vocab_type_token_ratio": _rate(F.col("types")), "vocab_hapax_ratio": _rate(F.col("once"))}
        out |= {"cap_all_caps_rate": _rate(F.col("w_caps")), "cap_initial_caps_rate": _rate(F.col("w_initial")), "para_count": plain("pn"), "para_mean_length": F.when(F.col("wc") > 0, F.coalesce(F.try_divide("ps", "pn"), F.lit(0.0)))}
    else:
        out |= {"sent_mean": zero(F.try_divide("ss", "sn")), "sent_std": zero(deviation), "sent_count": _rate(F.col("sn")) * 100, "word_mean_len": _rate(F.col("ws")), "vocab_ttr": _rate(F.col("types")), "vocab_hapax": _rate(F.col("once")), "para_count": _rate(F.col("pn")) * 100}
    return rows.select(key, *(out[k].alias(k) for k in sorted(out)))


def names(profile: str = "s") -> list[str]:
    """Names of a profile's features, sorted."""
    lists = PROFILES[profile]
    long = profile == "l"
    own = [f"fw_{w}" for w in lists["words"]] + [k for k in lists if k != "words"] + [f"punct_{LONG_NAMES.get(k, k)}_rate" if long else f"punct_{k}" for k in PUNCTUATION] + ["contraction_rate", "word_long_rate", "word_short_rate", "sent_count", "para_count"]
    own += ["sent_mean_length", "sent_std_length", "sent_max_length", "sent_min_length", "word_mean_length", "word_std_length", "vocab_type_token_ratio", "vocab_hapax_ratio", "cap_all_caps_rate", "cap_initial_caps_rate", "para_mean_length"] if long else ["sent_mean", "sent_std", "word_mean_len", "vocab_ttr", "vocab_hapax"]
    return sorted(own)
