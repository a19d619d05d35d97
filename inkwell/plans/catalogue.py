"""Queries over the tables of a folder, one or more for each operator, with the SQL that they must equal."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches
from ..functions import features as X
from ..functions import text as T
from ..operators import audit, clean, corpus, model, score, terms
from ..sources import files, html, pages
from . import cleaning

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batches.bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their class: label is quality."""
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


TOKENS = r"regexp_extract_all(text, '[^\s\x0b\x1c-\x1f\x85\pZ]+')"
WC = f"len({TOKENS})"
LABELLED = "(select d.*, quality as label from documents d join labels l using (doc_id))"

#: Text with what cleaning removes, by the id; the same expression in both dialects.
DECORATED = """case doc_id % 6
when 0 then concat('Quote from: someone on a day', chr(10), 'quoted words here', chr(10), chr(10), text, chr(10), 'Quote from: last', chr(10), 'unended')
when 1 then concat('On the third of a month one wrote:', chr(10), '> quoted', chr(10), 'Bob wrote:', chr(10), 'Quote', chr(10), replace(text, '.', '...'))
when 2 then concat(replace(text, chr(10), concat(chr(13), chr(10))), chr(13), 'an', chr(160), 'old', chr(8203), chr(13), 'line', chr(65279), chr(10), '-- ', chr(10), 'a signature', chr(10), '-- ', chr(10), 'more')
when 3 then concat('see http://a.b/c now', chr(10), 'Code:', chr(10), 'x = 1', chr(10), chr(10), chr(10), text, chr(10), 'Code:', chr(10), 'y')
when 4 then concat('A list', chr(10), 'Title', chr(10), '12', chr(10), 'From:', chr(10), 'someone', chr(10), 'Date:', chr(10), 'May 3, 2009, 10:20:30 UTC', chr(10), text, chr(10), 'View original', chr(10), 'Next', chr(10))
else concat('[snip]', chr(10), '12345', chr(10), '123', chr(10), 'Subject: q', chr(10), 'January 3, 2009', chr(10), 'it', chr(8217), 's  ', chr(8220), 'fine', chr(8221), chr(8212), 'don', chr(39), 't', chr(8230), '  (I think; maybe: yes?)', chr(10), replace(text, chr(10), concat(chr(10), chr(10)))) end"""
#: Spark's chr() ends at 255.
SIGNS = re.compile(r"chr\((\d{3,})\)")
DECORATED_SQL = f"(select doc_id, {DECORATED} as text from documents)"


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.expr(SIGNS.sub(lambda m: f"'{chr(int(m[1]))}'", DECORATED)).alias("text"))


# Counts, filters, aggregates


@query(f"select doc_id, {WC}::int as word_count from documents")
def doc_word_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("word_count"))


for least in (15, 50):
    query(f"select doc_id, {WC}::int as word_count from documents where {WC} >= {least}", f"min_words_{least}")(lambda spark, sf_dir, n=least: doc_word_count(spark, sf_dir).where(F.col("word_count") >= n))


@query(f"select source, count(*) as n, sum({WC})::bigint as words from documents group by rollup (source)")
def source_stats_rollup(spark, sf_dir):
    return docs(spark, sf_dir).rollup("source").agg(F.count("*").alias("n"), F.sum(T.word_count(F.col("text"))).alias("words"))


@query("select source, count(*) as n from documents group by source order by n desc, source limit 15")
def author_topk(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(15)


@query(f"""with w as (select {WC} as x from documents), o as (select x, row_number() over (order by x) as i, count(*) over () as n from w)
select min(x)::int as low, max(x)::int as high, round(avg(x), 6) as mean, max(x) filter (i = n // 2 + 1)::int as upper_median, median(x)::double as median,
quantile_cont(x, 0.25)::double as p25, quantile_cont(x, 0.75)::double as p75, round(stddev_pop(x), 6) as deviation from o""")
def length_stats(spark, sf_dir):
    x = F.col("word_count")
    rows = doc_word_count(spark, sf_dir)
    upper = F.expr("percentile_disc(0.5) within group (order by word_count desc)").cast("int")  # from above: the upper one of two middles
    return rows.agg(
        F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.avg(x), 6).alias("mean"), upper.alias("upper_median"), F.median(x).alias("median"),
        F.percentile(x, 0.25).alias("p25"), F.percentile(x, 0.75).alias("p75"), F.round(F.stddev_pop(x), 6).alias("deviation"),
    )


@query("""select doc_id as id, source, coalesce(lang, 'unknown') as author, source in ('src1', 'src2', 'src3', 'src4', 'src5') as archive, 1 as label, 'positive' as label_name
from documents where source like '%1%' union all
select conv_id, role, 'unknown', false, 0, 'negative' from (select distinct conv_id, role from conversations where role = 'user')""")
def source_flag_union(spark, sf_dir):
    pos = docs(spark, sf_dir).where(F.col("source").contains("1")).select(F.col("doc_id").alias("id"), "source", F.coalesce("lang", F.lit("unknown")).alias("author"), F.col("source").isin("src1", "src2", "src3", "src4", "src5").alias("archive"), F.lit(1).alias("label"), F.lit("positive").alias("label_name"))
    neg = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("id"), F.col("role").alias("source")).distinct()
    return pos.unionByName(neg.withColumns({"author": F.lit("unknown"), "archive": F.lit(False), "label": F.lit(0), "label_name": F.lit("negative")}))


@query("""select conv_id, turn, role, conv_id in (select conv_id from conversations where role = 'system') as same_thread from conversations where lower(role) <> 'system'
and conv_id in (select conv_id from conversations where role = 'system')""")
def same_thread_semi(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    ids = conv.where("role = 'system'").select("conv_id").distinct()
    return conv.where("lower(role) <> 'system'").join(ids, "conv_id", "left_semi").select("conv_id", "turn", "role", F.lit(True).alias("same_thread"))


@query("""select conv_id, turn, role, c.conv_id in (select conv_id from conversations where role = 'system') as same_thread from conversations c where lower(role) <> 'system'""")
def same_thread_flag(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    ids = conv.where("role = 'system'").select(F.col("conv_id").alias("own")).distinct()
    return conv.where("lower(role) <> 'system'").join(ids, F.col("conv_id") == F.col("own"), "left").select("conv_id", "turn", "role", F.col("own").isNotNull().alias("same_thread"))


@query("select r as id from range(1, 2001, 25) t(r) where r not in (select conv_id from conversations where role = 'system') order by id limit 40")
def supplement_anti_stride(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").where("role = 'system'").select(F.col("conv_id").alias("id")).distinct()
    return spark.range(1, 2001, 25).join(ids, "id", "left_anti").orderBy("id").limit(40)


@query("select doc_id, source from documents qualify row_number() over (partition by substr(text, 1, 200) order by doc_id) = 1")
def dedup_prefix200(spark, sf_dir):
    return corpus.keep_first(docs(spark, sf_dir), [F.left("text", F.lit(200))], ["doc_id"]).select("doc_id", "source")


@query(f"select doc_id, label from {LABELLED} where label = 1 or substr(text, 1, 200) not in (select substr(text, 1, 200) from {LABELLED} where label = 1)")
def decontaminate_anti(spark, sf_dir):
    return corpus.decontaminate(labelled(spark, sf_dir)).select("doc_id", "label")


@query("select doc_id from documents order by md5(concat(doc_id, '#42')), doc_id limit 5")
def sample5(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").orderBy(corpus.hash_order("doc_id"), "doc_id").limit(5)


@query("select doc_id, source from documents order by doc_id limit 100")
def first100(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "source").orderBy("doc_id").limit(100)


@query("select b.item_id, count(d.doc_id) as n from benchmark b left join documents d on contains(d.text, b.text) group by all")
def phrase_containment(spark, sf_dir):
    """The phrases, a small fixed list, are looked for in each text in turn."""
    phrases = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))
    found = docs(spark, sf_dir).select("doc_id", "text").join(F.broadcast(phrases), F.contains("text", "phrase")).groupBy("item_id").agg(F.count("*").alias("n"))
    return phrases.join(found, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))


# Audits

VOCABULARY = f"""with v as (select label, word, count(*) as n from (select label, regexp_replace(unnest(regexp_extract_all(lower(text), '[^\\s\\x0b\\x1c-\\x1f\\x85\\pZ]+')), '[^a-z]', '', 'g') as word from {LABELLED})
where len(word) > 2 and word not in ({', '.join(repr(w) for w in audit.STOP_WORDS)}) group by label, word qualify row_number() over (partition by label order by count(*) desc, word) <= 200)"""


@query(f"{VOCABULARY} select count(*) filter (k = 2) as common, count(*) filter (k = 1 and p = 1) as pos_only, count(*) filter (k = 1 and p = 0) as neg_only from (select word, count(*) as k, max(label) as p from v group by word)")
def vocab_top200_overlap(spark, sf_dir):
    words = audit.vocabulary(labelled(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("k"), F.max("label").alias("p"))
    return words.agg(F.count_if(F.col("k") == 2).alias("common"), F.count_if((F.col("k") == 1) & (F.col("p") == 1)).alias("pos_only"), F.count_if((F.col("k") == 1) & (F.col("p") == 0)).alias("neg_only"))


TRIGRAMS = f"""with t as (select label, substr(text, i, 3) as tri from (select label, text, unnest(range(1, len(text) - 1)) as i from {LABELLED} where len(text) > 2)),
c as (select tri, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from t group by tri)"""


@query(f"{TRIGRAMS} select * from c")
def trigram_dist(spark, sf_dir):
    return audit.trigrams(labelled(spark, sf_dir))


@query(f"{TRIGRAMS}, p as (select tri, pos * 100 / sum(pos) over () as pos, neg * 100 / sum(neg) over () as neg from c) select tri, round(pos, 9) as pos, round(neg, 9) as neg from p where (pos > 1 and neg < 0.1) or (neg > 1 and pos < 0.1)")
def trigram_problems(spark, sf_dir):
    return audit.trigram_problems(labelled(spark, sf_dir)).select("tri", F.round("pos", 9).alias("pos"), F.round("neg", 9).alias("neg"))


@query(f"{SQL['trigram_problems']} order by abs(pos - neg) desc, tri limit 10")
def trigram_problems_top10(spark, sf_dir):
    return trigram_problems(spark, sf_dir).orderBy(F.desc(F.abs(F.col("pos") - F.col("neg"))), "tri").limit(10)


@query(f"select source, count(*) filter (label = 1) * 100 / (select count(*) from {LABELLED} where label = 1) as pos, count(*) filter (label = 0) * 100 / (select count(*) from {LABELLED} where label = 0) as neg from {LABELLED} group by source")
def source_parity(spark, sf_dir):
    return audit.source_parity(labelled(spark, sf_dir))


@query(f"""with x as (select {WC} as x, label from {LABELLED}), c as (select x, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from x group by x),
r as (select sum(p) over (order by x) as p, sum(n) over (order by x) as n, sum(p) over () as ps, sum(n) over () as ns from c) select round(max(abs(p / ps - n / ns)), 9) as d from r""")
def ks_length(spark, sf_dir):
    return audit.ks(labelled(spark, sf_dir), T.word_count(F.col("text"))).select("d")


@query(f"with n as (select label, len(text) - len(replace(text, chr(10), '')) as n from {LABELLED}) select sum(n) filter (label = 1) / count(*) filter (label = 1) as pos, sum(n) filter (label = 0) / count(*) filter (label = 0) as neg from n")
def newline_density(spark, sf_dir):
    return audit.newline_density(labelled(spark, sf_dir)).select("pos", "neg")


def _artifact_sql(name: str) -> str:
    return {"[": "contains(substr(text, 1, 50), '[')", "Re:": "contains(substr(text, 1, 30), 'Re:')", ">": "len([x for x in string_split(text, chr(10)) if regexp_matches(x, '^\\s*>')]) > 0"}.get(name, f"contains(text, '{name}')")


DECORATED_LABELLED = f"(select d.doc_id, d.text, quality as label from {DECORATED_SQL} d join labels using (doc_id))"


@query(" union all ".join(f"select '{a}' as \"check\", count(*) filter (label = 1 and {_artifact_sql(a)}) * 100 / count(*) filter (label = 1) as pos, count(*) filter (label = 0 and {_artifact_sql(a)}) * 100 / count(*) filter (label = 0) as neg from {DECORATED_LABELLED}" for a in audit.ARTIFACTS))
def artifact_rates(spark, sf_dir):
    return audit.artifacts(decorated(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id"))


@query(f"select 'ation' as \"check\", count(*) filter (label = 1 and contains(lower(text), 'ation')) * 100 / count(*) filter (label = 1) as pos, count(*) filter (label = 0 and contains(lower(text), 'ation')) * 100 / count(*) filter (label = 0) as neg from {LABELLED}")
def topic_mention_rate(spark, sf_dir):
    return audit.topic_rate(labelled(spark, sf_dir), "ation")


def _gap_sql(rows: str, name: str, limit: int) -> str:
    return f"select '{name}' as \"check\", round(max(abs(pos - neg)), 6) as metric, {limit}::double as threshold, max(abs(pos - neg)) <= {limit} as passed from ({rows})"


def _line_sql(rows: str, name: str, limit: float, ok: str) -> str:
    return f"select '{name}' as \"check\", round(metric::double, 6) as metric, {limit}::double as threshold, {ok} as passed from ({rows})"


def _artifact_rates(rows: str) -> str:
    share = lambda a, y: f"count(*) filter (label = {y} and {_artifact_sql(a)}) * 100 / count(*) filter (label = {y})"
    return " union all ".join(f"select '{a}' as \"check\", {share(a, 1)} as pos, {share(a, 0)} as neg from {rows}" for a in audit.ARTIFACTS)


_KS = f"""with d as (select max(abs(p / ps - n / ns)) as d, max(ps) as ps, max(ns) as ns from (
  select sum(p) over (order by x) as p, sum(n) over (order by x) as n, sum(p) over () as ps, sum(n) over () as ns from (
    select x, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from (select {WC} as x, label from {LABELLED}) group by x))),
r as (select d, sqrt(ps * ns / (ps + ns)) as root from d),
l as (select d, (root + 0.12 + 0.11 / root) * d as lam from r)
select case when d < 1e-9 then 1 else greatest(0, least(1, list_sum([(case when j % 2 = 1 then 2 else -2 end) * exp(-2 * j * j * lam * lam) for j in range(1, 101)]))) end as metric from l"""


@query()
def classifier_check(spark, sf_dir):
    return audit.classifier_check(naive_tfidf_lr(spark, sf_dir))


SUMMARY = " union all ".join([
    _gap_sql(SQL["source_parity"], "source parity", 10),
    _line_sql(_KS, "length", 0.05, "metric > 0.05"),
    _line_sql(f"select greatest(pos, neg) / greatest(least(pos, neg), 0.01) as metric from ({SQL['newline_density']})", "newlines", 1.25, "metric between 0.8 and 1.25"),
    _gap_sql(_artifact_rates(LABELLED), "artifacts", 5),
    _line_sql(f"select common * 100 / 200 as metric from ({SQL['vocab_top200_overlap']})", "vocabulary", 50, "metric >= 50"),
    _line_sql(f"select count(*) as metric from ({SQL['trigram_problems']})", "trigrams", 0, "metric = 0"),
    _gap_sql(SQL["topic_mention_rate"], "topic", 20),
])


@query(f"select count(*) as checks, bool_and(passed) as passed from ({SUMMARY})")
def audit_verdict(spark, sf_dir):
    return audit.verdict(audit_summary(spark, sf_dir))


@query(SUMMARY)
def audit_summary(spark, sf_dir):
    return audit.summary(labelled(spark, sf_dir), "ation")


# Terms: document frequencies and smoothed weights; ties by term

_TERMS = "with t as (select distinct doc_id, term from ({0})), d as (select term, count(*) as df from t group by term order by df desc, term limit {1}) select term, df, round(ln((1 + (select count(*) from documents)) / (1 + df)) + 1, 9) as idf from d"


@query(_TERMS.format("select doc_id, substr(text, i, 3) as term from (select doc_id, text, unnest(range(1, len(text) - 1)) as i from documents where len(text) > 2)", 300))
def char_tfidf_top(spark, sf_dir):
    return terms.weights(docs(spark, sf_dir), terms.char_grams(docs(spark, sf_dir), 3), 300)


_WORDS = "select doc_id, term from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}')) as term from documents) where term not in ({0})"


@query(_TERMS.format(_WORDS.format(", ".join("'" + w.replace("'", "''") + "'" for w in terms.STOP)), 1000))
def word_tfidf_top(spark, sf_dir):
    return terms.weights(docs(spark, sf_dir), terms.word_terms(docs(spark, sf_dir)), 1000)


@query()
def naive_tfidf_lr(spark, sf_dir):
    """The classifier's check: five-fold accuracy of a balanced logistic regression on word weights."""
    rows = corpus.folds(labelled(spark, sf_dir), "label", "doc_id").select("doc_id", "label", "fold", "text")
    return terms.naive_check(rows)


_GRAMS = " union all ".join(f"select doc_id, substr(text, i, {n}) as term from (select doc_id, text, unnest(range(1, len(text) - {n - 2})) as i from documents where len(text) >= {n})" for n in (2, 3, 4))


@query(f"""with t as (select doc_id, term, count(*) as n from ({_GRAMS}) group by all),
d as (select term, count(*) as df from t group by term order by df desc, term limit 500),
w as (select doc_id, term, n * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) as w from t join d using (term))
select doc_id, count(*) as terms, round(max(w) / sqrt(sum(w * w)), 6) as heaviest, round(sum(w) / sqrt(sum(w * w)), 6) as total from w group by doc_id""")
def char_gram_matrix(spark, sf_dir):
    """Unit rows over the 500 most common 2- to 4-grams, summed up by document."""
    rows = terms.matrix(docs(spark, sf_dir), (2, 3, 4), 500)
    return rows.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("heaviest"), F.round(F.sum("weight"), 6).alias("total"))


# Features


def _features_sql(profile: str, source: str) -> str:
    lists = X.PROFILES[profile]
    wanted = sorted({w for ws in lists.values() for w in ws})
    some = lambda ws: "(" + " + ".join(f"n_{w}" for w in ws) + ")"
    out = {f"fw_{w}": f"n_{w} / wc" for w in lists["words"]} | {k: f"{some(ws)} / wc" for k, ws in lists.items() if k != "words"}
    sign = lambda c: f"(len(text) - len(replace(text, '{c.replace(chr(39), chr(39) * 2)}', '')))"
    for k, v in X.PUNCTUATION.items():
        name = f"punct_{X.LONG_NAMES.get(k, k)}_rate" if profile == "l" else f"punct_{k}"
        out[name] = f"({sign(v)} // 3) / wc" if k == "ellipsis" else f"({' + '.join(map(sign, v))}) / wc"
    sums = "list_sum([{0}])::bigint"
    n, s, q = "len(sl)", "coalesce(list_sum(sl), 0)::bigint", "coalesce(list_sum([x * x for x in sl]), 0)::bigint"
    zero = lambda x: f"case when len(sl) > 0 then {x} else 0 end"
    deviation = f"sqrt(({n} * {q} - {s} * {s}) / ({n} * {n}))"
    ws, wq = "list_sum(wl)::bigint", sums.format("x * x for x in wl")
    pn, ps = "len(pl)", "coalesce(list_sum(pl), 0)::bigint"
    out |= {"contraction_rate": "contractions / wc", "word_long_rate": "len([x for x in wl if x > 6]) / wc", "word_short_rate": "len([x for x in wl if x <= 3]) / wc"}
    if profile == "l":
        up = lambda x: f"({x} = upper({x}) and {x} <> lower({x}))"
        out |= {"sent_mean_length": zero(f"{s} / {n}"), "sent_std_length": zero(deviation), "sent_max_length": zero("list_max(sl)::double"), "sent_min_length": zero("list_min(sl)::double"), "sent_count": f"{n}::double", "word_mean_length": f"{ws} / wc", "word_std_length": f"sqrt((wc * {wq} - {ws} * {ws}) / (wc * wc))"}
        out |= {"vocab_type_token_ratio": "types / wc", "vocab_hapax_ratio": "once / wc", "cap_all_caps_rate": f"len([x for x in w if {up('x')} and len(x) > 1]) / wc", "cap_initial_caps_rate": f"len([x for x in w if {up('x[1]')} and not {up('x')}]) / wc", "para_count": f"{pn}::double", "para_mean_length": f"case when {pn} > 0 then {ps} / {pn} else 0 end"}
    else:
        out |= {"sent_mean": zero(f"{s} / {n}"), "sent_std": zero(deviation), "sent_count": f"{n} / wc * 100", "word_mean_len": f"{ws} / wc", "vocab_ttr": "types / wc", "vocab_hapax": "once / wc", "para_count": f"{pn} / wc * 100"}
    blank = r"regexp_matches(x, '[^\s\x0b\x1c-\x1f\x85\pZ]')"
    token = r"'[^\s\x0b\x1c-\x1f\x85\pZ]+'"
    return f"""(with t as (select doc_id, text, {TOKENS} as w from {source}),
m as (select doc_id, text, w, nullif(len(w), 0) as wc, [len(x) for x in w] as wl, [len(regexp_extract_all(x, {token})) for x in regexp_split_to_array(text, '[.!?]+') if {blank}] as sl,
  [len(regexp_extract_all(x, {token})) for x in string_split(text, concat(chr(10), chr(10))) if {blank}] as pl,
  len(regexp_extract_all(lower(text), '[\\pL\\pN_]+n''t|[\\pL\\pN_]+''[a-z]{{1,2}}')) as contractions from t),
c as (select doc_id, word, count(*) as n from (select doc_id, lower(unnest(w)) as word from t) group by all),
k as (select doc_id, count(*) as types, count(*) filter (n = 1) as once, {', '.join(f"coalesce(sum(n) filter (word = '{w}'), 0)::bigint as n_{w}" for w in wanted)} from c group by doc_id)
select doc_id, {', '.join(f"({out[x]})::double as {x}" for x in sorted(out))} from m left join k using (doc_id))"""


for profile in ("s", "l"):
    query(f"select * from {_features_sql(profile, DECORATED_SQL)}", f"feature_vector_{profile}")(lambda spark, sf_dir, p=profile: X.features(decorated(spark, sf_dir), p))

GROUPS = {"feat_punct": "punct_", "feat_sentence": "sent_", "feat_word_len": "word_", "feat_vocab": "vocab_", "feat_contraction": "contraction_", "feat_caps": "cap_", "feat_paragraph": "para_", "feat_function_words_l": "fw_"}
for group, prefix in GROUPS.items():
    columns = [c for c in X.names("l") if c.startswith(prefix)]
    query(f"select doc_id, {', '.join(columns)} from {_features_sql('l', DECORATED_SQL)}", group)(lambda spark, sf_dir, c=columns: X.features(decorated(spark, sf_dir), "l").select("doc_id", *c))
PERSON = ["first_person", "first_person_pl", "second_person", "hedge_rate", "certainty_rate"]
query(f"select doc_id, {', '.join(PERSON)} from {_features_sql('s', DECORATED_SQL)}", "feat_person_hedge")(lambda spark, sf_dir: X.features(decorated(spark, sf_dir)).select("doc_id", *PERSON))
query(f"select doc_id, {', '.join('fw_' + w for w in X.FUNCTION_WORDS)} from {_features_sql('s', 'documents')}", "feat_function_words")(lambda spark, sf_dir: X.features(docs(spark, sf_dir)).select("doc_id", *(f"fw_{w}" for w in X.FUNCTION_WORDS)))

PROFILE = ["contraction_rate", "first_person", "fw_if", "sent_mean", "para_count"]
LONG_TEXTS = f"(select f.*, quality as label from {_features_sql('s', DECORATED_SQL)} f join documents using (doc_id) join labels using (doc_id) where {WC} >= 50)"


@query(" union all ".join(f"select '{f}' as feature, round(avg({f}) filter (label = 1), 9) as pos, round(avg({f}) filter (label = 0), 9) as neg from {LONG_TEXTS}" for f in PROFILE))
def class_profile(spark, sf_dir):
    rows = class_rows(spark, sf_dir)
    mean = lambda f, y: F.round(F.avg(F.when(F.col("label") == y, F.col(f))), 9)
    row = rows.agg(*(F.struct(F.lit(f).alias("feature"), mean(f, 1).alias("pos"), mean(f, 0).alias("neg")).alias(f"r{i}") for i, f in enumerate(PROFILE)))
    return row.select(F.inline(F.array(*(f"r{i}" for i in range(len(PROFILE))))))


@query(f"select feature, pos, neg, round(pos - neg, 8) as diff, case when neg > 0.0001 then round(pos / neg, 6) else 'inf'::double end as ratio from ({SQL['class_profile']})")
def class_profile_diff(spark, sf_dir):
    ratio = F.when(F.col("neg") > 0.0001, F.round(F.col("pos") / F.col("neg"), 6)).otherwise(F.lit(float("inf")))
    return class_profile(spark, sf_dir).withColumns({"diff": F.round(F.col("pos") - F.col("neg"), 8), "ratio": ratio})


_MEANS = ", ".join(f"round(avg({f}) filter (label = {y}), 9) as {f}_{y}" for f in X.names() for y in (0, 1))
_ROWS = " union all ".join(f"select '{f}' as feature, {f}_1 as pos, {f}_0 as neg from m" for f in X.names())


@query(f"with m as (select {_MEANS} from {LONG_TEXTS}), r as ({_ROWS}) select feature, pos, neg, round(pos - neg, 8) as diff from r order by abs(round(pos - neg, 8)) desc, feature limit 30")
def class_profile_top30(spark, sf_dir):
    """The features whose means differ most between the classes, of all."""
    row = class_rows(spark, sf_dir).groupBy().pivot("label", [0, 1]).agg(*(F.round(F.avg(f), 9).alias(f) for f in X.names()))
    flat = row.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"1_{f}").alias("pos"), F.col(f"0_{f}").alias("neg")) for f in X.names()))))
    diff = F.round(F.col("pos") - F.col("neg"), 8)
    return flat.withColumn("diff", diff).orderBy(F.desc(F.abs("diff")), "feature").limit(30)


def class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and label of the labelled documents of 50 words and more."""
    long = docs(spark, sf_dir).where(T.word_count(F.col("text")) >= 50).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return X.features(decorated(spark, sf_dir).join(long, "doc_id", "left_semi")).join(long, "doc_id")


# Cleaning

_lines = lambda test: f"array_to_string([x for x in string_split(text, chr(10)) if not coalesce({test}, false)], chr(10))"
_trim = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_S = _trim("x")
_white = _trim("regexp_replace(array_to_string([" + _trim("x") + " for x in string_split(regexp_replace(regexp_replace(text, '\\n{3,}', concat(chr(10), chr(10)), 'g'), ' {2,}', ' ', 'g'), chr(10))], chr(10)), '\\n{3,}', concat(chr(10), chr(10)), 'g')")
_META = " or ".join([f"{_S} in ('View original', 'View in thread')", f"regexp_matches({_S}, '^\\d{{1,4}}$')", f"regexp_matches({_S}, '^(From|Subject|Date):\\s*$')", f"regexp_matches({_S}, '{clean.MONTH}\\d{{1,2}},\\s+\\d{{4}}')", f"(contains({_S}, 'UTC') and len({_S}) < 50 and regexp_matches({_S}, '\\d{{2}}:\\d{{2}}'))", f"regexp_matches({_S}, '{clean.MAIL}')", f"regexp_matches({_S}, '^\\[.{{1,38}}\\]$')"])
_QUOTED = " or ".join([f"starts_with({_S}, '>')", f"regexp_matches({_S}, '^On .{{10,80}} wrote:\\s*$')", f"regexp_matches({_S}, '^.{{1,30}} wrote:\\s*$')", f"{_S} = 'Quote'"])
STEP_SQL = {
    "c1": "translate(replace(replace(replace(text, concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)), chr(160), ' '), concat(chr(8203), chr(8204), chr(65279)), '')",
    "c4": _lines(_QUOTED),
    "c5": "regexp_replace(text, '(?s)\\n-- ?\\n.*$', '')",
    "c6": "regexp_replace(text, 'https?://[^\\s]+', '', 'g')",
    "c7": "regexp_replace(text, 'Code:\\s*\\n(?s:.*?)(\\n\\n|\\z)', '\\1', 'g')",
    "c8": _lines(_META),
    "c9": _white,
    "c10": "replace(translate(text, concat(chr(8216), chr(8217), chr(8220), chr(8221), chr(8211), chr(8212)), concat(chr(39), chr(39), '\"\"--')), chr(8230), '...')",
}
_C3 = """select doc_id, coalesce(string_agg(line, chr(10) order by i), '') as text from (select *, coalesce(max(case when opens then i end) over w, 0) as o, coalesce(max(case when blank then i end) over v, 0) as b
from (select doc_id, i, line, starts_with(regexp_replace(line, '^\\s+', ''), 'Quote from:') as opens, not regexp_matches(line, '\\S') as blank from (select doc_id, generate_subscripts(l, 1) as i, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from {0})))
window w as (partition by doc_id order by i), v as (partition by doc_id order by i rows between unbounded preceding and 1 preceding)) where not (o > b) group by doc_id"""
STEPS = {"c1": clean.encoding, "c4": clean.quoted_lines(), "c5": clean.signature, "c6": clean.urls, "c7": clean.code_blocks, "c8": clean.metadata_lines(), "c9": clean.white_space, "c10": clean.punctuation}
for name, step in STEPS.items():
    query(f"select doc_id, {STEP_SQL[name]} as cleaned, ({STEP_SQL[name]}) <> text as changed from {DECORATED_SQL}", f"clean_{name}")(lambda spark, sf_dir, f=step: decorated(spark, sf_dir).select("doc_id", f(F.col("text")).alias("cleaned"), (f(F.col("text")) != F.col("text")).alias("changed")))


@query(f"select doc_id, coalesce(c.text, '') as cleaned from documents left join ({_C3.format(DECORATED_SQL)}) c using (doc_id)")
def clean_c3(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", clean.quote_blocks(F.col("text")).alias("cleaned"))


def _v5_sql() -> str:
    rows = f"(select doc_id, {STEP_SQL['c1']} as text from {DECORATED_SQL})"
    rows = f"(select doc_id, coalesce(c.text, '') as text from documents left join ({_C3.format(rows)}) c using (doc_id))"
    for k in ("c4", "c5", "c6", "c7", "c8", "c9", "c10"):
        rows = f"(select doc_id, {STEP_SQL[k]} as text from {rows})"
    return rows


@query(f"select doc_id, text as cleaned, {WC}::int as word_count from {_v5_sql()} where {WC} >= 15")
def clean_v5_full(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", F.inline(clean.kept(F.col("text"))))


for name in ("v5a", "v4", "v2", "v1_pos", "v1_neg"):
    query(f"select doc_id, text as cleaned from {cleaning.profile(name, DECORATED_SQL, STEP_SQL, _C3)}", f"clean_{name}_full")(lambda spark, sf_dir, n=name: decorated(spark, sf_dir).select("doc_id", clean.clean(F.col("text"), n).alias("cleaned")))


@query(f"""with f as (select doc_id, {_trim("string_split(text, chr(10))[1]")} as line from {_v5_sql()})
select doc_id, substr(line, 1, 80) as line from f where contains(substr(line, 1, 30), ',') and line[1] = upper(line[1]) and line[1] <> lower(line[1]) and len(regexp_extract_all(string_split(line, ',')[1], '[^\\s]+')) <= 3""")
def salutation_suspects(spark, sf_dir):
    line = T.strip(F.split(clean.clean(F.col("text")), "\n")[0])
    rows, first = decorated(spark, sf_dir).select("doc_id", line.alias("line")), F.substring("line", 1, 1)
    return rows.where(F.left("line", F.lit(30)).contains(",") & (first == F.upper(first)) & (first != F.lower(first)) & (T.word_count(F.split("line", ",")[0]) <= 3)).select("doc_id", F.left("line", F.lit(80)).alias("line"))


# Chunks, splits, weights


@query(f"""with recursive d as (select doc_id, replace(text, chr(10), concat(chr(10), chr(10))) as text from documents),
p as (select doc_id, row_number() over (partition by doc_id order by i) as i, len(regexp_extract_all(para, '[^\\s]+')) as n, para from (select doc_id, generate_subscripts(l, 1) as i, unnest(l) as para from (select doc_id, regexp_split_to_array(text, '\\n\\n+') as l from d where {WC} > 400)) where regexp_matches(para, '\\S')),
r as (select doc_id, i, 0 as c, n as cur from p where i = 1 union all select p.doc_id, p.i, case when r.cur + p.n > 400 and r.cur >= 50 then r.c + 1 else r.c end, case when r.cur + p.n > 400 and r.cur >= 50 then p.n else r.cur + p.n end from r join p on p.doc_id = r.doc_id and p.i = r.i + 1)
select r.doc_id, r.c::int as chunk_index, string_agg(para, concat(chr(10), chr(10)) order by r.i) as text, sum(p.n)::int as word_count from r join p using (doc_id, i) group by r.doc_id, r.c having sum(p.n) >= 50
union all select doc_id, 0, text, {WC}::int from d where {WC} between 50 and 400""")
def chunk_paragraphs(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return corpus.chunked(rows).select("doc_id", "chunk_index", "text", "word_count")


ORDERED = "select doc_id, quality as label, row_number() over (partition by quality order by md5(concat(doc_id, '#42')), doc_id) as i, count(*) over (partition by quality) as n from labels"
SPLIT = f"""select doc_id, label, case when i <= greatest(20, floor(n * 0.2)) then 'golden' when i <= greatest(20, floor(n * 0.2)) + greatest(15, floor(n * 0.1)) then 'test'
when i <= greatest(20, floor(n * 0.2)) + 2 * greatest(15, floor(n * 0.1)) then 'val' else 'train' end as split from ({ORDERED})"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


@query(SPLIT)
def split_stratified(spark, sf_dir):
    return corpus.splits(_labels(spark, sf_dir), "label", "doc_id")


@query(f"select split, count(*) filter (label = 0) as neg, count(*) filter (label = 1) as pos from ({SPLIT}) group by split")
def split_sizes(spark, sf_dir):
    return split_stratified(spark, sf_dir).groupBy("split").agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos"))


@query(f"select doc_id, label, ((i - 1) % 5)::int as fold from ({ORDERED})")
def cv_folds(spark, sf_dir):
    return corpus.folds(_labels(spark, sf_dir), "label", "doc_id")


@query(f"select doc_id, label, i <= ceil(n * 0.2) as held_out from ({ORDERED})")
def holdout(spark, sf_dir):
    return corpus.holdout(_labels(spark, sf_dir), "label", "doc_id")


@query("select quality as label, count(*) as n, (select count(*) from labels) / (2 * count(*)) as weight from labels group by quality")
def class_weights(spark, sf_dir):
    return corpus.class_weights(_labels(spark, sf_dir), "label")


# Scores by a plain rule, and what is reported of them

SCORED = f"(select doc_id, source, text, quality as label, ({WC} % 101) / 100 as score, case when ({WC} % 101) / 100 > 0.5 then 1 else 0 end as pred from documents join labels using (doc_id))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).withColumn("score", (T.word_count(F.col("text")) % 101) / 100).withColumn("pred", (F.col("score") > 0.5).cast("int"))


@query(f"select label, pred, count(*) as n from {SCORED} group by all")
def confusion_matrix(spark, sf_dir):
    return model.confusion(scored(spark, sf_dir))


@query(f"""with m as (select count(*) as n, count(*) filter (label = 1 and pred = 1) as tp, count(*) filter (label = 0 and pred = 1) as fp, count(*) filter (label = 1 and pred = 0) as fn, count(*) filter (label = 0 and pred = 0) as tn from {SCORED})
select tp + tn as "right", n, (tp + tn) / n as accuracy, tp / (tp + fp) as precision, tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1 from m""")
def prf_report(spark, sf_dir):
    return model.report(scored(spark, sf_dir))


@query(f"select label, count(*) filter (label = pred) / count(*) as accuracy, count(*) as n from {SCORED} group by label")
def accuracy_by_class(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("label").agg((F.count_if(F.col("label") == F.col("pred")) / F.count("*")).alias("accuracy"), F.count("*").alias("n"))


@query(f"select doc_id, substr(text, 1, 100) as preview, label, pred, score from {SCORED} where label <> pred")
def misclassified(spark, sf_dir):
    return scored(spark, sf_dir).where("label <> pred").select("doc_id", F.left("text", F.lit(100)).alias("preview"), "label", "pred", "score")


@query(f"select doc_id, case when {WC} < 20 then 'too short' when score * 100 >= 70 then 'strong' when score * 100 >= 40 then 'moderate' when score * 100 >= 15 then 'weak' else 'none' end as tier, repeat('█', floor(score * 20)::int) as bar from {SCORED}")
def verdict_tiers(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", F.when(T.word_count(F.col("text")) < 20, "too short").otherwise(score.tier(F.col("score"))).alias("tier"), score.bar(F.col("score")).alias("bar"))


@query(f"""select source, count(*) as texts, round(avg(score), 9) as mean, median(score) as median, round(quantile_cont(score, 0.25), 9) as p25, round(quantile_cont(score, 0.75), 9) as p75, count(*) filter (score > 0.5) / count(*) as above, min(score) as low, max(score) as high,
arg_max(substr(text, 1, 120), score * 1000000 - doc_id) as best from {SCORED} where {WC} >= 50 group by source""")
def score_summary_by_author(spark, sf_dir):
    rows = score.summary(scored(spark, sf_dir).where(T.word_count(F.col("text")) >= 50), "source")
    return rows.withColumns({c: F.round(c, 9) for c in ("mean", "p25", "p75")})


_REFERENCE = f"(select f.* from {_features_sql('s', DECORATED_SQL)} f join labels using (doc_id) where quality = 1 order by doc_id limit 100)"
_CLOSE = """case when mean > 0.0001 then case when value / mean between 0.7 and 1.3 then 'Close' when value / mean between 0.4 and 1.6 then '~' else 'Far' end
  when value < 0.001 then 'Close' else 'Far' end"""
_PAIRS = " union all ".join(f"select doc_id, '{f}' as feature, {f} as value, (select avg({f}) from r) as mean from f" for f in score.FINGERPRINT)


@query(f"""with f as (select * from {_features_sql('s', DECORATED_SQL)}), r as (select * from {_REFERENCE}),
p as ({_PAIRS}) select doc_id, feature, round(value, 9) as value, round(mean, 9) as mean, {_CLOSE} as match from p""")
def fingerprint(spark, sf_dir):
    rows = X.features(decorated(spark, sf_dir))
    first = docs(spark, sf_dir).select("doc_id").join(_labels(spark, sf_dir).where("label = 1").select("doc_id"), "doc_id", "left_semi").orderBy("doc_id").limit(100)
    reference = X.features(decorated(spark, sf_dir).join(F.broadcast(first), "doc_id", "left_semi"))
    return score.fingerprint(rows, reference).withColumns({c: F.round(c, 9) for c in ("value", "mean")})


# Pages and archives

_tag = lambda tag: f"regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)"


def _decode_sql(x: str) -> str:
    for name, sign in html.ENTITIES.items():
        x = f"replace({x}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return x


_no = "html"
for _t in ("nav", "header", "footer", "script", "style"):
    _no = f"regexp_replace({_no}, '(?is)<{_t}\\b.*?</{_t}\\s*>', '', 'g')"


@query("select page_id, " + _trim(_decode_sql(f"regexp_replace({_tag('h1')}, '<[^>]*>', '', 'g')")) + " as title, len(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref=\"([^\"]*)\"', 1))::int as n_links from pages")
def html_title_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"), F.size(html.links(F.col("html"))).alias("n_links"))


@query(f"with p as (select page_id, regexp_replace({_no}, '(?s)<!--.*?-->', '', 'g') as html from pages), r as (select page_id, case when {_tag('main')} <> '' then {_tag('main')} when {_tag('article')} <> '' then {_tag('article')} else html end as html from p) select page_id, " + _trim("regexp_replace(" + _decode_sql("regexp_replace(html, '<[^>]*>', chr(10), 'g')") + ", '\\n\\s*\\n+', chr(10), 'g')") + " as text from r")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.text(F.col("html")).alias("text"))


@query()
def html_tree_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.tree_text("html").alias("text"))


@query("""select page_id, nullif(regexp_extract(concat('<a href="http://other/?topic=7">', html, '<a href="http://f/index.php?topic=', page_id, '.0">'),
  '(?i)<a\\b[^>]*\\bhref="[^"]*f/[^"]*topic=(\\d+)', 1), '')::bigint as topic from pages""")
def url_topic_id(spark, sf_dir):
    page = F.concat(F.lit('<a href="http://other/?topic=7">'), "html", F.lit('<a href="http://f/index.php?topic='), F.col("page_id").cast("string"), F.lit('.0">'))
    return table(spark, sf_dir, "pages").select("page_id", html.topic(page, "f/").alias("topic"))


@query(f"select doc_id, source as author, {_trim('text')} as text from documents, range(2) where len({_trim('text')}) >= 30")
def forum_posts(spark, sf_dir):
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(F.lit('<td class="poster_info"><a href="u">'), "source", F.lit('</a></td><div class="post">'), safe, F.lit("</div>"))
    return docs(spark, sf_dir).select("doc_id", F.inline(html.posts(F.concat(body, body)))).drop("date")


PAGE = "concat('From: ann x', chr(10), 'Date: today', chr(10), text, chr(10), '> quoted', chr(10), 'from: Ann y', chr(10), 'Subject: more', chr(10), text)"


def _blocks_sql(page: str, mark: str) -> str:
    return f"""select doc_id, body from (
  select doc_id, {_trim("coalesce(array_to_string([x for x in l[h + 1:] if not starts_with(ltrim(x), '>')], chr(10)), '')")} as body from (
    select doc_id, l, coalesce(list_max([i for i in range(1, len(l) + 1) if regexp_matches(l[i], '^\\s*[A-Z][A-Za-z-]*:')]), 0) as h from (
      select doc_id, string_split(concat('From: ann', part), chr(10)) as l from (
        select doc_id, unnest(string_split({page}, '{mark}')[2:]) as part from documents))))
where len(regexp_extract_all(body, '[^\\s]+')) >= 10"""


@query(_blocks_sql(PAGE, "From: ann"))
def block_split(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(files.blocks(F.expr(PAGE), "ann")).alias("body"))


@query(_blocks_sql(f"replace({PAGE}, 'from: Ann', 'From: ann')", "From: ann"))
def block_split_any_case(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.explode(files.blocks(F.expr(PAGE), "ANN", any_case=True)).alias("body"))


# Scans

DATED = "concat('<div class=\"smalltext\">day ', doc_id, '</div><div class=\"post\">', {0}, '</div><div class=\"smalltext\">', repeat('long ', 12), '</div><div class=\"post\">', {0}, '</div>')"


@query(f"select doc_id, case when i = 0 then concat('day ', doc_id) end as date from documents, range(2) t(i) where len({_trim('text')}) >= 30")
def post_dates(spark, sf_dir):
    safe = "replace(replace(text, '&', '&amp;'), '<', '&lt;')"
    return docs(spark, sf_dir).select("doc_id", F.inline(html.posts(F.expr(DATED.format(safe))))).select("doc_id", "date")


@query("select * from conversations c where turn < coalesce((select min(turn) from conversations e where e.conv_id = c.conv_id and len(e.text) % 4 = 0), 1000000000)")
def paged_scan(spark, sf_dir):
    return pages.until_empty(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text") % 4 != 0)


@query(f"select page_id, title from ({SQL['html_title_links']}) where regexp_matches(lower(title), 'ba|ne')")
def subject_scan(spark, sf_dir):
    titled = table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))
    return pages.about(titled, F.col("title"), ["BA", "ne"])


@query(f"select doc_id, source, substr(text, 1, 3000) as text from documents where {WC} >= 30 qualify row_number() over (partition by source order by doc_id) <= 20")
def writer_scan(spark, sf_dir):
    return pages.by_writer(docs(spark, sf_dir).select("doc_id", "source", "text"), "source", "doc_id", 30, 3000, 20)


@query("select doc_id, source from documents where lower(coalesce(source, '')) <> 'src1'")
def others_equal(spark, sf_dir):
    return pages.without_author(docs(spark, sf_dir), "source", "SRC1").select("doc_id", "source")


@query("select doc_id, source from documents where not contains(lower(coalesce(source, '')), 'src1')")
def others_containing(spark, sf_dir):
    return pages.without_author(docs(spark, sf_dir), "source", "SRC1", within=True).select("doc_id", "source")


ARTICLE = "concat('p = 1 - q', chr(10), text, chr(10), '  z = p * (q - p)', chr(10), '(p < q)', chr(10), 'Proof: p = q', chr(10), 'q = 2')"
_PROSE = cleaning.drop_lines(rf"regexp_matches({_S}, '^[pqz\s=\-\+\*\(\)\{{\}}\<\>\.]+$')", cleaning.starts(pages.FORMULA_HEADS))


@query(f"select doc_id, {_trim(_PROSE)} as text from (select doc_id, {ARTICLE} as text from documents)")
def article_prose(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", pages.prose(F.expr(ARTICLE)).alias("text"))


MAIL = """concat('<a href="/info/1"> </a><a href="x/info/2">a@b</a><a href="/x">No</a><a href="/info/3"><b>Writer ', doc_id, '</b></a><div class="c msgBody">', {0}, '<p>end</p></div>')"""


@query(f"select doc_id, concat('Writer ', doc_id) as author, case when len({_trim('concat(text, chr(101), chr(110), chr(100))')}) >= 50 then {_trim('concat(text, chr(101), chr(110), chr(100))')} end as body from (select doc_id, replace(text, '<', '(') as text from documents)")
def mail_pages(spark, sf_dir):
    page = F.expr(MAIL.format("replace(text, '<', '(')"))
    return docs(spark, sf_dir).select("doc_id", pages.mail_author(page).alias("author"), pages.mail_body(page).alias("body"))


CLASSED = """concat('<div class="message other"><div class="body">', {0}, '</div></div><div class="x message own"><div class="header">Date: day ', doc_id, '<br>Subject: s</div><div class="body">', {0},
'<br>On a day x wrote:<br>&gt; quoted</div></div><div class="message own"><pre>', {0}, '</pre>tail</div>')"""
_QUOTELESS = _trim(cleaning.drop_lines(f"starts_with({_S}, '>')", f"regexp_matches({_S}, '^On .+ wrote:')"))


@query(f"select doc_id, case when i = 0 then concat('day ', doc_id) end as date, case when i = 0 then 's' end as subject, {_QUOTELESS} as text from documents, range(2) t(i) where len(regexp_extract_all({_QUOTELESS}, '[^\\s]+')) >= 5")
def classed_messages(spark, sf_dir):
    safe = "replace(replace(text, '&', '&amp;'), '<', '&lt;')"
    return docs(spark, sf_dir).select("doc_id", F.inline(pages.messages(F.expr(CLASSED.format(safe)), "own")))


_LEAK = {"wrote": "contains(text, 'wrote:')", "quote_from": "contains(text, 'Quote from:')", "starts_quote": "starts_with(text, 'Quote')", "link": "contains(text, 'http')"}


@query("select " + ", ".join(f"count(*) filter ({x}) as {k}" for k, x in _LEAK.items()) + f", round(coalesce(avg(len(text) - len(replace(text, chr(10), ''))), 0), 6) as newlines, round(coalesce(avg(len(text)), 0), 6) as chars from {DECORATED_SQL}")
def leak_report(spark, sf_dir):
    return audit.leaks(decorated(spark, sf_dir))


@query("select r as id, format('http://archive/{}/', r) as url from range(5, 544) t(r)")
def id_grid(spark, sf_dir):
    return files.grid(spark, 5, 543, "http://archive/%d/")


# Models


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, label and fold of the labelled documents; computed once for all folds and released with the session."""
    return corpus.folds(class_rows(spark, sf_dir), "label", "doc_id").select("doc_id", "label", "fold", *X.names()).persist(StorageLevel.DISK_ONLY)


@query()
def lr_cv(spark, sf_dir):
    return model.cross_validate(_folded(spark, sf_dir), X.names(), "lr")


@query()
def rf_holdout(spark, sf_dir):
    return model.cross_validate(_folded(spark, sf_dir), X.names(), "rf", folds=1, trees=200)


@query()
def gbt_holdout(spark, sf_dir):
    return model.cross_validate(_folded(spark, sf_dir), X.names(), "gbt", folds=1, rounds=200)


@query()
def rf_importances(spark, sf_dir):
    """The 20 most important features of a forest of 200 trees, fitted on all rows."""
    fitted = model.fit(class_rows(spark, sf_dir), X.names(), "rf", trees=200)
    return spark.createDataFrame(model.importances(fitted, X.names()), "feature string, importance double")


@query()
def lr_coefficients(spark, sf_dir):
    """The 10 greatest and the 10 least coefficients of a logistic regression, fitted on all rows."""
    top, bottom = model.coefficients(model.fit(class_rows(spark, sf_dir), X.names(), "lr"), X.names())
    return spark.createDataFrame([(end, i + 1, f, c) for end, rows in (("top", top), ("bottom", bottom)) for i, (f, c) in enumerate(rows)], "end string, place int, feature string, coefficient double")


@query()
def refit_scores(spark, sf_dir):
    """Scores of all labelled documents by a logistic regression fitted on all of them."""
    rows = class_rows(spark, sf_dir).persist(StorageLevel.DISK_ONLY)  # computed once, released with the session
    return model.score(rows, model.fit(rows, X.names(), "lr"), ["doc_id", "label"])


#: The reference's classifiers, in its order: kind and options. SVC has C = 10.
GRID = {"lr": {}, "svm": {"c": 10.0}, "gbt": {"rounds": 300, "depth": 4}, "rf": {"trees": 300}}


@query()
def grid_best(spark, sf_dir):
    """Mean F1 over five folds of each classifier on each family of features, and the best: the first of the highest.

    Families are style features, weights of the 500 most common 2- to 4-grams, and both; missing weights are zero."""
    style = _folded(spark, sf_dir)
    texts = docs(spark, sf_dir).join(style.select("doc_id"), "doc_id", "left_semi")
    weights = terms.matrix(texts, (2, 3, 4), 500).persist(StorageLevel.DISK_ONLY)
    found = sorted(r.term for r in weights.select("term").distinct().collect())
    grams = [f"gram_{i:03}" for i in range(len(found))]
    at = F.create_map(*(F.lit(x) for i, t in enumerate(found) for x in (t, i)))
    maps = weights.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(at[F.col("term")].alias("i"), "weight"))).alias("m"))
    joined = style.join(maps, "doc_id", "left")
    rows = joined.select(*style.columns, *(F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0.0)).alias(g) for i, g in enumerate(grams))).persist(StorageLevel.DISK_ONLY)
    families = {"style": X.names(), "grams": grams, "both": [*X.names(), *grams]}
    tried = lambda names, k, o: model.cross_validate_kernel(rows, names, **o) if k == "svm" else model.cross_validate(rows, names, k, **o)
    grid = [(f, k, tried(names, k, o).select("mean_f1").first()[0]) for f, names in families.items() for k, o in GRID.items()]
    best = max(range(len(grid)), key=lambda i: (grid[i][2], -i))
    return spark.createDataFrame([(i, f, k, f1, i == best) for i, (f, k, f1) in enumerate(grid)], "rank int, family string, kind string, f1 double, best boolean")


@query()
def stream_score(spark, sf_dir):
    """The documents as a stream, scored by a plain rule in batches."""
    from ..streaming.scoring import score_stream

    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")) + f"/stream-{uuid.uuid4().hex}"
    schema = docs(spark, sf_dir).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
    plain = lambda d: d.select("doc_id", ((T.word_count(F.col("text")) % 101) / 100).alias("score")).withColumn("tier", score.tier(F.col("score")))
    score_stream(stream, plain, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("doc_id", "score", "tier")


@query()
def rbf_svm_score(spark, sf_dir):
    rows = _folded(spark, sf_dir)
    machine = model.fit_kernel(rows.where("fold > 0"), X.names())
    return model.score_kernel(rows, machine, X.names(), ["doc_id", "label"])
