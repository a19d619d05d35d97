"""URL filters: rules for hosts and paths, and for the rest the reputation of hosts, estimated by empirical Bayes.

A page's outcome is 1 (bad) or 0. The bad share of a host is beta-binomial: its prior has the mean of its registered
domain, that one's prior the mean of the suffix, and that one's the mean of all; the weight of each level's prior is
estimated from the spread of the shares at the level (method of moments). A host is blocked where the lower bound of
its posterior share exceeds max_bad; the posterior of a host without outcomes is its prior. All of it is DataFrame
functions; the tables of the levels are made by partial aggregation, each from the one below, so a hot host is one row
a task before any shuffle.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule, and is judged like any host
(the empty one); a host may have a user and a port, which its domain lacks, and an address is a domain of its own; null
outcomes are left out; repeated outcomes each count; no outcomes at all block nothing; of rules that fit, the longest wins, and of
equally long ones (ties) the later; urls of any length are read whole; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path prefix); few enough to be part of the plan.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A host is blocked where its bad share is above MAX_BAD with about 95 % confidence.
MAX_BAD, Z = 0.25, 1.645
#: Bounds of a prior's weight, in outcomes.
WEIGHT = (1.0, 1000.0)
# Suffixes of two labels under which domains are registered; the full public list can be given instead.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.in", "co.jp", "ne.jp", "or.jp", "co.kr",
    "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "com.sg", "com.hk", "com.ar",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def site_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port. An address is its own domain, of the suffix `address`."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    address = bare.rlike(r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$")
    two = F.substring_index(bare, ".", -2).isin(*suffixes)
    domain = F.when(address, bare).when(two, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    suffix = F.when(address, "address").when(two, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    return domain, suffix


def _level(stats: DataFrame, unit: str, parents: DataFrame, parent: str) -> DataFrame:
    """n and bad of each unit (0 without outcomes), means of their parents -> posterior a and b of each unit.

    The prior has the parent's mean; its weight is estimated from the units that have outcomes.
    """
    rows = stats.join(parents, parent)
    seen = lambda x: F.when(F.col("n") > 0, x)
    p, m, n = F.try_divide("bad", "n"), F.col("mean"), F.col("n")
    spread = rows.agg(F.sum(seen(n * (p - m) * (p - m))).alias("s"), F.sum(seen(m * (1 - m) * n)).alias("v"), F.sum(seen(m * (1 - m))).alias("r"))
    ratio = (F.col("v") - F.col("s")) / F.greatest(F.col("s") - F.col("r"), F.lit(1e-9))
    weight = spread.select(F.coalesce(F.least(F.greatest(ratio, F.lit(WEIGHT[0])), F.lit(WEIGHT[1])), F.lit(WEIGHT[1])).alias("weight"))
    w, bad = F.col("weight"), F.col("bad")
    return rows.join(F.broadcast(weight)).select(unit, *([parent] if parent != unit else []), (m * w + bad).alias("a"), ((1 - m) * w + n - bad).alias("b"), "n", "bad")


def reputation(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """host, bad (0, 1, or null without an outcome) of pages -> host, n, bad, a, b: the posterior of each host's bad share."""
    host = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = site_of(F.col("host"), suffixes)
    host = staged(host.withColumns({"domain": domain, "suffix": suffix, "every": F.lit(1)}), "hosts")
    sums = lambda rows, *keys: rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = staged(sums(host, "domain", "suffix", "every"), "domains")
    suffixed = staged(sums(domains, "suffix", "every"), "suffixes")
    every = sums(suffixed, "every").where("n > 0").select("every", ((F.col("bad") + 1) / (F.col("n") + 2)).alias("mean"))
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")
    of_suffix = staged(_level(suffixed, "suffix", every, "every").select("suffix", mean), "suffix-means")
    of_domain = staged(_level(domains, "domain", of_suffix, "suffix").select("domain", mean), "domain-means")
    return _level(host.select("host", "domain", "n", "bad"), "host", of_domain, "domain").select("host", "n", "bad", "a", "b")


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_bad: float = MAX_BAD, z: float = Z, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """pages (page_id, url), outcomes (page_id, bad) -> page_id, host, path, rule, verdict, labelled, bad."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = reputation(split.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id", "left").select("host", "bad"), suffixes)
    a, b = F.col("a"), F.col("b")
    low = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    named = known.select("host", F.col("n").alias("labelled"), "bad", (low > max_bad).alias("poor"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("poor"), "block").otherwise("allow")
    judged = split.join(named, "host", "left").withColumn("verdict", F.coalesce(verdict, method))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "verdict", F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("bad", F.lit(0)).alias("bad"))


_LEVEL_SQL = """
{unit}_w as (select coalesce(least(greatest((v - s) / greatest(s - r, 1e-9), {low}), {high}), {high}) as weight from (
  select sum(n * (bad / n - mean) * (bad / n - mean)) as s, sum(mean * (1 - mean) * n) as v, sum(mean * (1 - mean)) as r
  from {unit}_s join {parent}_p using ({parent}) where n > 0)),
{unit}_p as (select {unit}, n, bad, mean * weight + bad as a, (1 - mean) * weight + n - bad as b,
  (mean * weight + bad) / (mean * weight + bad + (1 - mean) * weight + n - bad) as post
  from {unit}_s join {parent}_p using ({parent}), {unit}_w)"""

_ORACLE = r"""with rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as r from pages),
split as (
  select page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), '{upper}', '{lower}'), '') as host,
  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') as path from rest),
host_0 as (
  select host, count(bad) as n, coalesce(sum(bad), 0)::bigint as bad from (
    select host, case when quality is not null and toxic is not null then (quality = 0 or toxic = 1)::int end as bad
    from split left join labels on page_id = doc_id) group by host),
host_1 as (
  select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as bare from host_0),
host_2 as (
  select *, string_split(bare, '.') as parts, regexp_matches(bare, '^(\[.*\]|[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}})$') as address,
  array_to_string(string_split(bare, '.')[-2:], '.') in ({suffixes}) as two from host_1),
host_s as (
  select host, n, bad, 1 as every,
  case when address then bare when two then array_to_string(parts[-3:], '.') else array_to_string(parts[-2:], '.') end as domain,
  case when address then 'address' when two then array_to_string(parts[-2:], '.') else parts[-1] end as suffix from host_2),
domain_s as (select domain, suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from host_s group by all),
suffix_s as (select suffix, every, sum(n)::bigint as n, sum(bad)::bigint as bad from host_s group by all),
every_p as (select every, (sum(bad) + 1) / (sum(n) + 2) as mean from host_s group by every having sum(n) > 0),{suffix},
{suffix_mean},{domain},
{domain_mean},{host}
select page_id, host, path, {rule} as rule,
  coalesce({verdict}, case when a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {max_bad} then 'block' else 'allow' end) as verdict,
  coalesce(n, 0)::bigint as labelled, coalesce(bad, 0)::bigint as bad
from split left join host_p using (host)"""


def oracle() -> str:
    """The op6 query as SQL."""

    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"((host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}'))"

    longest = sorted(RULES, key=lambda r: -len(r[1]))
    case = lambda k: "case " + " ".join(f"when {fits(r[1])} then '{r[k]}'" for r in longest) + " end"
    level = lambda unit, parent: _LEVEL_SQL.format(unit=unit, parent=parent, low=WEIGHT[0], high=WEIGHT[1])
    mean = lambda unit: f"{unit}_p as (select {unit}, post as mean from {unit}_p0)"
    inner = lambda unit, parent: level(unit, parent).replace(f"{unit}_p as", f"{unit}_p0 as")
    return _ORACLE.format(
        upper=UPPER, lower=LOWER, suffixes=", ".join(f"'{x}'" for x in SUFFIXES), suffix=inner("suffix", "every"), suffix_mean=mean("suffix"),
        domain=inner("domain", "suffix"), domain_mean=mean("domain"), host=level("host", "domain"), rule=case(1), verdict=case(0), z=Z, max_bad=MAX_BAD,
    )
