"""URL filters, fingerprints, quality rules and mixing against brute force."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkwell.llm import catalogue, mixing, quality, sketch, urls

SMALL = "/root/testdata/sf0.001"
TEXTS = [(3, "a b c d e f g a b c"), (1, None), (2, ""), (5, "One"), (5, "One"), (9, "é x\ny z\n\nx y z w q\ny z\n"), (2000, "a b c d e f g a b c " * 40), (None, "lost row")]


def test_url_rules(spark):
    rows = [(1, "http://A.b.Example.net/en/x?q#f"), (2, "https://net/"), (3, "ftp://x.net"), (4, None), (5, "no scheme/en"), (6, "http://my.example.com/de/1"), (7, "http://w.org/fr/"), (8, "http://example.net/en"), (9, "http://xexample.com/de/?a://b"), (10, "x://h.org?/fr/"), (10, "x://h.org?/fr/")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    got = urls.judge(pages, spark.createDataFrame([], "page_id long, bad long")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [
        ("a.b.example.net", "/en/x", "example.net/en/", "allow"), ("net", "/", "net/", "block"), ("x.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("my.example.com", "/de/1", "example.com/de/", "block"), ("w.org", "/fr/", "org/fr/", "allow"), ("example.net", "/en", "net/", "block"), ("xexample.com", "/de/", None, "allow"), ("h.org", "", None, "allow"), ("h.org", "", None, "allow"),
    ]
    assert urls.judge(pages.limit(0), spark.createDataFrame([], "page_id long, bad long")).count() == 0


def test_bad_hosts_are_blocked_and_strangers_shrunk(spark):
    pages = [(i, f"http://{h}/p") for i, h in enumerate(["bad.one.com"] * 40 + ["good.two.org"] * 60 + ["new.one.com", "rare.two.org"])]
    bad = [(i, int(i < 40) if i != 50 else None) for i in range(100)]
    got = {r.host: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad long")).collect()}
    # a correction: new.one.com was expected to be allowed, though its domain's share is the prior of a host without outcomes
    assert got == {"bad.one.com": "block", "good.two.org": "allow", "new.one.com": "block", "rare.two.org": "allow"}


def test_sites(spark):
    hosts = ["www.good.co.uk", "co.uk", "u@h.example.com:8080", "10.1.2.3", "10.1.2.3:80", "[::1]:80", "com", "", "a.b.c.d"]
    domain, suffix = urls.site_of(F.col("h"))
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(domain, suffix).collect()
    assert [tuple(r) for r in got] == [("good.co.uk", "co.uk"), ("co.uk", "co.uk"), ("example.com", "com"), ("10.1.2.3", "address"), ("10.1.2.3", "address"), ("[::1]", "address"), ("com", "com"), ("", ""), ("c.d", "d")]


def test_long_urls_ties_and_nulls(spark):
    long = "http://x.net/" + "p/" * 50_000
    rows = [(1, long), (2, None), (None, "http://x.net/a"), (4, "http://y.org/")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, verdict string")
    outcomes = spark.createDataFrame([(4, 1), (4, 1), (4, None), (None, 1)], "page_id long, bad long")
    got = {r.page_id: r for r in urls.judge(pages, outcomes, rules=[("allow", "net/"), ("block", "net/")]).collect()}
    assert got[1].path == long[12:] and got[1].verdict == got[None].verdict == "block" and got[1].rule == "net/"
    assert (got[2].host, got[2].rule) == ("", None) and got[4].labelled == 2 and got[None].labelled == 0


def test_url_query_matches_sql(spark):
    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = catalogue.op6_url_filters(spark, SMALL)
    want = db.execute(catalogue.ORACLE_SQL["op6_url_filters"]).df()[got.columns]
    key = lambda rows: sorted(map(str, rows))
    assert key(map(tuple, got.collect())) == key(tuple(None if x != x else x for x in r) for r in want.itertuples(index=False))


def brute_sketch(text, fraction):
    h = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
    words = [xxhash.xxh64_intdigest(w, 42) for w in (text or "").encode().split()]
    grams = [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else [])
    out = set()
    for g in grams:
        seed = 42
        for w in g:  # a shorter sequence is hashed as pairs of what was before and the word
            seed = h(w, seed if len(g) == 5 else h(seed, 42))
        out.add(seed - (1 << 64) if seed >> 63 else seed)
    kept = {x for x in out if x + (1 << 63) < fraction * 2**64}
    return sorted(kept or ({min(out)} if out else set()))


def check_sketches(rows, got, fraction=sketch.FRACTION):
    tie = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tie(r[1] or "")))
    want = []
    for (doc, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (brute_sketch(x, fraction) for x in (text, edited, after))
        near = lambda x, y: 1.0 if not x and not y else len({*x} & {*y}) / len({*x} | {*y})
        want.append((doc, len(text), edited, a, b, near(a, b), near(a, c)))
    key = lambda r: repr(r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("width", [1, 1024])
def test_fingerprints_match_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(sketch, "CELL", width)
    monkeypatch.setattr(sketch, "QUANTILES", 6)
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    hashed = [((d * 0x9E3779B97F4A7C15) % (1 << 62), t) for d, t in rows[:60]]
    shared = [(None if i % 2 else 7, f"t{i} " * (i % 9)) for i in range(40)]
    for some in (TEXTS, rows[:60], TEXTS[:1], hashed, shared):
        df = spark.createDataFrame([(d, t, 1) for d, t in some], "doc_id long, text string, bucket int")
        cols = ["doc_id", "n_chars", "edited", "sketch", "edited_sketch", "near_edited", "near_next"]
        check_sketches(some, sketch.fingerprints(df).select(cols).collect())
    assert sketch.fingerprints(df.limit(0)).count() == 0


def test_fingerprint_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = sorted(rows)
    for r in catalogue.op8_fingerprints(spark, SMALL).collect():
        text, after = rows[r.doc_id], rows[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(text) // 2
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x & (1 << 64) - 1:016x}" for x in brute_sketch(text, sketch.FRACTION))


def test_merged_sketches_hold_the_union(spark):
    a, b = "a b c d e f g h", "g h i j k l m n o p"
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(a, b)], "a string, b string").select(sketch.merged(F.array(sketch.sketch(F.col("a"), 5, 1.0), sketch.sketch(F.col("b"), 5, 1.0)), 1.0).alias("m")).first().m
    assert got == sorted({*brute_sketch(a, 1), *brute_sketch(b, 1)})


def test_merged_sketches_have_no_hash_that_the_whole_lacks(spark):
    from pyspark.sql import functions as F

    parts = [(" ".join(f"x{i}y{k}" for k in range(5 + i % 4)), " ".join(f"x{i}z{k}" for k in range(5 + i % 7))) for i in range(60)]
    whole = spark.createDataFrame(parts, "a string, b string").select("a", "b", sketch.merged(F.array(sketch.sketch(F.col("a")), sketch.sketch(F.col("b")))).alias("m"))
    alone = 0
    for r in whole.collect():
        every = {*brute_sketch(r.a, 1), *brute_sketch(r.b, 1)}
        below = {h for h in every if h + (1 << 63) < sketch.FRACTION * 2**64}
        assert r.m == sorted(below or {min(every)})
        alone += not below
    assert 0 < alone < 60


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside), len(lines)


def test_quality_counts_and_base_rules(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text) < 6000]
    rows += [(d, t, None, None) for d, t in TEXTS]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    want = [(d, *brute_counts(t)) for d, t, _, _ in rows]
    key = lambda r: repr(r)
    assert sorted((tuple(r[:7]) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed)
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


LONG = ["".join("ab"[(i.bit_count() + odd) % 2] for i in range(2048)) for odd in (0, 1)]


def test_long_words_are_not_mixed_up(spark):
    """Words of 2,048 letters that polynomial hashes modulo 2**64 cannot tell apart."""
    x, y = LONG
    got = quality.counts(f"p q {x} r s p q {y} z".encode())
    assert got[0] == 9 and got[4] == 0
    assert quality.counts(f"p q {x} r s p q {x} z".encode())[4] == 6


def test_quality_verdicts_match_brute_force(spark):
    """Quartiles by sorting, drawn to those of the language and of all."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(700):
        words = [f"w{r.integers(400)}" + "&" * int(r.random() < (0.3 if i % 3 else 0.02)) for _ in range(int(r.integers(45, 140)))]
        if r.random() < 0.1:
            words = words[:8] * 9
        if r.random() < 0.05:
            words = ["longword" * int(r.integers(1, 12)) for _ in words]
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], ["a", "b", "c", "d"][int(r.integers(4)) if i % 5 else 0]))
    counted = {d: brute_counts(t) for d, t, _, _ in rows}
    share = lambda c: [c[2] / c[1], c[3] / c[5], c[4] / c[0], c[1] / c[0]]
    good = [(d, lang, source) for d, _, lang, source in rows if counted[d][0] >= 50 and 2 * counted[d][4] <= counted[d][0]]

    def quartiles(ids):
        columns = zip(*(share(counted[d]) for d in ids))
        return np.array([[sorted(c)[max(0, int(np.ceil(p * len(ids))) - 1)] for p in (0.25, 0.75)] for c in columns])

    every = quartiles([d for d, _, _ in good])
    want = {}
    for d, _, lang, source in rows:
        wide, own = ([x for x, m, s in good if m == lang and (s == source or not k)] for k in (0, 1))
        q = (len(wide) * quartiles(wide) + 100 * every) / (len(wide) + 100)
        q = (len(own) * quartiles(own) + 100 * q) / (len(own) + 100) if own else None
        if d not in {x for x, _, _ in good}:
            want[d] = False
            continue
        slack = np.array(list(quality.SLACK.values()))
        x, reach = np.array(share(counted[d])), 3 * (q[:, 1] - q[:, 0]) + slack
        want[d] = bool(((x >= q[:, 0] - reach - 1e-12) & (x <= q[:, 1] + reach + 1e-12)).all())
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {x.doc_id: x.kept for x in quality.judge(df.withColumn("part", F.lit(1))).collect()} == want
    assert {x.doc_id: (x.n_words, x.n_repeat_words) for x in quality.judge(df).collect()} == {d: (c[0], c[4]) for d, c in counted.items()}
    assert 20 < sum(want.values()) < 690


def test_quality_thresholds_follow_the_group(spark):
    plain = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "a") for i in range(150)]
    coded = [(1000 + i, " ".join(f"w{i}&{k}" for k in range(60)), "xx", "b") for i in range(150)]
    odd = [(5000, " ".join(f"q&{k}" for k in range(60)), "en", "a"), (5001, " ".join(f"w&{k}" for k in range(60)), "xx", "b")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(plain + coded + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert [d for d, k in got.items() if not k] == [5000]


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([0, 10], [5, 2]) == [0, 15]
    assert mixing.targets([], []) == []


def test_splitting_tree():
    counts = np.array([100, 7, 0, 50])
    shards = mixing.split(counts, 5, np.random.default_rng(1))
    assert shards.sum(0).tolist() == counts.tolist() and np.ptp(shards.sum(1)) <= 2


def test_mix(spark):
    rows = [(i, " ".join("w" * (1 + i % 40)), ["a", "b", "c", None][i % 4], i) for i in range(2000)] + [(5000, None, "d", 1), (None, "x y", "a", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    first, again = (sorted(map(tuple, mixing.shares(df.repartition(n)).collect()), key=str) for n in (2, 5))
    assert first == again
    sums = {}
    where = {r[0]: r[2] for r in rows}
    for doc, size, whole, target, taken, by_shard in first:
        assert taken in (0, size, 2 * size) and taken == sum(x.words for x in by_shard)
        s = sums.setdefault(where[doc], [whole, target, 0])
        s[2] += taken
    assert sum(s[1] for s in sums.values()) == pytest.approx(1.5 * sum(s[0] for s in sums.values()))
    assert all(abs(s[2] - s[1]) <= 0.01 * s[1] for s in sums.values())
    mixed = mixing.mix(df).collect()
    taken = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len((r.text or "").split())
    assert {d: t for d, t in taken.items() if t} == {d: t for d, _, _, _, t, _ in first if t}
    for r in mixing.shares(df).where("doc_id is not null").collect():
        assert sorted(x.shard for x in r.by_shard if x.words) == sorted(x.shard for x in mixed if x.doc_id == r.doc_id and x.text)
    assert mixing.shares(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_shares_depend_on_the_tree(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    one, four = ({r.doc_id: r for r in mixing.shares(df, shards=n).collect()} for n in (1, 4))
    used = {n: {x.shard for r in rows.values() for x in r.by_shard} for n, rows in ((1, one), (4, four))}
    assert used == {1: {0}, 4: {0, 1, 2, 3}}
    assert {d: r.taken for d, r in one.items()} == {d: r.taken for d, r in four.items()}


def test_mixing_without_ids_and_with_any_names(spark):
    names = ["copy", "upto", "place", "d_source", "__n", "block", "row", "a.b"]
    rows = [(None if i % 2 else 7, f"w{i} " * 10, "only", *range(8)) for i in range(1000)]
    rows += [(5000 + i, "x " * 10, "other", *range(8)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    got = mixing.shares(df).groupBy("target").sum("taken").collect()
    assert len(got) == 2 and all(abs(taken - target) <= 10 for target, taken in got)
    assert mixing.mix(df).columns == [*df.columns, "shard"] and mixing.mix(df).count() > 1000
