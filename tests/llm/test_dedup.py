"""Substring, suffix-array and SimHash dedup against brute force."""

import hashlib
import random

import pytest
import xxhash

from inkwell.llm import catalogue, simhash, substring, suffix

SMALL = "/root/testdata/sf0.001"


def brute_runs(rows, tokens, length):
    """rows: (doc_id, text) -> removed token flags, by row."""
    first = {}
    for doc, text in rows:
        t = tokens(text)
        for i in range(len(t) - length + 1):
            k = tuple(t[i : i + length]) if isinstance(t, list) else t[i : i + length]
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        t = tokens(text)
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            k = tuple(t[i : i + length]) if isinstance(t, list) else t[i : i + length]
            if first[k] < doc:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def words(text):
    return (text or "").encode().split()


def data(text):
    return (text or "").encode()


def expect_words(rows, length):
    out = []
    for (doc, text), gone in zip(rows, brute_runs(rows, words, length)):
        kept = b" ".join(w for w, g in zip(words(text), gone) if not g)
        out.append((doc, len(gone), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def expect_bytes(rows, length):
    out = []
    for (doc, text), gone in zip(rows, brute_runs(rows, data, length)):
        kept = bytes(b for b, g in zip(data(text), gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((doc, len(gone), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def planted(n=60, vocabulary=40, seed=3):
    """Documents of few words with shared passages, cut at any place, and copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    pool = [word() for _ in range(vocabulary)]
    passages = [" ".join(r.choice(pool) for _ in range(r.randint(5, 90))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [r.choice(passages)[r.randint(0, 9) :] if r.random() < 0.5 else " ".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 5))]
        rows.append((i * 3, "\n".join(parts)))
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (7, None), (8, ""), (9, "a" * 500), (10, "a" * 300), (11, " \t\n"), (12, rows[1][1]), (12, rows[1][1]), (12, rows[2][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("length", [5, 50])
def test_substring_matches_brute_force(spark, length):
    rows = planted()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_removed int, key string").repartition(3)
    got = substring.dedup_digest(df, length).select("doc_id", "n_tokens", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == expect_words(rows, length)


@pytest.mark.parametrize("length", [7, 50])
def test_suffix_matches_brute_force(spark, length):
    rows = planted(seed=4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix.dedup_digest(df, length).select("doc_id", "n_tokens", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == expect_bytes(rows, length)


@pytest.mark.parametrize("length", [7, 50])
def test_doubling_matches_brute_force(spark, length):
    rows = planted(seed=4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix.dedup_digest(df, length, doubled=True).select("doc_id", "n_tokens", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == expect_bytes(rows, length)
    assert suffix.dedup_digest(df.limit(0), length, doubled=True).count() == 0


def test_queries_match_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = catalogue.op2_substring_dedup(spark, SMALL).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == expect_words(rows, 50)
    got = catalogue.op3_suffix_array_dedup(spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == expect_bytes(rows, 50)


def test_texts_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"a {long} b", 5), (2, f"c\n{long}\nd", 6), (None, long, 7)], "doc_id long, text string, spans int")
    kept = {r.doc_id: r.kept_text for r in substring.dedup(df).collect()}
    assert kept == {1: f"a {long} b", 2: "c\nd", None: long}
    assert {r.doc_id: r.n_spans for r in suffix.dedup(df).collect()} == {1: 0, 2: 1, None: 0}
    for f in (substring.dedup, substring.dedup_digest, suffix.dedup_digest):
        assert f(df.limit(0)).count() == 0
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def brute_simhash(rows):
    prints = {}
    for doc, text in rows:
        w = [x.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for x in words(text)]
        grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    label = {d: d for d in prints}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return sorted((d, f"{prints[d]:016x}", root(d)) for d in ids)


def test_simhash_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(5000, None), (5001, ""), (5002, "One two"), (5003, "oNE\ttwo"), (5004, " \n")]
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, fp string")
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == brute_simhash(rows)


def test_links_reach_all_near_pairs_in_crowded_buckets(spark):
    r = random.Random(1)
    base = [r.getrandbits(63) for _ in range(6)]
    fps = {b ^ sum(1 << i for i in r.sample(range(63), r.randint(0, 5))) for b in base for _ in range(150)}
    got = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), tile=50)).collect()
    roots = {x.node: x.root for x in got}
    label = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            low = min(label[b] for b in fps if (a ^ b).bit_count() <= 4)
            if low < label[a]:
                label[a], changed = low, True
    assert {x: roots.get(x, x) for x in fps} == label


def test_few_links_take_two_queries(spark, monkeypatch):
    """Chains, stars and pairs of any sign; as many as FEW are joined by one task, more by rounds of queries, alike."""
    from inkwell.llm import graph

    r = random.Random(4)
    ids = [r.getrandbits(64) - (1 << 63) for _ in range(300)]
    links = list(zip(ids[:99], ids[1:100], strict=True)) + [(ids[100], x) for x in ids[101:180]] + [(r.choice(ids[180:]), r.choice(ids[180:])) for _ in range(60)]
    label = {x: x for link in links if link[0] != link[1] for x in link}
    for _ in range(100):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(links, "u long, v long").repartition(3)

    def done():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark._jsparkSession.sharedState().statusStore().executionsCount()

    before = done()
    found = graph.components(df)
    assert done() - before <= 2
    assert sorted(map(tuple, found.collect())) == sorted(label.items())
    assert graph.components(df.where("u = v")).collect() == []
    monkeypatch.setattr(graph, "FEW", 0)
    assert sorted(map(tuple, graph.components(df).collect())) == sorted(label.items())


def test_crowded_passages(spark, monkeypatch):
    """A passage that many documents of a slice share, cut at different places, between texts of their own."""
    from inkwell.llm import spans

    monkeypatch.setattr(spans, "HOT", 3)
    r = random.Random(9)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(30)] + passage[r.randint(0, 25) : r.randint(45, 70)] + [f"b{i}x{k}" for k in range(30)])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring.dedup_digest(df).select("doc_id", "n_tokens", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == expect_words(rows, 50)
    got = suffix.dedup_digest(df).select("doc_id", "n_tokens", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == expect_bytes(rows, 50)


def test_long_words_are_not_mixed_up(spark):
    """Words of 2,048 letters that polynomial hashes modulo 2**64 cannot tell apart."""
    x, y = ("".join("ab"[(i.bit_count() + odd) % 2] for i in range(2048)) for odd in (0, 1))
    rows = [(d, " ".join([f"w{k}" for k in range(30)] + [w] + [f"v{k}" for k in range(29)])) for d, w in ((1, x), (2, y), (3, x))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.dedup_digest(df).collect()} == {1: 0, 2: 0, 3: 60}
    got = suffix.dedup_digest(df).select("doc_id", "n_tokens", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == expect_bytes(rows, 50)


def test_factors_are_copies_and_greedy(spark):
    """Each factor is found where it is said to be; none is shorter than a window unless the one before it reached over its start."""
    rows = list(dict(planted(seed=8)).items())
    tokens = {d: words(t) for d, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in substring.dedup(df, 10).collect()}
    assert sum(r.n_factors for r in found.values()) > 20
    for d, r in found.items():
        at = 0
        for f in r.factors:
            assert f.source < d and tokens[d][f.start : f.end] == tokens[f.source][f.source_start : f.source_start + f.end - f.start]
            assert f.start >= at and (f.end - f.start >= 10 or f.start == at > 0)
            at = f.end
        assert r.n_removed == sum(f.end - f.start for f in r.factors) and r.n_factors == len(r.factors)


def test_any_column_names(spark):
    names = ["__doc", "__salt", "__done", "__starts", "row", "salt", "done", "a.b"]
    text = " ".join(f"w{i}" for i in range(70))
    df = spark.createDataFrame([(i, text, *range(8)) for i in (1, 2)], "doc_id int, text string, " + ", ".join(f"`{n}` int" for n in names))
    for f in (substring.dedup, suffix.dedup):
        out = f(df)
        assert out.columns[:10] == df.columns and out.schema["doc_id"].dataType == df.schema["doc_id"].dataType
        assert {r.doc_id: r.n_removed > 0 for r in out.collect()} == {1: False, 2: True}


def test_very_long_texts(spark):
    base = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, base), (2, base[1000:]), (3, "z" * 400_000), (4, "y" + "z" * 399_999)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_removed) for r in substring.dedup_digest(df).collect()}
    assert got[1] == (60_000, 0) and got[2][0] - got[2][1] <= 1 and got[3] == (1, 0)
    got = {r.doc_id: (r.n_tokens, r.n_removed, r.n_spans) for r in suffix.dedup_digest(df).collect()}
    assert got[2] == (len(base) - 1000, len(base) - 1000, 1) and got[4] == (400_000, 399_999, 1)
