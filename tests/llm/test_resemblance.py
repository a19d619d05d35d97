"""The pipeline's near-duplicates against brute force over five-word shingles."""

import random

import corpus_pipeline
import numpy as np
from inkwell.llm import resemblance, simhash
from pyspark.sql import functions as F
from test_dedup import words

MEDIUM = "/root/testdata/sf0.01"


def grams(text):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_links_are_exact(spark):
    base = [f"w{i}" for i in range(200)]
    swap = lambda at: " ".join("other" if i in at else w for i, w in enumerate(base))
    rows = [(1, swap([])), (2, swap([50])), (3, swap(range(0, 200, 12))), (4, swap([50]).upper()), (5, "a b"), (6, "A  b"), (7, ""), (8, None), (None, swap([]))]
    got = {tuple(sorted(r)) for r in resemblance.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 2), (2, 4), (5, 6)}


def test_pairs_of_similarity_are_dropped(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").cache()
    sets = {r.doc_id: grams(r.text) for r in docs.collect()}
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, MEDIUM).collect()}
    size = sorted(left, key=lambda d: len(sets[d]))
    met = [(a, b) for i, a in enumerate(size) for b in size[i + 1 :] if sets[a] and len(sets[b]) <= 1.25 * len(sets[a]) and near(sets[a], sets[b])]
    assert not met
    before = {r.doc_id for r in simhash.near_duplicates(docs.select("doc_id", "text")).where("doc_id = component_id").collect()}
    assert left < before and all(any(near(sets[a], sets[d]) for a in sets if a < d) for d in before - left)


def test_rows_are_judged_by_their_texts(spark):
    """Different texts under one doc_id, equal texts under several, rows without an id, and any column names."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(80))
    edited = text("a").replace("aw40", "other")
    rows = [(1, text("b")), (1, text("c")), (2, text("a")), (3, edited), (None, text("a")), (None, text("d")), (None, text("d")), (4, None), (5, ""), (2, text("a"))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, t int").repartition(3)
    got = corpus_pipeline.near_dedup(spark, df, MEDIUM)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, text("b")), (1, text("c")), (2, text("a")), (None, text("d")), (4, None)], key=repr)


def test_crowded_buckets(spark):
    """Many texts near one another, and many that only resemble them, over several batches."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        out = list(base)
        for at in r.sample(range(300), 3 if i % 2 else 25):
            out[at] = f"x{i}y{at}"
        rows.append((i, " ".join(out)))
    sets = {d: grams(t) for d, t in rows}
    links = {tuple(sorted(x)) for x in resemblance.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert all(near(sets[a], sets[b]) for a, b in links) and len(links) <= 400 * 2 * resemblance.TRIES
    label = {d: d for d in sets}
    for _ in range(20):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert len({label[d] for d in sets if d % 2}) == 1
    left = [d for d in sets if label[d] == d]
    assert not [(a, b) for i, a in enumerate(left) for b in left[i + 1 :] if near(sets[a], sets[b])]


def classes(ids, links):
    label = {d: d for d in ids}
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def pairs_of(sets):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and near(sets[a], sets[b])}


def test_partners_behind_many_candidates(spark):
    """Two near texts, which have more candidates than TRIES that are not near, before them in each bucket."""
    base, r, rows = [f"w{i}" for i in range(300)], random.Random(5), []
    places = list(range(5, 295, 6))
    for pair in range(6):
        core = [f"p{pair}{w}" for w in base]
        for i in range(30):
            text = list(core)
            for at in r.sample(places, 4):
                text[at] = f"d{i}x{at}"
            rows.append((1000 * pair + i, " ".join(text)))
        own = r.sample(places, 9)
        for i in (0, 1):
            text = list(core)
            for at in own[:3] + own[3 + 3 * i : 6 + 3 * i]:
                text[at] = f"y{at}"
            rows.append((1000 * pair + 500 + i, " ".join(text)))
    sets = {d: grams(t) for d, t in rows}
    want = pairs_of(sets)
    assert all((1000 * p + 500, 1000 * p + 501) in want for p in range(6))
    links = {tuple(sorted(x)) for x in resemblance.links(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert links <= want and classes(sets, links) == classes(sets, want)


def test_components_are_those_of_all_pairs(spark):
    """Texts of all sizes around the bound, with passages that many share."""
    r, rows = random.Random(11), []
    common = [f"c{i}" for i in range(40)]
    for g in range(60):
        n = r.choice([1, 3, 5, 6, 9, 14, 30, 60, 200])
        core = [f"g{g}w{i}" for i in range(n)] + (common if g % 3 == 0 else [])
        for i in range(12):
            text = list(core)
            for at in r.sample(range(len(text)), min(len(text), r.randrange(1 + len(text) // 25 + 1))):
                text[at] = f"e{r.randrange(3)}"
            cut = r.randrange(1 + len(text) // 6)
            rows.append((100 * g + i, " ".join(text[cut:] if r.random() < 0.5 else text[: len(text) - cut])))
    sets = {d: grams(t) for d, t in rows}
    want, docs = pairs_of(sets), spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    links = {tuple(sorted(x)) for x in resemblance.links(docs).collect()}
    assert links <= want and classes(sets, links) == classes(sets, want)


def test_rest_has_all_near_pairs(spark, monkeypatch):
    """Without any links, and with crowds dealt to tasks, the exact filters keep each near pair and few others."""
    monkeypatch.setattr(resemblance, "TILE", 16)
    base, r, rows = [f"w{i}" for i in range(120)], random.Random(3), []
    for i in range(150):
        text = [w if i % 2 else f"o{w}" if at > 40 else w for at, w in enumerate(base)]
        for at in r.sample(range(120), r.randrange(1, 9)):
            text[at] = f"x{i}y{at}"
        rows.append((i, " ".join(text)))
    sets = {d: grams(t) for d, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for frequent in (resemblance._frequent(docs), (np.empty(0, np.uint64), np.empty(0, np.int64))):
        own = resemblance._prints(docs, frequent, 0.8).withColumnRenamed("doc_id", "v").withColumn("row", F.col("v"))
        links = spark.createDataFrame([], "u long, v long")
        found = {tuple(x) for x in resemblance._rest(own, own, links, 0.8).collect()}
        assert pairs_of(sets) <= found and all(a % 2 == b % 2 for a, b in found)
