"""Language ID, toxicity, SentencePiece and the pipeline."""

import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import catalogue, language, mixing, pieces, toxicity
from inkwell.llm.common import least
from test_dedup import brute_runs, brute_simhash, words

MEDIUM = "/root/testdata/sf0.01"
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "123 !?"), (5, "é"), (5, "é"), (6, "of the and " * 3000), (None, "the end")]


def frame(spark, rows, more="x int"):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, " + more)


def test_kneser_ney_shares_sum_to_one():
    m = language.Models({"a": ["abracadabra abba cab"], "b": ["zebra zoo"]})
    text = language.normal("abracad")
    for i in range(len(text) - language.ORDER):
        stem = text[i : i + language.ORDER - 1]
        sums = sum(np.exp(-m.entropies([stem + c])[0, 0]) for c in "abrcd ")
        assert sums <= 1.0001
        assert sums > 0.95  # the rest is for characters never seen


def test_language_query_holds_out(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = catalogue.op5_language(spark, MEDIUM).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {d for d in rows if zlib.crc32(str(d).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in out]) > 0.97
    assert np.mean([r.accepted for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    models = language.fit(spark.createDataFrame([(i, t * 5, x) for i, (t, x) in enumerate([("the cat and the dog ", "en"), ("der hund und die katze ", "de"), ("no language ", None)] * 6)], "doc_id long, text string, lang string"))
    assert models.languages == ["de", "en"]
    got = language.identify(frame(spark, EDGE, "score int"), models).collect()
    assert [r.lang_pred for r in got][:4] == ["und"] * 4 and got[6].lang_pred == "en" and not got[0].accepted
    assert got[4].lang_pred in models.languages
    none = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(frame(spark, EDGE), none).collect()} == {"und"}
    assert language.identify(frame(spark, EDGE).limit(0), models).count() == 0


def brute_entropy(texts, text, floor):
    """Nats a character by interpolated Kneser-Ney, by dictionaries; floor: the share of a character below the lowest order."""
    from collections import Counter

    order, d = language.ORDER, language.DISCOUNT
    normed = [language.normal(t) for t in texts]
    ends = [t[i - order : i] for t in normed for i in range(order, len(t) + 1)]
    top = Counter(ends)
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(gram):
        k = len(gram)
        if not k:
            return floor
        own = {g: n for g, n in levels[k].items() if g[:-1] == gram[:-1]}
        low = p(gram[1:])
        if not own:
            return low
        total = sum(own.values())
        return max(own.get(gram, 0) - d, 0) / total + min(1, d * len(own) / total) * low

    x = language.normal(text)
    grams = [x[i - order : i] for i in range(order, len(x) + 1)]
    return -sum(np.log(p(g)) for g in grams) / len(grams)


def test_entropies_match_brute_force():
    texts = {"a": ["abracadabra abba cab", "a cab and a car"], "b": ["zebra zoo azure", "oz"]}
    m = language.Models(texts)
    for text in ("abracad zoo", "cab", "qqq a", "Zebra, 12 cars!"):
        got = m.entropies([language.normal(text)])[0]
        assert got == pytest.approx([brute_entropy(texts[x], text, m.floor) for x in m.languages], rel=1e-4)


def test_language_rejects_what_it_has_not_learned(spark):
    r = np.random.default_rng(0)
    words = {"en": ["the", "cat", "dog", "house", "and", "runs"], "de": ["der", "hund", "katze", "haus", "und", "rennt"]}
    rows = [(i, " ".join(r.choice(words[x], 40)), x) for i in range(60) for x in words]
    models = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    some = [(0, "the cat and the dog runs"), (1, "der hund und katze rennt haus"), (2, "xqz wvk jjp zzqx kkwv " * 5), (3, "日本語 テキスト 你好")]
    got = {x.doc_id: (x.lang_pred, x.accepted) for x in language.identify(frame(spark, some, "accepted int"), models).collect()}
    assert got[0] == ("en", True) and got[1] == ("de", True) and not got[2][1] and not got[3][1]


def test_fits_collect_no_more_than_their_sample(spark, monkeypatch):
    """5,000 equal rows, and 9,000 texts of one labelled id."""
    seen, trained = [], []
    monkeypatch.setattr(language.Models, "_fit", staticmethod(lambda texts, plain=language.Models._fit: seen.append(texts) or plain(texts)))
    rows = [(7, "the same text " * 3, "en")] * 5000 + [(i, f"text {i} " * 5000, "en") for i in range(500)]
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(seen[0]) <= 400 and max(map(len, seen[0])) <= language.SAMPLE_CHARS
    monkeypatch.setattr(toxicity.Network, "train", lambda self, texts, labels: trained.append((texts, labels)))
    docs = spark.createDataFrame([(1, f"word {i}") for i in range(9000)] + [(i, "clean " * 9000) for i in range(2, 50)], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(i, int(i == 1)) for i in range(1, 50)], "doc_id long, toxic int"))
    assert len(trained[0][0]) == 49 and max(map(len, trained[0][0])) == toxicity.CHARS and trained[0][1].sum() == 1


def brute_logit(n, b, window):
    """The forward pass of one window, by loops."""
    p, h = n.p, toxicity.HIDDEN
    x = n.inputs(b)
    used = [int(w) for w in window if w >= 0]
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = {}
    for d, order in (("f", used), ("b", used[::-1])):
        s, out = np.zeros(h), []
        for w in order:
            g = x[w] @ p[f"x{d}"] + p[f"c{d}"]
            zr = sig(g[: 2 * h] + s @ p[f"u{d}"])
            c = np.tanh(g[2 * h :] + (zr[h:] * s) @ p[f"n{d}"])
            s = (1 - zr[:h]) * c + zr[:h] * s
            out.append(s)
        states[d] = out if d == "f" else out[::-1]
    both = [np.r_[f, g] for f, g in zip(states["f"], states["b"])]
    e = np.array([np.tanh(v @ p["att"]) @ p["pick"] for v in both])
    e = np.exp(e - e.max())
    return float(sum(a * v for a, v in zip(e / e.sum(), both)) @ p["out"] + p["bias"][0])


def test_forward_matches_loops():
    n = toxicity.Network()
    b = toxicity.Batch([b"some words here", b"many more words of a text " * 12])
    got = n.forward(n.inputs(b), b.windows)
    assert got == pytest.approx([brute_logit(n, b, w) for w in b.windows], abs=1e-5)


def test_toxicity_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = catalogue.op7_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert {r.doc_id for r in got if r.held_out} == {d for d in docs if zlib.crc32(str(d).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by_text = {}
    assert all(by_text.setdefault(docs[r.doc_id].text, r.score) == pytest.approx(r.score, abs=1e-6) for r in got)


def test_gradients():
    n, r = toxicity.Network(), np.random.default_rng(0)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    b = toxicity.Batch([b"you are an idiot clown", b"the nice day is here " * 10, b"", b"abc idiot" * 20])
    c = r.standard_normal(len(b.windows))

    def loss():
        chars = np.add.reduceat(n.p["gram"][b.grams], b.first, axis=0) / b.length[:, None]
        x = np.concatenate([n.p["word"][b.words], chars, np.zeros((len(b.words), 1))], 1)
        return float((n.forward(x, b.windows) * c).sum()), x

    _, x = loss()
    _, kept = n.forward(x, b.windows, keep=True)
    g = n.backward(b, x, b.windows, kept, c)
    for k in ("xf", "xb", "uf", "nb", "cf", "att", "pick", "out", "word", "gram"):
        if k in ("word", "gram"):
            at = (g[k][0][0], 3)
            got = g[k][1][g[k][0] == at[0]][:, 3].sum()
        else:
            at = tuple(0 for _ in n.p[k].shape)
            got = g[k][at]
        old, values = n.p[k][at], []
        for step in (1e-3, -1e-3):
            n.p[k][at] = old + step
            values.append(loss()[0])
        n.p[k][at] = old
        assert got == pytest.approx((values[0] - values[1]) / 2e-3, rel=1e-2, abs=1e-6)


def test_every_word_is_in_a_window_and_parts_agree():
    b = toxicity.Batch([b" ".join(b"w" + bytes([97 + i % 26, 97 + i // 26]) for i in range(k)) for k in (0, 1, 31, 32, 33, 48, 49, 100)])
    for i, k in enumerate((0, 1, 31, 32, 33, 48, 49, 100)):
        w = b.windows[b.doc == i]
        assert len(np.unique(w[w >= 0])) == k
    n = toxicity.Network()
    whole, some = n.forward(n.inputs(b), b.windows), b.part(np.arange(2, len(b.windows)))
    assert n.forward(n.inputs(some), some.windows) == pytest.approx(whole[2:], abs=1e-5)


def test_toxicity_held_out(spark):
    r = np.random.default_rng(3)
    pool = ["".join(r.choice(list("abcdefgh"), 4)) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        w = [str(x) for x in r.choice(pool, r.integers(20, 200))]
        if i % 3 == 0:
            w[r.integers(len(w))] = "vilex" + str(r.choice(pool))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = toxicity.fit(docs.where("doc_id < 600"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x.doc_id: x.score for x in toxicity.score(docs.where("doc_id >= 600"), net, keep=["doc_id"]).collect()}
    assert np.mean([(s >= 0.5) == (d % 3 == 0) for d, s in got.items()]) > 0.95
    edge = toxicity.score(frame(spark, EDGE, "score int"), net).collect()
    assert len(edge) == len(EDGE) and all(0 <= x.score <= 1 for x in edge)
    assert toxicity.score(docs.limit(0), net).count() == 0
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x.score for x in toxicity.score(docs.limit(3), nothing).collect()} == {0.5}


ODD = ["", "a", " ", "  ", "   a    b", "tab\tnl\n\n  x", "日本語テキスト 你好", "🙂🙂 é", "a" * 500, "    def f(x):\n        return x+1", " trailing   ", "\u0000 a"]


def test_pieces_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = ODD + ["▁x▁ y"] + [r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("text").limit(150).collect()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None)]
    v = pieces.Vocabulary()
    got = pieces.encode(frame(spark, rows, "ids int"), v, check=True)
    for r in got.collect():
        assert r.ids == (None if r.text is None else library.encode(r.text))
        assert r.round_trip == (None if r.text is None else "▁" not in r.text)
    back = {r.doc_id: r.text for r in pieces.decode(got.select("doc_id", "ids"), v).collect()}
    assert all(back[i] == (t and t.replace("▁", " ")) for i, t in rows)
    assert pieces.encode(frame(spark, rows).limit(0), v).count() == 0


def test_long_runs_of_spaces_are_quick():
    import time

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    e = pieces.Encoder(pieces.Vocabulary())
    began = time.process_time()
    for text in (" " * 100_000, "a" + " " * 100_001 + "b", " " * 33):
        assert e.encode([text.encode()])[0].tolist() == library.encode(text)
    assert time.process_time() - began < 3


def test_repeated_and_long_rows_of_pieces(spark):
    long = "Some words, and a number 12345. " * 30_000
    v = pieces.Vocabulary()
    got = pieces.encode(frame(spark, [(1, long), (2, long), (2, "x"), (2, "x")], "n_pieces int"), v, check=True).collect()
    assert [r.round_trip for r in got] == [True] * 4 and got[0].ids == got[1].ids and got[2].ids == got[3].ids
    assert got[0].ids == sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()).encode(long)


def test_pieces_query(spark):
    got = catalogue.op1_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r.round_trip and len(r.ids) == r.n_pieces for r in got)


def test_pipeline_matches_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    kept = corpus_pipeline.identify(spark, docs, MEDIUM)
    rows = {r.doc_id: r for r in kept.collect()}
    assert len(rows) > 0.98 * docs.count() and kept.columns == docs.columns
    near = {d for d, _, c in brute_simhash([(d, r.text) for d, r in rows.items()]) if d == c}
    runs = {d: gone for d, gone in zip(sorted(near), brute_runs([(d, rows[d].text) for d in sorted(near)], words, 50))}
    left = {d: [w for w, g in zip(words(rows[d].text), runs[d]) if not g] for d in near}
    left = {d: w for d, w in left.items() if w or not runs[d]}
    got = corpus_pipeline.run(spark, MEDIUM).collect()
    v = pieces.Vocabulary()
    for r in got:
        assert v.decode(r.ids).encode().split() == left[r.doc_id] and r.round_trip
    order = sorted({rows[d].source for d in left})
    sizes = [sum(len(left[d]) for d in left if rows[d].source == s) for s in order]
    for s, target in zip(order, mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))])):
        most = max(len(left[d]) for d in left if rows[d].source == s)
        assert abs(sum(len(left[r.doc_id]) for r in got if r.source == s) - target) <= most
    assert max(np.unique([r.doc_id for r in got], return_counts=True)[1]) <= 2


def test_pipeline_edges(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").limit(60)
    more = spark.createDataFrame([(None, None, None, None, None), (9000, None, "en", None, None), (9001, "", "en", "s", 0), (9002, "the " * 9000, None, "s", 1), (9002, "the " * 9000, None, "s", 1)], docs.schema)
    for some in (docs.unionByName(more), docs.limit(0)):
        out = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, MEDIUM)
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
        corpus_pipeline.encode(spark, out, MEDIUM).count()


def test_least_is_a_sort_cut_at_n(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") < 30, "b").otherwise("a").alias("g"))
    same = spark.createDataFrame([(7, "c")] * 3000, "id long, g string")
    found = least(rows.union(same), "g", [F.xxhash64("id"), F.col("id")], 40)
    got = {g: sorted(r.id for r in found.where(F.col("g") == g).collect()) for g in "abc"}
    hashes = {r.id: r.h for r in rows.select("id", F.xxhash64("id").alias("h")).collect()}
    assert got["a"] == sorted(sorted(range(30, 20_000), key=lambda i: (hashes[i], i))[:40])
    assert got["b"] == list(range(30)) and got["c"] == [7] * 40
    assert not least(rows.where("false"), "g", [F.xxhash64("id"), F.col("id")], 40).count()
