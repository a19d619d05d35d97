"""What a step takes at most does not grow with its input."""

import sys

import numpy as np

from inkwell.functions import text as T
from inkwell.operators import model
from inkwell.plans import catalogue
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_tokens_are_found_by_latin_signs_alone(spark):
    """A sign beyond Latin-1 in the class makes Java look up all of it sign by sign."""
    assert all(c < "\x80" for c in T.TOKEN) and "\\u" not in T.TOKEN
    spaces = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()]
    assert sorted(T.SPACES) == sorted(spaces)
    texts = [f"{c}a{c}{c}b​c{c}" for c in spaces] + ["", "　", "über 日本"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.words(F.col("t")).alias("w"), T.word_count(F.col("t")).alias("n"), T.strip(F.col("t")).alias("s"))
    for r in rows.collect():
        assert (r.w, r.n, r.s) == (r.t.split(), len(r.t.split()), r.t.strip())


def test_arrow_batches_are_small(spark):
    for q in (catalogue.QUERIES["feature_vector_l"], catalogue.forum_posts, catalogue.classed_messages):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        q(spark, SMALL)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_kernel_values_are_held_for_few_rows(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 3))
    machine = model.KernelMachine().fit(x[:60], (x[:60, 0] > 0).astype(int))
    whole, seen, plain = 1 / (1 + np.exp(-(machine.slope * machine.decide(x) + machine.shift).clip(-30, 30))), [], machine.decide
    monkeypatch.setattr(machine, "decide", lambda part: seen.append(len(part)) or plain(part))
    assert np.allclose(machine.probability(x), whole) and max(seen) <= 256 and sum(seen) == 1000 and machine.probability(x[:0]).shape == (0,)
