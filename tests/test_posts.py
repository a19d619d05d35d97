"""Posts of forum pages."""

from inkwell.plans import catalogue
from inkwell.sources import html

SMALL = "/root/testdata/sf0.001"


def posts(spark, page):
    row = spark.createDataFrame([(page,)], "h string").select(html.posts("h", 3).alias("p")).first()
    return [(p.author, " ".join(p.text.split())) for p in row.p]


def test_inner_divs_and_two_posts_of_one_author(spark):
    page = '<div class="post">early</div><td class="poster_info"><b><a href="u">ann</a></b> <a>other</a></td>'
    page += '<td><div class="post big">before <div class="quote">quoted &amp; <div>deep</div></div><script>var x</script> after<br>end</div> out <div class="post">second</div></td>'
    page += '<td class="poster_info">no link</td><td><div class="post">third</div><div class="post">x</div>'
    assert posts(spark, page) == [("unknown", "early"), ("ann", "before quoted & deep after end"), ("ann", "second"), ("unknown", "third")]


def test_query_has_whole_texts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    plain = {d for d, t in docs.items() if len(t.strip()) >= 30 and not set("<&") & set(t)}
    got = catalogue.forum_posts(spark, SMALL).collect()
    assert max(len(docs[d]) for d in plain) > 500
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id in plain) == sorted((d, docs[d].strip()) for d in plain for _ in range(2))


def test_sets_tables_and_newest_files(spark, tmp_path):
    from inkwell.sources import files, pages

    rows = spark.createDataFrame([(10,), (9,), (10,), (None,)], "thread long")
    for _ in range(2):
        files.write_set(rows, "thread", str(tmp_path / "set"))
        assert [r.value for r in spark.read.text(str(tmp_path / "set")).collect()] == ["9", "10"]
    for n in (3, 2):
        assert files.replace({"a": spark.range(n), "b": spark.range(0)}, str(tmp_path)) == ["b"]
    assert spark.read.json(str(tmp_path / "a")).count() == 2
    assert pages.newest(spark, str(tmp_path / "none"), str(tmp_path / "a")) == str(tmp_path / "a")
    (tmp_path / "one_writer.json").write_text('["first text", "second"]')
    (tmp_path / "items.json").write_text('[{"source": "s", "text": "t", "number": 3}]')
    assert sorted(map(tuple, files.candidates(spark, f"{tmp_path}/one_writer.json").collect())) == [("One Writer", "first text"), ("One Writer", "second")]
    assert [(r.source, r.text, r.number, r.url) for r in files.items(spark, f"{tmp_path}/items.json").collect()] == [("s", "t", 3, None)]
    files.write_splits(spark.createDataFrame([(1, "val"), (2, "train")], "doc_id long, split string"), str(tmp_path / "splits"))
    assert {r.split: r.doc_id for r in spark.read.json(str(tmp_path / "splits")).collect()} == {"val": 1, "train": 2}
