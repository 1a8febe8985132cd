"""Every operator and pipeline stage on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import pytest
from brute import near, sha
from pyspark.sql import functions as F

import corpus_pipeline
from prodseries.llm import bpe, decontaminate, fixity, language_id, licenses, near_dup, pii, queries, token_rollups, unit_dedup, vector_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox of the north and an old dog " * 4000
ODD = [
    (1, None, "en", "s", None), (2, "", "en", None, 0), (3, "...", None, "s", 3), (None, "words without an id", "en", "s", 5),
    (None, None, None, None, None), (5, LONG, "en", "s", len(LONG)), (6, "le chat et la souris", "fr", "s", 20),
    (6, "le chat et la souris", "fr", "s", 20), (7, "le chat et la souris", "fr", "t", 20), (8, "x" * 100_000, "en", "s", 1),
    (9, "mail a@b.cc, all rights reserved", "en", "s", 1), (9, "another text under the same id", "en", "s", 1), (10, "42 17", "en", "s", 5),
]
#: Names that the operators use themselves.
CLASH = "row tokens hit found key gram at rank rep digest bands a b component n label start end kept v list id ids score spans node lang_pred n_words copy changed".split()
OPS = {
    "op2": lambda d, b: decontaminate.report(d, b),
    "op3": lambda d, b: language_id.languages(d),
    "op7": lambda d, b: near_dup.groups(d),
    "op8": lambda d, b: pii.report(d),
    "op9": lambda d, b: licenses.report(d),
    "op10": lambda d, b: bpe.digests(d),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "le chat et la souris"), (2, None), (None, "old dog the quick"), (3, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


def clashing(df):
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", OPS)
def test_one_row_a_row_whatever_else_is_there(docs, items, name):
    got = plain(OPS[name](docs, items))
    assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in ODD)
    other = clashing(items.withColumn("doc_id", F.lit(1)))
    assert plain(OPS[name](clashing(docs), other)) == got


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(docs, items, name):
    assert plain(OPS[name](docs.limit(0), items)) == []
    assert len(plain(OPS[name](docs, items.limit(0)))) == len(ODD)


def test_values_of_odd_rows(docs, items):
    by = lambda df: {(r.doc_id, i): r for i, r in enumerate(df.collect())}
    hits = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in by(decontaminate.report(docs, items)).values()}
    assert {(1, 0, 0, 0, False), (2, 0, 0, 0, False), (6, 5, 5, 1, True), (7, 5, 5, 1, True), (None, 4, 0, 0, False)} <= hits
    assert (5, 44_000, 4 * 3999, 0, True) in hits  # an item without an id hits, and is not counted
    langs = {r.doc_id: (r.lang_pred, r.score) for r in language_id.languages(docs).collect() if r.doc_id in (1, 2, 3, 10)}
    assert langs == {k: ("und", 0.0) for k in (1, 2, 3, 10)}
    want = [(d, n, c, True if d is None else d == c) for d, n, c in near([r[:2] for r in ODD])]
    assert plain(near_dup.groups(docs)) == sorted(want, key=str)
    empty = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert (empty[1].n_tokens, empty[1].ids_sha256, empty[2].decoded_sha256) == (0, sha(""), sha(""))


def test_one_language_and_none(docs, spark):
    one = language_id.languages(docs.withColumn("lang", F.lit("xx")))
    assert {(r.lang_pred, r.score) for r in one.collect()} == {("xx", 1.0), ("und", 0.0)}
    assert {r.lang_pred for r in language_id.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_units_of_odd_rows(docs):
    assert plain(unit_dedup.removed(docs.limit(0))) == []
    got = unit_dedup.removed(clashing(docs), least=3).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in got} == {(7, 6)}
    assert {(r.doc_id, r.text) for r in unit_dedup.cleaned(docs, unit_dedup.ENDS, least=3).where("doc_id IN (6, 7) OR text IS NULL").collect()} == {
        (6, "le chat et la souris"), (7, ""), (1, None), (None, None)}
    none_last = docs.sparkSession.createDataFrame([(None, "a b c d"), (4, "a b c d")], "doc_id long, text string")
    assert [(r.doc_id, r.kept_doc_id) for r in unit_dedup.removed(none_last, least=3).collect()] == [(None, 4)]


def test_repeats_of_odd_rows(docs):
    assert plain(unit_dedup.repeats(docs.limit(0))) == []
    assert plain(unit_dedup.cleaned(docs.limit(0))) == []
    got = unit_dedup.repeats(clashing(docs)).collect()
    lines = {(r.doc_id, r.kept_doc_id, r.start, r.end, r.n_copies) for r in got if r.unit == "line"}
    assert lines == {(7, 6, 0, 20, 3)}  # the copy under the same doc_id is the same occurrence
    assert {r.doc_id for r in got if r.unit == "window"} == {5} and {r.kept_doc_id for r in got if r.doc_id == 5} == {5}
    texts = {(r.doc_id, r.text) for r in unit_dedup.cleaned(clashing(docs)).where("doc_id <> 5 OR doc_id IS NULL").collect()}
    assert texts == {(d, "" if d == 7 else t) for d, t, *_ in ODD if d != 5}


def test_rollup_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(9, None, 1), (9, 1, 1), (None, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    r = token_rollups.Rollup(spark)
    token_rollups.feed(clashing(docs), clashing(labels), r)
    total = r.totals().groupBy("tokenizer").agg(F.sum("n_docs").alias("d")).collect()
    assert {(x.tokenizer, x.d) for x in total} == {("blanks_1", 11), ("words_1", 11)}
    none = token_rollups.Rollup(spark)
    token_rollups.feed(docs.limit(0), labels, none)
    assert plain(none.totals()) == []


def test_pages_of_odd_rows(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, None, None), (None, "u", "h"), (None, "u", "h"), (2, "u", "x" * 200_000), (2, "u", "other"), (3, "", ""), (3, "", "")]
    pages = spark.createDataFrame(rows, schema)
    archive = fixity.records(clashing(pages))
    assert archive.count() == len(rows)  # repeated pages are records of their own
    assert fixity.audit(archive, archive).count() == 0
    assert {r.damage for r in fixity.audit(archive, archive.limit(0)).collect()} == {"missing"}
    assert fixity.audit(fixity.records(pages.limit(0)), fixity.records(pages.limit(0))).count() == 0
    holes = archive.select(*(F.when(F.col("record_id") == 3, None).otherwise(F.col(c)).alias(c) for c in archive.columns))
    assert [r.damage for r in fixity.audit(archive, holes).collect()] == ["missing"] * 2


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0]), (None, [1.0, 1.0])]
    rows += [(8, [1.0, 1.0]), (9, [1e200, 1e200]), (50, [0.0, 2.0])]
    e = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in vector_search.nearest(e).collect())
    assert got == [(0, 1, 8, 0.707107), (0, 2, 9, 0.707107), (0, 3, 50, 0.0), (50, 1, 8, 0.707107), (50, 2, 9, 0.707107), (50, 3, 0, 0.0)]
    assert vector_search.nearest(e.limit(0)).count() == 0
    twice = spark.createDataFrame([(50, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, round(r.score, 6)) for r in vector_search.nearest(twice).collect())
    assert got == [(1, 3, 0.707107), (1, 50, 0.707107), (2, 3, 0.0), (2, 50, 0.707107)]  # each is a query of its own


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, tmp_path, items, name):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    wide = clashing(docs)
    got = stage(spark, wide, str(tmp_path))
    if name != "bpe":
        assert got.columns == wide.columns and got.dtypes == wide.dtypes
    assert stage(spark, wide.limit(0), str(tmp_path)).count() == 0
    ids = sorted(str(r.doc_id) for r in got.collect())
    gone = {"language_id": {"1", "2", "3", "10"}, "near_dup": {"7"}, "decontaminate": {"5", "6", "7"}}.get(name, set())
    want = sorted(str(r[0]) for r in ODD if str(r[0]) not in gone)
    if name == "near_dup":  # one row of each doc_id and text
        want.remove("6")
    if name == "language_id":
        want.remove("None")  # the one without text
    assert ids == want


def test_texts_under_one_id_stay_apart(spark):
    rows = [(1, "one two three four five"), (1, "wholly other words are here"), (2, "wholly other words are here"), (1, "one two three four five"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.create_map(F.lit("k"), "text"))
    got = near_dup.deduplicated(docs)
    assert got.dtypes == docs.dtypes
    want = [("1", "one two three four five"), ("1 or 2", "wholly other words are here"), ("None", "None")]
    plain_id = lambda r: "1 or 2" if r.text and r.text.startswith("wholly") else str(r.doc_id)
    assert sorted((plain_id(r), str(r.text)) for r in got.collect()) == want
    named = near_dup.deduplicated(docs.withColumn("doc_id", F.concat(F.lit("n"), "doc_id")))
    assert sorted((plain_id(r).removeprefix("n"), str(r.text)) for r in named.collect()) == want
    assert near_dup.deduplicated(docs.where("doc_id = 2")).count() == 1


def test_components_of_odd_graphs(spark):
    from prodseries.llm.graph import components

    edges = spark.createDataFrame([(3, 2), (2, 3), (2, 3), (5, 5), (None, 7), (7, None), (9, 8), (3, 9)], "a long, b long")
    assert plain(components(edges)) == [(2, 2), (3, 2), (8, 2), (9, 2)]
    assert plain(components(edges.limit(0))) == []
    named = edges.select(*(F.struct(F.lit("n").alias("k"), F.col(c).alias("i")).alias(c) for c in ("a", "b"))).where("a.i > 7 OR b.i > 8")
    assert {(r.node.i, r.component.i) for r in components(named).collect()} == {(3, 3), (8, 3), (9, 3)}


def test_pipeline_against_plain_steps(spark, tmp_path):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = {r.doc_id for r in language_id.languages(docs).where("lang_pred <> 'und' AND NOT ambiguous").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in known}
    kept = {d for d, _, c in near(sorted(texts.items())) if d == c}
    from brute import contamination

    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    dirty = {r[0] for r in contamination([(d, texts[d]) for d in kept], items) if r[5]}
    assert set(out) == kept - dirty
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert all(out[d].decoded_sha256 == sha(clean[d]) for d in out)
    assert all("@" not in clean[d] or clean[d] == texts[d] or "[EMAIL]" in clean[d] for d in out)


def test_registered_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLES) < set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    from compare import compare, duck

    sf = "/root/testdata/sf0.001"
    assert compare(spark, duck(sf), sf, queries.QUERIES[name], queries.ORACLES[name]) is None
