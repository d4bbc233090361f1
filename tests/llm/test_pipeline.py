import regex

import corpus_pipeline
from liftwise.llm.surrogates import PATTERN
from liftwise.session import materialize
from tests.llm.brute import text_components
from tests.llm.test_decontaminate import brute_items

DATA = "/root/testdata/sf0.01"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), "test-pipeline")
        now = {r.doc_id: r for r in docs.collect()}
        assert len(now) == docs.count()
        if name == "language_id":
            assert len(now) > 0.98 * len(kept) and all(now[k] == kept[k] for k in now)
        elif name == "near_duplicates":
            groups = text_components([(k, r.text) for k, r in kept.items()])
            assert set(now) == {k for k, _, c in groups if k == c}
        elif name == "decontamination":
            assert set(now) == {k for k, r in kept.items() if not brute_items(r.text, bench)} and len(now) < len(kept)
        elif name == "personal_data":
            old = {v for r in kept.values() for v in regex.findall(PATTERN, r.text)}
            new = {v for r in now.values() for v in regex.findall(PATTERN, r.text)}
            assert set(now) == set(kept) and old and not old & new and all(r.n_chars == len(r.text) for r in now.values())
        else:
            assert all(len(r.pieces) == r.n_pieces > 0 and r.text == kept[k].text for k, r in now.items())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        kept = now


def test_run_over_odd_rows(spark, tmp_path):
    text = "the and that of with from this are was one of these " * 5
    rows = [(1, text, "en", 1, "x"), (1, text, "en", 1, "x"), (2, None, "en", None, None), (3, "", None, 0, ""), (4, "123", "de", 3, "y"), (None, text + "more", None, 2, "z"), (6, "der die und nicht einer auf das ist mit " * 9, "de", 5, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, lang_pred string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    items = spark.createDataFrame([(1, None)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    items.write.parquet(f"{tmp_path}/none/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [1, 6]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_near_duplicates_go_by_row(spark, tmp_path):
    a, b = "one text that several rows share word for word in full", "a text of its own that nothing else in here resembles at all"
    rows = [(None, a), (1, a), (2, b), (2, a), (2, a), (None, "x"), (None, "x"), (3, None), (3, None), (4, ""), (5, b + " and more words follow here"), (None, "only an unnamed row says just this thing")]
    want = sorted([(1, a), (2, b), (5, b + " and more words follow here"), (None, "x"), (3, None), (3, None), (4, ""), (None, rows[-1][1])], key=str)
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, _gone_file string")
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    for given in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        got = corpus_pipeline.near_duplicates(spark, given, DATA)
        assert got.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
