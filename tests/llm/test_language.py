import numpy as np
import pytest

from liftwise.llm.language import codewords, held_out, identify_languages, train_languages

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(~held_out())
    return train_languages(docs.select("doc_id", "text", "lang"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(held_out())
    rows = identify_languages(docs, model, ["doc_id", "lang"]).collect()
    assert len(rows) == docs.count()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    clear = [r for r in rows if not r.ambiguous]
    assert len(clear) > 0.97 * len(rows)


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 40):
        code = codewords(n)
        gaps = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * 99
        assert gaps.min() >= (1 if n == 2 else 2)


def test_edge_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, "the and that of with"), (4, "the and that of with"), (None, "der und die einer nicht"), (6, "é"), (7, "漢字"), (8, "the and of " * 100_000)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, extra int")
    got = identify_languages(docs, model, ["doc_id", "text", "extra"]).collect()
    by = {r.text: r for r in got}
    assert len(got) == len(rows)
    assert {by[t].lang_pred for t in (None, "", "123 !? \n")} == {"und"}
    assert by["the and that of with"].lang_pred == "en" and by["der und die einer nicht"].lang_pred == "de"
    assert by["漢字"].lang_pred in model.languages and by["é"].lang_pred in model.languages
    assert by["the and of " * 100_000].lang_pred == "en"
    with pytest.raises(ValueError):
        identify_languages(docs.withColumnRenamed("extra", "score"), model, ["score"])


def test_few_languages(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, "en")], "doc_id long, text string, lang string")
    none = train_languages(docs)
    assert {r.lang_pred for r in identify_languages(docs, none, ["doc_id"]).collect()} == {"und"}
    one = train_languages(docs.fillna({"lang": "xx"}))
    assert [r.lang_pred for r in identify_languages(docs, one, ["doc_id"]).orderBy("doc_id").collect()] == ["xx", "und"]
    assert identify_languages(docs.limit(0), one, ["doc_id"]).count() == 0
