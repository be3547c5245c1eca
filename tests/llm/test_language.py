"""Language ID: held-out accuracy, and what a prediction may depend on."""

import zlib

import pytest
import regex
from pyspark.sql import functions as F

from brindle.llm import language

from .conftest import DATA, rows_by_id, texts_of


def test_contract(spark, folder):
    out = rows_by_id(language.op4_language(spark, folder))
    texts = texts_of(spark, folder)
    assert out.keys() == texts.keys()
    for i, t in texts.items():
        r = out[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if not regex.search(r"\p{L}", t or ""):
            assert r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"]
        else:
            assert r["lang_pred"] != "und"


@pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in language.op4_language(spark, str(DATA)).collect() if r["held_out"]]
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in held)
    assert len(held) > 20 and right / len(held) >= 0.95


def test_labels_teach_only_where_they_may(spark):
    rows = [(i, "the cat and the dog went over there" if i % 2 else "der Hund und die Katze gingen dorthin", "en" if i % 2 else "de") for i in range(60)]
    schema = "doc_id long, text string, lang string, score string"
    docs = spark.createDataFrame([(*r, "x") for r in rows], schema)
    # the labels of rows held out are no input
    wrong = docs.withColumn("lang", F.when(language.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    told = lambda d: {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(d).collect()}
    assert told(docs) == told(wrong)
    assert {i: p for i, (p, _) in told(docs).items()} == {i: lang for i, _, lang in rows}


def test_no_labels_and_ties(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, "en"), (None, "words", "en")], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language.identify(docs).collect()] == ["und"] * 3
    same = language.identify(docs, {"b": b"words", "a": b"words"})
    assert [r["lang_pred"] for r in same.where("doc_id = 1").collect()] == ["b"]  # the first of those that tie
    assert same.where("doc_id = 1").first()["rejected"]


def test_too_many_labels(spark):
    docs = spark.createDataFrame([(i, "words", str(i)) for i in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language.learn(docs, most_langs=5)


def test_a_language_of_long_texts_alone_is_learned(spark):
    """Long texts teach where there aren't enough others; they teach whole."""
    rows = [(i, "the cat and the dog went over there " * 30, "en") for i in range(20)] + [(100 + i, f"der Hund {i} und die Katze gingen dorthin " * 20 + "Ende", "de") for i in range(20)]
    docs = spark.createDataFrame([*rows, (500, "", "fr"), (501, None, "fr"), (None, "perro", "es")], "doc_id long, text string, lang string")
    found = language.learn(docs, texts=3, long=600)
    assert set(found) == {"en", "de", "fr"} and found["fr"] == b"" and found["de"].count(b"ende") == 3
    assert {r["lang_pred"] for r in language.identify(docs, found).where("doc_id between 100 and 119").collect()} == {"de"}
