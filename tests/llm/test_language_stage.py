"""What the language stage of the pipeline rejects."""

import pytest

from wickwork.llm import langid


@pytest.mark.parametrize("langs", [(None, None), ("en", "fr")])
def test_letters_stay(spark, langs):
    rows = [(i, t, langs[i % 2]) for i, t in enumerate(["the cat sat", "le chat", "12 34 !", "", None, "\u0436", "7 a"] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = langid.accepted(docs)
    assert got.dtypes == docs.dtypes
    assert {r["doc_id"] for r in got.collect()} == {i for i, t, _ in rows if any(c.isalpha() for c in t or "")}


def voices(n, words):
    return " ".join(words[(7 * i + i * i) % len(words)] for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    said = {"ee": ["pepper", "seven", "elefen", "tree", "between", "keeper"], "aa": ["banana", "papaya", "salsa", "canasta", "patata", "ananas"], "oo": ["solo", "cocoon", "monsoon", "gogo", "bongo", "rodo"]}
    one = said["aa"]
    rows = [(i, voices(5 + i % 60, list(said.values())[i % 3]), list(said)[i % 3]) for i in range(300)]
    rows += [(900, "\u0436\u0443\u043a " * 200, None), (901, "\u0436\u0443\u043a", None), (902, "123 " * 500, None), (903, voices(400, one), None)]
    return spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, lang string, score int, w_letters string").repartition(3)


def test_a_long_text_that_no_classifier_claims_goes(spark, docs):
    got = {r["doc_id"] for r in langid.accepted(docs).collect()}
    assert got == {*range(300), 901, 903}


def test_unwanted_languages_go(spark, docs):
    got = {r["doc_id"] for r in langid.accepted(docs, wanted=("aa",)).collect()}
    assert {i for i in range(300) if i % 3 == 1} <= got and not got & {i for i in range(300) if i % 3 != 1} and 903 in got
    unlearned = docs.withColumn("lang", docs["lang"].substr(100, 1)).where("lang is null")
    assert langid.accepted(unlearned, wanted=("aa",)).count() == 0
