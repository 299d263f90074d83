"""What is broadcast while it is small has another way beyond; the results are the same."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cambium.llm import langid, minhash, suffixes
from tests.llm.test_langid import corpus
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_minhash import family
from tests.llm.test_suffixes import brute as repeats_brute
from tests.llm.test_suffixes import texts


@pytest.fixture(autouse=True)
def small(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(suffixes, "BROADCAST_TEXTS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_near_duplicates(spark):
    rows = list(enumerate(family(4, 150, 50, 14), 1))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Near(k=4)).collect()
    assert sorted(map(tuple, got)) == near_brute(rows, 4)


def test_repeats(spark):
    own = texts(7, 40)
    rows = list(enumerate([*own, own[3], own[3]]))
    got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == repeats_brute(rows, 200)


def test_repeats_with_frequent_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BROADCAST_TEXTS", 10**6)
    monkeypatch.setattr(suffixes, "FREQUENT", 2)
    own = texts(7, 40)
    rows = list(enumerate([*own, *(f"{i} {own[3]}" for i in range(9)), own[3]]))
    got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == repeats_brute(rows, 200)


def test_languages(spark):
    docs = corpus(spark)
    with_broadcast = langid.Profile()
    assert set(langid.learn(docs, with_broadcast)) == {"aa", "bb", "cc"}


def test_pipeline_stage(spark, sf):
    docs = spark.createDataFrame([(i, "the same seven words in every one", "en", "s", 1) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()] == [0] and docs.select(F.count("*")).first()[0] == 5
