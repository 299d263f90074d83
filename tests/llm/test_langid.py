import random

from pyspark.sql import functions as F

from cambium.llm import langid

WORDS = {"aa": ["thora", "wend", "ishel", "morning", "sheath", "weather"], "bb": ["però", "andiamo", "quella", "notte", "ancora", "sempre"], "cc": ["schnell", "über", "gehen", "straße", "immer", "wieder"]}


def corpus(spark, n=60):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 80))), lang) for i in range(n) for lang in WORDS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    out = langid.classify(docs.where(held), langid.learn(docs.where(~held)), ["doc_id", "lang"])
    right, n, gone = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*"), F.count_if("rejected")).first()
    assert right >= 0.99 * n and gone <= 0.01 * n


def test_edges(spark):
    docs = corpus(spark)
    own = langid.learn(docs.unionByName(spark.createDataFrame([(1, None, "dd"), (2, "123", "ee"), (3, "word", None)], docs.schema)))
    assert set(own) == set(WORDS)
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "über straße immer wieder gehen"), (None, "andiamo sempre ancora notte"), (6, "weather morning " * 40_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("zz"))
    got = {r["doc_id"]: r for r in langid.classify(frame, own, ["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, None, 6)] == ["und", "und", "und", "cc", "bb", "aa"]
    assert all(got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3)) and not got[4]["rejected"] and all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_learned_and_empty_table(spark):
    docs = corpus(spark, 1)
    assert langid.learn(docs.limit(0)) == {}
    assert {r["lang_pred"] for r in langid.classify(docs, {}, ["doc_id"]).collect()} == {"und"}
    assert langid.classify(docs.limit(0), {}, ["doc_id"]).count() == 0


def test_equal_dictionaries_are_rejected(spark):
    same = langid.letters("one two three four") * 5
    row = langid.classify(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), {"a": same, "b": same}, ["doc_id"]).first()
    assert row["rejected"] and row["lang_pred"] == "a" and row["score"] == 0.5


def test_query_against_plain_compression(spark, sf):
    """Every whole text with every dictionary, one by one; the dictionaries come from the rows that aren't held out."""
    import zlib

    import zstandard

    from cambium.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in rows}
    own = langid.learn(docs.where(~F.col("doc_id").isin([d for d, h in held.items() if h])))
    profile, ties = langid.Profile(), 0
    for r in langid_query(spark, sf, queries):
        text = rows[r["doc_id"]]["text"]
        assert r["held_out"] == held[r["doc_id"]]
        raw = langid.letters(text or "")
        if not any(c.isalpha() for c in (text or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        blocks = [raw[i : i + profile.block] for i in range(0, len(raw), profile.block)]

        def sizes(level, times, of):
            out = {}
            for lang in of:
                compress = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(own[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress
                out[lang] = sum(len(compress(b * times)) for b in blocks)
            return out

        by_lang = sizes(profile.level, 1, own)
        least = [lang for lang, n in by_lang.items() if n == min(by_lang.values())]
        if len(least) > 1:
            ties += 1
            by_lang = sizes(profile.finer, profile.times, least)
        first, second = sorted(by_lang.values())[:2]
        assert by_lang[r["lang_pred"]] == first and r["margin"] == (second - first) / second and r["rejected"] == (r["margin"] < profile.narrow)
        assert r["score"] == 0.5 if first == second else r["score"] > 0.5
    assert ties < 0.05 * len(rows)


def langid_query(spark, sf, queries):
    return queries.op2(spark, sf).collect()


def test_null_id_is_not_held_out_and_clashes_are_refused(spark, tmp_path):
    import pytest

    from cambium.llm import queries

    rows = [(None, "ein wort und noch eines", "de"), (1, "one word and one other", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["held_out"] for r in queries.op2(spark, str(tmp_path)).collect()}
    assert got[None] is False and got[1] in (True, False)
    with pytest.raises(ValueError, match="rename score"):
        langid.classify(spark.createDataFrame(rows, "score long, text string, lang string"), {}, ["score"])
    with pytest.raises(ValueError, match="languages"):
        langid.learn(corpus(spark), langid.Profile(languages=2))


def test_sample_is_bounded(spark):
    docs = spark.range(5000).select(F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.lit("aa").alias("lang"))
    own = langid.learn(docs, langid.Profile(texts=10))
    assert len(own["aa"].split(b"  ")) <= 10
