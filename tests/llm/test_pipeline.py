import hashlib

import corpus_pipeline
from cambium.llm import bpe, decontaminate, langid, pii
from cambium.llm.queries import TOKENIZERS, pii_key
from tests.llm.test_minhash import brute


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "pii_pseudonyms", "bpe_tokens"]
    rows = [tuple(r) for r in docs.collect()]
    own = langid.Classifier(langid.learn(docs), langid.Profile())
    told = [(r, own.best(r[1])) for r in rows]
    rows = [r for r, (lang, _, margin) in told if lang != "und" and margin >= langid.Profile().narrow]
    firsts = {d for d, _, _, kept in brute([(r[0], r[1]) for r in rows], 5) if kept}
    rows = [r for r in rows if r[0] in firsts]
    bench = decontaminate.Benchmark([tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()], decontaminate.Tiling())
    import pyarrow as pa

    rows = [r for r, found in zip(rows, bench.judge(pa.array([r[1] for r in rows])), strict=True) if not any(c[0] >= 0.5 for c in found)]
    frame = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in pii.pseudonymize(frame, pii_key(spark), ["doc_id"]).collect()}
    with open(f"{TOKENIZERS}/byte_bpe_50k.json", "rb") as f:
        encoder = bpe.Transducer(f.read())
    want = {}
    for d, t in texts.items():
        ids = [i for run, _ in encoder.encode(t) for i in run]
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), ids)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and len(got) < 200


def test_repeated_ids_with_maps(spark, sf):
    rows = [(1, "one two three four five six", {"b": 1}), (1, "one two three four five six", {"a": 2}), (2, "other words", None), (2, "other words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    got = {r["doc_id"]: r["m"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert got == {1: {"a": 2}, 2: None}


def test_columns_nulls_repeats_and_clashes(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected string, kept int, coverage int, item_id int, _row int"
    clean = [(i, f"Then the weather of morning {'and the other ' * i}was in it", "en", "s", 9, 1.0, "r", 1, 2, 3, 4) for i in range(1, 9)]
    rows = [*clean, clean[0], (None, "The and for with that was in", None, None, None, None, None, None, None, None, None), (50, None, "en", "s", 0, 0.0, "", 0, 0, 0, 0), (51, "", "en", "s", 0, 0.0, "", 0, 0, 0, 0), (52, "mail u@x.org to the one and other there", None, "s", 1, 0.0, "", 0, 0, 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert 50 not in kept and 51 not in kept and "u@x.org" not in kept[52]["text"] and kept[52]["lang"] == "en" and kept[52]["n_chars"] == len(kept[52]["text"]) and None in kept
    assert len(docs.collect()) == len(kept)
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
