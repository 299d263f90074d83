import hashlib

from pyspark.sql import functions as F

from cambium.llm import fingerprints


def edited(rows):
    """(doc_id, n_chars, digest of the edited text), by the order of doc_id."""
    key = lambda d: -(2**63) if d is None else d
    ids = sorted({key(d) for d, _ in rows})
    out = []
    for d, t in rows:
        t = t or ""
        after = ids[(ids.index(key(d)) + 1) % len(ids)]
        n = len(t) // 4
        text = t[: len(t) - n] + min(u or "" for e, u in rows if key(e) == after)[:n]
        out.append((d, len(t), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit(1), "range": F.lit("x"), "sketch": F.lit(2)})
    return fingerprints.fingerprints(frame).collect()


def test_edited_texts(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:3] for r in run(spark, rows)), key=str) == edited(rows)


def test_nulls_repeats_characters_beyond_bytes(spark):
    rows = [(3, "a b c"), (1, "x y z w q r s t"), (3, "a a"), (None, "né"), (9, None), (9, ""), (9, "😀😀😀😀é"), (2**62, "long " * 30_000), (-5, "中文字符 中文字符")]
    assert sorted((tuple(r)[:3] for r in run(spark, rows)), key=str) == edited(rows)


def test_single_row_and_empty_table(spark):
    rows = [(7, "one two three four")]
    assert [tuple(r)[:3] for r in run(spark, rows)] == edited(rows)
    assert run(spark, []) == []


def test_likeness(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = fingerprints.fingerprints(docs).join(docs, "doc_id").collect()
    by_text = {}
    for r in out:
        assert by_text.setdefault(r["text"], r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    large = [r for r in out if r["n_chars"] > 2000]
    assert sum(r["near_edited"] for r in large) / len(large) > 0.5 > 0.05 > sum(r["near_next"] for r in large) / len(large)


def shingles(text, k=5):
    """Shingles of k words; fewer words are one."""
    low = text.translate({c: c + 32 for c in range(65, 91)})
    for space in "\t\n\v\f\r":
        low = low.replace(space, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k, 0) + 1)} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_error_by_length_against_whole_sets(spark, sf):
    """near_edited is the likeness of the whole sets, for texts of any number of words."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10**9 + i, " ".join(f"w{i}x{j}" for j in range(n))) for i, n in enumerate(n for n in range(1, 31) for _ in range(3))]
    by_id = dict(docs)
    ids = sorted(by_id)
    assert len(ids) == len(docs)
    errors, near, short = {}, 0, 0
    for r in run(spark, docs):
        text, after = by_id[r["doc_id"]], by_id[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        n = len(text) // 4
        own, want = shingles(text), shingles(text[: len(text) - n] + after[:n])
        errors.setdefault(min(len(text.split()) // 10, 10), []).append(abs(r["near_edited"] - alike(own, want)))
        assert len(r["fingerprint"]) == 16 * len(own)
        other = shingles(after)
        assert abs(r["near_next"] - alike(own, other)) < 1e-12
        for name, x in (("contained_edited", want), ("contained_next", other)):
            assert r[name] is None if not own else abs(r[name] - len(own & x) / len(own)) < 1e-12
        if 10 <= len(text.split()) < 30 and alike(own, want) >= 0.3:
            short, near = short + 1, near + (r["near_edited"] >= 0.3)
    assert {1, 2} <= set(errors) and max(max(e) for e in errors.values()) < 1e-12 and near == short > 0


def test_sketch_is_the_hashes_under_the_bound(spark):
    """Of every shingle's hash, one by one, those under the bound; none stands in where none is."""
    texts = [" ".join(f"w{i * 7 + j}" for j in range(i % 40)) for i in range(120)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", fingerprints.sketch(F.col("t"), share=8).alias("s")).collect()
    every = sorted({w for t in texts for w in t.split()})
    of_word = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    sets = [(i, [of_word[w] for w in s]) for i, t in enumerate(texts) for s in shingles(t)]
    hashed = spark.createDataFrame(sets, "i long, h array<long>").select("i", F.when(F.size("h") < 5, F.xxhash64("h")).otherwise(F.xxhash64(*[F.get("h", j) for j in range(5)])).alias("x")).collect()
    want = {i: [] for i in range(len(texts))}
    for i, x in hashed:
        if x < -(2**63) + 2**61:
            want[i].append(x)
    assert {i: s for i, s in rows} == {i: sorted(x) for i, x in want.items()} and any(not s for _, s in rows) and any(s for _, s in rows)


def test_whole_sketches_merge(spark):
    row = spark.createDataFrame([("a b c d e f", "e f g h i j k"), ("one two", "")], "a string, b string").select(F.explode(F.array(*[fingerprints.sketch(F.col(x), share=1) for x in "ab"])).alias("s"))
    parts, made = [set(r["s"]) for r in row.collect()], row.agg(fingerprints.merged(F.col("s")).alias("m")).first()["m"]
    assert made == sorted(set().union(*parts)) and len(made) == 2 + 3 + 1


def test_sketch_estimates_and_merges(spark):
    words = [f"w{i}" for i in range(8000)]
    frame = spark.createDataFrame([(" ".join(words), " ".join(words[:4000]), " ".join(words[3996:]))], "a string, b string, c string").select(*[fingerprints.sketch(F.col(x)).alias(x) for x in "abc"])
    row = frame.select(fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.containment(F.col("b"), F.col("a")), fingerprints.containment(F.col("a"), F.col("b"))).first()
    assert abs(row[0] - 0.5) < 0.05 and row[1] == 1 and abs(row[2] - 0.5) < 0.05
    whole = frame.select("a").first()["a"]
    parts = frame.select(F.explode(F.array("b", "c")).alias("s")).agg(fingerprints.merged(F.col("s")).alias("m")).first()["m"]
    assert parts == whole and all(h < -(2**63) + 2**61 for h in whole)


def test_native_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plan = fingerprints.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
