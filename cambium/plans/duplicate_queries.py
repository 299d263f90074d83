"""De-duplication over documents: a document is a sample, its source a dataset, its text the image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.functions import scalars as S
from cambium.operators import audits as A
from cambium.operators import duplicates as D
from cambium.operators import reports as R
from cambium.operators.graph import components
from cambium.plans.common import Catalog, table
from cambium.scratch import written

catalog = Catalog()
SHA = "sha256(coalesce(text, ''))"
FIRST = f"row_number() OVER (PARTITION BY {SHA} ORDER BY doc_id)"


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = hashed(spark, sf_dir)
    return docs.join(docs.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")), "sha")


@catalog.add(f"SELECT {SHA} AS sha, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hashed(spark, sf_dir).groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count_distinct("source").alias("sources"))
    return own.where("copies > 1")


@catalog.add(f"""
WITH t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY {SHA} ORDER BY source, doc_id) AS place, count(*) OVER (PARTITION BY {SHA}) AS copies FROM documents)
SELECT doc_id, source, CASE WHEN copies = 1 THEN 'unique' WHEN place = 1 THEN 'canonical' ELSE 'redundant_exact' END AS status FROM t""")
def exact_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = hashed(spark, sf_dir).groupBy("sha").agg(F.min(F.struct("source", "doc_id")).alias("best"), F.count("*").alias("copies"))
    own = hashed(spark, sf_dir).join(best, "sha")
    return own.select("doc_id", "source", S.choice([("unique", F.col("copies") == 1), ("canonical", F.col("best.doc_id") == F.col("doc_id"))], "redundant_exact").alias("status"))


@catalog.add(f"""
WITH t AS (SELECT doc_id, source, lang, {SHA} AS sha FROM documents)
SELECT a.doc_id AS sample_id_a, b.doc_id AS sample_id_b, a.source AS dataset_id_a, b.source AS dataset_id_b, a.source <> b.source AS cross_dataset, a.lang = b.lang AS label_agreement
FROM t a JOIN t b ON a.sha = b.sha AND a.doc_id < b.doc_id""")
def exact_pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = hashed(spark, sf_dir)
    pairs = D.all_pairs(docs.withColumnRenamed("doc_id", "sample_id"), F.col("sha"), "exact")
    side = lambda x: docs.select(*[F.col(c).alias(f"{n}_{x}") for c, n in (("doc_id", "sample_id"), ("source", "dataset_id"), ("lang", "lang"))])
    own = pairs.join(side("a"), F.col("a") == F.col("sample_id_a")).join(side("b"), F.col("b") == F.col("sample_id_b"))
    return own.select("sample_id_a", "sample_id_b", "dataset_id_a", "dataset_id_b", (F.col("dataset_id_a") != F.col("dataset_id_b")).alias("cross_dataset"), (F.col("lang_a") == F.col("lang_b")).alias("label_agreement"))


@catalog.add(f"""
WITH t AS (SELECT {SHA} AS sha, d.doc_id, coalesce(CAST(quality AS VARCHAR), 'none') AS label FROM documents d LEFT JOIN labels USING (doc_id)
  UNION ALL SELECT * FROM (VALUES ('fixture_1', -1, '0'), ('fixture_1', -2, '1'), ('fixture_2', -3, '1'), ('fixture_2', -4, '1')))
SELECT sha, count(*) AS copies, count(DISTINCT label) AS labels, CASE WHEN count(DISTINCT label) > 1 THEN 'exact_label_conflict' ELSE 'agreement' END AS verdict FROM t WHERE label <> 'none' GROUP BY sha HAVING count(*) > 1""")
def exact_label_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hashed(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("sha", "doc_id", F.col("quality").cast("string").alias("label"))
    planted = spark.createDataFrame([("fixture_1", -1, "0"), ("fixture_1", -2, "1"), ("fixture_2", -3, "1"), ("fixture_2", -4, "1")], "sha string, doc_id long, label string")
    own = own.where("label is not null").unionByName(planted).groupBy("sha").agg(F.count("*").alias("copies"), F.count_distinct("label").alias("labels")).where("copies > 1")
    return own.withColumn("verdict", F.when(F.col("labels") > 1, "exact_label_conflict").otherwise("agreement"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, code): the signs of an embedding's 64 numbers."""
    bits = F.aggregate("embedding", F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR((x > 0).cast("long")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("code"))


SIGNS = "codes AS (SELECT vec_id AS id, CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS BIT) AS code FROM embeddings)"


@catalog.add(f"WITH {SIGNS} SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.code, b.code)) AS INT) AS distance FROM codes a JOIN codes b ON a.id < b.id WHERE bit_count(xor(a.code, b.code)) <= 15")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.near_pairs(codes(spark, sf_dir), 15)


@catalog.add(f"""
WITH RECURSIVE {SIGNS},
e AS (SELECT a.id AS x, b.id AS y FROM codes a JOIN codes b ON a.id <> b.id AND bit_count(xor(a.code, b.code)) <= 15),
r AS (SELECT id, id AS m FROM codes UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.id WHERE r.m < e.y)
SELECT id AS node, min(m) AS label, count(*) OVER (PARTITION BY min(m)) AS members FROM r GROUP BY id""")
def near_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near ones among one id of each code; the others of a code are tied to it by a star, not by all its pairs."""
    own = written(codes(spark, sf_dir), "codes")
    near = D.near_pairs(own.where("code is not null").groupBy("code").agg(F.min("id").alias("id")), 15).select("a", "b")
    equal = D.star(own.withColumnRenamed("id", "sample_id"), F.col("code"), "equal").select("a", "b")
    label = components(near.unionByName(equal))
    out = own.select(F.col("id").alias("node")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return out.join(out.groupBy("label").agg(F.count("*").alias("members")), "label").select("node", "label", "members")


@catalog.add(f"""
WITH t AS (SELECT doc_id, {SHA} AS sha FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY sha) AS component, count(*) OVER (PARTITION BY sha) AS members FROM t""")
def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = hashed(spark, sf_dir)
    label = components(D.star(docs.withColumnRenamed("doc_id", "sample_id"), F.col("sha"), "exact"))
    out = docs.select("doc_id").join(label, docs["doc_id"] == label["node"], "left").select("doc_id", F.coalesce("label", "doc_id").alias("component"))
    return out.join(out.groupBy("component").agg(F.count("*").alias("members")), "component").select("doc_id", "component", "members")


@catalog.add(f"""
WITH RECURSIVE t AS (SELECT doc_id, {SHA} AS sha, n_chars FROM documents),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON (a.sha = b.sha OR a.n_chars = b.n_chars) AND a.doc_id <> b.doc_id),
r AS (SELECT doc_id, doc_id AS m FROM t UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id WHERE r.m < e.y)
SELECT doc_id, min(m) AS leakage_root FROM r GROUP BY doc_id""")
def leakage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a text or, standing for a source group, a length."""
    docs = hashed(spark, sf_dir).withColumnRenamed("doc_id", "sample_id")
    label = components(D.star(docs, F.col("sha"), "exact").unionByName(D.star(docs, F.col("n_chars"), "group")))
    return docs.join(label, docs["sample_id"] == label["node"], "left").select(F.col("sample_id").alias("doc_id"), F.coalesce("label", "sample_id").alias("leakage_root"))


@catalog.add(f"""
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, {SHA} AS sha FROM documents)
SELECT sha, 'DUPLICATE_' || substr(sha256(string_agg(id, chr(10) ORDER BY id)), 1, 20) AS group_id, count(*) AS members FROM t GROUP BY sha HAVING count(*) > 1""")
def stable_group_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hashed(spark, sf_dir)
    many = own.groupBy("sha").count().where("count > 1").select("sha")
    return own.join(many, "sha").groupBy("sha").agg(S.members_id("DUPLICATE", F.collect_list(F.col("doc_id").cast("string"))).alias("group_id"), F.count("*").alias("members"))


@catalog.add(f"""
WITH t AS (SELECT source, {SHA} AS sha, {FIRST} AS place, count(*) OVER (PARTITION BY {SHA}) AS copies FROM documents),
x AS (SELECT sha, count(DISTINCT source) > 1 AS across FROM documents, LATERAL (SELECT {SHA} AS sha) GROUP BY sha)
SELECT CASE WHEN grouping(source) = 1 THEN 'all_datasets' ELSE source END AS dataset_id, count(*) AS sample_count, count(DISTINCT sha) AS image_count,
  count(*) FILTER (copies > 1) AS duplicate_sample_count, count(*) FILTER (copies > 1 AND place = 1) AS exact_canonical_count, count(*) FILTER (place > 1) AS exact_redundant_count,
  count(DISTINCT CASE WHEN copies > 1 THEN sha END) AS duplicate_group_count, count(*) FILTER (across) AS cross_dataset_duplicate_sample_count
FROM t JOIN x USING (sha) GROUP BY ROLLUP (source)""")
def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = hashed(spark, sf_dir)
    groups = docs.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), (F.min("source") != F.max("source")).alias("across"))
    own = docs.join(groups, "sha")
    many, first = F.col("copies") > 1, F.col("doc_id") == F.col("first_id")
    return R.with_total(
        own, "source", "all_datasets", F.count("*").alias("sample_count"), F.count_distinct("sha").alias("image_count"), F.count_if(many).alias("duplicate_sample_count"), F.count_if(many & first).alias("exact_canonical_count"),
        F.count_if(~first).alias("exact_redundant_count"), F.count_distinct(F.when(many, F.col("sha"))).alias("duplicate_group_count"), F.count_if("across").alias("cross_dataset_duplicate_sample_count"),
    ).withColumnRenamed("source", "dataset_id")


@catalog.add(f"""
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, source, lang, {SHA} AS sha FROM documents)
SELECT sha, count(*) AS sample_count, count(DISTINCT source) AS dataset_count, count(DISTINCT lang) AS label_count, count(DISTINCT source) > 1 AS cross_dataset,
  (SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT DISTINCT u.source AS s FROM t u WHERE u.sha = t.sha)) AS dataset_ids, string_agg(id, '|' ORDER BY id) AS sample_ids
FROM t GROUP BY sha HAVING count(*) > 1""")
def duplicate_group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hashed(spark, sf_dir).select(F.col("doc_id").cast("string").alias("sample_id"), F.col("source").alias("dataset_id"), F.col("lang").alias("disease_id"), F.lit(None).cast("string").alias("group_id"), "sha")
    many = own.groupBy("sha").count().where("count > 1").select("sha")
    return D.group_report(own.join(many, "sha"), "sha").select("sha", "sample_count", "dataset_count", F.col("label_count"), "cross_dataset", "dataset_ids", "sample_ids")


@catalog.add(f"""
WITH t AS (SELECT doc_id, source, lang, {SHA} AS sha FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.source AS sa, b.source AS sb, a.lang = b.lang AS agree FROM t a JOIN t b ON a.sha = b.sha AND a.doc_id < b.doc_id)
SELECT a AS sample_id_a, b AS sample_id_b, CASE WHEN NOT agree THEN 'mapped_label_conflict' WHEN sa <> sb AND (sa IN ('src0','src1') OR sb IN ('src0','src1')) AND (sa IN ('src2','src3') OR sb IN ('src2','src3')) THEN 'internal_external_overlap'
  WHEN sa <> sb THEN 'cross_dataset_overlap' ELSE 'perceptual_distance_0' END AS priority_reason,
  CASE WHEN NOT agree THEN 1 WHEN sa <> sb AND (sa IN ('src0','src1') OR sb IN ('src0','src1')) AND (sa IN ('src2','src3') OR sb IN ('src2','src3')) THEN 2 WHEN sa <> sb THEN 3 ELSE 4 END AS review_priority, 'pending' AS review_status
FROM p""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of equal texts, taken as near pairs of distance 0."""
    docs = hashed(spark, sf_dir).select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("dataset_id"), F.lit("").alias("group_id"), F.col("lang").alias("disease_id"), F.conv(F.substring("sha", 1, 16), 16, -10).cast("long").alias("perceptual_hash"), F.lit(True).alias("include"), "sha"
    )
    pairs = D.all_pairs(docs, F.col("sha"), "perceptual").select("a", "b", F.array("kind").alias("kinds"))
    queue = D.review_queue(D.pair_report(docs, pairs), D.Policy(contributors=("src0", "src1"), external=("src2", "src3")))
    return queue.select("sample_id_a", "sample_id_b", "priority_reason", "review_priority", "review_status")


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, code): for each of 64 bits what most of a document's word trigrams' hashes have there."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), words.alias("w"))
    grams = docs.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.slice("w", i + 1, 3)))).alias("h"))
    bits = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(1)) * 2 - 1) > 0 for j in range(64)]
    code = F.lit(0).cast("long")
    for j, b in enumerate(bits):
        code = code.bitwiseOR(F.shiftleft(b.cast("long"), j))
    return grams.groupBy("id").agg(code.alias("code"))


@catalog.add()
def simhash_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.near_pairs(simhash(spark, sf_dir), 4)


@catalog.add()
def duplicate_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis over documents: exact by text, near by simhash, lineage by source and length."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    frame = docs.join(labels, "doc_id", "left").join(simhash(spark, sf_dir).withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        F.format_string("SAMPLE_%010d", "doc_id").alias("sample_id"), F.col("source").alias("dataset_id"), F.concat_ws("_", "source", "n_chars").alias("group_id"), F.col("quality").cast("string").alias("disease_id"),
        F.lit("atlas_label").alias("diagnosis_basis"), F.col("quality").isNotNull().alias("include"), F.lit(None).cast("string").alias("exclusion_reason"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("image_sha256"),
        F.col("code").alias("perceptual_hash"), F.array().cast("array<string>").alias("lineage"),
    )
    out = D.analyze(frame, D.Policy(contributors=("src0", "src1", "src2")))
    return out.select("sample_id", "dataset_id", "duplicate_group_id", "duplicate_match_type", "deduplication_status", "leakage_group_id", "include", "exclusion_reason")


@catalog.add("""
SELECT d.doc_id, count(*) AS items, min(item_id) AS first_item, array_to_string(list_sort(list(CAST(item_id AS VARCHAR))), ',') AS reasons
FROM documents d JOIN benchmark b ON contains(d.text, substr(b.text, 1, 60)) GROUP BY d.doc_id""")
def contamination_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the first 60 characters of a benchmark passage. Both sides meet on a hash of 60 characters, found in a document at its passages' first words, so documents aren't compared with every passage."""
    heads = table(spark, sf_dir, "benchmark").where(F.length("text") > 0).select("item_id", F.substring("text", 1, 60).alias("head"))
    heads = heads.withColumn("word", F.regexp_extract("head", r"^\s*(\S+)", 1))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a head's first word can begin inside a document's word, so only what follows its first space is a whole word there
    keyed = heads.withColumn("second", F.regexp_extract("head", r"^\s*\S+\s+(\S+)\s", 1))
    few = keyed.where("second = ''").select("item_id", "head")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("second"))
    named = words.join(F.broadcast(keyed.where("second <> ''").select("second", "item_id", "head")), "second").select("doc_id", "item_id", "head")
    hit = docs.join(named, "doc_id").where(F.contains("text", "head")).select("doc_id", "item_id")
    if few.take(1):
        hit = hit.unionByName(docs.join(F.broadcast(few), F.contains(docs["text"], few["head"])).select("doc_id", "item_id"))
    return hit.distinct().groupBy("doc_id").agg(F.count("*").alias("items"), F.min("item_id").alias("first_item"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("reasons"))



WORDS = r"' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' '"


@catalog.add(f"""
WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents), b AS (SELECT item_id, {WORDS} AS words FROM benchmark)
SELECT doc_id, count(DISTINCT item_id) AS items, min(item_id) AS first_item, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS reasons
FROM d JOIN b ON contains(d.words, b.words) WHERE trim(b.words) <> '' GROUP BY doc_id""")
def contamination_audit_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all words of a benchmark passage in a row, whatever case, spacing and punctuation."""
    return whole_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def whole_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, items, first_item, reasons of documents that hold whole passages. Both meet on a hash of a passage's first five words, or all of fewer; then the whole passage is sought."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    items = benchmark.select("item_id", words.alias("w")).where(F.size("w") > 0)
    items = items.select("item_id", padded.alias("passage"), F.least(F.size("w"), F.lit(5)).alias("k"), F.xxhash64(F.slice("w", 1, 5)).alias("h"))
    own = docs.select("doc_id", words.alias("w"))
    hits = None
    for k in [r["k"] for r in items.select("k").distinct().collect()]:
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.slice("w", i, k))))  # noqa: B023
        named = own.where(F.size("w") >= k).select("doc_id", F.explode(grams).alias("h")).join(items.where(F.col("k") == k).select("item_id", "passage", "h"), "h")
        hits = named.drop("h") if hits is None else hits.unionByName(named.drop("h"))
    if hits is None:
        hits = own.select("doc_id").join(items.select("item_id", "passage")).limit(0)
    hits, text = hits.distinct().alias("x"), own.select("doc_id", padded.alias("own")).alias("y")
    found = hits.join(text, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & F.contains(F.col("own"), F.col("passage"))).select("x.doc_id", "item_id").distinct()
    return found.groupBy("doc_id").agg(F.count("*").alias("items"), F.min("item_id").alias("first_item"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("reasons"))

@catalog.add(f"""
WITH d AS (SELECT *, {SHA} AS sha, CASE doc_id % 5 WHEN 0 THEN 'f17k/' || doc_id || '.JPG' WHEN 1 THEN 'scin/' || doc_id || '.png' WHEN 2 THEN 'pad/PAT_' || n_chars || '_' || doc_id || '.png' WHEN 3 THEN 'isic/' || doc_id || '.jpg' ELSE 'other/' || doc_id END AS image FROM documents),
t AS (SELECT sha, source, CASE source WHEN 'src1' THEN CAST(doc_id + 10 AS VARCHAR) WHEN 'src2' THEN 'pat_' || n_chars || '_' || (doc_id + 1) || '.png' ELSE '' END AS id,
  CASE WHEN source = 'src3' THEN 'CASE_' || (doc_id // 10) WHEN source = 'src2' THEN 'PAD_UFES_20_PATIENT_PAT_' || n_chars ELSE 'PATIENT_' || (doc_id // 7) END AS grp FROM d WHERE source IN ('src1', 'src2', 'src3')),
e AS (SELECT * FROM d WHERE source NOT IN ('src1', 'src2', 'src3')),
r AS (SELECT image, 'exact_image_sha256' AS reason FROM e WHERE sha IN (SELECT sha FROM t)
  UNION ALL SELECT image, 'fitzpatrick17k_c_source_image_id' FROM e WHERE doc_id % 5 = 0 AND CAST(doc_id AS VARCHAR) IN (SELECT id FROM t WHERE source = 'src1')
  UNION ALL SELECT image, 'scin_case_group' FROM e WHERE doc_id % 5 = 1 AND 'CASE_' || (doc_id // 10) IN (SELECT grp FROM t)
  UNION ALL SELECT image, 'pad_ufes_20_source_image_id' FROM e WHERE doc_id % 5 = 2 AND lower('PAT_' || n_chars || '_' || doc_id || '.png') IN (SELECT id FROM t WHERE source = 'src2')
  UNION ALL SELECT image, 'pad_ufes_20_patient_group' FROM e WHERE doc_id % 5 = 2 AND 'PAD_UFES_20_PATIENT_PAT_' || n_chars IN (SELECT grp FROM t)
  UNION ALL SELECT image, 'hiba_patient_group' FROM e WHERE doc_id % 5 = 3 AND 'PATIENT_' || (doc_id // 7) IN (SELECT grp FROM t))
SELECT e.image, e.sha AS image_sha256, coalesce(string_agg(reason, ',' ORDER BY reason), '') AS reasons FROM e LEFT JOIN r USING (image) GROUP BY ALL""")
def image_contamination_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images in five folders, held against those of three sources as training data by digest, source id, case and patient."""
    k = F.col("doc_id")
    paths = {0: F.concat(F.lit("f17k/"), k, F.lit(".JPG")), 1: F.concat(F.lit("scin/"), k, F.lit(".png")), 2: F.concat(F.lit("pad/PAT_"), "n_chars", F.lit("_"), k, F.lit(".png")), 3: F.concat(F.lit("isic/"), k, F.lit(".jpg"))}
    image = F.concat(F.lit("other/"), k)
    for i, path in paths.items():
        image = F.when(k % 5 == i, path).otherwise(image)
    docs = hashed(spark, sf_dir).withColumn("image", image).withColumnRenamed("sha", "image_sha256")
    names = ("src1", "src2", "src3")
    source = F.col("source")
    ids = F.when(source == "src1", (k + 10).cast("string")).when(source == "src2", F.concat(F.lit("PAT_"), "n_chars", F.lit("_"), k + 1, F.lit(".png"))).otherwise("")
    patient = F.concat(F.lit("PATIENT_"), F.floor(k / 7))
    case = F.concat(F.lit("CASE_"), F.floor(k / 10))
    groups = F.when(source == "src3", case).when(source == "src2", F.concat(F.lit("PAD_UFES_20_PATIENT_PAT_"), "n_chars")).otherwise(patient)
    called = F.when(source == "src1", "fitzpatrick17k_c").when(source == "src2", "pad_ufes_20").otherwise(source)
    train = docs.where(source.isin(*names)).select("image_sha256", called.alias("source"), ids.alias("source_image_id"), groups.alias("leakage_group_id"))
    out = A.image_audit(docs.where(~source.isin(*names)), train, A.skin_rules(F.col("image"), case, patient))
    return out.select("image", "image_sha256", F.array_join("reasons", ",").alias("reasons"))


@catalog.add(f"""
WITH t AS (SELECT doc_id, source, {SHA} AS sha, {FIRST} AS place FROM documents), p AS (SELECT DISTINCT sha FROM t WHERE source = 'src0'), b AS (SELECT DISTINCT sha FROM t WHERE source = 'src1')
SELECT doc_id, CASE WHEN sha IN (SELECT sha FROM p) THEN 'protected_exact' WHEN sha IN (SELECT sha FROM b) OR n > 1 THEN 'train_exact' ELSE 'kept' END AS screen
FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY doc_id) AS n FROM t WHERE source NOT IN ('src0', 'src1'))""")
def training_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against src0 as protected and src1 as base training data, exact rules only: codes are left null."""
    docs = hashed(spark, sf_dir)
    code = F.lit(None).cast("long").alias("code")
    part = lambda s: docs.where(F.col("source") == s).select("sha", code)
    rows = docs.where(~F.col("source").isin("src0", "src1")).select(F.col("doc_id").alias("sample_id"), F.col("doc_id").alias("ord"), "sha", code)
    return D.screened(rows, part("src0"), part("src1")).select(F.col("sample_id").alias("doc_id"), "screen")


@catalog.add()
def training_screen_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """training_screen with all its rules: codes are the documents' simhashes."""
    docs = written(hashed(spark, sf_dir).select("doc_id", "source", "sha").join(simhash(spark, sf_dir).withColumnRenamed("id", "doc_id"), "doc_id", "left"), "coded")
    part = lambda s: docs.where(F.col("source") == s).select("sha", "code")
    rows = docs.where(~F.col("source").isin("src0", "src1")).select(F.col("doc_id").alias("sample_id"), F.col("doc_id").alias("ord"), "sha", "code")
    return D.screened(rows, part("src0"), part("src1")).select(F.col("sample_id").alias("doc_id"), "screen")


@catalog.add("""
SELECT p.c_custkey, p.c_mktsegment FROM customer p WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = p.c_custkey AND o.o_orderpriority = '1-URGENT')
AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = p.c_custkey AND o.o_orderstatus = 'P')""")
def promotion_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible groups that are in neither of two other sets."""
    orders = table(spark, sf_dir, "orders")
    own = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    for taken in (orders.where("o_orderpriority = '1-URGENT'"), orders.where("o_orderstatus = 'P'")):
        own = own.join(taken.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return own


@catalog.add("""
SELECT page_id, regexp_replace(url, '#.*$', '') AS lineage_url, CASE WHEN contains(url, '/en/') THEN 'EN_' || regexp_extract(url, '/en/([0-9]+)', 1)
  WHEN contains(url, '?') THEN 'Q_' || regexp_extract(url, '^([^?]*)', 1) ELSE 'PAGE_' || substr(sha256(regexp_replace(url, '#.*$', '')), 1, 24) END AS lineage_group FROM pages""")
def lineage_group_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lineage key by a source's own rule, else by a hash of the address without its fragment."""
    url = F.col("url")
    key = F.when(url.contains("/en/"), F.concat(F.lit("EN_"), F.regexp_extract(url, "/en/([0-9]+)", 1))).when(url.contains("?"), F.concat(F.lit("Q_"), F.regexp_extract(url, "^([^?]*)", 1))).otherwise(S.stable_id("PAGE", S.without_fragment(url)))
    return table(spark, sf_dir, "pages").select("page_id", S.without_fragment(url).alias("lineage_url"), key.alias("lineage_group"))


