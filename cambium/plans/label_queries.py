"""Normalisation over the star schema, events and pages: labels, ages, inclusion, unpivoting, metadata, rule cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.functions import scalars as S
from cambium.operators import reports as R
from cambium.plans.common import Catalog, table

catalog = Catalog()
PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), '&', ' and '), '[_/\\\\-]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@catalog.add(f"SELECT p_partkey, {PLAIN.format('p_name')} AS name, {PLAIN.format('p_type')} AS type FROM part")
def normalize_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.plain_label("p_name").alias("name"), S.plain_label("p_type").alias("type"))


@catalog.add()
def normalize_label_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels beyond ASCII: the first line of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", S.label(F.regexp_extract("text", r"^([^\n]*)", 1)).alias("name"))


MAPPINGS = [("click", None, "engagement"), ("view", None, "impression"), ("click", "1", "engagement_special"), ("purchase", None, "revenue")]


@catalog.add("""
WITH m(raw, dataset, target) AS (VALUES ('click', NULL, 'engagement'), ('view', NULL, 'impression'), ('click', '1', 'engagement_special'), ('purchase', NULL, 'revenue')),
e AS (SELECT event_id, event_type, CAST(user_id % 7 AS VARCHAR) AS dataset FROM events)
SELECT event_id, coalesce(d.target, g.target, e.event_type) AS label, CASE WHEN d.target IS NOT NULL THEN 'dataset' WHEN g.target IS NOT NULL THEN 'global' ELSE 'base' END AS mapping_source
FROM e LEFT JOIN m d ON d.raw = e.event_type AND d.dataset = e.dataset LEFT JOIN m g ON g.raw = e.event_type AND g.dataset IS NULL""")
def label_mapping_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset's own mapping before the global one, before the label itself."""
    m = spark.createDataFrame(MAPPINGS, "raw string, dataset string, target string")
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("raw"), (F.col("user_id") % 7).cast("string").alias("dataset"))
    own = m.where("dataset is not null").withColumnRenamed("target", "by_dataset")
    every = m.where("dataset is null").select("raw", F.col("target").alias("by_all"))
    e = e.join(F.broadcast(own), ["raw", "dataset"], "left").join(F.broadcast(every), "raw", "left")
    return e.select("event_id", F.coalesce("by_dataset", "by_all", "raw").alias("label"), S.choice([("dataset", F.col("by_dataset").isNotNull()), ("global", F.col("by_all").isNotNull())], "base").alias("mapping_source"))


@catalog.add("""
SELECT p_partkey, CASE WHEN p_size * 2 - 4 < 0 THEN NULL WHEN p_size * 2 - 4 < 18 THEN 'under_18' WHEN p_size * 2 - 4 < 30 THEN '18_to_29' WHEN p_size * 2 - 4 < 40 THEN '30_to_39' WHEN p_size * 2 - 4 < 50 THEN '40_to_49'
  WHEN p_size * 2 - 4 < 60 THEN '50_to_59' WHEN p_size * 2 - 4 < 70 THEN '60_to_69' ELSE '70_and_over' END AS age_group FROM part""")
def age_band_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.age_group(F.col("p_size") * 2 - 4).alias("age_group"))


@catalog.add("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'fitzpatrick:FST_' || CASE WHEN p_size % 6 < 2 THEN '1-2' WHEN p_size % 6 < 4 THEN '3-4' ELSE '5-6' END
  WHEN 2 THEN 'monk:MST_' || CASE WHEN p_size % 10 < 3 THEN '1-3' WHEN p_size % 10 < 6 THEN '4-6' ELSE '7-10' END ELSE 'unspecified:' || p_size END AS band FROM part""")
def tone_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    tone = F.when(n % 4 == 0, " nan ").when(n % 4 == 1, F.concat(F.lit("fst_"), n % 6 + 1)).when(n % 4 == 2, F.concat(F.lit("MST_"), n % 10 + 1)).otherwise(n.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", S.tone_band(S.tone_group(tone, F.lit(None).cast("string"))).alias("band"))


CASCADE = "CASE WHEN d.text IS NULL OR trim(d.text) = '' THEN 'empty' WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'low_quality' WHEN d.n_chars < 200 THEN 'short' END"


@catalog.add(f"SELECT d.doc_id, {CASCADE} IS NULL AS include, {CASCADE} AS exclusion_reason FROM documents d LEFT JOIN labels l USING (doc_id)")
def manifest_inclusion_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that excludes a sample."""
    own = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True)), "doc_id", "left")
    cases = [("empty", F.col("text").isNull() | (F.trim("text") == "")), ("unlabelled", F.col("labelled").isNull()), ("toxic", F.col("toxic") == 1), ("low_quality", F.col("quality") == 0), ("short", F.col("n_chars") < 200)]
    reason = S.choice(cases, None)
    return own.select("doc_id", reason.isNull().alias("include"), reason.alias("exclusion_reason"))


@catalog.add("""
SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax FROM lineitem)
UNPIVOT (value FOR name IN (quantity, discount, tax))""")
def unpivot_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each column that is told."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return own.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "name", "value").where("value is not null")


@catalog.add("""
WITH r AS (SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS total FROM lineitem)
SELECT l_orderkey, rank, l_partkey, round(l_extendedprice / total, 6) AS weight FROM r""")
def ranked_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a list ranked by weight, nested and unnested again."""
    item = F.struct((-F.col("l_extendedprice")).alias("w"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"))
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("l_extendedprice").alias("total"))
    own = own.select("l_orderkey", "total", F.posexplode("items").alias("i", "x"))
    return own.select("l_orderkey", (F.col("i") + 1).cast("long").alias("rank"), F.col("x.k").alias("l_partkey"), F.round(-F.col("x.w") / F.col("total"), 6).alias("weight"))


@catalog.add("""
SELECT o_orderkey, o_orderstatus IN ('O', 'P') OR contains(upper(o_orderpriority), 'URGENT') AS gradable, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus ELSE o_orderpriority END AS preferred,
  CASE WHEN o_orderstatus <> 'F' THEN 'status' ELSE 'priority' END AS preferred_source FROM orders""")
def gradable_and_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of several texts says yes; the first told value with its source."""
    status = F.nullif("o_orderstatus", F.lit("F"))
    best = F.coalesce(F.when(status.isNotNull(), F.struct(status.alias("v"), F.lit("status").alias("s"))), F.struct(F.col("o_orderpriority").alias("v"), F.lit("priority").alias("s")))
    yes = F.col("o_orderstatus").isin("O", "P") | S.any_contains(["o_orderpriority"], "urgent")
    return table(spark, sf_dir, "orders").select("o_orderkey", yes.alias("gradable"), best["v"].alias("preferred"), best["s"].alias("preferred_source"))


@catalog.add(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)token = "|all rights reserved') THEN 'explicit_excluded' WHEN source IN ('src1', 'src2') THEN 'trusted_source'
  WHEN source IN ('src3', 'src4', 'src5') AND regexp_matches(text, '(?i)\bthe\b.*\bof\b') THEN 'strong_language' ELSE 'insufficient_evidence' END AS rule,
  NOT regexp_matches(text, '(?i)token = "|all rights reserved') AND (source IN ('src1', 'src2') OR (source IN ('src3', 'src4', 'src5') AND regexp_matches(text, '(?i)\bthe\b.*\bof\b'))) AS selected FROM documents""")
def regex_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad, strong = F.col("text").rlike('(?i)token = "|all rights reserved'), F.col("text").rlike(r"(?i)\bthe\b.*\bof\b")
    rule = S.choice([("explicit_excluded", bad), ("trusted_source", F.col("source").isin("src1", "src2")), ("strong_language", F.col("source").isin("src3", "src4", "src5") & strong)], "insufficient_evidence")
    return table(spark, sf_dir, "documents").select("doc_id", rule.alias("rule"), rule.isin("trusted_source", "strong_language").alias("selected"))


@catalog.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || ':' || coalesce(json_extract_string(props, '$.k'), 'none') AS token FROM events")
def json_metadata_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.concat_ws(":", "event_type", F.coalesce(k.cast("string"), F.lit("none"))).alias("token"))


@catalog.add("""SELECT o_orderkey, '{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS metadata FROM orders""")
def json_metadata_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", S.sorted_json({"status": F.nullif("o_orderstatus", F.lit("P")), "key": F.col("o_orderkey"), "priority": F.col("o_orderpriority")}).alias("metadata"))


@catalog.add("""
SELECT p_partkey, CASE WHEN p_size % 9 BETWEEN 1 AND 6 THEN CAST(p_size % 9 AS VARCHAR) END AS tone, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS brand,
  'PART_' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 24) AS stable_id, sha256('42:' || p_partkey) AS digest, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS alnum FROM part""")
def scalar_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.scale_value((n % 9).cast("string"), 1, 6).alias("tone"), S.without_marker(F.when(n % 5 == 0, " N/A ").otherwise(F.col("p_brand")), ["n/a"]).alias("brand"), S.stable_id("PART", "p_partkey").alias("stable_id"),
        S.digest(42, "p_partkey").alias("digest"), S.letters_and_digits("p_type").alias("alnum"),
    )


@catalog.add("""
SELECT o_orderkey, concat_ws(chr(10), CASE WHEN o_orderstatus = 'O' THEN 'open: yes' END, CASE WHEN o_totalprice > 100000 THEN 'large: yes' END, 'priority: ' || o_orderpriority) AS context,
  concat_ws(',', CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN o_totalprice > 100000 THEN 'large' END) AS labels FROM orders""")
def rendered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide flags as a list of labels, and as lines of text."""
    flags = {"open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 100000}
    labels = S.selected(flags)
    lines = F.concat_ws("\n", F.transform(labels, lambda x: F.concat(x, F.lit(": yes"))), F.concat(F.lit("priority: "), F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select("o_orderkey", lines.alias("context"), F.array_join(labels, ",").alias("labels"))


@catalog.add("""
WITH u AS (SELECT o_custkey AS id, o_orderdate AS ord, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS a, o_orderpriority AS b FROM orders)
SELECT DISTINCT id, first_value(a IGNORE NULLS) OVER w AS a, first_value(b IGNORE NULLS) OVER w AS b FROM u WINDOW w AS (PARTITION BY id ORDER BY ord, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first told value of each column over ordered records: as partial minima, so a key with very many records is no burden."""
    own = table(spark, sf_dir, "orders").withColumn("a", F.nullif("o_orderstatus", F.lit("F")))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("o_orderdate", "o_orderkey", F.col(c).alias("v"))))["v"]
    return own.groupBy(F.col("o_custkey").alias("id")).agg(first("a").alias("a"), first("o_orderpriority").alias("b"))


@catalog.add("""
SELECT rule, violations FROM (
  SELECT 'positive_quantity' AS rule, count(*) FILTER (NOT (l_quantity > 0)) AS violations FROM lineitem UNION ALL SELECT 'discount_under_5_percent', count(*) FILTER (NOT (l_discount < 0.05)) FROM lineitem
  UNION ALL SELECT 'known_flag', count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) FROM lineitem UNION ALL SELECT 'unique_l_orderkey_l_linenumber', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  UNION ALL SELECT 'order_exists', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))""")
def validate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants as counts of violations."""
    own, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    out = R.checks(own, {"positive_quantity": F.col("l_quantity") > 0, "discount_under_5_percent": F.col("l_discount") < 0.05, "known_flag": F.col("l_returnflag").isin("A", "N", "R")})
    return out.unionByName(R.unique(own, "l_orderkey", "l_linenumber")).unionByName(R.missing(own, orders, "l_orderkey", "order_exists"))


@catalog.add("""
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)
SELECT conv_id, max(CASE WHEN role = 'user' AND n = 1 THEN text END) AS question, max(CASE WHEN role = 'assistant' AND n = 1 THEN text END) AS answer FROM t GROUP BY conv_id""")
def conversation_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first question and the first answer."""
    first = lambda role: F.min(F.when(F.col("role") == role, F.struct("turn", "text")))["text"]
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(first("user").alias("question"), first("assistant").alias("answer"))


