"""Task frames and the metrics of each task type, over predictions made from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.functions import pictures
from cambium.functions import scalars as S
from cambium.operators import joins as J
from cambium.operators.tasks import TASKS, Setting
from cambium.plans.common import Catalog, table

catalog = Catalog()


@catalog.add("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > l_discount THEN 'tax' ELSE 'discount' END AS label, greatest(l_tax, l_discount) AS weight, CAST(2 AS BIGINT) AS labels FROM lineitem""")
def weighted_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a list written as a literal, by weight, in the order written where weights are equal."""
    text = F.concat(F.lit("{'discount': "), F.col("l_discount").cast("string"), F.lit(", 'tax': "), F.col("l_tax").cast("string"), F.lit("}"))
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.weighted_list(text).alias("w"))
    return own.select("l_orderkey", "l_linenumber", F.col("w")[0]["label"].alias("label"), F.col("w")[0]["weight"].alias("weight"), F.size("w").cast("long").alias("labels"))


@catalog.add("""
SELECT event_id, array_to_string(list_sort(list_distinct([event_type, CAST(user_id AS VARCHAR)])), ',') AS ids FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 'a,b' FROM events WHERE event_id % 3 = 0""")
def candidate_id_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from texts of lists as different writers print them; a fallback for none."""
    kind, user, e = F.col("event_id") % 3, F.col("user_id").cast("string"), F.col("event_type")
    text = F.when(kind == 1, F.concat(F.lit("['"), e, F.lit("' '"), user, F.lit("']"))).when(kind == 2, F.concat_ws(", ", e, user))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(S.id_set(text, F.array(F.lit("a"), F.lit("b"))), ",").alias("ids"))


@catalog.add("""
SELECT p_partkey, 'Name the type of ' || p_name || ' from:' || chr(10) || '- ' || p_type || chr(10) || '- other' AS prompt,
  CASE WHEN contains(lower(p_name), 'red ring') THEN 'red ring' WHEN contains(lower(p_name), 'red') THEN 'red' WHEN contains(lower(p_name), 'ring') THEN 'ring' ELSE 'none' END AS attribute FROM part""")
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = S.rendered("Name the type of {{ name }} from:\n{{options}}", {"name": F.col("p_name"), "options": S.bullets(F.array(F.col("p_type"), F.lit("other")))})
    return table(spark, sf_dir, "part").select("p_partkey", prompt.alias("prompt"), S.first_contained("p_name", ["red ring", "red", "ring"], "none").alias("attribute"))


@catalog.add("""
SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal > 0 THEN 'rich' END, CASE WHEN c_nationkey < 10 THEN 'near' END) AS concepts, CAST(CAST(c_acctbal > 0 AS INT) + CAST(c_nationkey < 10 AS INT) AS BIGINT) AS concept_count,
  CASE WHEN c_custkey % 3 = 0 THEN c_name END AS reference_description, c_custkey % 3 = 0 AS score_description FROM customer""")
def evidence_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with wide flags as a list, a caption that some lack, and the scores they can take part in."""
    own = table(spark, sf_dir, "customer")
    flags = own.select("c_custkey", (F.col("c_acctbal") > 0).cast("int").alias("Rich Ones"), (F.col("c_nationkey") < 10).cast("int").alias("near"))
    columns = J.flag_columns(flags.columns, {"rich": "rich-ones", "near": "Near"})
    out = J.with_evidence(own.select("c_custkey"), flags, own.where("c_custkey % 3 = 0").select("c_custkey", "c_name"), "c_custkey", columns, "c_name")
    return out.select("c_custkey", F.array_join("concept_ids", ",").alias("concepts"), F.col("concept_count").cast("long").alias("concept_count"), "reference_description", "score_description")


@catalog.add("SELECT c_custkey, condition, sha256(c_custkey || ':' || condition) AS task_id FROM customer, (VALUES ('image_only'), ('image_plus_context')) v(condition)")
def condition_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = J.fanned(table(spark, sf_dir, "customer").select("c_custkey"), "condition", ["image_only", "image_plus_context"])
    return own.withColumn("task_id", F.sha2(F.concat_ws(":", F.col("c_custkey").cast("string"), "condition"), 256))


@catalog.add("""
WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders), n AS (SELECT o_orderkey // 2 AS unit, count(*) AS n, min(o_orderkey % 2) AS a FROM t GROUP BY 1)
SELECT unit, 'all|x' AS stratum FROM n WHERE n = 2""")
def unit_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pairs of tasks with their stratum."""
    tasks = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 2).alias("unit"))
    whole = tasks.groupBy("unit").count().where(F.col("count") == 2).select("unit")
    tasks = tasks.join(whole, "unit", "left_semi")
    return J.units(tasks, tasks.select("o_orderkey", F.lit("all").alias("a"), F.lit("x").alias("b")), "o_orderkey", "unit", ["a", "b"], 2)


STATUS = "CASE user_id % 3 WHEN 0 THEN 'abstained' WHEN 1 THEN 'answered' ELSE 'uncertain' END"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % 3
    status = F.when(u == 0, "abstained").when(u == 1, "answered").otherwise("uncertain")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("condition"), status.alias("status"), F.when(u == 0, 0).otherwise(F.col("event_id") % 3).alias("n_predictions"), (F.col("event_id") % 2).alias("n_findings"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        (F.col("event_id") % 10 > 0).alias("schema_valid"), F.when(F.col("event_id") % 2 == 0, "abstained").otherwise("answered").alias("expected"),
    )


Z2 = "3.841458820694124"


@catalog.add(f"""
WITH t AS (SELECT event_type AS condition, {STATUS} AS status, CASE WHEN user_id % 3 = 0 THEN 0 ELSE event_id % 3 END AS p, event_id % 2 AS f, least(value / 100, 1.0) AS c, event_id % 10 > 0 AS ok FROM events),
g AS (SELECT condition, count(*) AS n, avg(CAST(status = 'abstained' AS DOUBLE)) AS a, avg(CAST(p > 0 OR f > 0 AS DOUBLE)) AS h, avg(CAST(p > 0 AND c >= 0.75 AS DOUBLE)) AS o, avg(CAST(ok AS DOUBLE)) AS v FROM t GROUP BY 1)
SELECT condition, n, round(a, 6) AS abstention, round(h, 6) AS hallucination, round(o, 6) AS overconfidence, round(v, 6) AS valid,
  round((a + {Z2} / 2 / n - sqrt({Z2}) * sqrt(a * (1 - a) / n + {Z2} / 4 / n / n)) / (1 + {Z2} / n), 6) AS abstention_low, round((a + {Z2} / 2 / n + sqrt({Z2}) * sqrt(a * (1 - a) / n + {Z2} / 4 / n / n)) / (1 + {Z2} / n), 6) AS abstention_high FROM g""")
def abstention_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TASKS["visual_grounding_no_image"].score(answers(spark, sf_dir), Setting())


@catalog.add(f"""
WITH t AS (SELECT event_type AS condition, {STATUS} AS status, CASE WHEN event_id % 2 = 0 THEN 'abstained' ELSE 'answered' END AS expected FROM events)
SELECT condition, count(*) AS n, round(avg(CAST(status = expected AS DOUBLE)), 6) AS status_accuracy, round(count(*) FILTER (expected = 'abstained' AND status = 'answered') / CAST(count(*) FILTER (expected = 'abstained') AS DOUBLE), 6) AS hallucination,
  round(count(*) FILTER (expected = 'abstained' AND status = 'abstained') / CAST(count(*) FILTER (expected = 'abstained') AS DOUBLE), 6) AS abstention FROM t GROUP BY 1""")
def answerability_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TASKS["general_visual_hallucination"].score(answers(spark, sf_dir), Setting())


@catalog.add(f"""
WITH t AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'swap' ELSE 'pixel_shuffle' END AS condition, {STATUS} AS status, CASE WHEN event_id % 4 = 0 THEN ['a', 'b', 'c'] ELSE ['b', 'a', 'd'] END AS ranked, event_type = 'click' AS flip FROM events),
r AS (SELECT *, coalesce(list_position(ranked, CASE WHEN flip THEN 'b' ELSE 'a' END), 0) AS rank, coalesce(list_position(ranked, CASE WHEN flip THEN 'a' ELSE 'b' END), 0) AS old FROM t)
SELECT count(*) AS n, round(count(*) FILTER (condition = 'pixel_shuffle' AND status = 'abstained') / CAST(count(*) FILTER (condition = 'pixel_shuffle') AS DOUBLE), 6) AS shuffled_abstention, round(count(*) FILTER (condition = 'swap' AND rank = 1) / CAST(count(*) FILTER (condition = 'swap') AS DOUBLE), 6) AS swap_top_1,
  round(count(*) FILTER (condition = 'swap' AND rank BETWEEN 1 AND 3) / CAST(count(*) FILTER (condition = 'swap') AS DOUBLE), 6) AS swap_top_3, round(count(*) FILTER (condition = 'swap' AND old = 1) / CAST(count(*) FILTER (condition = 'swap') AS DOUBLE), 6) AS source_persistence,
  round(count(*) FILTER (CASE WHEN condition = 'swap' THEN rank = 1 ELSE status = 'abstained' END) / CAST(count(*) AS DOUBLE), 6) AS full_success FROM r""")
def counterfactual_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, flip = F.col("event_id"), F.col("condition") == "click"
    own = answers(spark, sf_dir).select(
        F.when(n % 2 == 0, "swap").otherwise("pixel_shuffle").alias("condition"), "status", F.when(n % 4 == 0, F.array(*map(F.lit, "abc"))).otherwise(F.array(*map(F.lit, "bad"))).alias("ranked"),
        F.when(flip, "b").otherwise("a").alias("target"), F.when(flip, "a").otherwise("b").alias("source"),
    )
    return TASKS["counterfactual_hallucination"].score(own, Setting())


@catalog.add("""
SELECT count(*) AS n, round(avg(CAST(length(trim(text)) > 0 AS DOUBLE)), 6) AS response_rate, round(avg(length(trim(text))), 4) AS mean_characters FROM conversations WHERE role = 'assistant'""")
def open_ended_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = TASKS["open_ended_diagnosis"]
    own = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(task.check(F.col("text"), Setting()).alias("r")).select("r.*")
    return task.score(own, Setting())


@catalog.add("""
SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'finding_0_concept_id_unknown' ELSE '' END AS schema_errors,
  concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'description_concepts_must_be_declared_findings' END, CASE WHEN o_orderkey % 7 = 0 THEN 'case_confidence_must_match_top_confidence' END) AS semantic_errors, count(*) AS n
FROM orders GROUP BY ALL""")
def evidence_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with findings, made from orders, by what is wrong with them."""
    finding = F.format_string('{"finding_id": "F1", "concept_id": "%s", "confidence": 0.9}', F.when(F.col("o_orderkey") % 5 == 0, "unheard").otherwise("ring"))
    share = F.when(F.col("o_orderkey") % 7 == 0, "0.5").otherwise("0.8")
    text = F.format_string('{"findings": [%s], "clinical_description": "a ring", "differential": [{"rank": 1, "disease_id": "%s", "confidence": %s, "supporting_finding_ids": ["F1"]}], "case_confidence": "high"}', finding, F.col("o_orderstatus"), share)
    setting = Setting(diseases=("O", "F", "P"), k=1, concepts={"ring": ["ring", "rings"]})
    own = table(spark, sf_dir, "orders").select(TASKS["evidence_grounded_diagnosis"].check(text, setting).alias("r"))
    return own.groupBy(F.array_join("r.schema_errors", ",").alias("schema_errors"), F.array_join("r.semantic_errors", ",").alias("semantic_errors")).agg(F.count("*").alias("n"))


@catalog.add()
def control_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of 8 by 8 from embeddings, shuffled and gray, with their perceptual codes."""
    byte = F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.greatest(F.round(x * 127 + 128), F.lit(0)), F.lit(255)).cast("int")), 2, "0"))
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(byte, "")).alias("data")).alias("p"))
    mixed = own.withColumn("s", pictures.pixel_shuffle(42)("p", "vec_id")).withColumn("g", pictures.uniform_gray("p"))
    return mixed.select("vec_id", pictures.perceptual_code("p").alias("code"), F.sha2(F.col("s.data"), 256).alias("shuffled_sha256"), F.sha2(F.col("g.data"), 256).alias("gray_sha256"))
