"""Coverage, inventory and availability reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.operators import reports as R
from cambium.plans.common import Catalog, table

catalog = Catalog()
#: Languages and sources named by a report's columns or grids.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@catalog.add("""
SELECT o_orderpriority, l_returnflag, l_linestatus, count(*) AS rows, count(DISTINCT l_orderkey) AS groups, count(DISTINCT CASE WHEN l_linenumber = 1 THEN l_orderkey END) AS first_rank_groups
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    own = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    first = F.when(F.col("l_linenumber") == 1, F.col("l_orderkey"))
    return own.groupBy("o_orderpriority", "l_returnflag", "l_linestatus").agg(F.count("*").alias("rows"), F.count_distinct("l_orderkey").alias("groups"), F.count_distinct(first).alias("first_rank_groups"))


@catalog.add("""
SELECT p_type, CASE WHEN grouping(p_brand) = 1 THEN 'all_sources' ELSE p_brand END AS source, count(*) AS rows, count(DISTINCT p_size) AS sizes, count(DISTINCT p_brand || ':' || p_name) AS raw_labels
FROM part GROUP BY GROUPING SETS ((p_type, p_brand), (p_type))""")
def all_source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = R.with_total(table(spark, sf_dir, "part"), "p_brand", "all_sources", F.count("*").alias("rows"), F.count_distinct("p_size").alias("sizes"), F.count_distinct(F.concat_ws(":", "p_brand", "p_name")).alias("raw_labels"), also=["p_type"])
    return own.withColumnRenamed("p_brand", "source")


@catalog.add("""
WITH g AS (SELECT n_nationkey, segment FROM nation, (SELECT DISTINCT c_mktsegment AS segment FROM customer)), f AS (SELECT c_nationkey, c_mktsegment, count(DISTINCT c_custkey) AS groups, count(o_orderkey) AS rows FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT n_nationkey, segment, CAST(coalesce(groups, 0) AS BIGINT) AS groups, CAST(coalesce(rows, 0) AS BIGINT) AS rows, CAST(sum(coalesce(groups, 0)) OVER (PARTITION BY n_nationkey) AS BIGINT) AS nation_groups FROM g LEFT JOIN f ON c_nationkey = n_nationkey AND c_mktsegment = segment""")
def coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation and segment, also those without customers."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"), "c_custkey")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    facts = customers.join(orders, "c_custkey", "left").groupBy("n_nationkey", "segment").agg(F.count_distinct("c_custkey").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    grid = R.dense([table(spark, sf_dir, "nation").select("n_nationkey"), customers.select("segment").distinct()], facts, ["n_nationkey", "segment"], ["groups", "rows"])
    return grid.join(grid.groupBy("n_nationkey").agg(F.sum("groups").alias("nation_groups")), "n_nationkey")


@catalog.add("""
WITH f AS (SELECT p_type, count(*) AS total, count(DISTINCT p_brand) AS brands FROM part WHERE p_size < 25 GROUP BY 1)
SELECT p_type, total, brands, CASE WHEN total >= 100 AND brands >= 25 THEN 'supported' ELSE 'unsupported' END AS status,
  nullif(concat_ws(';', CASE WHEN total < 100 THEN 'insufficient_groups' END, CASE WHEN brands < 25 THEN 'insufficient_datasets' END), '') AS reasons FROM f""")
def support_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").where("p_size < 25").groupBy("p_type").agg(F.count("*").alias("total"), F.count_distinct("p_brand").alias("brands"))
    status, reasons = R.support(F.col("total"), F.col("brands"), 100, 25)
    return own.select("p_type", "total", "brands", status.alias("status"), reasons.alias("reasons"))


@catalog.add("""
WITH t AS (SELECT source, doc_id, lang, CAST(quality AS VARCHAR) AS quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, scope, count(DISTINCT doc_id) AS units, count(DISTINCT CASE WHEN quality IS NOT NULL THEN doc_id END) AS quality_units, round(count(DISTINCT CASE WHEN quality IS NOT NULL THEN doc_id END) / CAST(count(DISTINCT doc_id) AS DOUBLE), 6) AS quality_fraction,
  count(DISTINCT CASE WHEN lang IS NOT NULL THEN doc_id END) AS lang_units, round(count(DISTINCT CASE WHEN lang IS NOT NULL THEN doc_id END) / CAST(count(DISTINCT doc_id) AS DOUBLE), 6) AS lang_fraction
FROM (SELECT *, 'all' AS scope FROM t UNION ALL SELECT *, 'english' FROM t WHERE lang = 'en') GROUP BY source, scope""")
def demographic_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return R.availability(own, "source", "doc_id", {"quality": F.col("quality"), "lang": F.col("lang")}, {"all": F.lit(True), "english": F.col("lang") == "en"})


@catalog.add("""
SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS event_type, CAST(user_id % 10 AS BIGINT) AS segment, count(DISTINCT user_id) AS groups, count(*) AS rows, count(DISTINCT user_id) >= 5 AS eligible
FROM events GROUP BY GROUPING SETS ((user_id % 10, event_type), (user_id % 10))""")
def subgroup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("event_type", "user_id", (F.col("user_id") % 10).alias("segment"))
    own = R.with_total(own, "event_type", "all", F.count_distinct("user_id").alias("groups"), F.count("*").alias("rows"), also=["segment"])
    return own.withColumn("eligible", F.col("groups") >= 5)


@catalog.add("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in EVENT_TYPES) + ", count(*) AS total FROM events GROUP BY user_id")
def label_source_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.crosstab(table(spark, sf_dir, "events"), "user_id", "event_type", EVENT_TYPES)


@catalog.add("""
SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS rows, count(DISTINCT source) AS groups, count(DISTINCT quality) AS classes, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def dataset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return R.with_total(own, "lang", "all", F.count("*").alias("rows"), F.count_distinct("source").alias("groups"), F.count_distinct("quality").alias("classes"), F.sum("n_chars").alias("chars"))


@catalog.add("""
WITH s(status) AS (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('never')), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT status, CAST(coalesce(n, 0) AS BIGINT) AS n FROM s LEFT JOIN c ON event_type = status UNION ALL SELECT 'total', count(*) FROM events""")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(table(spark, sf_dir, "events").select(F.col("event_type").alias("status")), "status", [*EVENT_TYPES, "never"])


@catalog.add("""
SELECT doc_id, sha256(text) AS row_sha256, 'split-' || lang AS shard, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents""")
def release_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("row_sha256"), F.concat(F.lit("split-"), F.col("lang")).alias("shard"), F.octet_length("text").cast("long").alias("bytes"))


@catalog.add("""
SELECT o_orderstatus, o_orderpriority, count(*) AS rows, count(DISTINCT o_custkey) AS samples, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("samples"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
