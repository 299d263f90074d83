"""Selection, splits, quotas and pairing, over orders, conversations, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cambium.functions import scalars as S
from cambium.operators import cohorts as C
from cambium.operators import reports as R
from cambium.plans.common import Catalog, table

catalog = Catalog()
RATIOS = {"train": 0.7, "validation": 0.1, "test": 0.2}
#: The share of a digest's first 32 bits, in SQL.
PLACE = "CAST(('0x' || substr(sha256('42:' || o_custkey), 1, 8)) AS BIGINT) / 4294967296.0"
SPLIT = f"CASE WHEN {PLACE} < 0.7 THEN 'train' WHEN {PLACE} < 0.8 THEN 'validation' ELSE 'test' END"


def split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.conv(F.substring(S.digest(42, "o_custkey"), 1, 8), 16, 10).cast("double") / 2.0**32
    return table(spark, sf_dir, "orders").withColumn("split", F.when(place < 0.7, "train").when(place < 0.8, "validation").otherwise("test"))


@catalog.add("""
WITH u AS (SELECT conv_id, row_number() OVER (ORDER BY sha256('r1' || chr(0) || '42' || chr(0) || conv_id), conv_id) AS unit_rank FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, turn, unit_rank FROM conversations JOIN u USING (conv_id) WHERE unit_rank <= 20""".replace("chr(0)", "chr(1)"))
def select_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of 20 conversations. DuckDB can't hash a NUL, so here parts are joined by \\x01."""
    score = F.sha2(F.concat_ws("\u0001", F.lit("r1"), F.lit("42"), F.col("conv_id").cast("string")), 256)
    frame = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    units = frame.select("conv_id").distinct().withColumn("s", score).orderBy("s", "conv_id").limit(20)
    ranked = units.withColumn("unit_rank", F.row_number().over(W.orderBy("s", "conv_id")).cast("long")).drop("s")
    return frame.join(F.broadcast(ranked), "conv_id")


@catalog.add("""
WITH r AS (SELECT conv_id, row_number() OVER (ORDER BY sha256('release-1' || chr(0) || '42' || chr(0) || conv_id), conv_id) AS unit_rank FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, turn, CAST(unit_rank AS INT) AS unit_rank FROM conversations JOIN r USING (conv_id) WHERE unit_rank <= 20""")
def select_units_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.select_units(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 20, 42, "release-1").select("conv_id", "turn", "unit_rank")


@catalog.add("SELECT conv_id, turn, CAST(('0x' || substr(sha256('7:' || conv_id || '-' || turn), 9, 8)) AS BIGINT) % 2147483648 AS seed FROM conversations")
def task_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.task_seed(7, F.concat_ws("-", "conv_id", "turn")).alias("seed"))


@catalog.add("""
WITH a AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('1:' || doc_id), doc_id) AS turn FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, sha256('1:' || source), source) AS turn_of_stratum FROM a),
c AS (SELECT *, row_number() OVER (ORDER BY turn_of_stratum, sha256('1:' || lang), lang) AS position FROM b)
SELECT doc_id, lang, source, position FROM c WHERE position <= 100""")
def balanced_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 documents in an order in which languages take turns, and in each its sources. Each partition keeps its own first 100."""
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    own = own.withColumn("turn", F.row_number().over(W.partitionBy("lang", "source").orderBy(S.digest(1, "doc_id"), "doc_id")))
    own = own.withColumn("turn_of_stratum", F.row_number().over(W.partitionBy("lang").orderBy("turn", S.digest(1, "source"), "source")))
    order = ["turn_of_stratum", S.digest(1, "lang"), "lang"]
    few = own.orderBy(*order).limit(100)
    return few.select("doc_id", "lang", "source", F.row_number().over(W.orderBy(*order)).cast("long").alias("position"))


@catalog.add("""
WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, sha256('42:' || o_orderkey), o_orderkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM t WHERE n = 1""")
def one_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.one_per_group(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_totalprice").desc(), S.digest(42, "o_orderkey"), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@catalog.add("""
WITH s AS (SELECT o_orderpriority, count(DISTINCT o_custkey) AS label_support FROM orders GROUP BY 1),
t AS (SELECT o_custkey, o_orderkey, label_support, row_number() OVER (PARTITION BY o_custkey ORDER BY label_support, o_orderstatus, sha256('42:' || o_orderkey), o_orderkey) AS n FROM orders JOIN s USING (o_orderpriority))
SELECT o_custkey, o_orderkey, label_support FROM t WHERE n = 1""")
def representative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = C.representatives(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", F.col("o_orderstatus"), 42, "o_orderkey")
    return own.select("o_custkey", "o_orderkey", "label_support")


@catalog.add("""
WITH w AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), x AS (SELECT lang, n, n * (200 - 4 * count(*) OVER ()) / CAST(sum(n) OVER () AS DOUBLE) AS e, 200 - 4 * count(*) OVER () AS rest FROM w),
y AS (SELECT *, floor(e) AS f, rest - sum(floor(e)) OVER () AS more, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, lang) AS place FROM x)
SELECT lang, n AS documents, CAST(4 + f + CASE WHEN place <= more THEN 1 ELSE 0 END AS BIGINT) AS quota FROM y""")
def largest_remainder_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"))
    return C.apportioned(weights, "lang", "documents", 200, least=4)


@catalog.add("""
WITH t AS (SELECT count(DISTINCT o_custkey) AS n FROM orders), r(split, ratio, i) AS (VALUES ('train', 0.7, 1), ('validation', 0.1, 2), ('test', 0.2, 3)),
x AS (SELECT split, i, n, CAST(n AS DOUBLE) * CAST(ratio AS DOUBLE) AS e FROM t, r), y AS (SELECT *, n - sum(floor(e)) OVER () AS more, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, i) AS place FROM x)
SELECT split, CAST(floor(e) + CASE WHEN place <= more THEN 1 ELSE 0 END AS BIGINT) AS capacity FROM y""")
def split_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey")).first()[0]
    return spark.createDataFrame([(k, v) for k, v in C.capacities(total, RATIOS).items()], "split string, capacity long")


@catalog.add("""
WITH m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM events GROUP BY event_type)), t AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('42:' || event_id), event_id) AS place FROM events)
SELECT event_id, event_type, place FROM t, m WHERE place <= least""")
def downsample_to_rarest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.downsampled(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 42).select("event_id", "event_type", F.col("place").cast("long").alias("place"))


@catalog.add("""
WITH e AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('42:' || event_id), event_id) - 1 AS n FROM events),
d AS (SELECT * FROM e WHERE n < (SELECT min(c) FROM (SELECT count(*) AS c FROM events GROUP BY event_type))),
l AS (SELECT list_sort(list(DISTINCT event_type)) AS every FROM d),
p AS (SELECT d.*, every, list_filter(every, lambda x: x <> event_type) AS rest, 'PAIR_' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 16) AS pair_id FROM d, l),
t AS (SELECT *, 'TASK_' || substr(sha256(pair_id || ':' || difficulty), 1, 16) AS task_id,
  CASE WHEN difficulty = 'low' THEN [event_type, rest[n * 2 % len(rest) + 1], rest[(n * 2 + 1) % len(rest) + 1]] ELSE every END AS given FROM p, (VALUES ('low'), ('high')) v(difficulty))
SELECT pair_id, task_id, event_id, event_type, difficulty, CAST(len(given) AS SMALLINT) AS candidate_count,
  array_to_string(list_transform(list_sort(list_transform(given, lambda c: {'k': sha256('42:' || task_id || ':' || c), 'c': c})), lambda x: x.c), ',') AS candidates FROM t""")
def paired_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = C.paired_tasks(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type", 42)
    return own.select("pair_id", "task_id", "event_id", "event_type", "difficulty", F.array_join("candidates", ",").alias("candidates"), "candidate_count")


@catalog.add("""
WITH c AS (SELECT event_type, count(*) AS s FROM events GROUP BY event_type),
r AS (SELECT a.event_type, b.event_type AS distractor, a.s, row_number() OVER (PARTITION BY a.event_type ORDER BY b.event_type) - 1 AS j, count(*) OVER (PARTITION BY a.event_type) AS k FROM c a JOIN c b ON a.event_type <> b.event_type)
SELECT event_type, distractor, s // k + CAST(j < s % k AS BIGINT) AS used FROM r WHERE s // k + CAST(j < s % k AS BIGINT) > 0""")
def balanced_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each label is the wrong choice for each other one."""
    own = C.distractors(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type", 42)
    return own.select("event_type", F.explode("distractors").alias("distractor")).groupBy("event_type", "distractor").agg(F.count("*").alias("used"))


@catalog.add()
def greedy_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers into splits, balanced by status, priority and, at a quarter, by clerkless month."""
    orders = table(spark, sf_dir, "orders")
    features = C.group_features(orders, "o_custkey", {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "both": F.concat_ws(":", "o_orderstatus", "o_orderpriority")}, {"quarter": F.quarter("o_orderdate").cast("string")})
    return C.greedy_split(features, "o_custkey", RATIOS, 42, block=200_000)


@catalog.add()
def subset_sum_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations with 100 turns in all. One size a conversation goes to the driver, of the first 2,000 in hash order: a cohort, whose limit is the feature."""
    sizes = table(spark, sf_dir, "conversations").groupBy("conv_id").count().orderBy(S.digest(42, "conv_id")).limit(2000).collect()
    own = {str(r["conv_id"]): r["count"] for r in sizes}
    chosen = C.exact_subset(own, min(100, sum(own.values())), 42)
    return spark.createDataFrame([(int(k), own[k]) for k in sorted(chosen)], "conv_id long, turns long")


@catalog.add("""
WITH t AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_brand, sha256('42:' || p_partkey), p_partkey) - 1 AS at, count(*) OVER () AS total FROM part),
m AS (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM part GROUP BY p_brand))
SELECT a.p_partkey, CASE WHEN a.p_brand <> b.p_brand THEN b.p_partkey END AS donor FROM t a CROSS JOIN m JOIN t b ON b.at = (a.at + m.most) % a.total""")
def donor_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of another brand for each part."""
    return C.matched(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand", 42)


@catalog.add()
def augmenting_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier of its own nation for each of 200 customers, as far as there are enough: the cohort's limit is the feature."""
    few = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").orderBy(S.digest(42, "c_custkey"), "c_custkey").limit(200)
    wishes = few.join(table(spark, sf_dir, "supplier"), F.col("c_nationkey") == F.col("s_nationkey")).groupBy("c_custkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("s")).orderBy("c_custkey").collect()
    found = C.matching({str(r["c_custkey"]): [str(x) for x in r["s"]] for r in wishes})
    return spark.createDataFrame([(int(a), int(b)) for a, b in sorted(found.items())], "c_custkey long, s_suppkey long")


@catalog.add(f"""
WITH t AS (SELECT *, {SPLIT} AS split FROM orders)
SELECT split, CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS status, count(DISTINCT o_custkey) AS groups, count(*) AS rows FROM t GROUP BY GROUPING SETS ((split, o_orderstatus), (split))""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = R.with_total(split_orders(spark, sf_dir), "o_orderstatus", "all", F.count_distinct("o_custkey").alias("groups"), F.count("*").alias("rows"), also=["split"])
    return own.select("split", F.col("o_orderstatus").alias("status"), "groups", "rows")


@catalog.add(f"""
WITH t AS (SELECT o_custkey, {SPLIT} AS split, unnest([{{'d': 'status', 'v': o_orderstatus}}, {{'d': 'priority', 'v': o_orderpriority}}], recursive := true) FROM orders)
SELECT split, d AS dimension, v AS value, count(DISTINCT o_custkey) AS groups, count(*) AS rows FROM t GROUP BY ALL""")
def split_subgroup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = R.long_form(split_orders(spark, sf_dir), ["split", "o_custkey"], {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")})
    return own.groupBy("split", "dimension", "value").agg(F.count_distinct("o_custkey").alias("groups"), F.count("*").alias("rows"))


@catalog.add("""
WITH a AS (SELECT c_mktsegment, count(*) AS x FROM customer GROUP BY 1), b AS (SELECT c_mktsegment, count(*) AS y FROM customer WHERE c_acctbal > 5000 GROUP BY 1),
j AS (SELECT c_mktsegment, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b USING (c_mktsegment)), f AS (SELECT *, x / CAST(sum(x) OVER () AS DOUBLE) AS p, coalesce(y / CAST(nullif(sum(y) OVER (), 0) AS DOUBLE), 0) AS q FROM j)
SELECT c_mktsegment, x AS full_count, y AS part_count, round(p, 6) AS full_fraction, round(q, 6) AS part_fraction, round(abs(p - q), 6) AS difference FROM f""")
def selection_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = table(spark, sf_dir, "customer")
    return R.balance(full, full.where("c_acctbal > 5000"), ["c_mktsegment"])


@catalog.add(f"""
WITH t AS (SELECT DISTINCT o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'test' ELSE {SPLIT} END AS split FROM orders), p(l, r) AS (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test'))
SELECT l AS left_split, r AS right_split, count(b.o_custkey) AS overlap FROM p LEFT JOIN t a ON a.split = l LEFT JOIN t b ON b.split = r AND b.o_custkey = a.o_custkey GROUP BY ALL""")
def integrity_overlap_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in two splits, where urgent orders have been moved to test."""
    own = split_orders(spark, sf_dir).withColumn("split", F.when(F.col("o_orderpriority") == "1-URGENT", "test").otherwise(F.col("split")))
    return R.overlaps(own, "split", "o_custkey", list(RATIOS))


@catalog.add("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 512 AS BIGINT) AS batch FROM orders")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunked(table(spark, sf_dir, "orders").select("o_orderkey"), 512, "o_orderkey")


@catalog.add("""
SELECT 'both' AS rule, count(*) AS units FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'only_open', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'either', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    a, b = (orders.where(F.col("o_orderstatus") == s).select("o_custkey") for s in "OF")
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count("*").alias("units"))
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "only_open")).unionByName(count(a.union(b).distinct(), "either"))


@catalog.add("""
WITH a AS (SELECT conv_id, turn, role, turn AS seq FROM conversations WHERE turn % 2 = 0), b AS (SELECT conv_id, turn, role, turn + 100 AS seq FROM conversations WHERE turn % 2 = 1 OR conv_id % 5 = 0)
SELECT (SELECT count(*) FROM (SELECT conv_id, turn FROM a INTERSECT SELECT conv_id, turn FROM b)) AS in_both, (SELECT count(*) FROM (SELECT conv_id, turn FROM a UNION SELECT conv_id, turn FROM b)) AS in_either,
 (SELECT count(*) FROM (SELECT conv_id, turn FROM conversations EXCEPT (SELECT conv_id, turn FROM a UNION SELECT conv_id, turn FROM b))) AS missing""")
def run_union_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over parts of the tasks: what both have, what either has, what neither has. One pass over the tasks' union, counted by key."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    marked = own.withColumn("a", F.lit(False)).withColumn("b", F.lit(False))
    first = own.where("turn % 2 = 0").withColumn("a", F.lit(True)).withColumn("b", F.lit(False))
    second = own.where("turn % 2 = 1 or conv_id % 5 = 0").withColumn("a", F.lit(False)).withColumn("b", F.lit(True))
    keys = marked.union(first).union(second).groupBy("conv_id", "turn").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return keys.agg(F.count_if(F.col("a") & F.col("b")).alias("in_both"), F.count_if(F.col("a") | F.col("b")).alias("in_either"), F.count_if(~F.col("a") & ~F.col("b")).alias("missing"))
