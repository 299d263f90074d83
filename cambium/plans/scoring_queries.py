"""Metrics over predictions that are made from the driver tables by digests, and contracts of responses made from events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.functions import responses as P
from cambium.functions import stats
from cambium.operators import scoring as M
from cambium.plans.common import Catalog, table

catalog = Catalog()
LANGS = ("de", "en", "es", "fr")
#: Languages in the order of a digest: a document's ranked prediction.
PREDICTED = """
ranked AS (SELECT doc_id, lang AS truth, source, l.l AS guess, row_number() OVER (PARTITION BY doc_id ORDER BY sha256('p:' || doc_id || l.l)) AS rank FROM documents, (VALUES ('de'), ('en'), ('es'), ('fr')) l(l)),
scored AS (SELECT doc_id, any_value(truth) AS truth, any_value(source) AS source, max(CASE WHEN rank = 1 THEN guess END) AS top, max(CASE WHEN guess = truth THEN rank END) AS rank FROM ranked GROUP BY doc_id)"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, truth, source, ranked, rank, top."""
    keyed = F.array(*[F.struct(F.sha2(F.concat(F.lit("p:"), F.col("doc_id").cast("string"), F.lit(x)), 256).alias("k"), F.lit(x).alias("l")) for x in LANGS])
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("truth"), "source", F.transform(F.array_sort(keyed), lambda x: x["l"]).alias("ranked"))
    return own.withColumn("rank", M.rank_of(F.col("truth"), F.col("ranked"))).withColumn("top", F.element_at("ranked", 1))


@catalog.add(f"WITH {PREDICTED} SELECT source, count(*) AS n, round(avg(CAST(rank <= 1 AS DOUBLE)), 6) AS top_1, round(avg(CAST(rank <= 2 AS DOUBLE)), 6) AS top_2, round(avg(CAST(rank <= 3 AS DOUBLE)), 6) AS top_3, round(avg(1.0 / rank), 6) AS mrr FROM scored GROUP BY source")
def topk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ranking_metrics(predicted(spark, sf_dir), ["source"], "truth", "ranked", (1, 2, 3))


@catalog.add(f"""
WITH {PREDICTED}, l(lang) AS (VALUES ('de'), ('en'), ('es'), ('fr'), ('xx')),
c AS (SELECT lang, (SELECT count(*) FROM scored WHERE truth = lang AND top = lang) AS tp, (SELECT count(*) FROM scored WHERE truth <> lang AND top = lang) AS fp, (SELECT count(*) FROM scored WHERE truth = lang AND top <> lang) AS fn FROM l)
SELECT round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1, count(*) AS labels FROM c""")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([(x,) for x in (*LANGS, "xx")], "lang string")
    return M.macro_f1(M.label_counts(predicted(spark, sf_dir), labels, "lang", "truth", "top"))


Z2 = "3.841458820694124"


@catalog.add(f"""
WITH {PREDICTED}, t AS (SELECT truth AS lang, source, doc_id, CAST(rank = 1 AS INT) AS hit FROM scored),
g AS (SELECT source, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, count(DISTINCT doc_id) AS units, sum(hit) / CAST(count(*) AS DOUBLE) AS p FROM t GROUP BY source),
a AS (SELECT source, round(avg(a), 6) AS label_adjusted, count(*) AS labels FROM (SELECT source, lang, avg(hit) AS a, count(DISTINCT doc_id) AS u FROM t GROUP BY ALL) WHERE u >= 3 GROUP BY source)
SELECT source, n, hits, units, round(p, 6) AS accuracy, round(greatest(0.0, (p + {Z2} / 2 / n - sqrt({Z2}) * sqrt(p * (1 - p) / n + {Z2} / 4 / n / n)) / (1 + {Z2} / n)), 6) AS low,
  round(least(1.0, (p + {Z2} / 2 / n + sqrt({Z2}) * sqrt(p * (1 - p) / n + {Z2} / 4 / n / n)) / (1 + {Z2} / n)), 6) AS high, units >= 50 AS supported, label_adjusted, CAST(coalesce(labels, 0) AS BIGINT) AS labels FROM g LEFT JOIN a USING (source)""")
def subgroup_accuracy_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = predicted(spark, sf_dir).withColumn("hit", (F.col("rank") == 1).cast("int"))
    return M.subgroup_accuracy(own, "source", "hit", "doc_id", "truth", 50, 3)


PAIRS = """
p AS (SELECT user_id AS pair, max(CASE WHEN event_type = 'view' THEN value END) AS low, max(CASE WHEN event_type = 'click' THEN value END) AS high, count(*) FILTER (event_type = 'view') = 1 AND count(*) FILTER (event_type = 'click') = 1 AS complete
  FROM (SELECT user_id, event_type, round(avg(value), 6) AS value FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL) GROUP BY user_id)"""


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click")).groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("value"))
    return M.paired(own, "user_id", "event_type", "value", ("view", "click"))


@catalog.add(f"WITH {PAIRS} SELECT count(*) AS pairs, count(*) FILTER (complete) AS complete, round(avg(CASE WHEN complete THEN low - high END), 5) AS gap FROM p")
def paired_condition_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = event_pairs(spark, sf_dir)
    return own.agg(F.count("*").alias("pairs"), F.count_if("complete").alias("complete"), F.round(F.avg(F.when(F.col("complete"), F.col("view") - F.col("click"))), 5).alias("gap"))


@catalog.add()
def paired_gap_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean difference, by segment."""
    own = event_pairs(spark, sf_dir).where("complete").select((F.col("user_id") % 4).alias("segment"), "user_id", (F.col("view") - F.col("click")).alias("difference"))
    return stats.bootstrap_by(own, "segment", "difference", "user_id")


@catalog.add()
def poisson_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for keys of any size."""
    return stats.poisson_bootstrap(table(spark, sf_dir, "events"), "event_type", "value", "event_id", 100)


@catalog.add(f"WITH {PAIRS} SELECT count(*) AS pairs, count(*) FILTER (high > low) AS improved, count(*) FILTER (high < low) AS worsened, count(*) FILTER (high = low) AS unchanged FROM p WHERE complete")
def ablation_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.transitions(event_pairs(spark, sf_dir).where("complete"), "view", "click").drop("delta")


@catalog.add()
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.transitions(event_pairs(spark, sf_dir).where("complete"), "view", "click").select("improved", "worsened", stats.mcnemar("improved", "worsened").alias("p_value"))


SETS = """
s AS (SELECT l_orderkey, list(DISTINCT l_returnflag || l_linestatus) FILTER (l_discount > 0.04) AS predicted, list(DISTINCT l_returnflag || l_linestatus) FILTER (l_tax > 0.03) AS reference FROM lineitem GROUP BY 1),
t AS (SELECT l_orderkey, coalesce(predicted, []) AS p, coalesce(reference, []) AS r FROM s),
u AS (SELECT *, len(p) AS np, len(r) AS nr, len(list_intersect(p, r)) AS tp FROM t)"""


def flag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.concat("l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_discount") > 0.04, flag)).alias("predicted"), F.collect_set(F.when(F.col("l_tax") > 0.03, flag)).alias("reference"))


@catalog.add(f"""
WITH {SETS}, v AS (SELECT *, CASE WHEN np = 0 THEN CAST(nr = 0 AS DOUBLE) ELSE tp / CAST(np AS DOUBLE) END AS pr, CASE WHEN nr = 0 THEN CAST(np = 0 AS DOUBLE) ELSE tp / CAST(nr AS DOUBLE) END AS re FROM u)
SELECT count(*) AS n, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END), 6) AS f1, round(2.0 * sum(tp) / (sum(np) + sum(nr)), 6) AS micro_f1 FROM v""")
def set_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.set_metrics(flag_sets(spark, sf_dir), "predicted", "reference")


@catalog.add(f"""
WITH {SETS}, x AS (SELECT l_orderkey, unnest(list_distinct(list_concat(p, r))) AS concept, p, r FROM u)
SELECT concept, count(*) FILTER (list_contains(p, concept) AND list_contains(r, concept)) AS tp, count(*) FILTER (list_contains(p, concept) AND NOT list_contains(r, concept)) AS fp, count(*) FILTER (list_contains(r, concept) AND NOT list_contains(p, concept)) AS fn FROM x GROUP BY concept""")
def concept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.concept_counts(flag_sets(spark, sf_dir), "predicted", "reference", "concept")


@catalog.add("""
WITH t AS (SELECT least(value / 100, 1.0) AS c, CAST(event_type IN ('click', 'view') AS INT) AS h FROM events WHERE value / 100 >= 0), b AS (SELECT least(floor(c * 10), 9) AS bin, count(*) AS n, avg(c) AS c, avg(h) AS a, sum((c - h) * (c - h)) AS b FROM t GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(abs(c - a) * n) / sum(n), 6) AS ece, round(sum(b) / sum(n), 6) AS brier FROM b""")
def calibration_ece_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select(F.least(F.col("value") / 100, F.lit(1.0)).alias("c"), F.col("event_type").isin("click", "view").cast("int").alias("h"))
    return M.calibration(own, "c", "h")


@catalog.add("""
SELECT count(*) AS links, count(p_name) AS resolved, count(*) FILTER (p_size > 25) AS supported, round(count(p_name) / CAST(count(*) AS DOUBLE), 6) AS resolution_rate, round(count(*) FILTER (p_size > 25) / CAST(count(p_name) AS DOUBLE), 6) AS visible_precision
FROM (SELECT l_orderkey % 8 AS c, l_partkey FROM lineitem) LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 8 = c""")
def evidence_link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 8).alias("case"), F.col("l_partkey").alias("link"))
    findings = table(spark, sf_dir, "part").select((F.col("p_partkey") % 8).alias("case"), F.col("p_partkey").alias("link"), F.col("p_name").alias("concept"), (F.col("p_size") > 25).alias("supported"))
    return M.evidence_links(claims, findings, "case", "link", "concept")


@catalog.add(f"WITH {PREDICTED}, g AS (SELECT truth, avg(CAST(rank = 1 AS DOUBLE)) AS a FROM scored GROUP BY truth) SELECT count(*) AS groups, round(1 - (max(a) - min(a)) / max(a), 6) AS fairness FROM g")
def fairness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = predicted(spark, sf_dir).groupBy("truth").agg(F.avg((F.col("rank") == 1).cast("double")).alias("a"))
    return M.fairness(own, "truth", "a")


@catalog.add("""
WITH v AS (SELECT l_orderkey, round(avg(coalesce(l_quantity, 0)), 4) AS text_overall, round(avg(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_discount * 10 END), 4) AS morph FROM lineitem GROUP BY 1)
SELECT l_orderkey, text_overall, morph, CAST(round(CAST(0.5 * text_overall + 0.5 * 100.0 * morph AS DECIMAL(18, 6)), 2) AS DOUBLE) AS final_overall FROM v""")
def vote_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes as JSON with a nested path; one that isn't a number counts as 0."""
    vote = F.to_json(F.struct(F.struct(F.col("l_quantity").alias("overall")).alias("text"), F.when(F.col("l_returnflag") == "N", "n/a").otherwise((F.col("l_discount") * 10).cast("string")).alias("morph")))
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", vote.alias("vote"))
    own = own.groupBy("l_orderkey").agg(M.mean_vote(F.get_json_object("vote", "$.text.overall")).alias("text_overall"), M.mean_vote(F.get_json_object("vote", "$.morph")).alias("morph"))
    return own.withColumn("final_overall", F.round((0.5 * F.col("text_overall") + 0.5 * 100.0 * F.col("morph")).cast("decimal(18,6)"), 2).cast("double"))


@catalog.add("""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), l AS (SELECT CASE event_type WHEN 'error' THEN 'judge_invalid' WHEN 'signup' THEN 'model_failure' ELSE 'ok' END AS status, event_id % 4 AS rank, value FROM t WHERE n = 1),
v AS (SELECT *, status IN ('ok', 'model_failure') AS valid FROM l)
SELECT count(*) AS total, count(*) FILTER (valid) AS evaluated_total, round(count(*) FILTER (valid) / CAST(count(*) AS DOUBLE), 6) AS judge_coverage, round(avg(CASE WHEN valid THEN CAST(rank = 1 AS DOUBLE) END), 6) AS judge_top_1_accuracy,
  round(avg(CASE WHEN valid THEN CAST(rank BETWEEN 1 AND 3 AS DOUBLE) END), 6) AS judge_top_3_accuracy, round(avg(CASE WHEN valid THEN CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0.0 END END), 6) AS judge_mean_reciprocal_rank,
  round(avg(CASE WHEN valid THEN value END), 6) AS mean_value, count(*) FILTER (status = 'judge_safety_refusal') AS judge_safety_refusal_count, count(*) FILTER (status = 'judge_invalid') AS judge_invalid_count, count(*) FILTER (status = 'model_failure') AS model_failure_count FROM v""")
def judge_latest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = M.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    status = F.when(F.col("event_type") == "error", "judge_invalid").when(F.col("event_type") == "signup", "model_failure").otherwise("ok")
    return M.judge_metrics(own.select(status.alias("status"), (F.col("event_id") % 4).alias("rank"), "value"), "rank", "status", ["value"])


JUDGED = "(SELECT event_id, event_id % 4 AS r, CAST(value AS BIGINT) % 5 AS s, CASE user_id % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'mostly_correct' ELSE 'incorrect' END AS v, user_id % 2 AS c FROM (SELECT event_id, user_id, floor(value) AS value FROM events))"


@catalog.add(f"""
SELECT event_id, concat_ws(',', CASE WHEN r = 0 AND s > 2 THEN 'rank_0_score_over_2' END, CASE WHEN r = 0 AND v IN ('correct', 'mostly_correct') THEN 'rank_0_verdict_correct' END, CASE WHEN r = 1 AND s < 3 THEN 'rank_1_score_under_3' END,
  CASE WHEN r = 1 AND v = 'incorrect' THEN 'rank_1_verdict_incorrect' END, CASE WHEN r = 2 AND s <> 3 THEN 'rank_2_score_not_3' END, CASE WHEN r = 3 AND s <> 2 THEN 'rank_3_score_not_2' END,
  CASE WHEN v = 'correct' AND NOT (r = 1 AND s = 4) THEN 'correct_without_rank_1_and_score_4' END, CASE WHEN v = 'mostly_correct' AND r <> 1 THEN 'mostly_correct_without_rank_1' END, CASE WHEN c = 0 THEN 'examples_without_count' END) AS errors FROM {JUDGED}""")
def judgment_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, n = F.col("user_id"), F.col("event_id") % 4
    verdict = F.when(user % 3 == 0, "correct").when(user % 3 == 1, "mostly_correct").otherwise("incorrect")
    errors = P.judgment_errors(n, F.floor("value") % 5, verdict, user % 2, F.array(F.lit("claim")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(errors, ",").alias("errors"))


@catalog.add("""
SELECT conv_id, turn, CASE WHEN length(text) % 7 = 0 THEN 'truncated_output' WHEN role = 'system' THEN 'format_invalid' WHEN length(text) < 40 THEN 'schema_invalid' WHEN contains(text, '!') THEN 'semantic_noncompliant' ELSE 'ok' END AS status FROM conversations""")
def status_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    finish = F.when(F.length("text") % 7 == 0, "MAX_TOKENS").otherwise("stop")
    own = P.status(P.truncated(finish), F.col("role") != "system", F.length("text") >= 40, ~F.col("text").contains("!"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", own.alias("status"))


REPLY = "CASE event_id % 5 WHEN 0 THEN chr(65 + CAST(user_id % 6 AS INT)) WHEN 1 THEN chr(65 + CAST(user_id % 6 AS INT)) || ') because' WHEN 2 THEN 'I think the answer is ' || chr(97 + CAST(user_id % 6 AS INT)) || '.' WHEN 3 THEN 'none of these' ELSE ' ' || chr(65 + CAST(user_id % 6 AS INT)) || ': yes' END"


@catalog.add(f"""
WITH t AS (SELECT event_id, {REPLY} AS reply FROM events), u AS (SELECT event_id, trim(reply) AS t, regexp_extract(trim(reply), '^\\s*([A-Z])(?:\\s*[\\)\\].:\\-]|\\s|$)', 1) AS a, upper(regexp_extract(trim(reply), '(?i)\\b(?:answer|choice|option)\\s*(?:is|:)?\\s*([A-Z])\\b', 1)) AS b FROM t),
v AS (SELECT event_id, t, CASE WHEN a IN ('A', 'B', 'C', 'D') THEN a WHEN b IN ('A', 'B', 'C', 'D') THEN b END AS choice, CASE WHEN a IN ('A', 'B', 'C', 'D') THEN 'leading_choice_letter' WHEN b IN ('A', 'B', 'C', 'D') THEN 'explicit_answer_phrase' END AS rule FROM u)
SELECT event_id, choice, rule, coalesce(t = choice, false) AS strict FROM v""")
def mcq_choice_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, user = F.col("event_id") % 5, F.col("user_id") % 6
    upper, lower = F.char(user + 65), F.char(user + 97)
    reply = F.when(n == 0, upper).when(n == 1, F.concat(upper, F.lit(") because"))).when(n == 2, F.concat(F.lit("I think the answer is "), lower, F.lit("."))).when(n == 3, "none of these").otherwise(F.concat(F.lit(" "), upper, F.lit(": yes")))
    return table(spark, sf_dir, "events").select("event_id", P.mcq_choice(reply, "ABCD").alias("c")).select("event_id", "c.choice", "c.rule", "c.strict")


@catalog.add("""
SELECT page_id, trim(regexp_extract(html, '(?is)<title>\\s*(.*?)\\s*</title>', 1)) AS title, regexp_matches(html, '(?is)<nav>.*?</nav>.*?<article>.*?</article>') AS ordered, regexp_matches(html, '(?is)<article>.*?</article>.*?<nav>.*?</nav>') AS reversed FROM pages""")
def tag_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.trim(P.tag_block("html", "title")).alias("title"), P.ordered_tags("html", ["nav", "article"]).alias("ordered"), P.ordered_tags("html", ["article", "nav"]).alias("reversed"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all kinds, right and wrong, made from events."""
    good = F.concat(F.lit('{"predictions": [{"rank": 1, "disease_id": "'), F.col("event_type"), F.lit('"}, {"rank": 2, "disease_id": "other"}]}'))
    bare = F.concat(F.lit('{"predictions": ["'), F.col("event_type"), F.lit('", "other"]}'))
    n = F.col("event_id") % 6
    text = F.when(n == 0, good).when(n == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(n == 2, bare).when(n == 3, F.concat(F.lit("Sure: "), good)).when(n == 4, F.regexp_replace(good, "other", "unheard")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("reply"))


@catalog.add("""
SELECT event_id, event_id % 6 NOT IN (1, 3) AS raw_valid, event_id % 6 <> 3 AS recoverable, CASE WHEN event_id % 6 = 1 THEN 'single_json_fence' END AS recovery,
  CASE event_id % 6 WHEN 2 THEN '{"predictions": ["' || event_type || '", "other"]}' WHEN 3 THEN NULL WHEN 5 THEN props
    ELSE '{"predictions": [{"disease_id": "' || event_type || '", "rank": 1}, {"disease_id": "' || CASE WHEN event_id % 6 = 4 THEN 'unheard' ELSE 'other' END || '", "rank": 2}]}' END AS value FROM events""")
def strict_json_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = variants(spark, sf_dir).select("event_id", P.strict_json("reply").alias("j"))
    return own.select("event_id", "j.raw_valid", "j.recoverable", "j.recovery", "j.value")


@catalog.add("""
SELECT event_id, event_id % 6 = 0 AS schema_valid, event_id % 6 IN (0, 1, 2) AS canonical_valid FROM events""")
def ranked_output_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = variants(spark, sf_dir).select("event_id", P.ranked_output("reply", ["click", "error", "purchase", "signup", "view", "other"], 2).alias("r"))
    return own.select("event_id", "r.schema_valid", "r.canonical_valid")


LEXICON = {"in": ["in", "inin"], "the": ["the", "then"], "edat": ["ed at", "edat"]}


@catalog.add()
def lexicon_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(P.lexicon_concepts("text", LEXICON), ",").alias("concepts"))


@catalog.add(r"""
SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(token|secret)([^a-z0-9]|$)') THEN 'secrets' END, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])all\s+rights\s+reserved([^a-z0-9]|$)') THEN 'rights' END) AS categories FROM documents""")
def forbidden_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(P.terms_in("text", {"secrets": ["token", "secret"], "rights": ["all rights reserved"]}), ",").alias("categories"))


@catalog.add("""
SELECT role, count(*) AS n, round(avg(CAST(length(text) >= 40 AS DOUBLE)), 6) AS long_rate, round(avg(CAST(contains(text, '.') AS DOUBLE)), 6) AS sentence_rate FROM conversations GROUP BY role""")
def compliance_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rates(table(spark, sf_dir, "conversations"), ["role"], long_rate=F.length("text") >= 40, sentence_rate=F.col("text").contains("."))


@catalog.add("SELECT conv_id, turn, v AS voter FROM conversations, range(1, 4) r(v) WHERE role = 'assistant'")
def voter_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("voter"))


