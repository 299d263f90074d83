"""Deterministic metrics of predictions: rankings, sets, calibration, subgroups, pairs, votes, judgments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cambium.functions import stats

# What scores of a judged answer are called.
RUBRIC = ("diagnosis_correctness", "visual_findings_correctness", "evidence_grounding", "clinical_rationale_quality", "differential_quality")


def rank_of(truth: Column, ranked: Column) -> Column:
    """Place of the truth in a ranked array, 0 if it isn't there."""
    return F.coalesce(F.array_position(ranked, truth), F.lit(0)).cast("long")


def top_k(rank: Column, k: int) -> Column:
    return rank.between(1, k).cast("double")


def reciprocal(rank: Column) -> Column:
    return F.when(rank > 0, 1.0 / rank).otherwise(0.0)


def ranking_metrics(frame: DataFrame, by: Sequence[str], truth: str, ranked: str, ks: Sequence[int] = (1, 3, 6)) -> DataFrame:
    """Accuracy within the first k and mean reciprocal rank of each group."""
    own = frame.withColumn("_rank", rank_of(F.col(truth), F.col(ranked)))
    return own.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(top_k(F.col("_rank"), k)), 6).alias(f"top_{k}") for k in ks], F.round(F.avg(reciprocal(F.col("_rank"))), 6).alias("mrr"))


def label_counts(frame: DataFrame, labels: DataFrame, label: str, truth: str, prediction: str) -> DataFrame:
    """(label, tp, fp, fn) for every given label, also those never met. A null prediction is no label."""
    hit = F.col(truth).eqNullSafe(F.col(prediction))
    by_truth = frame.groupBy(F.col(truth).alias(label)).agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fn"))
    by_guess = frame.where(F.col(prediction).isNotNull()).groupBy(F.col(prediction).alias(label)).agg(F.count_if(~hit).alias("fp"))
    out = labels.select(label).join(by_truth, label, "left").join(by_guess, label, "left")
    return out.select(label, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])


def macro_f1(counts: DataFrame) -> DataFrame:
    """One row: mean F1 over labels, 0 of none."""
    return counts.agg(F.round(F.coalesce(F.avg(stats.f1(F.col("tp"), F.col("fp"), F.col("fn"))), F.lit(0.0)), 6).alias("macro_f1"), F.count("*").alias("labels"))


def subgroup_accuracy(frame: DataFrame, group: str, hit: str, unit: str, label: str, least_units: int, least_label_units: int, level: float = 0.95) -> DataFrame:
    """Accuracy of each group with its interval, distinct units, whether they suffice, and the mean accuracy over labels with enough units."""
    own = frame.groupBy(group).agg(F.count("*").alias("n"), F.sum(hit).cast("long").alias("hits"), F.count_distinct(unit).alias("units"))
    low, high = stats.wilson(F.col("hits"), F.col("n"), level)
    by_label = frame.groupBy(group, label).agg(F.avg(hit).alias("a"), F.count_distinct(unit).alias("u")).where(F.col("u") >= least_label_units)
    adjusted = by_label.groupBy(group).agg(F.round(F.avg("a"), 6).alias("label_adjusted"), F.count("*").alias("labels"))
    out = own.join(adjusted, own[group].eqNullSafe(adjusted[group]), "left").drop(adjusted[group])
    return out.select(
        group, "n", "hits", "units", F.round(stats.ratio(F.col("hits"), F.col("n")), 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"),
        ((F.col("units") >= least_units) & (F.col(group) != "unknown")).alias("supported"), "label_adjusted", F.coalesce("labels", F.lit(0)).cast("long").alias("labels"),
    )


def paired(frame: DataFrame, pair: str, condition: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row a pair with a column for each condition, and complete: each is there once."""
    own = frame.groupBy(pair).pivot(condition, list(names)).agg(F.max(value).alias("v"), F.count(F.lit(1)).alias("n"))
    whole = F.lit(True)
    for n in names:
        whole = whole & (F.coalesce(F.col(f"{n}_n"), F.lit(0)) == 1)
    return own.select(pair, *[F.col(f"{n}_v").alias(n) for n in names], whole.alias("complete"))


def transitions(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Counts of pairs that improved, worsened and stayed, with the mean difference and an exact p value."""
    out = pairs.agg(
        F.count("*").alias("pairs"), F.count_if(F.col(after) > F.col(before)).alias("improved"), F.count_if(F.col(after) < F.col(before)).alias("worsened"), F.count_if(F.col(after) == F.col(before)).alias("unchanged"),
        F.round(F.avg(F.col(after) - F.col(before)), 6).alias("delta"),
    )
    return out


def set_metrics(frame: DataFrame, predicted: str, reference: str) -> DataFrame:
    """Sample means of precision, recall and F1, and micro F1."""
    p, r, f = stats.set_scores(F.col(predicted), F.col(reference))
    tp = F.size(F.array_intersect(predicted, reference))
    fp, fn = F.size(F.array_except(predicted, reference)), F.size(F.array_except(reference, predicted))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return frame.agg(F.count("*").alias("n"), mean(p).alias("precision"), mean(r).alias("recall"), mean(f).alias("f1"), F.round(stats.f1(F.sum(tp), F.sum(fp), F.sum(fn)), 6).alias("micro_f1"))


def concept_counts(frame: DataFrame, predicted: str, reference: str, concept: str) -> DataFrame:
    """(concept, tp, fp, fn) over the rows' sets."""
    both = frame.select(F.explode(F.array_union(predicted, reference)).alias(concept), predicted, reference)
    p, r = F.array_contains(predicted, F.col(concept)), F.array_contains(reference, F.col(concept))
    return both.groupBy(concept).agg(F.count_if(p & r).alias("tp"), F.count_if(p & ~r).alias("fp"), F.count_if(r & ~p).alias("fn"))


def calibration(frame: DataFrame, confidence: str, hit: str, bins: int = 10) -> DataFrame:
    """One row: expected calibration error over equal bins and Brier score. A confidence of 1 lies in the last bin; others than 0 to 1 are left out."""
    own = frame.where(F.col(confidence).between(0, 1) & ~F.isnan(confidence))
    own = own.withColumn("_bin", F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)))
    parts = own.groupBy("_bin").agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(hit).alias("a"), F.sum((F.col(confidence) - F.col(hit)) * (F.col(confidence) - F.col(hit))).alias("b"))
    return parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(stats.ratio(F.sum(F.abs(F.col("c") - F.col("a")) * F.col("n")), F.sum("n")), 6).alias("ece"), F.round(stats.ratio(F.sum("b"), F.sum("n")), 6).alias("brier")
    )


def evidence_links(claims: DataFrame, findings: DataFrame, case: str, link: str, concept: str) -> DataFrame:
    """One row: links, those that resolve to a finding of their case, and those whose finding is supported."""
    own = claims.join(findings, [case, link], "left")
    return own.agg(
        F.count("*").alias("links"), F.count(concept).alias("resolved"), F.count_if("supported").alias("supported"), F.round(stats.ratio(F.count(concept), F.count("*")), 6).alias("resolution_rate"),
        F.round(stats.ratio(F.count_if("supported"), F.count(concept)), 6).alias("visible_precision"),
    )


def fairness(groups: DataFrame, group: str, accuracy: str) -> DataFrame:
    """One row: 1 - (max - min) / max over the known groups; 1 of one group or none, 0 if all are 0."""
    own = groups.where(F.coalesce(F.col(group), F.lit("unknown")) != "unknown")
    out = own.agg(F.count("*").alias("groups"), F.max(accuracy).alias("high"), F.min(accuracy).alias("low"))
    return out.select("groups", F.round(F.when(F.col("groups") <= 1, 1.0).when(F.col("high") <= 0, 0.0).otherwise(1 - (F.col("high") - F.col("low")) / F.col("high")), 6).alias("fairness"))


def mean_vote(value: Column) -> Column:
    """Mean of votes, where one that isn't a number is 0; rounded to 4 digits."""
    return F.round(F.avg(F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))), 4)


def latest(frame: DataFrame, key: str, *order: str) -> DataFrame:
    """The last record of each key in an order that ends in a unique column."""
    own = frame.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])))
    return own.where("_n = 1").drop("_n")


def judge_metrics(records: DataFrame, rank: str, status: str, fields: Sequence[str] = RUBRIC) -> DataFrame:
    """One row over latest records: coverage, accuracy of ranks (0 is a miss), mean rubric scores."""
    valid = F.col(status).isin("ok", "model_failure")
    r = F.when(valid, F.col(rank))
    return records.agg(
        F.count("*").alias("total"), F.count_if(valid).alias("evaluated_total"), F.round(stats.ratio(F.count_if(valid), F.count("*")), 6).alias("judge_coverage"),
        F.round(F.coalesce(F.avg(top_k(r, 1)), F.lit(0.0)), 6).alias("judge_top_1_accuracy"), F.round(F.coalesce(F.avg(top_k(r, 3)), F.lit(0.0)), 6).alias("judge_top_3_accuracy"),
        F.round(F.coalesce(F.avg(F.when(valid, reciprocal(r))), F.lit(0.0)), 6).alias("judge_mean_reciprocal_rank"),
        *[F.round(F.coalesce(F.avg(F.when(valid, F.col(f).cast("double"))), F.lit(0.0)), 6).alias(f"mean_{f}") for f in fields],
        F.count_if(F.col(status) == "judge_safety_refusal").alias("judge_safety_refusal_count"), F.count_if(F.col(status) == "judge_invalid").alias("judge_invalid_count"), F.count_if(F.col(status) == "model_failure").alias("model_failure_count"),
    )


def rates(frame: DataFrame, by: Sequence[str], **flags: Column) -> DataFrame:
    """Row count and the share of each flag, null as false."""
    return frame.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0)), 6).alias(name) for name, c in flags.items()])
