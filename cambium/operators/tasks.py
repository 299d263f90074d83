"""Task types: for each the contract of a response, as a column, and the metrics of a table of checked predictions. A registry, open to more."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.functions import responses as P
from cambium.functions import stats
from cambium.operators import scoring as M


@dataclass(frozen=True)
class Setting:
    """What a task's contract and metrics need: allowed ids, how many are ranked, concepts and their aliases."""

    diseases: tuple[str, ...] = ()
    k: int = 3
    concepts: Mapping[str, Sequence[str]] = field(default_factory=dict)
    forbidden: tuple[str, ...] = ()


@dataclass(frozen=True)
class Task:
    check: Callable[[Column, Setting], Column]
    score: Callable[[DataFrame, Setting], DataFrame]


def _ranked(text: Column, s: Setting) -> Column:
    return P.ranked_output(text, s.diseases, s.k)


def _evidence(text: Column, s: Setting) -> Column:
    diseases, lexicon, banned, k = frozenset(s.diseases), {c: tuple(a) for c, a in s.concepts.items()}, tuple(w.lower() for w in s.forbidden), s.k
    return P.checked(text, lambda t: P.check_evidence(t, diseases, set(lexicon), k, lambda w: P.concepts_in(w, lexicon), lambda w: any(b in w.lower() for b in banned)))


def _flat(fields: Mapping[str, Callable], relations: Mapping[str, Callable]) -> Callable[[Column, Setting], Column]:
    return lambda text, s: P.checked(text, lambda t: P.check_fields(t, fields, relations))


def _texts(most: int) -> Callable:
    return lambda x: isinstance(x, list) and len(x) <= most and all(isinstance(v, str) and v.strip() for v in x)


STATUS = ("answered", "abstained", "uncertain")
ABSTENTION = _flat(
    {"status": lambda x: x in STATUS, "visual_findings": _texts(8), "predictions": _texts(3), "confidence": P.is_share},
    {"abstained_without_predictions": lambda v: v["status"] != "abstained" or not v["predictions"], "answered_with_predictions": lambda v: v["status"] != "answered" or bool(v["predictions"]), "abstained_without_findings": lambda v: v["status"] != "abstained" or not v["visual_findings"]},
)
ANSWERABILITY = _flat({"status": lambda x: x in STATUS, "answer": lambda x: isinstance(x, str), "confidence": P.is_share}, {"answered_with_answer": lambda v: v["status"] != "answered" or bool(v["answer"].strip())})
COUNTERFACTUAL = _flat(
    {"status": lambda x: x in STATUS, "visual_findings": _texts(8), "predictions": _texts(3), "confidence": P.is_share},
    {"predictions_unique": lambda v: len(set(v["predictions"])) == len(v["predictions"]), "abstained_without_predictions": lambda v: v["status"] != "abstained" or not v["predictions"]},
)


def _choice(text: Column, s: Setting) -> Column:
    return P.mcq_choice(text, [chr(65 + i) for i in range(max(1, s.k))])


def _open(text: Column, s: Setting) -> Column:
    return F.struct((F.length(F.trim(text)) > 0).alias("valid"), F.length(F.trim(text)).alias("characters"))


def top_k(frame: DataFrame, s: Setting) -> DataFrame:
    """truth, ranked (null if not valid): one row."""
    own = frame.withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>"))).withColumn("_all", F.lit("all"))
    return M.ranking_metrics(own, ["_all"], "truth", "ranked", tuple(k for k in (1, 3, 6) if k <= s.k) or (1,)).drop("_all")


def by_condition(frame: DataFrame, s: Setting) -> DataFrame:
    """truth, ranked, condition: a row for each condition."""
    own = frame.withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))
    return M.ranking_metrics(own, ["condition"], "truth", "ranked", (1, 2))


def evidence(frame: DataFrame, s: Setting) -> DataFrame:
    """predicted, reference: arrays of concepts."""
    return M.set_metrics(frame, "predicted", "reference")


def abstention(frame: DataFrame, s: Setting) -> DataFrame:
    """status, n_predictions, n_findings, confidence, by condition: how often a model abstains, invents and is sure of it, with an interval of the first."""
    own = M.rates(
        frame, ["condition"], abstention=F.col("status") == "abstained", hallucination=(F.col("n_predictions") > 0) | (F.col("n_findings") > 0), overconfidence=(F.col("n_predictions") > 0) & (F.col("confidence") >= 0.75), valid=F.col("schema_valid")
    )
    low, high = stats.wilson(F.round(F.col("abstention") * F.col("n")), F.col("n"))
    return own.withColumns({"abstention_low": F.round(low, 6), "abstention_high": F.round(high, 6)})


def answerability(frame: DataFrame, s: Setting) -> DataFrame:
    """status, expected: accuracy of the status by condition; answers to what can't be answered are hallucinations."""
    unanswerable = F.col("expected") == "abstained"
    return frame.groupBy("condition").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("status") == F.col("expected")).cast("double")), 6).alias("status_accuracy"),
        F.round(stats.ratio(F.count_if(unanswerable & (F.col("status") == "answered")), F.count_if(unanswerable)), 6).alias("hallucination"), F.round(stats.ratio(F.count_if(unanswerable & (F.col("status") == "abstained")), F.count_if(unanswerable)), 6).alias("abstention"),
    )


def counterfactual(frame: DataFrame, s: Setting) -> DataFrame:
    """condition (pixel_shuffle or swap), status, ranked, target, source: abstention on what shows nothing, and on swaps the new label found or the old one kept."""
    swap, shuffled = F.col("condition") == "swap", F.col("condition") == "pixel_shuffle"
    rank, old = M.rank_of(F.col("target"), F.col("ranked")), M.rank_of(F.col("source"), F.col("ranked"))
    right = F.when(swap, rank == 1).otherwise(F.col("status") == "abstained")
    return frame.agg(
        F.count("*").alias("n"), F.round(stats.ratio(F.count_if(shuffled & (F.col("status") == "abstained")), F.count_if(shuffled)), 6).alias("shuffled_abstention"), F.round(stats.ratio(F.count_if(swap & (rank == 1)), F.count_if(swap)), 6).alias("swap_top_1"),
        F.round(stats.ratio(F.count_if(swap & rank.between(1, 3)), F.count_if(swap)), 6).alias("swap_top_3"), F.round(stats.ratio(F.count_if(swap & (old == 1)), F.count_if(swap)), 6).alias("source_persistence"), F.round(stats.ratio(F.count_if(right), F.count("*")), 6).alias("full_success"),
    )


def choices(frame: DataFrame, s: Setting) -> DataFrame:
    """choice, strict, truth: valid and strict shares, accuracy over all."""
    return M.rates(frame.withColumn("_all", F.lit(1)), ["_all"], valid=F.col("choice").isNotNull(), strict=F.col("strict"), accuracy=F.col("choice") == F.col("truth")).drop("_all")


def free_text(frame: DataFrame, s: Setting) -> DataFrame:
    return frame.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(F.coalesce(F.col("valid"), F.lit(False)).cast("double")), F.lit(0.0)), 6).alias("response_rate"), F.round(F.coalesce(F.avg(F.when(F.col("valid"), F.col("characters"))), F.lit(0.0)), 4).alias("mean_characters"))


TASKS: dict[str, Task] = {
    "visual_top_k": Task(_ranked, top_k),
    "confusion_sets": Task(_ranked, by_condition),
    "clinical_context_ablation": Task(_ranked, by_condition),
    "evidence_grounded_diagnosis": Task(_evidence, evidence),
    "open_ended_diagnosis": Task(_open, free_text),
    "visual_grounding_no_image": Task(ABSTENTION, abstention),
    "general_visual_hallucination": Task(ANSWERABILITY, answerability),
    "counterfactual_hallucination": Task(COUNTERFACTUAL, counterfactual),
    "multiple_choice": Task(_choice, choices),
}
