"""Which images of an external benchmark were trained on, and the benchmark without their tasks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a rule's value is sought among: training images' digests, their ids in one source, or their leakage groups.
DIGESTS, IDS, GROUPS = "image_sha256", "source_image_id", "leakage_group_id"


@dataclass(frozen=True)
class Rule:
    """reason holds for an image of the folder prefix (any, if None) whose value is in among, of source only where that is given; a null value is in nothing."""

    reason: str
    value: Column
    among: str
    prefix: str | None = None
    source: str | None = None


def folder(image: Column) -> Column:
    return F.lower(F.substring_index(image, "/", 1))


def name(image: Column) -> Column:
    return F.substring_index(image, "/", -1)


def stem(image: Column) -> Column:
    """The name without its last extension; a leading dot begins none."""
    return F.regexp_replace(name(image), r"(?<=.)\.[^.]*$", "")


def skin_rules(image: Column, case_group: Column, patient_group: Column) -> list[Rule]:
    """The six rules; case_group and patient_group are what an index of cases, and of patients, tells for an image's name."""
    # Reasons, folders, sources and how a patient's group is named.
    patient = F.upper(F.regexp_extract(stem(image), r"(?i)^(PAT_[^_]+)_", 1))
    return [
        Rule("exact_image_sha256", F.col("image_sha256"), DIGESTS),
        Rule("fitzpatrick17k_c_source_image_id", F.lower(stem(image)), IDS, "f17k", "fitzpatrick17k_c"),
        Rule("scin_case_group", case_group, GROUPS, "scin"),
        Rule("pad_ufes_20_source_image_id", F.lower(name(image)), IDS, "pad", "pad_ufes_20"),
        Rule("pad_ufes_20_patient_group", F.when(patient != "", F.concat(F.lit("PAD_UFES_20_PATIENT_"), patient)), GROUPS, "pad"),
        Rule("hiba_patient_group", patient_group, GROUPS, "isic"),
    ]


def image_audit(images: DataFrame, train: DataFrame, rules: list[Rule]) -> DataFrame:
    """(image, image_sha256, reasons) for each distinct image, reasons in alphabetic order. train has image_sha256, source, source_image_id, leakage_group_id; ids are
    compared in lower case. Each rule is a semi-join on whole values; what they find is gathered by image, of which each rule gives one row at most."""
    own = images.withColumn("_folder", folder(F.col("image")))

    def hits(rule: Rule) -> DataFrame:
        asked = own if rule.prefix is None else own.where(F.col("_folder") == rule.prefix)
        held = train if rule.source is None else train.where(F.col("source") == rule.source)
        held = held.select((F.lower(rule.among) if rule.among == IDS else F.col(rule.among)).alias("_value")).distinct()
        return asked.select("image", rule.value.alias("_value")).join(held, "_value", "left_semi").select("image", F.lit(rule.reason).alias("reason"))

    found = reduce(DataFrame.unionByName, map(hits, rules)).groupBy("image").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return images.select("image", "image_sha256").distinct().join(found, "image", "left").select("image", "image_sha256", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def without(tasks: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of tasks (file, task_id, image, ...): those whose image has no reason, those that go with why, and a record for each file. A task whose image isn't audited is an error."""
    if tasks.join(audit, "image", "left_anti").limit(1).count():
        raise ValueError("tasks name images that weren't audited")
    told = tasks.join(audit.select("image", "image_sha256", "reasons"), "image")
    kept, gone = told.where(F.size("reasons") == 0).select(*tasks.columns), told.where(F.size("reasons") > 0).select("file", "task_id", "image", "image_sha256", "reasons")
    stays = F.size("reasons") == 0
    ids = F.coalesce(F.col("task_id").cast("string"), F.lit(""))
    record = told.groupBy("file").agg(
        F.count("*").alias("upstream_rows"), F.count_if(~stays).alias("excluded_rows"), F.count_if(stays).alias("evaluation_rows"),
        (F.count_if(stays) - F.count_distinct(F.when(stays, ids))).alias("duplicate_task_id_count"),
    )
    return kept, gone, record


def filtered_faults(kept: DataFrame, gone: DataFrame, record: DataFrame) -> list[str]:
    """What is wrong with a filtered benchmark: counts that differ from its record, and tasks that should have gone."""
    ids = F.coalesce(F.col("task_id").cast("string"), F.lit(""))
    now = kept.groupBy("file").agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct(ids)).alias("again"))
    both = record.join(now, "file", "full").where(~F.coalesce("evaluation_rows", F.lit(0)).eqNullSafe(F.coalesce("rows", F.lit(0))) | ~F.coalesce("duplicate_task_id_count", F.lit(0)).eqNullSafe(F.coalesce("again", F.lit(0))))
    out = [f"{r['file']}: counts" for r in both.select("file").orderBy("file").collect()]
    left = kept.join(gone.select("file", "task_id").distinct(), ["file", "task_id"], "left_semi").select("file").distinct().orderBy("file").collect()
    return out + [f"{r['file']}: excluded task remains" for r in left]
