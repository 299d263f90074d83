"""Joins with what they assume told as errors: one to one, complete, by wide flags, fanned out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.functions import scalars as S


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", complete: bool = False) -> DataFrame:
    """left joined to right by keys that both have once; complete: every row of left has a partner."""
    for frame, name in ((left, "left"), (right, "right")):
        if twice := frame.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect():
            raise ValueError(f"the {name} side has {[twice[0][k] for k in keys]} twice")
    if complete and (lost := left.join(right, list(keys), "left_anti").limit(1).collect()):
        raise ValueError(f"{[lost[0][k] for k in keys]} has no partner")
    return left.join(right, list(keys), how)


def flag_columns(columns: Sequence[str], names: Mapping[str, str]) -> dict[str, str]:
    """Which of a wide table's columns stands for which id: by letters and digits alone; each id needs exactly one."""
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    found: dict[str, list[str]] = {i: [c for c in columns if plain(c) == plain(n)] for i, n in names.items()}
    if wrong := {i: f for i, f in found.items() if len(f) != 1}:
        raise ValueError(f"columns by id: {wrong}")
    return {i: f[0] for i, f in found.items()}


def with_evidence(source: DataFrame, annotations: DataFrame, captions: DataFrame, key: str, flags: Mapping[str, str], caption: str, how: str = "left") -> DataFrame:
    """source with the ids that an annotation's flags of 1 name, their number, a caption, and which scores each row can take part in."""
    wide = annotations.select(key, S.selected({i: F.col(f"`{c}`").cast("int") == 1 for i, c in flags.items()}).alias("concept_ids"))
    out = one_to_one(one_to_one(source, wide, [key], how), captions.select(key, F.col(caption).alias("reference_description")), [key], "left")
    named, told = F.col("concept_ids").isNotNull(), S.optional_text("reference_description").isNotNull()
    return out.withColumns({"concept_count": F.coalesce(F.size("concept_ids"), F.lit(0)).cast("short"), "score_concepts": named, "score_description": named & told, "score_diagnosis": F.col("disease_id").isNotNull() if "disease_id" in out.columns else F.lit(False)})


def units(tasks: DataFrame, references: DataFrame, key: str, unit: str, strata: Sequence[str], size: int) -> DataFrame:
    """One row a unit with its stratum; a unit that hasn't size tasks, or whose tasks differ in stratum, is an error."""
    own = one_to_one(tasks, references, [key], complete=True).withColumn("stratum", F.concat_ws("|", *strata))
    out = own.groupBy(unit).agg(F.count("*").alias("n"), F.min("stratum").alias("stratum"), F.max("stratum").alias("_other"))
    if wrong := out.where((F.col("n") != size) | (F.col("stratum") != F.col("_other"))).limit(1).collect():
        raise ValueError(f"unit {wrong[0][unit]} isn't whole")
    return out.select(unit, "stratum")


def fanned(frame: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Each row once for each value."""
    return frame.withColumn(column, F.explode(F.array(*map(F.lit, values))))


def split_by(frame: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is listed, and the others."""
    return frame.join(ids.select(key), key, "left_semi"), frame.join(ids.select(key), key, "left_anti")
