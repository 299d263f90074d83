"""Builders of manifests from the shapes that image sources come in: a registry, open to more.

Each takes a session, a folder and its options, and gives a manifest by readers.manifest. An image that isn't where its row says is an error, told before anything is built on it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.functions import scalars as S
from cambium.sources import readers

BUILDERS: dict[str, Callable[..., DataFrame]] = {}


def builder(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def named(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        BUILDERS[name] = f
        return f

    return named


def resolved(rows: DataFrame, image: Column, places: DataFrame) -> DataFrame:
    """rows with uri by image name; places: (name, uri), names unique. Rows without a place are an error."""
    if twice := readers.unique_names(places).limit(1).collect():
        raise ValueError(f"{twice[0]['name']} is there twice")
    out = rows.withColumn("_name", image).join(places.withColumnRenamed("name", "_name"), "_name", "left")
    if lost := out.where("uri is null").limit(1).collect():
        raise ValueError(f"{lost[0]['_name']} isn't there")
    return out.drop("_name")


def in_archives(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return readers.zip_members(spark, paths).select("name", readers.zip_uri("archive", "member").alias("uri"))


def in_folder(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("path").alias("uri"))


def _common(prefix: str, image: Column) -> dict[str, Column]:
    return {"sample_id": S.stable_id(prefix, image), "original_image_id": image, "image_uri": F.col("uri")}


@builder("csv_and_archives")
def csv_and_archives(spark: SparkSession, csv: str, archives: str | Sequence[str], dataset: str, version: str, mapping: DataFrame, image: str = "image", label: str = "label", tone: str = "tone", patient: str | None = None, pathology: str | None = None) -> DataFrame:
    """A table whose images lie in archives; one group a patient where patients are told, else one an image; pathology where a flag says so."""
    rows = readers.csv(spark, csv, [c for c in (image, label, tone, patient, pathology) if c])
    own = resolved(rows, F.col(image), in_archives(spark, archives))
    basis = F.when(F.lower(F.col(pathology)).isin("true", "1", "yes"), "pathology").otherwise("clinical_consensus") if pathology else F.lit("atlas_label")
    group = S.first_of(*[c for c in (patient, image) if c])
    values = {**_common(dataset, F.col(image)), "group_id": F.concat_ws("_", F.lit(dataset), group), "disease_original": S.optional_text(label), "diagnosis_basis": basis, "skin_tone_system": F.lit("fitzpatrick"), "skin_tone": S.scale_value(tone, 1, 6)}
    return readers.manifest(own, dataset, version, values, mapping)


@builder("csv_and_folder")
def csv_and_folder(spark: SparkSession, csv: str, folder: str, dataset: str, version: str, mapping: DataFrame, image: str = "image", label: str = "label", number: str = "id") -> DataFrame:
    """A table whose images are files; ids are numbers filled up to six digits."""
    own = resolved(readers.csv(spark, csv, [image, label, number]), F.col(image), in_folder(spark, folder))
    padded = F.concat(F.lit(f"{dataset.upper()}_"), F.lpad(F.col(number), 6, "0"))
    return readers.manifest(own, dataset, version, {**_common(dataset, F.col(image)), "sample_id": padded, "group_id": padded, "disease_original": S.optional_text(label)}, mapping)


@builder("parquet_cases")
def parquet_cases(spark: SparkSession, path: str, dataset: str, version: str, mapping: DataFrame, images: Sequence[str], differential: str, gradable: Sequence[str] = (), age_code: str | None = None, case: str = "case_id") -> DataFrame:
    """Cases with several image columns and a weighted differential: a row for each image that is there; only the columns asked for are read."""
    wide = spark.read.parquet(path).select(case, *images, differential, *gradable, *([age_code] if age_code else []))
    long = wide.select("*", F.posexplode(F.array(*map(F.col, images))).alias("_i", "_image")).where("_image is not null")
    ranked = S.weighted_list(differential)
    key = S.plain_label(F.element_at(ranked, 1)["label"])
    values = {
        "sample_id": F.concat_ws("_", F.lit(dataset), F.col(case), F.col("_i")), "original_image_id": F.col("_image"), "original_case_id": F.col(case).cast("string"), "group_id": F.concat_ws("_", F.lit(dataset), F.col(case)), "image_uri": F.col("_image"),
        "disease_original": F.when(F.size(ranked) > 0, F.element_at(ranked, 1)["label"]), "diagnosis_basis": F.lit("dermatologist_differential"), "diagnosis_gradable": S.any_contains(list(gradable), "yes") if gradable else F.lit(True),
        "age_group_standardized": S.age_group(F.lit(None).cast("int"), age_code) if age_code else F.lit(None).cast("string"), "_ranked": ranked, "_key": key,
    }
    ids = F.broadcast(mapping.agg(F.map_from_entries(F.collect_list(F.struct("canonical_source_label", "disease_id"))).alias("_ids")))
    own = long.crossJoin(ids)
    items = F.transform(values.pop("_ranked"), lambda x: F.struct(x["label"].alias("disease_original"), F.try_element_at(F.col("_ids"), S.plain_label(x["label"])).alias("disease_id"), S.plain_label(x["label"]).alias("canonical_source_label"), F.when(F.try_element_at(F.col("_ids"), S.plain_label(x["label"])).isNull(), "unmapped").otherwise("mapped").alias("mapping_status"), x["rank"].cast("int").alias("rank"), x["weight"].alias("weight"), F.lit(dataset).alias("source")))
    values.pop("_key")
    values["reference_diagnoses"] = F.coalesce(items, F.array().cast(readers.relaxed(readers.MANIFEST["reference_diagnoses"].dataType)))
    return readers.manifest(own, dataset, version, values, mapping)


@builder("archive_folders")
def archive_folders(spark: SparkSession, archives: str | Sequence[str], dataset: str, version: str, mapping: DataFrame) -> DataFrame:
    """Archives whose folders name the labels; kept in the manifest, excluded as a whole."""
    own = readers.zip_members(spark, archives).withColumn("uri", readers.zip_uri("archive", "member"))
    parts = F.split("member", "/")
    label = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    out = readers.manifest(own, dataset, version, {**_common(dataset, F.col("member")), "group_id": F.col("member"), "disease_original": label}, mapping)
    return out.withColumn("exclusion_reason", F.coalesce("exclusion_reason", F.lit("source_excluded"))).withColumn("include", F.lit(False))


@builder("csv_in_archive")
def csv_in_archive(spark: SparkSession, archive: str, member: str, dataset: str, version: str, mapping: DataFrame, image: str = "image", label: str = "label", age: str = "age", root: str = "") -> DataFrame:
    """A table that lies in the archive with its images; only images under root count, which leaves derivatives out. A whole age is told in years, any age as its band."""
    wanted = spark.createDataFrame([(member,)], "member string")
    text = readers.zip_content(spark, archive, wanted).select(F.posexplode(F.split(F.decode("content", "utf-8"), r"\r?\n")).alias("n", "line")).where("line <> ''")
    names = next(iter(text.where("n = 0").collect()))["line"].split(",")
    rows = text.where("n > 0").select(F.from_csv("line", ", ".join(f"`{n.strip()}` string" for n in names)).alias("r")).select("r.*")
    places = in_archives(spark, archive).where(F.col("uri").contains(f"::{root}") & ~F.col("uri").endswith(member))
    own = resolved(rows, F.col(image), places)
    years = F.col(age).try_cast("double")
    values = {**_common(dataset, F.col(image)), "group_id": F.concat_ws("_", F.lit(dataset), F.col(image)), "disease_original": S.optional_text(label), "age_years": F.when(years == F.floor(years), years.cast("int")), "age_group_standardized": S.age_group(F.floor(years))}
    return readers.manifest(own, dataset, version, values, mapping)


@builder("captioned")
def captioned(spark: SparkSession, csv: str, dataset: str, version: str, mapping: DataFrame, excluded: str, strong: str, trusted: Sequence[str], evidenced: Sequence[str], archives: Mapping[str, str], missing: str = "none") -> DataFrame:
    """Captioned images of many sources: each row is judged by rules on its source and caption; also the rows that aren't selected are told, with their rule."""
    rows = readers.csv(spark, csv, ["filename", "source", "caption", "disease"])
    words = F.translate(F.concat_ws(" ", "filename", "caption"), "_", " ")
    rule = S.choice([("explicit_excluded", words.rlike(f"(?i){excluded}")), ("trusted_source", F.col("source").isin(*trusted)), ("strong_language", F.col("source").isin(*evidenced) & words.rlike(f"(?i){strong}"))], "insufficient_evidence")
    prefix = F.regexp_extract("filename", "^([^/_]+)", 1)
    archive = F.coalesce(S.lookup(archives, prefix), F.raise_error(F.concat(F.lit("no archive for "), F.col("filename"))).cast("string"))
    lineage = F.when(prefix == "youtube", F.regexp_extract("filename", "^(.*?)_frame_", 1)).when(prefix == "pubmed", F.regexp_extract("filename", "(PMC[0-9]+)", 1)).otherwise(F.regexp_replace("filename", r"(_[0-9]+)?\.[^.]+$", ""))
    own = rows.withColumn("uri", readers.zip_uri(archive, F.regexp_extract("filename", "^[^/]*/?(.*)$", 1))).withColumn("rule", rule)
    out = readers.manifest(own, dataset, version, {**_common(dataset, F.col("filename")), "group_id": S.stable_id("LINEAGE", F.concat_ws(":", prefix, lineage)), "disease_original": S.without_marker("disease", [missing]), "source_metadata": S.sorted_json({"rule": F.col("rule"), "source": F.col("source")})}, mapping)
    picked = F.get_json_object("source_metadata", "$.rule")
    return out.withColumn("exclusion_reason", F.when(picked.isin("trusted_source", "strong_language"), F.col("exclusion_reason")).otherwise(picked)).withColumn("include", F.col("exclusion_reason").isNull())


@builder("lesion_csv")
def lesion_csv(spark: SparkSession, csv: str, dataset: str, version: str, mapping: DataFrame, prefix: str = "clinical") -> DataFrame:
    """A table of lesions: only images of one type, grouped by patient, else lesion, else image."""
    rows = readers.csv(spark, csv, ["image", "image_type", "patient", "lesion", "diagnosis", "age"]).where(F.col("image_type").startswith(prefix)).withColumn("uri", F.col("image"))
    years = S.whole_number("age")
    values = {**_common(dataset, F.col("image")), "patient_id": S.optional_text("patient"), "group_id": F.concat_ws("_", F.lit(dataset), S.first_of("patient", "lesion", "image")), "disease_original": S.optional_text("diagnosis"), "age_years": years, "age_group_standardized": S.age_group(years)}
    return readers.manifest(rows, dataset, version, values, mapping)


def training_rows(manifest: DataFrame, role: str = "supervised") -> DataFrame:
    """A frozen manifest with the columns that a training corpus adds."""
    has = F.col("disease_id").isNotNull()
    task = S.choice([("none", F.col("disease_original").isNull()), ("mapped_diagnosis", has)], "unmapped_diagnosis")
    return manifest.withColumns({"training_role": F.lit(role), "training_task": task, "caption": F.lit(None).cast("string"), "screen": F.lit("kept"), "near_train": F.lit(False), "source_rule": F.lit("base")})
