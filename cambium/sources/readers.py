"""Scans: CSV and Parquet sources as manifests, JSON and JSONL, archives, locators of embedded bytes, task lists."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.functions import scalars as S

# The fields of a reference diagnosis.
DIAGNOSIS = T.StructType(
    [
        T.StructField("disease_original", T.StringType(), False),
        T.StructField("disease_id", T.StringType()),
        T.StructField("canonical_source_label", T.StringType(), False),
        T.StructField("mapping_status", T.StringType(), False),
        T.StructField("rank", T.IntegerType(), False),
        T.StructField("weight", T.DoubleType()),
        T.StructField("source", T.StringType(), False),
    ]
)
# The fields of a manifest in order, and which are never null.
MANIFEST = T.StructType(
    [
        T.StructField("schema_version", T.StringType(), False),
        T.StructField("sample_id", T.StringType(), False),
        T.StructField("dataset_id", T.StringType(), False),
        T.StructField("dataset_version", T.StringType(), False),
        T.StructField("original_image_id", T.StringType(), False),
        T.StructField("original_case_id", T.StringType()),
        T.StructField("patient_id", T.StringType()),
        T.StructField("group_id", T.StringType(), False),
        T.StructField("image_uri", T.StringType(), False),
        T.StructField("disease_original", T.StringType()),
        T.StructField("canonical_source_label", T.StringType()),
        T.StructField("disease_id", T.StringType()),
        T.StructField("reference_diagnoses", T.ArrayType(DIAGNOSIS, False), False),
        T.StructField("mapping_status", T.StringType(), False),
        T.StructField("diagnosis_basis", T.StringType(), False),
        T.StructField("diagnosis_gradable", T.BooleanType(), False),
        T.StructField("taxonomy_id", T.StringType(), False),
        T.StructField("taxonomy_version", T.StringType(), False),
        T.StructField("age_years", T.IntegerType()),
        T.StructField("age_group_source", T.StringType()),
        T.StructField("age_group_standardized", T.StringType()),
        T.StructField("age_source", T.StringType()),
        T.StructField("sex_or_gender", T.StringType()),
        T.StructField("sex_or_gender_system", T.StringType()),
        T.StructField("sex_or_gender_source", T.StringType()),
        T.StructField("race_ethnicity", T.StringType()),
        T.StructField("race_ethnicity_source", T.StringType()),
        T.StructField("skin_tone_system", T.StringType()),
        T.StructField("skin_tone", T.StringType()),
        T.StructField("skin_tone_source", T.StringType()),
        T.StructField("image_sha256", T.StringType()),
        T.StructField("perceptual_hash", T.StringType()),
        T.StructField("perceptual_hash_algorithm", T.StringType()),
        T.StructField("duplicate_group_id", T.StringType()),
        T.StructField("duplicate_match_type", T.StringType()),
        T.StructField("deduplication_status", T.StringType(), False),
        T.StructField("leakage_group_id", T.StringType(), False),
        T.StructField("license_id", T.StringType(), False),
        T.StructField("split", T.StringType()),
        T.StructField("split_version", T.StringType()),
        T.StructField("include", T.BooleanType(), False),
        T.StructField("exclusion_reason", T.StringType()),
        T.StructField("source_metadata", T.StringType(), False),
    ]
)


def relaxed(kind: T.DataType) -> T.DataType:
    """kind with null allowed inside it: what a cast can reach; what must not be null is checked on rows."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(relaxed(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, relaxed(f.dataType)) for f in kind])
    return kind


def csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV with a header as text columns, found by name; null where the file lacks one."""
    have = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return have.select(*[(F.col(f"`{c}`") if c in have.columns else F.lit(None).cast("string")).alias(c) for c in columns])


def shards(spark: SparkSession, directory: str, split: str) -> DataFrame:
    """All shards of a split; an error if there is none."""
    return spark.read.option("pathGlobFilter", f"{split}-*.parquet").option("recursiveFileLookup", True).parquet(directory)


def require(frame: DataFrame, columns: Sequence[str], name: str) -> None:
    if lacking := sorted(set(columns) - set(frame.columns)):
        raise ValueError(f"{name} lacks {', '.join(lacking)}")


def manifest(frame: DataFrame, dataset_id: str, version: str, values: Mapping[str, Column], mapping: DataFrame | None = None) -> DataFrame:
    """A source's rows as a manifest: values by field, the rest from what is the same for all. mapping: (canonical_source_label, disease_id), of a taxonomy's size.

    A row is excluded, with the first reason that holds, if its label is missing, isn't mapped or can't be graded.
    """
    own = frame.select(*[c.alias(n) for n, c in values.items()])
    label = S.plain_label(F.col("disease_original")) if "disease_original" in values else F.lit(None).cast("string")
    own = own.withColumn("canonical_source_label", label)
    if mapping is not None:
        own = own.join(F.broadcast(mapping.select("canonical_source_label", "disease_id")), "canonical_source_label", "left")
    constant = {"schema_version": "1.3.0", "dataset_id": dataset_id, "dataset_version": version, "diagnosis_basis": "unknown", "taxonomy_id": "taxonomy", "taxonomy_version": "1", "deduplication_status": "unique", "license_id": "unspecified"}
    for name, value in constant.items():
        if name not in own.columns:
            own = own.withColumn(name, F.lit(value))
    own = own.withColumn("diagnosis_gradable", F.coalesce(F.col("diagnosis_gradable"), F.lit(True)) if "diagnosis_gradable" in own.columns else F.lit(True))
    if "disease_id" not in own.columns:
        own = own.withColumn("disease_id", F.lit(None).cast("string"))
    told = F.col("disease_original").isNotNull() if "disease_original" in own.columns else F.lit(False)
    own = own.withColumn("mapping_status", S.choice([("no_label", ~told), ("unmapped", F.col("disease_id").isNull())], "mapped"))
    reason = S.choice([("missing_label", ~told), ("unmapped_label", F.col("disease_id").isNull()), ("not_gradable", ~F.col("diagnosis_gradable"))], None)
    own = own.withColumn("exclusion_reason", reason).withColumn("include", F.col("exclusion_reason").isNull()).withColumn("leakage_group_id", F.col("group_id"))
    if "reference_diagnoses" not in own.columns:
        one = F.struct(F.coalesce("disease_original", F.lit("")).alias("disease_original"), "disease_id", F.coalesce("canonical_source_label", F.lit("")).alias("canonical_source_label"), "mapping_status", F.lit(1).alias("rank"), F.lit(None).cast("double").alias("weight"), F.lit(dataset_id).alias("source")) if "disease_original" in own.columns else None
        none = F.array().cast(relaxed(T.ArrayType(DIAGNOSIS)))
        own = own.withColumn("reference_diagnoses", F.when(told, F.array(one)).otherwise(none) if one is not None else none)
    if "source_metadata" not in own.columns:
        own = own.withColumn("source_metadata", F.lit("{}"))
    return own.select(*[(F.col(f.name) if f.name in own.columns else F.lit(None)).cast(relaxed(f.dataType)).alias(f.name) for f in MANIFEST])


def zip_members(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(archive, member, name) of ZIP archives, read by Spark; members that leave their folder are an error."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for path, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if not n.endswith("/")]
                if any(n.startswith("/") or ".." in n.split("/") for n in names):
                    raise ValueError(f"{path} has a member outside of it")
                yield pd.DataFrame({"archive": [path] * len(names), "member": names, "name": [n.rsplit("/", 1)[-1] for n in names]})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(listed, "archive string, member string, name string")


def zip_content(spark: SparkSession, paths: Sequence[str] | str, wanted: DataFrame | None = None) -> DataFrame:
    """(archive, member, content), one archive at a time in a task; wanted: (member), few enough to be broadcast, else all."""
    names = None if wanted is None else {r["member"] for r in wanted.select("member").distinct().limit(1_000_001).collect()}
    if names is not None and len(names) > 1_000_000:
        raise ValueError("too many members to pick by name; read all and join")

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for path, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in z.namelist():
                        if not n.endswith("/") and (names is None or n in names):
                            yield pd.DataFrame({"archive": [path], "member": [n], "content": [z.read(n)]})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(unpacked, "archive string, member string, content binary")


def unique_names(members: DataFrame) -> DataFrame:
    """(name) of members that are there twice: what must be empty before names are looked up."""
    return members.groupBy("name").count().where(F.col("count") > 1).select("name")


def zip_uri(archive: Column | str, member: Column | str) -> Column:
    return F.concat(F.lit("zip://"), S.col(archive), F.lit("::"), S.col(member))


def locator(uri: Column | str) -> Column:
    """Struct of kind, path, member, row and column of a plain path, zip://a::m or parquet://f::row=i::column=c."""
    uri = S.col(uri)
    kind = F.when(uri.startswith("zip://"), "zip").when(uri.startswith("parquet://"), "parquet").otherwise("file")
    rest = F.regexp_replace(uri, "^(?:zip|parquet)://", "")
    return F.struct(
        kind.alias("kind"), F.element_at(F.split(rest, "::"), 1).alias("path"), F.when(kind == "zip", F.try_element_at(F.split(rest, "::"), F.lit(2))).alias("member"),
        F.when(kind == "parquet", F.regexp_extract(rest, "::row=([0-9]+)", 1).try_cast("long")).alias("row"), F.when(kind == "parquet", F.regexp_extract(rest, "::column=(.+)$", 1)).alias("column"),
    )


def json_rows(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Objects of a JSON array or of lines."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("multiLine", not path.endswith((".jsonl", ".ndjson"))).json(path)


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of JSON lines. A record that a crash cut off is left out: only a file's last line, without a line end, may be no JSON; elsewhere it is an error."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for file, content in zip(part["path"], part["content"], strict=True):
                text = content.decode()
                lines = text.split("\n")
                out = []
                for i, line in enumerate(lines):
                    if not line.strip():
                        continue
                    try:
                        json.loads(line)
                    except ValueError:
                        if i == len(lines) - 1:
                            continue
                        raise ValueError(f"{file}, line {i + 1}, is no JSON") from None
                    out.append((file, i + 1, line))
                yield pd.DataFrame(out, columns=["file", "line", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parsed, "file string, line long, value string")


def task_list(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, position) of a text file with an id a line; blank lines and those with # are none. Ids that are there twice are an error."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "id")).select("line", F.trim("id").alias("task_id"))
    own = [r["task_id"] for r in rows.where("task_id <> '' and task_id not like '#%'").orderBy("line").collect()]
    if len(set(own)) < len(own):
        raise ValueError(f"{path} has an id twice")
    return spark.createDataFrame(list(zip(own, range(len(own)), strict=True)), "task_id string, position long")


def cohort(frame: DataFrame, tasks: DataFrame, unit: str | None = None) -> DataFrame:
    """The listed tasks in their order; unknown tasks, and units of which only some tasks are listed, are an error."""
    out = frame.join(tasks, "task_id")
    if lacking := tasks.join(frame, "task_id", "left_anti").limit(1).collect():
        raise ValueError(f"unknown task {lacking[0]['task_id']}")
    if unit and (cut := frame.join(out.select(unit).distinct(), unit).join(tasks, "task_id", "left_anti").limit(1).collect()):
        raise ValueError(f"unit {cut[0][unit]} is listed in part")
    return out.orderBy("position")


def frozen(tasks: DataFrame, references: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks with their references, one to one; anything else is an error."""
    for frame, name in ((tasks, "tasks"), (references, "references")):
        if frame.groupBy(key).count().where(F.col("count") > 1).limit(1).count():
            raise ValueError(f"{name} has a {key} twice")
    if tasks.join(references, key, "left_anti").limit(1).count() or references.join(tasks, key, "left_anti").limit(1).count():
        raise ValueError(f"tasks and references differ in {key}")
    kept = [c for c in references.columns if c == key or c not in tasks.columns]
    return tasks.join(references.select(*kept), key)


def best_match(wanted: DataFrame, have: DataFrame, least: float = 0.8) -> DataFrame:
    """(path, found, how) for each wanted path: equal, else equal without case and punctuation, else the most similar of those with the same numbered suffix; two equally similar are none."""
    from difflib import SequenceMatcher

    norm = F.regexp_replace(F.lower("path"), "[^a-z0-9]", "")
    suffix = F.nullif(F.regexp_extract("path", r"(_[0-9]{5}_[0-9]{5}(?:_[0-9]+)?\.[A-Za-z0-9]+)$", 1), F.lit(""))
    w, h = wanted.select("path").distinct(), have.select(F.col("path").alias("found")).distinct()
    exact = w.join(h, w["path"] == h["found"]).select("path", "found", F.lit("exact").alias("how"))
    rest = w.join(exact, "path", "left_anti")
    plain = h.select("found", F.regexp_replace(F.lower("found"), "[^a-z0-9]", "").alias("n"))
    once = plain.groupBy("n").agg(F.min("found").alias("found"), F.count("*").alias("c")).where("c = 1").drop("c")
    normal = rest.withColumn("n", norm).join(once, "n").select("path", "found", F.lit("normalized").alias("how"))
    rest = rest.join(normal, "path", "left_anti")
    by = h.select("found", F.nullif(F.regexp_extract("found", r"(_[0-9]{5}_[0-9]{5}(?:_[0-9]+)?\.[A-Za-z0-9]+)$", 1), F.lit("")).alias("s"))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    near = rest.withColumn("s", suffix).join(by, "s").withColumn("r", alike("path", "found")).where(F.col("r") >= least)
    top = near.groupBy("path").agg(F.max("r").alias("r"))
    near = near.join(top, ["path", "r"]).groupBy("path").agg(F.min("found").alias("found"), F.count("*").alias("c")).where("c = 1").select("path", "found", F.lit("similar").alias("how"))
    return exact.unionByName(normal).unionByName(near)
