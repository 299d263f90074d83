"""Sinks: manifests, numbered shards, checksums, release documents, run records."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.functions.responses import canonical_json
from cambium.operators.cohorts import chunked, union_all
from cambium.sources.readers import MANIFEST, relaxed

TERMINAL = ("ok", "truncated_output", "format_invalid", "schema_invalid", "semantic_noncompliant")


def conformed(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """frame's columns as schema has them, in its order; a missing column or one that can't be cast is an error."""
    return frame.select(*[F.col(f.name).cast(relaxed(f.dataType)).alias(f.name) for f in schema])


def write_manifest(frame: DataFrame, path: str, schema: T.StructType = MANIFEST) -> int:
    """Parquet in zstd; the row count. Columns that must not be null are checked in the same count."""
    own = conformed(frame, schema)
    own.write.mode("overwrite").option("compression", "zstd").parquet(path)
    back = own.sparkSession.read.parquet(path)
    need = [f.name for f in schema if not f.nullable]
    row = back.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in need]).first()
    if bad := [c for c in need if row[c]]:
        raise ValueError(f"null in {', '.join(bad)}")
    return row["n"]


def write_pool(spark: SparkSession, paths: Sequence[str], path: str) -> int:
    """Manifests of several sources as one."""
    return write_manifest(union_all([spark.read.parquet(p) for p in paths]), path)


def write_shards(frame: DataFrame, path: str, split: str, order: str, size: int = 512) -> DataFrame:
    """Shards of size rows in the order of a unique column, one folder each; (shard, rows, sha256) of each. The digest is of its rows' digests in order, so it doesn't depend on how a file is written."""
    own = chunked(frame, size, order)
    total = own.agg(F.max("batch")).first()[0]
    own = own.withColumn("shard", F.format_string(f"{split}-%05d-of-{(total or 0) + 1:05d}", "batch")).drop("batch")
    own.repartition("shard").sortWithinPartitions("shard", order).write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(path)
    return shard_records(own.sparkSession.read.parquet(path), order)


def file_records(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, bytes, sha256) of the files under a folder, as they lie there. Files are read whole, one a row, so they must be under 2 GB each, as shards are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def shard_files(spark: SparkSession, path: str, order: str) -> DataFrame:
    """(shard, rows, sha256, file, bytes, file_sha256): what shard_records tells of each shard's rows, and file_records of its file. A shard of other than one file is an error."""
    files = file_records(spark, path).withColumn("shard", F.regexp_extract("path", r"shard=([^/]+)/[^/]*$", 1))
    if files.groupBy("shard").count().where("count <> 1").limit(1).count():
        raise ValueError("a shard is not one file")
    rows = shard_records(spark.read.parquet(path), order)
    return rows.join(files.select("shard", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"), "bytes", F.col("sha256").alias("file_sha256")), "shard")


def shard_records(frame: DataFrame, order: str, shard: str = "shard") -> DataFrame:
    """A shard is of bounded size, so its rows' digests are gathered."""
    columns = [c for c in frame.columns if c != shard]
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
    rows = frame.select(shard, F.col(order).alias("_o"), row.alias("_h")).groupBy(shard).agg(F.array_sort(F.collect_list(F.struct("_o", "_h"))).alias("_r"))
    return rows.select(shard, F.size("_r").cast("long").alias("rows"), F.sha2(F.array_join(F.transform("_r", lambda x: x["_h"]), "\n"), 256).alias("sha256"))


def release_document(name: str, version: str, seed: object, artifacts: Mapping[str, DataFrame], integrity: DataFrame) -> dict:
    """Names, checksums of artifacts' shards, and whether no rule is broken."""
    broken = {r["rule"]: r["violations"] for r in integrity.where("violations > 0").collect()}
    own = {k: {r["shard"]: {"rows": r["rows"], "sha256": r["sha256"]} for r in df.collect()} for k, df in artifacts.items()}
    body = {"name": name, "version": version, "seed": seed, "artifacts": own, "integrity_passed": not broken, "violations": broken}
    return body | {"identity": sha256(canonical_json(body).encode()).hexdigest()}


def validate_release(document: Mapping, artifacts: Mapping[str, DataFrame]) -> list[str]:
    """What differs from a release document: shards that are missing, new or changed, and broken integrity."""
    out = [] if document["integrity_passed"] else ["integrity"]
    for name, df in artifacts.items():
        now = {r["shard"]: {"rows": r["rows"], "sha256": r["sha256"]} for r in df.collect()}
        then = document["artifacts"].get(name, {})
        out += [f"{name}/{s}" for s in sorted(now.keys() | then.keys()) if now.get(s) != then.get(s)]
    return out


def isolated(tasks: DataFrame, answers: Sequence[str]) -> list[str]:
    """Columns of answers that a task view shows."""
    return sorted(set(tasks.columns) & set(answers))


def append_records(frame: DataFrame, path: str, run: str) -> None:
    """Records of a run, added as JSON lines in a folder of the run."""
    frame.write.mode("append").json(f"{path}/run={run}")


def completed(records: DataFrame, task: str = "task_id", status: str = "status") -> DataFrame:
    return records.where(F.col(status).isin(*TERMINAL)).select(task).distinct()


def pending(tasks: DataFrame, records: DataFrame, task: str = "task_id") -> DataFrame:
    """Tasks without a terminal record: what a resumed run has left to do."""
    return tasks.join(completed(records, task), task, "left_anti")


def replaced_columns(frame: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """frame with updates' columns in place of its own, by key; keys that either lacks, or that updates has twice, are an error. The order of rows doesn't matter."""
    changed = [c for c in updates.columns if c != key]
    if updates.groupBy(key).count().where(F.col("count") > 1).limit(1).count() or frame.join(updates, key, "left_anti").limit(1).count() or updates.join(frame, key, "left_anti").limit(1).count():
        raise ValueError(f"updates don't fit by {key}")
    return frame.drop(*changed).join(updates, key).select(*frame.columns, *[c for c in changed if c not in frame.columns])


def dumps(document: Mapping) -> str:
    return json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False)
