"""Readers, sinks, releases and the stream, over files written for them."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from cambium.functions import scalars as S
from cambium.sources import readers, release
from cambium.streaming import records


def test_manifest_of_a_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text('image,label,age,tone\na.png,"Seborrheic-Keratosis",72,3\nb.png,Strange,,9\nc.png,,5,\n')
    own = readers.csv(spark, str(tmp_path / "s.csv"), ["image", "label", "age", "tone", "absent"])
    assert own.columns[-1] == "absent" and own.where("absent is not null").count() == 0
    mapping = spark.createDataFrame([("seborrheic keratosis", "D007")], "canonical_source_label string, disease_id string")
    years = S.whole_number("age")
    values = {
        "sample_id": S.stable_id("X", "image"), "original_image_id": F.col("image"), "group_id": F.col("image"), "image_uri": readers.zip_uri(F.lit("a.zip"), "image"), "disease_original": S.optional_text("label"),
        "age_years": years, "age_group_standardized": S.age_group(years), "skin_tone": S.scale_value("tone", 1, 6),
    }
    out = readers.manifest(own, "x", "1", values, mapping)
    assert release.write_manifest(out, str(tmp_path / "m")) == 3
    got = {r["original_image_id"]: r for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert got["a.png"]["include"] and got["a.png"]["disease_id"] == "D007" and got["a.png"]["age_group_standardized"] == "70_and_over" and got["a.png"]["reference_diagnoses"][0]["rank"] == 1 and got["a.png"]["image_uri"] == "zip://a.zip::a.png"
    assert got["b.png"]["exclusion_reason"] == "unmapped_label" and got["b.png"]["skin_tone"] is None and got["c.png"]["exclusion_reason"] == "missing_label" and got["c.png"]["reference_diagnoses"] == []
    assert spark.read.parquet(str(tmp_path / "m")).columns == [f.name for f in readers.MANIFEST]
    assert release.write_pool(spark, [str(tmp_path / "m")] * 2, str(tmp_path / "pool")) == 6
    with pytest.raises(ValueError, match="sample_id"):
        release.write_manifest(out.withColumn("sample_id", F.lit(None).cast("string")), str(tmp_path / "bad"))


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/1.txt", "one")
        z.writestr("y/1.txt", "two")
        z.writestr("y/2.txt", "three")
    members = readers.zip_members(spark, str(tmp_path / "*.zip"))
    assert members.count() == 3 and [r["name"] for r in readers.unique_names(members).collect()] == ["1.txt"]
    some = readers.zip_content(spark, str(tmp_path / "a.zip"), spark.createDataFrame([("y/2.txt",)], "member string")).collect()
    assert [bytes(r["content"]) for r in some] == [b"three"]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../out.txt", "no")
    with pytest.raises(Exception, match="outside"):
        readers.zip_members(spark, str(tmp_path / "b.zip")).count()


def test_locators(spark):
    uris = ["a/b.png", "zip://a.zip::m/1.png", "parquet://p.parquet::row=7::column=image"]
    got = [tuple(r["l"]) for r in spark.createDataFrame([(u,) for u in uris], "u string").select(readers.locator("u").alias("l")).collect()]
    assert [g[:3] for g in got] == [("file", "a/b.png", None), ("zip", "a.zip", "m/1.png"), ("parquet", "p.parquet", None)] and got[2][3:] == (7, "image")


def test_json_lines_cut_off_at_the_end(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"task_id": 1}\n{"task')
    assert [json.loads(r["value"]) for r in readers.jsonl(spark, str(tmp_path / "a.jsonl")).collect()] == [{"task_id": 1}]
    (tmp_path / "b.jsonl").write_text('{"task_id": 1}\n{"task\n{"task_id": 2}\n')
    with pytest.raises(Exception, match="line 2"):
        readers.jsonl(spark, str(tmp_path / "b.jsonl")).count()
    (tmp_path / "c.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.json_rows(spark, str(tmp_path / "c.json")).count() == 2


def test_task_lists(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# cohort\nT3\n\nT1\n")
    tasks = readers.task_list(spark, str(tmp_path / "t.txt"))
    frame = spark.createDataFrame([("T1", "A"), ("T2", "B"), ("T3", "C")], "task_id string, unit string")
    assert [r["task_id"] for r in readers.cohort(frame, tasks, "unit").collect()] == ["T3", "T1"]
    with pytest.raises(ValueError, match="in part"):
        readers.cohort(frame.withColumn("unit", F.lit("A")), tasks, "unit")
    with pytest.raises(ValueError, match="unknown"):
        readers.cohort(frame.where("task_id <> 'T3'"), tasks)
    (tmp_path / "d.txt").write_text("T1\nT1\n")
    with pytest.raises(ValueError, match="twice"):
        readers.task_list(spark, str(tmp_path / "d.txt"))


def test_frozen_views(spark):
    tasks, answers = spark.createDataFrame([(1, "q")], "task_id int, prompt string"), spark.createDataFrame([(1, "D1")], "task_id int, answer string")
    assert readers.frozen(tasks, answers).first()["answer"] == "D1" and release.isolated(tasks, ["answer"]) == [] and release.isolated(answers, ["answer"]) == ["answer"]
    with pytest.raises(ValueError):
        readers.frozen(tasks, answers.union(answers))
    with pytest.raises(ValueError):
        readers.frozen(tasks, answers.withColumn("task_id", F.lit(2)))


def test_best_match(spark):
    wanted = spark.createDataFrame([("a/B 1.png",), ("exact.png",), ("pages/skin_lesion_00001_00002.png",), ("lost.png",)], "path string")
    have = spark.createDataFrame([("a/b-1.png",), ("exact.png",), ("pages/skin_lesions_00001_00002.png",), ("other/zzz_00001_00002.png",)], "path string")
    assert {r["path"]: r["how"] for r in readers.best_match(wanted, have).collect()} == {"exact.png": "exact", "a/B 1.png": "normalized", "pages/skin_lesion_00001_00002.png": "similar"}


def test_shards_and_release(spark, tmp_path):
    frame = spark.range(1100).select(F.format_string("T%05d", "id").alias("task_id"), (F.col("id") % 3).alias("v"))
    own = release.write_shards(frame.repartition(5), str(tmp_path / "r"), "test", "task_id").orderBy("shard").collect()
    assert [(r["shard"], r["rows"]) for r in own] == [("test-00000-of-00003", 512), ("test-00001-of-00003", 512), ("test-00002-of-00003", 76)]
    back = spark.read.parquet(str(tmp_path / "r"))
    integrity = spark.createDataFrame([("unique", 0)], "rule string, violations long")
    document = release.release_document("r", "1", 42, {"tasks": release.shard_records(back, "task_id")}, integrity)
    assert document["integrity_passed"] and release.validate_release(document, {"tasks": release.shard_records(back.repartition(3), "task_id")}) == []
    changed = back.withColumn("v", F.when(F.col("task_id") == "T00600", 9).otherwise(F.col("v")))
    assert release.validate_release(document, {"tasks": release.shard_records(changed, "task_id")}) == ["tasks/test-00001-of-00003"]
    assert readers.shards(spark, str(tmp_path / "r"), "part").count() == 1100 and json.loads(release.dumps(document))["seed"] == 42


def test_runs_resume(spark, tmp_path):
    tasks = spark.createDataFrame([(f"T{i}",) for i in range(4)], "task_id string")
    release.append_records(spark.createDataFrame([("T0", "ok"), ("T1", "error")], "task_id string, status string"), str(tmp_path), "a")
    release.append_records(spark.createDataFrame([("T2", "schema_invalid")], "task_id string, status string"), str(tmp_path), "a")
    left = release.pending(tasks, spark.read.json(f"{tmp_path}/run=a"))
    assert sorted(r["task_id"] for r in left.collect()) == ["T1", "T3"]


def test_replaced_columns(spark):
    frame = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, x string, y int")
    got = release.replaced_columns(frame, spark.createDataFrame([(2, "B"), (1, "A")], "id int, x string"), "id").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "A", 5), (2, "B", 6)]
    with pytest.raises(ValueError):
        release.replaced_columns(frame, spark.createDataFrame([(1, "A")], "id int, x string"), "id")


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "event_type")
    aware = events.withColumn("ts", F.col("ts").cast("timestamp"))
    twice = events.union(events.where("event_id % 4 = 0"))
    twice.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = records.once(records.events(spark, str(tmp_path / "in"), events.schema, 10), "event_id", "ts", "400 days")
    got = records.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert got.count() == events.count()
    batch, live = (sorted(map(tuple, records.status_counts(df, "ts", "event_type").collect()), key=str) for df in (aware, got))
    assert batch == live


def test_files_of_shards(spark, tmp_path):
    import hashlib

    from cambium.sources import release

    path = str(tmp_path / "shards")
    told = {r["shard"]: r for r in release.write_shards(spark.range(1200).withColumnRenamed("id", "k"), path, "train", "k", 500).collect()}
    rows = release.shard_files(spark, path, "k").collect()
    assert len(rows) == 3 and sum(r["rows"] for r in rows) == 1200
    for r in rows:
        raw = (tmp_path / "shards" / r["file"]).read_bytes()
        assert r["bytes"] == len(raw) and r["file_sha256"] == hashlib.sha256(raw).hexdigest() and told[r["shard"]]["sha256"] == r["sha256"]
    spark.range(3).write.parquet(f"{path}/shard=x")
    with pytest.raises(ValueError, match="one file"):
        release.shard_files(spark, path, "k")
