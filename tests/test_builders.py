"""Builders of manifests over small sources, joins that tell what they assume, task contracts, pages."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium.functions import pictures
from cambium.operators import joins as J
from cambium.operators import pages
from cambium.operators.tasks import TASKS, Setting
from cambium.sources import builders


@pytest.fixture(scope="module")
def mapping(spark):
    return spark.createDataFrame([("acne", "D1"), ("psoriasis", "D2")], "canonical_source_label string, disease_id string")


def archive(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return str(path)


def rows(df):
    return {r["original_image_id"]: r for r in df.collect()}


def test_registry():
    assert set(builders.BUILDERS) == {"csv_and_archives", "csv_and_folder", "parquet_cases", "archive_folders", "csv_in_archive", "captioned", "lesion_csv"}


def test_csv_and_archives(spark, tmp_path, mapping):
    (tmp_path / "t.csv").write_text("image,label,tone,patient,biopsed\na.png,Acne,3,P1,True\nb.png,psoriasis,0,,False\n")
    zips = [archive(tmp_path / "1.zip", imgs__a_dot_png="1"), archive(tmp_path / "2.zip", imgs__b_dot_png="2")]
    got = rows(builders.BUILDERS["csv_and_archives"](spark, str(tmp_path / "t.csv"), zips, "one", "1", mapping, patient="patient", pathology="biopsed"))
    assert got["a.png"]["group_id"] == "one_P1" and got["b.png"]["group_id"] == "one_b.png" and got["a.png"]["diagnosis_basis"] == "pathology" and got["b.png"]["skin_tone"] is None and got["a.png"]["image_uri"].endswith("1.zip::imgs/a.png") and got["b.png"]["disease_id"] == "D2"
    with pytest.raises(ValueError, match="isn't there"):
        builders.csv_and_archives(spark, str(tmp_path / "t.csv"), zips[:1], "one", "1", mapping)
    archive(tmp_path / "3.zip", other__a_dot_png="3")
    with pytest.raises(ValueError, match="twice"):
        builders.csv_and_archives(spark, str(tmp_path / "t.csv"), [*zips, str(tmp_path / "3.zip")], "one", "1", mapping)


def test_csv_and_folder(spark, tmp_path, mapping):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"x")
    (tmp_path / "t.csv").write_text("image,label,id\na.png,acne,7\n")
    got = rows(builders.csv_and_folder(spark, str(tmp_path / "t.csv"), str(tmp_path / "img"), "two", "1", mapping))
    assert got["a.png"]["sample_id"] == "TWO_000007" and got["a.png"]["include"]


def test_parquet_cases(spark, tmp_path, mapping):
    spark.createDataFrame([("c1", "x.png", None, "{'Psoriasis': 0.2, 'Acne': 0.8}", "YES", "AGE_80_OR_ABOVE"), ("c2", "y.png", "z.png", "{}", "no", "?")], "case_id string, i1 string, i2 string, weights string, ok string, age string").write.parquet(str(tmp_path / "p"))
    got = rows(builders.parquet_cases(spark, str(tmp_path / "p"), "three", "1", mapping, ["i1", "i2"], "weights", ["ok"], "age"))
    assert set(got) == {"x.png", "y.png", "z.png"} and [(d["disease_id"], d["rank"]) for d in got["x.png"]["reference_diagnoses"]] == [("D1", 1), ("D2", 2)]
    assert got["x.png"]["include"] and got["x.png"]["age_group_standardized"] == "70_and_over" and got["y.png"]["exclusion_reason"] == "missing_label" and not got["y.png"]["diagnosis_gradable"]


def test_archive_folders_and_csv_in_archive(spark, tmp_path, mapping):
    folder = archive(tmp_path / "f.zip", train__acne__1_dot_png="1")
    got = rows(builders.archive_folders(spark, folder, "four", "1", mapping))
    assert got["train/acne/1.png"]["disease_id"] == "D1" and got["train/acne/1.png"]["exclusion_reason"] == "source_excluded"
    inner = archive(tmp_path / "i.zip", meta_dot_csv="image,label,age\n1.png,acne,4.5\n2.png,acne,30\n", pre__1_dot_png="1", pre__2_dot_png="2", augmented__1_dot_png="3")
    got = rows(builders.csv_in_archive(spark, inner, "meta.csv", "seven", "1", mapping, root="pre/"))
    assert got["1.png"]["age_years"] is None and got["1.png"]["age_group_standardized"] == "under_18" and got["2.png"]["age_years"] == 30 and got["1.png"]["image_uri"].endswith("::pre/1.png")


def test_captioned_and_lesions(spark, tmp_path, mapping):
    (tmp_path / "c.csv").write_text("filename,source,caption,disease\nyoutube/v1_frame_2.png,youtube,clinical photo,acne\nyoutube/v1_frame_9.png,youtube,a histology slide,acne\npubmed/PMC12_3.png,pubmed,words,No\nreddit/r_1.png,reddit,words,acne\n")
    out = builders.captioned(spark, str(tmp_path / "c.csv"), "five", "1", mapping, "histolog|diagram", "clinical (photo|image)", ["reddit"], ["youtube", "pubmed"], {"youtube": "y.zip", "pubmed": "p.zip", "reddit": "r.zip"}, "no")
    got = rows(out)
    a, b, c, d = (got[k] for k in ("youtube/v1_frame_2.png", "youtube/v1_frame_9.png", "pubmed/PMC12_3.png", "reddit/r_1.png"))
    assert a["include"] and a["group_id"] == b["group_id"] != c["group_id"] and b["exclusion_reason"] == "explicit_excluded" and c["exclusion_reason"] == "insufficient_evidence" and c["disease_original"] is None and d["include"] and a["image_uri"] == "zip://y.zip::v1_frame_2.png"
    with pytest.raises(Exception, match="no archive"):
        builders.captioned(spark, str(tmp_path / "c.csv"), "five", "1", mapping, "x", "y", [], [], {"youtube": "y.zip"}).collect()
    (tmp_path / "l.csv").write_text("image,image_type,patient,lesion,diagnosis,age\n1,clinical: x,P,L,acne,40\n2,dermoscopic,P,L,acne,40\n3,clinical,,L,acne,-1\n")
    got = rows(builders.lesion_csv(spark, str(tmp_path / "l.csv"), "six", "1", mapping))
    assert set(got) == {"1", "3"} and got["1"]["group_id"] == "six_P" and got["3"]["group_id"] == "six_L" and got["3"]["age_years"] is None
    assert builders.training_rows(builders.lesion_csv(spark, str(tmp_path / "l.csv"), "six", "1", mapping)).first()["training_task"] == "mapped_diagnosis"


def test_joins(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"), spark.createDataFrame([(1, 5)], "id int, y int")
    assert J.one_to_one(left, right, ["id"], "left").count() == 2
    with pytest.raises(ValueError, match="partner"):
        J.one_to_one(left, right, ["id"], complete=True)
    with pytest.raises(ValueError, match="twice"):
        J.one_to_one(left, right.union(right), ["id"])
    with pytest.raises(ValueError):
        J.flag_columns(["Red Spot", "red-spot"], {"r": "redspot"})
    tasks = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v")], "id int, unit string")
    refs = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s")], "id int, s string")
    with pytest.raises(ValueError, match="whole"):
        J.units(tasks, refs, "id", "unit", ["s"], 2)
    kept, rest = J.split_by(tasks, refs.where("id = 1"), "id")
    assert kept.count() == 1 and rest.count() == 2


def test_task_contracts(spark):
    assert len(TASKS) == 9
    text = '{"status": "abstained", "visual_findings": [], "predictions": ["a"], "confidence": 0.1}'
    row = spark.range(1).select(*[TASKS[t].check(F.lit(text), Setting(("a",), 1)).alias(t) for t in ("visual_grounding_no_image", "counterfactual_hallucination", "general_visual_hallucination")]).first()
    assert row[0]["semantic_errors"] == ["abstained_without_predictions"] and row[1]["schema_valid"] and not row[2]["schema_valid"]
    ranked = spark.createDataFrame([("a", ["a"]), ("b", None)], "truth string, ranked array<string>")
    assert TASKS["visual_top_k"].score(ranked, Setting(k=1)).first()["top_1"] == 0.5
    picked = spark.createDataFrame([("A", True, "A"), (None, False, "B")], "choice string, strict boolean, truth string")
    assert tuple(TASKS["multiple_choice"].score(picked, Setting()).first()) == (2, 0.5, 0.5, 0.5)


def test_pages(spark):
    frame = spark.createDataFrame([("<a>", 0.5), (None, 3.25)], "k string, v double")
    assert "&lt;a&gt;" in pages.html_page("T", {"x": frame}) and "50.00 %" in pages.card("T", {"x": frame}) and "—" in pages.card("T", {"x": frame})


def test_pictures(spark):
    data = np.random.default_rng(1).integers(0, 255, 40 * 30 * 3, dtype=np.uint8)
    frame = spark.createDataFrame([(1, (40, 30, 3, bytearray(data.tobytes())))], "id int, p struct<height:int,width:int,channels:int,data:binary>")
    row = frame.select(pictures.pixel_shuffle(1)("p", "id").alias("s"), pictures.uniform_gray("p").alias("g"), pictures.perceptual_code("p").alias("c")).first()
    assert sorted(bytes(row["s"]["data"])) == sorted(data.tobytes()) and bytes(row["s"]["data"]) != data.tobytes() and set(row["g"]["data"]) == {128} and isinstance(row["c"], int)
