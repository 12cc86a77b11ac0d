from pyspark.sql import functions as F

from cohortloom.operators.counters import run_counters
from cohortloom.plans import jobs as J
from cohortloom.sources.tabular import ANNOTATION_SCHEMA, describe_paths


def listing(spark, *paths):
    return describe_paths(spark.createDataFrame([(p,) for p in paths], "path string"))


def test_dataset_build(spark):
    data = J.build_dataset(
        listing(spark, "/24/QQ001/QQ001-1.jpg", "/24/QQ001/QQ001-2.jpg", "/24/QQOO5/QQOO51.jpg", "/24/QQ009/QQ0091.jpg"),
        listing(spark, "/24/QQ001/QQ001-1.csv", "/24/QQOO5/QQOO51.csv"),
        listing(spark, "/25/img/QQ001正-1.jpg", "/25/img/QQ001正-2.jpg", "/25/img/甲乙丙正-1.png", "/25/img/ZZ777正1.jpg", "/25/img/QQ002左1.jpg"),
        listing(spark, "/25/t/QQ001正-1.csv", "/25/t/QQ001正-2.csv", "/25/t/甲乙丙正-1.csv", "/25/t/ZZ777正1.csv", "/25/t/lost.csv"),
        spark.createDataFrame([("QQ001", "missing"), ("QQ005", "61"), ("QQ007", "50")], "entity_id string, age string"),
        spark.createDataFrame([("QQ001", "44")], "entity_id string, age string"),
        spark.createDataFrame([("甲乙丙", "QQ007")], "name string, entity_id string"),
        preferred=["age"],
    )
    ids = sorted((r.sample_id, r.matched_by) for r in data.manifest.collect())
    assert ids == [
        ("2024_QQ001_1", "patient_id"), ("2024_QQ005_1", "patient_id"), ("2025_QQ001_1", "patient_id"), ("2025_QQ001_2", "patient_id"),
        ("2025_QQ007_1", "name"),
    ]
    assert [(r.raw_id, r.candidate_ids) for r in data.excluded.collect()] == [("ZZ777", 0)]
    assert sorted(r.code for r in data.issues.collect()) == ["missing_front_image", "missing_temperature_csv", "orphan_temperature_csv"]
    registry = {r.entity_id: (r.age, r.sample_count, r.n_2025) for r in data.registry.collect()}
    assert registry == {"QQ001": ("44", 3, 2), "QQ005": ("61", 1, 0), "QQ007": ("50", 1, 1)}
    assert {r.entity_id: r.source_ids for r in data.summary.collect()}["QQ005"] == "QQOO5"


def test_run_counters(spark):
    schema = "sample_id int, raw_id string, entity_id string"
    resolved = spark.createDataFrame([(1, "q1", "Q1"), (2, " Q1", "Q1"), (3, "QO", "Q0"), (4, "Z", None), (5, None, None)], schema)
    a = spark.createDataFrame([("Q1", "5"), ("Q7", "6")], "entity_id string, age string")
    issues = spark.range(3)
    args = (a, a.limit(0), issues, (["age"], [], []), (4, 1))
    got = {r.counter: r.n for r in run_counters(resolved, *args).collect()}
    assert got == {
        "selected_samples": 5, "included_samples": 3, "excluded_samples": 2, "selected_entities": 3, "registry_rows": 2,
        "selected_missing_registry": 2, "registry_missing_sample": 1, "included_entities": 2, "with_basic_data": 1,
        "source_issues": 3, "copied": 4, "skipped_existing": 1,
    }
    empty = {r.counter: r.n for r in run_counters(resolved.limit(0), a.limit(0), a.limit(0), issues.limit(0), args[3], (0, 0)).collect()}
    assert set(empty) == set(got) and not any(empty.values())


def test_missing_folders(spark, tmp_path):
    got = J.missing_folders(spark, [("missing_photo_dir", "2025", str(tmp_path / "no")), ("missing_year_dir", "2024", str(tmp_path))])
    assert [(r.code, r.year) for r in got.collect()] == [("missing_photo_dir", "2025")]


def test_raster_table(spark):
    head = "h\nv\n\n,1,2,3,4,\n"
    body = "".join(f"{y + 1}," + ",".join(str(30 + y + x) for x in range(4)) + ",\n" for y in range(4))
    docs = spark.createDataFrame([("a", head + body), ("b", head), ("c", head + body), ("x", head + body)], "sample_id string, content string")
    face = {"bbox_xyxy": [0.0, 0.0, 6.0, 6.0], "polygon": [[0.0, 0.0], [6.0, 0.0], [6.0, 6.0], [0.0, 6.0]]}
    far = {"bbox_xyxy": [90.0, 90.0, 99.0, 99.0], "polygon": [[90.0, 90.0], [99.0, 90.0], [99.0, 99.0]]}
    size = {"width": 8, "height": 8}
    samples = [
        {"sample_id": "a", "patient_id": "p", "year": 2024, "status": "ok", "image_size": size, "face": face},
        {"sample_id": "b", "status": "ok", "image_size": size, "face": face},
        {"sample_id": "c", "status": "ok", "image_size": size, "face": far},
        {"sample_id": "d", "status": "ok", "image_size": size, "face": face},
        {"sample_id": "e", "status": "no_face"},
        {"sample_id": "x", "status": "ok", "image_size": size, "face": face},
    ]
    notes = spark.createDataFrame([(samples,)], ANNOTATION_SCHEMA).selectExpr("inline(samples)")
    out = J.raster_table(notes, docs, spark.createDataFrame([("x",)], "sample_id string"))
    rows = {r.sample_id: r for r in out.collect()}
    assert {k: r.status for k, r in rows.items()} == {
        "a": "ok", "b": "temperature_parse_error: no rows", "c": "empty_face_mask", "d": "missing_temperature_csv", "e": "no_face",
    }
    # The image is twice the raster, so the face is the whole 4 x 4 raster and its box ends at 3.
    assert rows["a"].face_mean == 33.0 and rows["a"].face_hotspot_x_rel == 1.0 and rows["a"].nose_mean is None
    assert len(out.columns) == 4 + 142 and rows["c"].face_mean is None


def test_screening_job(spark):
    df = spark.range(200).select(
        F.col("id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 4).cast("int").alias("severity"),
        (F.col("id") % 2 + F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2 * 2 + F.col("id") % 7 * 2).cast("double").alias("b"),
        (F.col("id") % 11).cast("double").alias("c"), F.lit("matched").alias("match_status"),
    )
    scores, subset, kept = J.screen(df, ("a", "b", "c"), ("id", "label"), top=3)
    assert kept == ["a", "c"] and subset.columns == ["id", "label", "a", "c"]
    assert {r.feature_name: r.selected for r in scores.collect()} == {"a": 1, "b": 0, "c": 1}


def test_transcript_table_keeps_unmatched(spark):
    from cohortloom.sources.tabular import TRANSCRIPT_SCHEMA

    rows = [("QQ001", "北风和太阳", "f", []), ("QQ002", "", "f", [])]
    docs = spark.createDataFrame(rows, f"entity_id string, {TRANSCRIPT_SCHEMA}")
    registry = spark.createDataFrame([("QQ001", 1)], "entity_id string, label int")
    out = {r.entity_id: r for r in J.transcript_table(docs, registry).collect()}
    assert (out["QQ001"].match_status, out["QQ001"].label, out["QQ001"].norm_char_count) == ("matched", 1, 5)
    assert (out["QQ002"].match_status, out["QQ002"].label, out["QQ002"].sequence_ratio) == ("unmatched", None, 0)
