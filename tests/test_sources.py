import json
import shutil
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cohortloom.sources import rasters as W
from cohortloom.sources import tabular as T


def test_csv_with_byte_order_mark(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_bytes(b'\xef\xbb\xbfid,name\n1,"x ""y"""\n2,\n')
    df = T.read_csv_text(spark, str(file), "id")
    assert df.columns == ["id", "name"] and [tuple(r) for r in df.collect()] == [("1", 'x "y"'), ("2", None)]
    assert T.read_csv_text(spark, str(file), "other").count() == 0


def test_transcript_files(spark, tmp_path):
    doc = {"text": "a", "source_file": "f", "detailed_results": [{"text": "a", "duration": 5, "raw_sentence": {"SpeechRate": 9}}]}
    (tmp_path / "QQ1_x_y.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "QQ2.json").write_text(json.dumps({"text": None}))
    rows = {r.entity_id: r for r in T.read_transcripts(spark, str(tmp_path)).collect()}
    assert rows["QQ1"].detailed_results[0].raw_sentence.SpeechRate == "9" and rows["QQ2"].text == ""


def test_annotation_file_to_polygons(spark, tmp_path):
    sample = {
        "sample_id": "s", "image_size": {"width": 4, "height": 4}, "status": "ok", "face": {"polygon": [[0, 0], [1, 0], [1, 1]]},
        "regions": {"nose": {"polygon": [[0, 0], [1, 1]]}},
    }
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {}, "samples": [sample, {"sample_id": "t", "status": "no_face"}]}, indent=1))
    notes = T.read_annotations(spark, str(tmp_path / "a.json"))
    assert notes.count() == 2
    assert sorted(r.region for r in T.annotation_polygons(notes).collect()) == ["face", "nose"]


def test_exclusions_mix_and_missing_file(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"excluded_samples": ["a", {"sample_id": "b", "reason": "r"}, {"reason": "x"}, 5]}, indent=1))
    got = sorted(r.sample_id for r in T.read_exclusions(spark, str(tmp_path / "e.json")).collect())
    assert got[-2:] == ["a", "b"]
    assert T.read_exclusions(spark, str(tmp_path / "none.json")).count() == 0


def test_split_document(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"train_patient_ids": ["a", "b"], "val_patient_ids": ["c"], "test_patient_ids": []}, indent=1))
    assert sorted(map(tuple, T.read_split(spark, str(tmp_path / "s.json")).collect())) == [("a", "train"), ("b", "train"), ("c", "val")]


def test_rasters_from_files(spark, tmp_path):
    head = chr(0xFEFF) + "rule,max\nr,1\n\n,1,2,\n"
    (tmp_path / "good.csv").write_text(head + "1,1.5,2,\n\n2,3,4,\r\n", encoding="utf-8", newline="")
    (tmp_path / "ragged.csv").write_text(head + "1,1,2,\n2,3,\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text(head, encoding="utf-8")
    (tmp_path / "text.csv").write_text(head + "1,x,2,\n", encoding="utf-8")
    docs = W.read_rasters(spark, str(tmp_path))
    sound, failures = W.parse_rasters(docs)
    assert sorted((r.sample_id, r.y, r.temps) for r in sound.collect()) == [("good", 0, [1.5, 2.0]), ("good", 1, [3.0, 4.0])]
    assert {r.sample_id: r.error for r in failures.collect()} == {"ragged": "inconsistent row widths", "empty": "no rows", "text": "not a number"}
    none = spark.createDataFrame([], "sample_id string")
    target = str(tmp_path / "cache")
    first = {r.outcome: r.n for r in W.convert_rasters(docs, none, target).collect()}
    second = {r.outcome: r.n for r in W.convert_rasters(docs, none, target).collect()}
    assert first == {"success": 1, "skipped": 0, "failed": 3} and second == {"success": 0, "skipped": 1, "failed": 3}
    assert [tuple(r) for r in W.size_histogram(spark.read.parquet(target)).collect()] == [(2, 2, 1)]


def test_raster_stream_takes_new_files_and_survives_a_lost_run(spark, tmp_path):
    head = "rule,max\nr,1\n\n,1,2,\n"
    files, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    files.mkdir()

    def put(name, body):
        (files / f"{name}.csv").write_text(head + body, encoding="utf-8")

    def convert(fail=None):
        docs = W.raster_stream(spark, str(files), files_per_batch=1)
        if fail:
            broken = F.raise_error(F.lit("lost")).cast("string")
            docs = docs.withColumn("content", F.when(F.col("sample_id") == fail, broken).otherwise(F.col("content")))
        out = W.stream_rasters(docs, target, checkpoint, spark.createDataFrame([("x",)], "sample_id string"))
        return sorted((r.sample_id, r.error, r.scan) for r in out.collect())

    assert convert() == []
    put("a", "1,1,2,\n2,3,4,\n")
    put("x", "1,9,\n")
    assert convert() == [("a", None, [[1.0, 2.0], [3.0, 4.0]])]
    put("b", "1,5,6,\n2,7,\n")
    time.sleep(1.1)  # files are taken in the order of their times
    put("c", "1,8,\n")
    with pytest.raises(StreamingQueryException):
        convert(fail="c")
    # What a lost task leaves behind is not in the log.
    stray = next(f for f in (tmp_path / "out").glob("*.parquet"))
    shutil.copy(stray, stray.with_name("part-99999-stray.parquet"))
    want = [("a", None, [[1.0, 2.0], [3.0, 4.0]]), ("b", "inconsistent row widths", [[5.0, 6.0], [7.0]]), ("c", None, [[8.0]])]
    assert convert() == want and convert() == want


def test_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.JPG", "b.csv", "c.txt"):
        (tmp_path / "d" / name).write_text("x")
    got = {(r.stem, r.suffix, r.entity_dir) for r in T.list_files(spark, str(tmp_path), [".jpg", ".csv"]).collect()}
    assert got == {("a", ".jpg", "d"), ("b", ".csv", "d")}


def test_append_new_is_idempotent(spark, tmp_path):
    rows = spark.range(10).select(F.col("id"), (F.col("id") * 2).alias("x"))
    path = str(tmp_path / "t")
    assert tuple(T.append_new(rows.where("id < 4"), path, "id").first()) == (4, 0)
    assert tuple(T.append_new(rows, path, "id").first()) == (6, 4)
    assert tuple(T.append_new(rows, path, "id").first()) == (0, 10)
    assert spark.read.parquet(path).count() == 10
    twice = str(tmp_path / "twice")
    assert tuple(T.append_new(rows.unionByName(rows), twice, "id").first()) == (10, 10)
    assert spark.read.parquet(twice).count() == 10
