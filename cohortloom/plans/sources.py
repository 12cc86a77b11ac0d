"""Reader and writer queries (inventory 2.1): Spark writes the given tables out and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.text import id_from_filename
from cohortloom.operators.transcript import sentence_rows
from cohortloom.plans import views as V
from cohortloom.plans.rasters import BOXES
from cohortloom.plans.registry import query, table, wide_table
from cohortloom.plans.views import with_
from cohortloom.session import materialise, scratch_path
from cohortloom.sources import rasters as W
from cohortloom.sources import tabular as T


@query(
    "src_csv_text",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,"
    " CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer",
)
def src_csv_text(spark, folder):
    path = scratch_path(spark, "csv")
    table(spark, folder, "customer").write.csv(path, header=True)
    return T.read_csv_text(spark, path, "c_custkey")


@query("src_csv_typed", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def src_csv_typed(spark, folder):
    path = scratch_path(spark, "csv")
    rows = table(spark, folder, "supplier")
    rows.write.csv(path, header=True)
    return T.read_csv_typed(spark, path, rows.schema)


@query(
    "src_json_nested",
    "SELECT CAST(doc_id AS VARCHAR) AS entity_id, count(*) AS n_sentences, CAST(sum(length(line)) * 10 AS DOUBLE) AS duration_total,"
    " CAST(max(length(line) % 7) AS DOUBLE) AS longest_silence FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"
    " GROUP BY doc_id",
)
def src_json_nested(spark, folder):
    """Every document as a transcript; each of its lines is a sentence."""
    sentences = F.transform(
        F.split("text", "\n"),
        lambda s: F.struct(
            s.alias("text"), (F.length(s) * 10).alias("duration"),
            F.struct((F.length(s) % 7).alias("SilenceDuration")).alias("raw_sentence"),
        ),
    )
    path = scratch_path(spark, "transcripts")
    docs = wide_table(spark, folder, "documents", "doc_id", "text").select(
        "text", F.concat(F.col("doc_id").cast("string"), F.lit("_asr_v2.json")).alias("source_file"),
        sentences.alias("detailed_results"),
    )
    docs.write.json(path)
    read = spark.read.schema(T.TRANSCRIPT_SCHEMA).json(path)
    rows = sentence_rows(read.withColumn("entity_id", id_from_filename(F.col("source_file"))))
    return rows.groupBy("entity_id").agg(
        F.count("*").alias("n_sentences"), F.sum("duration").alias("duration_total"), F.max("silence").alias("longest_silence")
    )


def _annotated(spark, folder):
    """Vectors as annotated samples: label 9 has no face, label 0 no nose."""
    face = F.struct(
        F.lit(0.9).alias("confidence"), F.array(*[F.lit(float(v)) for v in BOXES["face"]]).alias("bbox_xyxy"),
        F.lit(49.0).alias("area"),
    )
    eye = F.struct((F.col("label") / 10.0).alias("confidence"), F.lit(1.5).alias("area"))
    nose = F.struct(F.lit(0.25).alias("confidence"), F.col("vec_id").cast("double").alias("area"))
    regions = F.when(F.col("label") == 0, F.create_map(F.lit("left_eye"), eye)).otherwise(
        F.create_map(F.lit("left_eye"), eye, F.lit("nose"), nose)
    )
    no_face = F.col("label") == 9
    quality = F.struct(
        F.when(F.col("label") == 0, F.array(F.lit("nose"))).otherwise(F.array().cast("array<string>")).alias("missing_regions"),
        F.when(no_face, F.array(F.lit("No face detected"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"), (F.col("vec_id") % 97).cast("string").alias("patient_id"),
        F.lit(2024).alias("year"), F.concat(F.lit("/i/"), "vec_id").alias("image_path"), F.concat(F.lit("/t/"), "vec_id").alias("temperature_path"),
        F.struct(F.lit(8).alias("width"), F.lit(8).alias("height")).alias("image_size"),
        F.when(no_face, "no_face").otherwise("ok").alias("status"), F.when(~no_face, face).alias("face"),
        F.when(~no_face, regions).otherwise(F.create_map().cast("map<string, struct<confidence: double, area: double>>")).alias("regions"),
        quality.alias("quality"),
    )


def _read_annotated(spark, folder):
    path = scratch_path(spark, "annotations")
    _annotated(spark, folder).select(F.array(F.struct("*")).alias("samples")).write.json(path)
    return T.read_annotations(spark, path, multi_line=False)


@query(
    "src_annotations",
    "SELECT CAST(vec_id AS VARCHAR) AS sample_id, CASE WHEN label = 9 THEN 'no_face' ELSE 'ok' END AS status, CAST(8 AS INTEGER) AS image_w,"
    " CASE label WHEN 9 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS n_regions, CASE WHEN label <> 9 THEN 7.0::DOUBLE END AS face_x2,"
    " CASE WHEN label NOT IN (0, 9) THEN CAST(vec_id AS DOUBLE) END AS nose_area FROM embeddings",
)
def src_annotations(spark, folder):
    return _read_annotated(spark, folder).select(
        "sample_id", "status", F.col("image_size.width").alias("image_w"), F.size("regions").alias("n_regions"),
        F.get("face.bbox_xyxy", F.lit(2)).alias("face_x2"), F.try_element_at("regions", F.lit("nose"))["area"].alias("nose_area"),
    )


@query(
    "src_mixed_exclusions",
    "SELECT DISTINCT CAST(user_id AS VARCHAR) || '_' || event_type AS sample_id FROM events",
)
def src_mixed_exclusions(spark, folder):
    """Event keys as exclusion documents: plain text for even events, objects for odd ones."""
    key = F.concat(F.col("user_id").cast("string"), F.lit("_"), "event_type")
    plain = F.concat(F.lit('{"excluded_samples": ["'), key, F.lit('", ""]}'))
    nested = F.concat(F.lit('{"excluded_samples": [{"sample_id": "'), key, F.lit('", "reason": "x"}, {"reason": "none"}]}'))
    docs = table(spark, folder, "events").select(F.when(F.col("event_id") % 2 == 0, plain).otherwise(nested).alias("value"))
    path = scratch_path(spark, "exclusions")
    docs.write.text(path)
    return T.read_exclusions(spark, path, multi_line=False)


def _raster_documents(spark, folder, ragged: bool = False):
    """Vectors as sensor text: four preamble lines, then eight numbered lines with a trailing comma."""
    line = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda y: F.concat(
            (y + 1).cast("string"), F.lit(","), F.array_join(F.slice(F.col("embedding").cast("array<string>"), y * 8 + 1, 8), ","), F.lit(",")
        ),
    )
    body = F.array_join(line, "\n")
    if ragged:
        # Label 8: one value too many on an extra ninth line.
        body = F.when(F.col("label") == 8, F.concat(body, F.lit("\n9,1,2,3,"))).otherwise(body)
    head = "﻿rule,max,mean,min\nr,1,1,1\n\n,1,2,3,4,5,6,7,8,\n".replace("﻿", chr(0xFEFF))
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"), "label", F.concat(F.lit(head), body, F.lit("\n")).alias("content")
    )


@query(
    "src_raster",
    "SELECT CAST(vec_id AS VARCHAR) AS sample_id, CAST(y AS INTEGER) AS y, CAST(8 AS INTEGER) AS width, list_sum(list_transform(embedding[y * 8 + 1 : y * 8 + 8],"
    " lambda v: CAST(CAST(v AS VARCHAR) AS DOUBLE))) AS total FROM embeddings, range(8) r(y) WHERE label <> 8",
    rounded="total",
)
def src_raster(spark, folder):
    docs = _raster_documents(spark, folder, ragged=True)
    sound, _ = W.parse_rasters(docs)
    total = F.aggregate("temps", F.lit(0.0), lambda a, v: a + v)
    return sound.select("sample_id", "y", F.size("temps").alias("width"), total.alias("total"))


@query(
    "sink_raster_columnar",
    "WITH n AS (SELECT count(*) FILTER (WHERE label <> 9) AS wanted, count(*) FILTER (WHERE label = 8) AS bad FROM embeddings)"
    " SELECT CAST(1 AS INTEGER) AS run, 'success' AS outcome, wanted - bad AS n FROM n UNION ALL SELECT 1, 'skipped', 0 FROM n UNION ALL SELECT 1, 'failed', bad FROM n"
    " UNION ALL SELECT 2, 'success', 0 FROM n UNION ALL SELECT 2, 'skipped', wanted - bad FROM n UNION ALL SELECT 2, 'failed', bad FROM n"
    " UNION ALL SELECT 3, 'size_8x8', wanted - bad FROM n",
)
def sink_raster_columnar(spark, folder):
    docs = _raster_documents(spark, folder, ragged=True)
    excluded = docs.where(F.col("label") == 9)
    path = scratch_path(spark, "raster-cache")
    first = W.convert_rasters(docs, excluded, path).select(F.lit(1).alias("run"), "outcome", "n")
    second = W.convert_rasters(docs, excluded, path).select(F.lit(2).alias("run"), "outcome", "n")
    sizes = W.size_histogram(spark.read.parquet(path)).select(
        F.lit(3).alias("run"), F.concat(F.lit("size_"), "width", F.lit("x"), "height").alias("outcome"), "n"
    )
    return first.unionByName(second).unionByName(sizes)


@query(
    "sink_raster_stream",
    "WITH v AS (SELECT *, CASE WHEN label % 2 = 0 THEN 1 ELSE 2 END AS wave FROM embeddings WHERE label <> 9)"
    " SELECT CAST(run AS INTEGER) AS run, CASE WHEN label = 8 THEN 'inconsistent row widths' ELSE 'success' END AS outcome, count(*) AS n,"
    " CAST(sum(CASE WHEN label = 8 THEN 67 ELSE 64 END) AS BIGINT) AS n_values FROM v, range(1, 4) r(run) WHERE wave <= run GROUP BY 1, 2",
)
def sink_raster_stream(spark, folder):
    """Rasters in two waves of files, read by one checkpointed stream; the third run finds nothing new."""
    docs = _raster_documents(spark, folder, ragged=True)
    excluded = docs.where(F.col("label") == 9)
    source, target, checkpoint = (scratch_path(spark, f"stream-{x}") for x in ("source", "target", "checkpoint"))
    out = None
    for run, wave in enumerate((docs.where(F.col("label") % 2 == 0), docs.where(F.col("label") % 2 != 0), docs.limit(0)), 1):
        wave.select("sample_id", "content").write.mode("append").json(source)
        arrived = spark.readStream.schema("sample_id string, content string").json(source)
        table_now = W.stream_rasters(arrived, target, checkpoint, excluded)
        counted = table_now.groupBy(F.coalesce("error", F.lit("success")).alias("outcome")).agg(
            F.count("*").alias("n"), F.sum(F.size(F.flatten("scan"))).cast("long").alias("n_values")
        )
        # Counted now: the next run adds to the same table.
        counted = materialise(counted.select(F.lit(run).alias("run"), "outcome", "n", "n_values"), "stream-counts")
        out = counted if out is None else out.unionByName(counted)
    return out


@query(
    "src_file_listing",
    "SELECT DISTINCT 'c_mktsegment=' || c_mktsegment AS entity_dir, '.csv' AS suffix, true AS has_bytes FROM customer",
)
def src_file_listing(spark, folder):
    path = scratch_path(spark, "listing")
    table(spark, folder, "customer").write.partitionBy("c_mktsegment").csv(path)
    files = T.list_files(spark, path, [".csv"])
    return files.groupBy("entity_dir", "suffix").agg((F.min("length") > 0).alias("has_bytes"))


@query("src_split_config", with_("splits") + "SELECT CAST(entity_id AS VARCHAR) AS entity_id, split FROM splits")
def src_split_config(spark, folder):
    """JSON split documents of four id arrays, read to rows, through the split table and back."""
    rows = V.splits(spark, folder)
    arrays = [
        F.when(F.col("split") == s, F.array(F.col("entity_id").cast("string"))).otherwise(F.array().cast("array<string>")).alias(f"{s}_patient_ids")
        for s in ("train", "val", "test", "unlabelled")
    ]
    path = scratch_path(spark, "split")
    documents = scratch_path(spark, "split-documents")
    rows.select(*arrays).write.json(documents)
    T.write_split(T.read_split(spark, documents, multi_line=False), path)
    return spark.read.schema("entity_id string, split string").parquet(path).select("entity_id", "split")


@query(
    "sink_csv",
    "SELECT 'ok' AS part, CAST(vec_id AS VARCHAR) AS sample_id, 'ok' AS status, CASE WHEN label % 2 = 0 THEN CAST(label AS VARCHAR) || '.5' END AS a FROM embeddings"
    " WHERE label <> 9 UNION ALL SELECT 'failed', CAST(vec_id AS VARCHAR), 'no_face', NULL FROM embeddings WHERE label = 9",
)
def sink_csv(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("sample_id"), (F.col("vec_id") % 97).alias("entity_id"), F.lit(2024).alias("year"),
        F.when(F.col("label") == 9, "no_face").otherwise("ok").alias("status"),
        F.when(F.col("label") % 2 == 0, F.col("label") + 0.5).otherwise(F.lit(float("nan"))).cast("double").alias("a"),
    )
    ok, failed = scratch_path(spark, "features"), scratch_path(spark, "failures")
    T.write_features(rows, ok, failed, ["a"])
    cols = ["sample_id", "status", "a"]
    good = T.read_csv_text(spark, ok).select(F.lit("ok").alias("part"), *cols)
    bad = T.read_csv_text(spark, failed).withColumn("a", F.lit(None).cast("string"))
    return good.unionByName(bad.select(F.lit("failed").alias("part"), *cols))


@query(
    "sink_json_lines",
    "SELECT CAST(vec_id AS VARCHAR) AS sample_id, CASE WHEN label = 9 THEN 'no_face' ELSE 'ok' END AS status, label <> 9 AS face_detected,"
    " CASE WHEN label = 9 THEN 0.0 ELSE 0.9 END::DOUBLE AS face_confidence, CASE WHEN label = 9 THEN 0.0 ELSE label / 10.0 END::DOUBLE AS left_eye_confidence,"
    " label NOT IN (0, 9) AS nose_detected, CASE WHEN label IN (0, 9) THEN 0.0 ELSE vec_id END::DOUBLE AS nose_area, false AS forehead_detected,"
    " CASE WHEN label = 0 THEN 'nose' END AS missing_regions, CASE WHEN label = 9 THEN 'No face detected' END AS warnings FROM embeddings",
)
def sink_json_lines(spark, folder):
    regions = ["left_eye", "right_eye", "nose", "forehead", "left_cheek", "right_cheek"]
    path = scratch_path(spark, "annotation-sink")
    T.write_annotations(_read_annotated(spark, folder), path, regions)
    back = T.read_csv_text(spark, f"{path}/summary")
    number, flag = ("face_confidence", "left_eye_confidence", "nose_area"), ("face_detected", "nose_detected", "forehead_detected")
    return back.select(
        "sample_id", "status", *[F.col(c).cast("boolean").alias(c) for c in flag], *[F.col(c).cast("double").alias(c) for c in number],
        "missing_regions", "warnings",
    )


@query(
    "incremental_copy",
    "WITH n AS (SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders)"
    " SELECT CAST(1 AS INTEGER) AS run, done AS copied, 0 AS skipped FROM n UNION ALL SELECT 2, total - done, done FROM n UNION ALL SELECT 3, 0, total FROM n".replace(
        "0 AS skipped", "CAST(0 AS BIGINT) AS skipped"
    ),
)
def incremental_copy(spark, folder):
    """Manifest rows copied once: a first part, then everything, then nothing new."""
    rows = V.samples(spark, folder).select("sample_id", "entity_id", "year", "status")
    path = scratch_path(spark, "copies")
    runs = [rows.where(F.col("status") == "F"), rows, rows]
    out = None
    for i, part in enumerate(runs, 1):
        counted = T.append_new(part, path, "sample_id").select(F.lit(i).alias("run"), "copied", "skipped")
        out = counted if out is None else out.unionByName(counted)
    return out
