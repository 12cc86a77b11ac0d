"""CSV and JSON readers and writers; absent values become NULL on the way in, '' on the way out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.text import file_stem, file_suffix, id_from_filename, parent_name
from cohortloom.session import path_exists

TRANSCRIPT_SCHEMA = """
  text string, source_file string,
  detailed_results array<struct<
    text: string, duration: string, begin_time: string, end_time: string,
    raw_sentence: struct<SpeechRate: string, SilenceDuration: string, EmotionValue: string>>>
"""
_BOX = "array<double>"
_POLYGON = "array<array<double>>"
ANNOTATION_SCHEMA = f"""
  samples array<struct<
    sample_id: string, patient_id: string, year: int, image_path: string, temperature_path: string,
    image_size: struct<width: int, height: int>, status: string,
    face: struct<confidence: double, bbox_xyxy: {_BOX}, polygon: {_POLYGON}, area: double>,
    regions: map<string, struct<confidence: double, bbox_xyxy: {_BOX}, centroid: {_BOX}, polygon: {_POLYGON}, area: double>>,
    quality: struct<missing_regions: array<string>, warnings: array<string>>>>
"""


def read_csv_text(spark: SparkSession, path: str, key: str | None = None, multi_line: bool = False) -> DataFrame:
    """Header CSV, every column text; empty when the key column is absent; a byte-order mark is dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=multi_line, encoding="UTF-8")
    df = df.toDF(*[c.lstrip(chr(0xFEFF)) for c in df.columns])
    return df if key is None or key in df.columns else df.limit(0)


def read_csv_typed(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Header CSV with a given schema; without one the types are inferred, for exploration only."""
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One nested JSON file per entity; the id is the file name up to the first underscore."""
    raw = spark.read.schema(TRANSCRIPT_SCHEMA).json(path, multiLine=True)
    return raw.select(
        id_from_filename(F.col("_metadata.file_name")).alias("entity_id"),
        F.col("_metadata.file_name").alias("source_name"),
        F.coalesce("text", F.lit("")).alias("text"),
        "source_file",
        "detailed_results",
    )


def read_annotations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Top-level `samples` arrays flattened to one row per sample with nested face and regions."""
    return spark.read.schema(ANNOTATION_SCHEMA).json(path, multiLine=multi_line).selectExpr("inline(samples)")


def annotation_polygons(annotations: DataFrame) -> DataFrame:
    """(sample_id, region, polygon, image_w, image_h) for the face and every annotated region."""
    size = [F.col("image_size.width").alias("image_w"), F.col("image_size.height").alias("image_h")]
    face = annotations.where(F.col("face").isNotNull()).select(
        "sample_id", F.lit("face").alias("region"), F.col("face.polygon").alias("polygon"), *size
    )
    parts = annotations.select("sample_id", F.explode("regions").alias("region", "r"), *size).select(
        "sample_id", "region", F.col("r.polygon").alias("polygon"), "image_w", "image_h"
    )
    return face.unionByName(parts)


def exclusion_ids(documents: DataFrame, column: str = "value") -> DataFrame:
    """Distinct sample ids of `excluded_samples` lists that mix plain ids and objects."""
    items = documents.select(F.parse_json(column).alias("_doc")).select(
        F.expr("cast(variant_get(_doc, '$.excluded_samples', 'array<variant>') as array<variant>)").alias("_items")
    )
    entry = items.select(F.explode("_items").alias("v"))
    return (
        entry.select(
            F.expr(
                "if(schema_of_variant(v) like 'OBJECT%', try_variant_get(v, '$.sample_id', 'string'),"
                " try_variant_get(v, '$', 'string'))"
            ).alias("sample_id")
        )
        .where(F.col("sample_id").isNotNull() & (F.col("sample_id") != ""))
        .distinct()
    )


def read_exclusions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Exclusion files to ids, one document a file or a line; a missing file is an empty set."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "sample_id string")
    return exclusion_ids(spark.read.text(path, wholetext=multi_line))


def split_rows(documents: DataFrame) -> DataFrame:
    """Split documents with four id arrays to (entity_id, split) rows."""

    def tagged(name: str) -> Column:
        ids = F.coalesce(f"{name}_patient_ids", F.array().cast("array<string>"))
        return F.transform(ids, lambda i: F.struct(i.alias("entity_id"), F.lit(name).alias("split")))

    rows = F.concat(*[tagged(n) for n in ("train", "val", "test", "unlabelled")])
    return documents.select(F.explode(rows).alias("r")).select("r.*")


def read_split(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Split documents (one a file or a line) to (entity_id, split) rows."""
    schema = ", ".join(f"{n}_patient_ids array<string>" for n in ("train", "val", "test", "unlabelled"))
    return split_rows(spark.read.schema(schema).json(path, multiLine=multi_line))


def write_split(splits: DataFrame, path: str) -> None:
    """Splits as a table partitioned by split: rows, not one id array per split."""
    splits.write.mode("overwrite").partitionBy("split").parquet(path)


def list_files(spark: SparkSession, path: str, extensions: Sequence[str]) -> DataFrame:
    """(path, length, stem, suffix, entity_dir) of the files with one of the extensions; no content is read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    )
    return describe_paths(files).where(F.col("suffix").isin([e.lower() for e in extensions]))


def describe_paths(files: DataFrame, column: str = "path") -> DataFrame:
    p = F.col(column)
    return files.withColumns({"stem": file_stem(p), "suffix": file_suffix(p), "entity_dir": parent_name(p)})


def _flat(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    def out(c: str) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c), F.col(c)).alias(c)
        return F.col(c)

    return df.select(*[out(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "error") -> None:
    """Header CSV in a fixed column order; NULL and NaN become empty fields."""
    _flat(df, columns).write.mode(mode).csv(path, header=True, escape='"', emptyValue="")


def write_features(results: DataFrame, ok_path: str, failed_path: str, columns: Sequence[str]) -> None:
    """Rows with status ok to the feature CSV, the others' keys to the failure CSV."""
    keys = ["sample_id", "entity_id", "year", "status"]
    write_csv(results.where(F.col("status") == "ok"), ok_path, [*keys, *columns])
    write_csv(results.where(F.col("status") != "ok"), failed_path, keys)


def annotation_summary(annotations: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Flat per-sample summary: face and per-region flag, confidence and area; lists as comma text."""
    cols: list[Column] = []
    for r in regions:
        here = F.try_element_at("regions", F.lit(r))
        cols += [
            here.isNotNull().alias(f"{r}_detected"),
            F.coalesce(here["confidence"], F.lit(0.0)).alias(f"{r}_confidence"),
            F.coalesce(here["area"], F.lit(0.0)).alias(f"{r}_area"),
        ]
    return annotations.select(
        "sample_id", "patient_id", "year", "image_path", "temperature_path", "status",
        F.col("face").isNotNull().alias("face_detected"),
        F.coalesce("face.confidence", F.lit(0.0)).alias("face_confidence"),
        F.coalesce("face.area", F.lit(0.0)).alias("face_area"),
        *cols,
        F.concat_ws(",", "quality.missing_regions").alias("missing_regions"),
        F.concat_ws(",", "quality.warnings").alias("warnings"),
    )


def write_annotations(annotations: DataFrame, folder: str, regions: Sequence[str]) -> None:
    """Nested JSON lines, the flat summary and the failures."""
    annotations.write.json(f"{folder}/annotations")
    summary = annotation_summary(annotations, regions)
    write_csv(summary, f"{folder}/summary", summary.columns)
    write_csv(
        summary.where(F.col("status") != "ok"), f"{folder}/failures",
        ["sample_id", "patient_id", "status", "warnings", "missing_regions"],
    )


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key is not in the Parquet target yet; (copied, skipped) counts as one row.

    Of several rows with a key the one that sorts first by its other columns is appended. The new part is written first and counted from the files, so both numbers describe what happened.
    """
    spark = rows.sparkSession
    fresh = rows
    before = 0
    if path_exists(spark, path):
        target = spark.read.schema(rows.schema).parquet(path)
        before = target.count()
        fresh = rows.join(target.select(key), key, "left_anti").select(*rows.columns)
    whole = F.struct(*[F.col(c) for c in rows.columns])
    fresh = fresh.groupBy(key).agg(F.min(whole).alias("_first")).select("_first.*")
    fresh.write.mode("append").parquet(path)
    copied = spark.read.schema(rows.schema).parquet(path).count() - before
    return rows.agg(F.count("*").alias("_n")).select(
        F.lit(copied).cast("long").alias("copied"), (F.col("_n") - F.lit(copied)).alias("skipped")
    )
