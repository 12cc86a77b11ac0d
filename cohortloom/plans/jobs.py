"""End-to-end jobs: files in, tables out, each one plan per result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import geometry as G
from cohortloom.functions.text import READING_PROMPT, norm_id, parse_stem, sample_name, sequence_for_entity
from cohortloom.operators import raster as R
from cohortloom.operators import resolve as E
from cohortloom.operators import scoring as S
from cohortloom.operators import selection as L
from cohortloom.operators.transcript import transcript_features
from cohortloom.session import path_exists
from cohortloom.sources.rasters import parse_rasters
from cohortloom.sources.tabular import annotation_polygons

FRONT = "正"


def missing_folders(spark: SparkSession, folders: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Issue rows for the (code, year, path) folders that do not exist."""
    rows = [(year, "", code, E.ISSUES[code], path) for code, year, path in folders if not path_exists(spark, path)]
    return spark.createDataFrame(rows, "year string, entity_id string, code string, message string, path string")


@dataclass
class Dataset:
    """Results of `build_dataset`; every member is a lazy table."""

    manifest: DataFrame
    excluded: DataFrame
    issues: DataFrame
    summary: DataFrame
    registry: DataFrame


def build_dataset(
    folder_images: DataFrame,
    folder_measures: DataFrame,
    view_images: DataFrame,
    view_measures: DataFrame,
    registry_a: DataFrame,
    registry_b: DataFrame,
    names: DataFrame,
    preferred: Sequence[str] = ("age", "height", "weight", "waist", "hip", "neck"),
    only_a: Sequence[str] = (),
    only_b: Sequence[str] = (),
    years: tuple[str, str] = ("2024", "2025"),
) -> Dataset:
    """Samples of both layouts, resolved to canonical entities and merged with both registries.

    The image and measurement tables are file listings (path, stem, suffix, entity_dir); `names` is a
    table of (name, entity_id).
    """
    upper = F.upper("stem")
    in_folders = folder_images.withColumns({"entity_id": norm_id(F.col("entity_dir")), "upper": upper})
    in_folders = in_folders.withColumn("sequence", sequence_for_entity(F.col("upper"), F.col("entity_id")))
    # A stem is unique inside its folder only, so the folder is part of the pairing key.
    keyed = F.concat_ws("/", "entity_dir", "stem").alias("stem")
    flat, flat_issues = E.source_samples_flat(
        in_folders.select("entity_id", keyed, "path", "sequence"), folder_measures.select(keyed, "path"), years[0]
    )
    parsed = view_images.withColumn("p", parse_stem(upper)).select("stem", "path", "p.*")
    views, view_issues = E.source_samples_views(parsed, view_measures.select("stem", "path"), years[1], FRONT)
    samples = flat.unionByName(views).withColumnsRenamed({"entity_id": "raw_id"})
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    samples = samples.withColumn("candidate_name", sample_name(F.col("raw_id"), stem))
    known = E.known_ids(registry_a, registry_b)
    resolved = E.resolve_identity(samples, known, E.unique_names(names))
    manifest = E.matched_rows(resolved).withColumns(
        {"sample_id": F.concat_ws("_", "year", "entity_id", "sequence"), "source_id": norm_id(F.col("raw_id"))}
    )
    summary = E.entity_summary(manifest, [int(y) for y in years])
    registry = E.merge_sources(summary, registry_a, registry_b, preferred, only_a, only_b)
    issues = flat_issues.unionByName(view_issues)
    return Dataset(manifest, E.excluded_rows(resolved, E.name_lookup(names)), issues, summary, registry)


def raster_table(annotations: DataFrame, documents: DataFrame, excluded: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per annotated sample: keys, status and the 142 raster features (NULL unless ok).

    `documents` holds (sample_id, content) raster texts.
    """
    notes = annotations.join(excluded.select("sample_id"), "sample_id", "left_anti")
    if limit:
        notes = notes.orderBy("sample_id").limit(limit)
    usable = notes.where((F.col("status") == "ok") & F.col("face").isNotNull())
    lines, failures = parse_rasters(documents.join(usable.select("sample_id"), "sample_id", "left_semi"))
    shapes = R.raster_shape(lines)
    polygons = R.scale_polygons(annotation_polygons(usable), shapes)
    box = G.box_to_raster_space(
        F.col("face.bbox_xyxy"), F.col("image_size.width"), F.col("image_size.height"), F.col("raster_w"), F.col("raster_h")
    )
    boxes = usable.join(shapes, "sample_id").select("sample_id", box.alias("box"))
    features = R.raster_features(lines, polygons, boxes)
    states = notes.select("sample_id", "status", F.col("face").isNotNull().alias("has_face"))
    status = R.extraction_status(states, documents, failures, features)
    keys = notes.select("sample_id", F.col("patient_id").alias("entity_id"), "year")
    return keys.join(status, "sample_id").join(features, "sample_id", "left")


def transcript_table(transcripts: DataFrame, registry: DataFrame, reference: str = READING_PROMPT) -> DataFrame:
    """Transcript features left-joined to the registry and marked matched or unmatched."""
    return E.enrich_with_status(transcript_features(transcripts, reference), registry)


def screen(
    features: DataFrame, names: Sequence[str], meta: Sequence[str], top: int = 12, threshold: float = 0.85
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Flagged score table, modelling subset and the kept names: score, rank, cut to the top, prune."""
    rows = E.filter_matched(features)
    scores = S.feature_scores(rows, names)
    ranked = [r.feature_name for r in L.rank_features(scores, names).limit(top).select("feature_name").collect()]
    kept = L.prune_correlated(ranked, rows, threshold)
    return L.flag_selected(scores, kept), L.modeling_subset(features, meta, kept), kept
