"""Entity resolution across sources, merging, and the log of everything left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.numeric import prefer
from cohortloom.functions.text import digits_for_lookalikes, norm_id, norm_name, strip
from cohortloom.session import materialise

#: Rows of the issue log that one task groups, on average.
ISSUE_ROWS = 500_000

NO_MATCH = ("no_patient_info_match", "neither the id nor a unique name is in a registry")
# The issue codes. What they mean is said in this package's words.
ISSUES = {
    "missing_sequence_1_image": "folder without a picture numbered 1",
    "multiple_sequence_1_images": "several pictures numbered 1; the path that sorts first counts",
    "missing_temperature_csv": "picture without a measurement of its stem",
    "unparseable_image_name": "file name holds no id, view and number",
    "missing_front_image": "entity without a front picture",
    "missing_front_sequence_1": "front pictures, but none numbered 1",
    "orphan_temperature_csv": "measurement without a picture of its stem",
    "missing_year_dir": "folder of the year is absent",
    "missing_photo_dir": "folder of the pictures is absent",
    "missing_temperature_dir": "folder of the measurements is absent",
}


# ---- registries -------------------------------------------------------------------------------


def registry_last_wins(rows: DataFrame, id_col: str, order_col: str, columns: dict[str, str]) -> DataFrame:
    """Project, rename and trim; one row per normalised id, the last in source order wins."""
    values = F.struct(*[strip(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(n) for c, n in columns.items()])
    keyed = rows.select(norm_id(F.col(id_col).cast("string")).alias("entity_id"), order_col, values.alias("v"))
    return (
        keyed.where(F.col("entity_id") != "")
        .groupBy("entity_id")
        .agg(F.max_by("v", F.col(order_col)).alias("v"))
        .select("entity_id", "v.*")
    )


def name_rows(rows: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Distinct (name, entity_id) from a column with one name per row."""
    out = rows.select(norm_name(F.col(name_col)).alias("name"), norm_id(F.col(id_col).cast("string")).alias("entity_id"))
    return out.where((F.col("name") != "") & (F.col("entity_id") != "")).distinct()


def listed_name_rows(rows: DataFrame, id_col: str, names: Column) -> DataFrame:
    """Distinct (name, entity_id) from an array of names per row."""
    out = rows.select(norm_id(F.col(id_col).cast("string")).alias("entity_id"), F.explode(names).alias("name"))
    return out.where(F.col("entity_id") != "").select("name", "entity_id").distinct()


def name_lookup(*sources: DataFrame) -> DataFrame:
    """Merged name lookup, one row per distinct (name, entity_id) with the number of ids of the name.

    Rows instead of one id list per name: a name shared by a third of all entities stays spread out.
    """
    merged = sources[0]
    for other in sources[1:]:
        merged = merged.unionByName(other)
    merged = merged.distinct()
    sizes = merged.groupBy("name").agg(F.count("*").alias("n_ids"))
    return merged.join(sizes, "name")


def unique_names(*sources: DataFrame) -> DataFrame:
    """(name, entity_id) of the names that stand for exactly one id: min equals max."""
    merged = sources[0]
    for other in sources[1:]:
        merged = merged.unionByName(other)
    per_name = merged.groupBy("name").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("_hi"))
    return per_name.where(F.col("entity_id") == F.col("_hi")).drop("_hi")


def known_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct ids of both registries with one availability flag each."""
    tagged = a.select("entity_id", F.lit(True).alias("in_a"), F.lit(False).alias("in_b")).unionByName(
        b.select("entity_id", F.lit(False).alias("in_a"), F.lit(True).alias("in_b"))
    )
    return tagged.groupBy("entity_id").agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))


# ---- matching ---------------------------------------------------------------------------------


def _spread_key(key: Column, columns: Sequence[str]) -> Column:
    """The join key, or a value that matches nothing where it is absent.

    Most rows have no corrected id and no name. As NULL or '' they would all hash to one partition of
    the outer join; a row hash behind a control character spreads them.
    """
    return F.coalesce(key, F.concat(F.lit(chr(1)), F.xxhash64(*columns).cast("string")))


def _attach(samples: DataFrame, known: DataFrame, on: str, prefix: str) -> DataFrame:
    side = known.select(
        F.col("entity_id").alias("_key"),
        F.lit(True).alias(f"{prefix}_hit"),
        F.col("in_a").alias(f"{prefix}_in_a"),
        F.col("in_b").alias(f"{prefix}_in_b"),
    )
    keyed = samples.withColumn("_key", _spread_key(F.col(on), samples.columns))
    return keyed.join(side, "_key", "left").drop("_key")


def match_id(samples: DataFrame, known: DataFrame) -> DataFrame:
    """Samples (with raw_id) plus `id_hit`, `id_in_a`, `id_in_b` of a direct match."""
    return _attach(samples.withColumn("norm_id", norm_id(F.col("raw_id"))), known, "norm_id", "id")


def match_ocr(samples: DataFrame, known: DataFrame) -> DataFrame:
    """Samples (with norm_id) plus the match of the id with look-alike letters read as digits."""
    fixed = digits_for_lookalikes(F.col("norm_id"))
    changed = samples.withColumn("ocr_id", F.when(fixed != F.col("norm_id"), fixed))
    return _attach(changed, known, "ocr_id", "ocr")


def match_unique_name(samples: DataFrame, names: DataFrame, known: DataFrame) -> DataFrame:
    """Samples (with candidate_name) plus the id of a name that stands for exactly one id.

    The availability flags are put on the names first, so the samples are joined once.
    """
    flags = known.select(F.col("entity_id").alias("name_id"), F.col("in_a").alias("name_in_a"), F.col("in_b").alias("name_in_b"))
    named = names.select(F.col("name").alias("_key"), F.col("entity_id").alias("name_id")).join(flags, "name_id", "left")
    present = F.when(F.col("candidate_name") != "", F.col("candidate_name"))
    keyed = samples.withColumn("_key", _spread_key(present, samples.columns))
    return keyed.join(named, "_key", "left").drop("_key")


def identity_lookup(known: DataFrame, names: DataFrame) -> DataFrame:
    """One table of all keys a sample may carry: ids, and unique names marked by `_named`.

    A name brings its id and that id's availability, so nothing is looked up after the match.
    """
    ids = known.select(F.lit(False).alias("_named"), F.col("entity_id").alias("_key"), "entity_id", "in_a", "in_b")
    named = names.join(known, "entity_id", "left").select(
        F.lit(True).alias("_named"), F.col("name").alias("_key"), "entity_id", "in_a", "in_b"
    )
    found = ids.unionByName(named).select("_named", "_key", F.struct("entity_id", "in_a", "in_b").alias("_found"))
    return found.where(F.col("_key").isNotNull())


def resolve_identity(samples: DataFrame, known: DataFrame, names: DataFrame) -> DataFrame:
    """Canonical id per sample by id, then corrected id, then unique name; NULL when none applies.

    A sample sends one row per key it has (always its id, the corrected id where that differs, a name that is
    not empty); these meet the lookup in one equi-join, and of the keys that hit the first wins by `min_by`.
    A hot id or name is split by the adaptive skew join, as is any large partition. Rows are put together
    again by all their columns (no map columns); repeated rows stay, by the number of ids sent.
    """
    norm = norm_id(F.col("raw_id"))
    fixed = digits_for_lookalikes(norm)
    name = F.col("candidate_name")

    def sent(rank: int, key: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), key.alias("key"))

    keys = F.array(sent(0, norm), F.when(fixed != norm, sent(1, fixed)), F.when(name != "", sent(2, name)))
    rows = samples.select(*samples.columns, F.explode(F.array_compact(keys)).alias("_sent"))
    rows = rows.select(
        *samples.columns, F.col("_sent.rank").alias("_rank"), (F.col("_sent.rank") == 2).alias("_named"),
        _spread_key(F.col("_sent.key"), samples.columns).alias("_key"),
    )
    met = rows.join(identity_lookup(known, names), ["_named", "_key"], "left")
    rank = F.when(F.col("_found.entity_id").isNotNull(), F.col("_rank"))
    best = met.groupBy(*samples.columns).agg(
        F.count_if(F.col("_rank") == 0).alias("_copies"), F.min(rank).alias("_best"), F.min_by("_found", rank).alias("_found")
    )
    by_name = F.col("_best") == 2
    resolved = best.select(
        *samples.columns,
        "_copies",
        F.col("_found.entity_id").alias("entity_id"),
        F.when(by_name, "name").when(F.col("_best") < 2, "patient_id").alias("matched_by"),
        F.when(by_name, name).otherwise("").alias("matched_name"),
        F.coalesce("_found.in_a", F.lit(False)).alias("in_a"),
        F.coalesce("_found.in_b", F.lit(False)).alias("in_b"),
        F.when(F.col("_best") == 1, F.concat(F.lit("normalized_from:"), norm)).otherwise("").alias("notes"),
    )
    return resolved.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")


def matched_rows(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("entity_id").isNotNull())


def excluded_rows(resolved: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Unmatched samples with reason; with a name lookup also how many ids the candidate name had."""
    out = resolved.where(F.col("entity_id").isNull()).drop(
        "entity_id", "matched_by", "matched_name", "in_a", "in_b", "notes"
    )
    out = out.withColumns({"reason_code": F.lit(NO_MATCH[0]), "reason": F.lit(NO_MATCH[1])})
    if names is None:
        return out
    sizes = names.groupBy(F.col("name").alias("candidate_name")).agg(F.count("*").alias("candidate_ids"))
    return out.join(sizes, "candidate_name", "left").fillna(0, ["candidate_ids"])


# ---- artefacts and issues ---------------------------------------------------------------------


def issue(rows: DataFrame, code: str, year: Column, entity: Column, path: Column) -> DataFrame:
    return rows.select(
        year.cast("string").alias("year"),
        F.coalesce(entity.cast("string"), F.lit("")).alias("entity_id"),
        F.lit(code).alias("code"),
        F.lit(ISSUES[code]).alias("message"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code").count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "code")


def issues_per_entity(issues: DataFrame) -> DataFrame:
    """Issues per year, entity and code with the first and the last of their paths.

    The paths themselves stay rows of the log: an entity may have any number of them. Text minima are found by sorting,
    so the log is written and dealt into tasks of about ISSUE_ROWS rows by its count, a large group in as many shares.
    """
    keys = ["year", "entity_id", "code"]
    rows = materialise(issues.select(*keys, "path"), "issues")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ISSUE_ROWS))
    share = F.pmod(F.xxhash64("path"), F.lit(parts)).alias("_share")
    dealt = rows.select("*", share).repartition(parts, *keys, "_share")
    some = dealt.groupBy(*keys, "_share").agg(
        F.count("*").alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    )
    return some.repartition(parts, *keys).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("first_path").alias("first_path"), F.max("last_path").alias("last_path")
    )


def first_in_sorted(images: DataFrame, entity: str = "entity_id", path: str = "path") -> DataFrame:
    """First path of each entity and whether there were several (no window: min and count combine)."""
    return images.groupBy(entity).agg(F.min(path).alias(path), (F.count("*") > 1).alias("several"))


def pair_artifacts(images: DataFrame, measures: DataFrame, on: str = "stem") -> tuple[DataFrame, DataFrame]:
    """Images with their same-stem measurement (of several the path that sorts first), and the images without one."""
    sides = measures.groupBy(on).agg(F.min("path").alias("measure_path"))
    joined = images.join(sides, on, "left")
    return joined.where(F.col("measure_path").isNotNull()), joined.where(F.col("measure_path").isNull()).drop(
        "measure_path"
    )


def orphan_artifacts(measures: DataFrame, images: DataFrame, on: str = "stem") -> DataFrame:
    return measures.join(images.select(on), on, "left_anti")


def front_view_gate(images: DataFrame, front: str) -> tuple[DataFrame, DataFrame]:
    """Front images of the entities that have a first front image, and the verdict per rejected entity.

    `images` has entity_id, view, sequence. The verdict is aggregated and joined back instead of a
    window over the entity.
    """
    is_front = F.col("view") == front
    verdict = images.groupBy("entity_id").agg(
        F.bool_or(is_front).alias("_front"), F.bool_or(is_front & (F.col("sequence") == 1)).alias("_first")
    )
    passed = images.where(is_front).join(verdict.where(F.col("_first")).select("entity_id"), "entity_id", "left_semi")
    rejected = verdict.where(~F.col("_first")).select(
        "entity_id",
        F.when(F.col("_front"), "missing_front_sequence_1").otherwise("missing_front_image").alias("code"),
    )
    return passed, rejected


def source_samples_flat(files: DataFrame, measures: DataFrame, year: str) -> tuple[DataFrame, DataFrame]:
    """Folder-per-entity layout: first sequence-1 image per folder with its same-stem measurement.

    `files` has entity_id, stem (upper case), path, sequence; returns samples and issues.
    """
    first_images = files.where(F.col("sequence") == 1)
    chosen = first_in_sorted(first_images)
    stems = first_images.select("entity_id", "path", "stem")
    chosen = chosen.join(stems, ["entity_id", "path"])
    paired, unpaired = pair_artifacts(chosen, measures)
    nothing = files.select("entity_id").distinct().join(first_images.select("entity_id"), "entity_id", "left_anti")
    y = F.lit(year)
    issues = (
        issue(nothing, "missing_sequence_1_image", y, F.col("entity_id"), F.lit(""))
        .unionByName(issue(chosen.where("several"), "multiple_sequence_1_images", y, F.col("entity_id"), F.col("path")))
        .unionByName(issue(unpaired, "missing_temperature_csv", y, F.col("entity_id"), F.col("path")))
    )
    samples = paired.select(
        y.alias("year"), "entity_id", F.lit(1).alias("sequence"), "path", "measure_path"
    )
    return samples, issues


def source_samples_views(images: DataFrame, measures: DataFrame, year: str, front: str) -> tuple[DataFrame, DataFrame]:
    """Flat layout with views: front images of the entities that pass the gate, with their measurement.

    `images` has stem, path, entity_id, view, sequence (NULL when unparseable); `measures` stem, path.
    """
    parsed = images.where(F.col("view").isNotNull() & F.col("sequence").isNotNull())
    unparsed = images.where(F.col("view").isNull() | F.col("sequence").isNull())
    passed, rejected = front_view_gate(parsed, front)
    paired, unpaired = pair_artifacts(passed, measures)
    orphans = orphan_artifacts(measures, images)
    y = F.lit(year)
    issues = (
        issue(unparsed, "unparseable_image_name", y, F.lit(""), F.col("path"))
        .unionByName(issue(unpaired, "missing_temperature_csv", y, F.col("entity_id"), F.col("path")))
        .unionByName(issue(orphans, "orphan_temperature_csv", y, F.lit(""), F.col("path")))
    )
    for code in ("missing_front_image", "missing_front_sequence_1"):
        issues = issues.unionByName(
            issue(rejected.where(F.col("code") == code), code, y, F.col("entity_id"), F.lit(""))
        )
    samples = paired.select(y.alias("year"), "entity_id", "sequence", "path", "measure_path")
    return samples, issues


# ---- roll-ups ---------------------------------------------------------------------------------


def entity_summary(rows: DataFrame, years: Sequence[int] = (2024, 2025)) -> DataFrame:
    """Per entity: samples, samples per year, sorted distinct match methods and source ids.

    Source ids are the distinct spellings of one id. Rows are counted per spelling first, so an entity's
    list is built from one row for each spelling, however many samples it has.
    """
    per_spelling = rows.groupBy("entity_id", "source_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("year") == y).alias(f"n_{y}") for y in years],
        F.collect_set("matched_by").alias("methods"),
    )
    return per_spelling.groupBy("entity_id").agg(
        F.sum("n").alias("sample_count"), *[F.sum(f"n_{y}").alias(f"n_{y}") for y in years],
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("methods")))), ";").alias("matched_by_values"),
        F.array_join(F.array_sort(F.collect_list("source_id")), ";").alias("source_ids"),
    )


def merge_sources(
    entities: DataFrame,
    a: DataFrame,
    b: DataFrame,
    preferred: Sequence[str],
    only_a: Sequence[str] = (),
    only_b: Sequence[str] = (),
    names: tuple[str, str] = ("clinical", "multimodal"),
) -> DataFrame:
    """Entities left-joined to both registries: per-column preference, source list, availability flags."""

    def side(df: DataFrame, tag: str, cols: Sequence[str]) -> DataFrame:
        return df.select(
            "entity_id", F.lit(True).alias(f"_{tag}"), *[F.col(c).alias(f"_{tag}_{c}") for c in cols]
        )

    rows = entities.join(side(a, "a", [*preferred, *only_a]), "entity_id", "left").join(
        side(b, "b", [*preferred, *only_b]), "entity_id", "left"
    )
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return rows.select(
        *entities.columns,
        (in_a | in_b).alias("has_basic_data"),
        F.concat_ws(";", F.when(in_a, names[0]), F.when(in_b, names[1])).alias("data_sources"),
        in_a.alias("in_a"),
        in_b.alias("in_b"),
        *[prefer(F.col(f"_a_{c}"), F.col(f"_b_{c}")).alias(c) for c in preferred],
        *[F.coalesce(f"_a_{c}", F.lit("")).alias(c) for c in only_a],
        *[F.coalesce(f"_b_{c}", F.lit("")).alias(c) for c in only_b],
    )


def coverage_diff(selected: DataFrame, registry: DataFrame) -> DataFrame:
    """(side, entity_id): selected without registry row, and registry without a selected sample."""
    s, r = selected.select("entity_id").distinct(), registry.select("entity_id").distinct()
    return s.join(r, "entity_id", "left_anti").select(F.lit("missing_registry").alias("side"), "entity_id").unionByName(
        r.join(s, "entity_id", "left_anti").select(F.lit("missing_sample").alias("side"), "entity_id")
    )


def enrich_with_status(features: DataFrame, registry: DataFrame) -> DataFrame:
    """Left join to the registry, unmatched rows kept and marked."""
    marked = registry.withColumn("_hit", F.lit(True))
    out = features.join(marked, "entity_id", "left")
    return out.withColumn("match_status", F.when(F.col("_hit"), "matched").otherwise("unmatched")).drop("_hit")


def filter_matched(df: DataFrame) -> DataFrame:
    return df.where(F.col("match_status") == "matched") if "match_status" in df.columns else df


def filter_eligible(
    manifest: DataFrame, splits: DataFrame, excluded: DataFrame, annotations: DataFrame
) -> DataFrame:
    """Manifest rows of split entities, not excluded, annotated with status ok; carries the split."""
    ok = annotations.where(F.col("status") == "ok").select("sample_id")
    in_split = splits.where(F.col("split").isin("train", "val", "test"))
    return (
        manifest.join(excluded.select("sample_id"), "sample_id", "left_anti")
        .join(ok, "sample_id", "left_semi")
        .join(in_split, "entity_id")
    )


def attrition_funnel(
    manifest: DataFrame, splits: DataFrame, excluded: DataFrame, annotations: DataFrame
) -> DataFrame:
    """Rows left after each stage in order, from one pass over flagged rows."""

    def flag(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(key).distinct().withColumn(name, F.lit(True))

    rows = (
        manifest.join(flag(excluded, "sample_id", "_ex"), "sample_id", "left")
        .join(flag(splits.where(F.col("split") != "unlabelled"), "entity_id", "_sp"), "entity_id", "left")
        .join(annotations.select("sample_id", F.col("status").alias("_state")), "sample_id", "left")
    )
    kept = F.lit(True)
    stages = []
    for name, cond in (
        ("all", F.lit(True)),
        ("not_excluded", F.col("_ex").isNull()),
        ("in_split", F.col("_sp").isNotNull()),
        ("annotated", F.col("_state").isNotNull()),
        ("status_ok", F.coalesce(F.col("_state") == "ok", F.lit(False))),
    ):
        kept = kept & cond
        stages.append(F.count_if(kept).alias(name))
    wide = rows.agg(*stages)
    names = [c for c in wide.columns]
    return wide.select(
        F.posexplode(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("n")) for n in names]))
    ).select(F.col("pos").alias("step"), "col.stage", "col.n")


def quality_distributions(included: DataFrame, excluded: DataFrame, summary: DataFrame, years: Sequence[int]) -> DataFrame:
    """(kind, value, n) histograms: samples per entity, year pattern, match method, exclusion reason."""
    pattern = F.concat_ws(",", *[F.concat(F.lit(f"{y}="), F.col(f"n_{y}").cast("string")) for y in years])

    def histogram(df: DataFrame, kind: str, value: Column) -> DataFrame:
        return df.groupBy(F.lit(kind).alias("kind"), value.cast("string").alias("value")).agg(F.count("*").alias("n"))

    return (
        histogram(summary, "samples_per_entity", F.col("sample_count"))
        .unionByName(histogram(summary, "year_pattern", pattern))
        .unionByName(histogram(included, "matched_by", F.col("matched_by")))
        .unionByName(histogram(excluded, "reason_code", F.col("reason_code")))
    )


def excluded_rollup(excluded: DataFrame) -> DataFrame:
    """Per excluded raw id: rows, first and last year, distinct years, reasons and candidate names.

    Years and reason codes come from small fixed sets, so the lists stay short.
    """
    return excluded.groupBy("raw_id").agg(
        F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_set(F.col("year").cast("string"))), ",").alias("years"),
        F.array_join(F.array_sort(F.collect_set("reason_code")), ";").alias("reasons"),
        F.max(F.when(F.col("candidate_name") != "", F.col("candidate_name"))).alias("candidate_name"),
    )


# ---- feature joins ----------------------------------------------------------------------------


def fusion_left(samples: DataFrame, entities: DataFrame, left_key: str, right_key: str, cols: Sequence[str]) -> DataFrame:
    """Samples with chosen entity columns; keys may differ in name and only the left one is kept."""
    side = entities.select(F.col(right_key).alias(left_key), *cols)
    return samples.join(side, left_key, "left")


def fusion_inner(a: DataFrame, b: DataFrame, key: str, b_cols: Sequence[str]) -> DataFrame:
    return a.join(b.select(key, *b_cols), key, "inner")


def structured_table(
    a: DataFrame | None, b: DataFrame | None, a_features: Sequence[str], b_features: Sequence[str]
) -> DataFrame:
    """Complete rows of one or both branches: (entity_id, label, severity, features)."""
    if not a_features and not b_features:
        raise ValueError("At least one branch must stay enabled.")
    base = ["entity_id", "label", "severity"]
    if a_features and b_features:
        rows = filter_matched(a).select(*base, *a_features).join(b.select("entity_id", *b_features), "entity_id")
    elif a_features:
        rows = filter_matched(a).select(*base, *a_features)
    else:
        rows = b.select(*base, *b_features)
    features = [*a_features, *b_features]
    numeric = {c: F.col(c).cast("string").try_cast("double") for c in ("label", "severity", *features)}
    return rows.withColumns(numeric).dropna(subset=["label", *features]).select(*base, *features)


def attach_entity_features(samples: DataFrame, entities: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every sample with its entity's features; a sample without them is an error at run time."""
    side = entities.select("entity_id", *features, F.lit(True).alias("_hit"))
    joined = samples.join(side, "entity_id", "left")
    message = F.concat(F.lit("Missing structured features for entity "), F.col("entity_id").cast("string"))
    guard = F.when(F.col("_hit"), F.col("entity_id")).otherwise(F.raise_error(message).cast(samples.schema["entity_id"].dataType))
    return joined.withColumn("entity_id", guard).drop("_hit")


def complete_case(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("entity_id").intersect(b.select("entity_id"))


def sample_metadata(samples: DataFrame, order_col: str) -> DataFrame:
    """sample_id to entity and year; the last row of a repeated sample wins."""
    return (
        samples.groupBy("sample_id")
        .agg(F.max_by(F.struct("entity_id", "year"), F.col(order_col)).alias("m"))
        .select("sample_id", "m.entity_id", "m.year")
    )
